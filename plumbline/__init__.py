"""Model-reliability and data-quality analytics on Spark DataFrames."""
