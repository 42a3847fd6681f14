"""Threshold grids and probability-bin edges, bit-equal to evenly spaced floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.scalars import count_reached

# Grids of thresholds and the default threshold of each model.
SWEEP_THRESHOLDS = [round(0.10 + 0.05 * i, 2) for i in range(17)]
DEFAULT_THRESHOLDS = {"logistic_regression": 0.50, "random_forest": 0.25}
FALLBACK_THRESHOLD = 0.5
TUNED_THRESHOLD = 0.25


def evenly_spaced(start: float, stop: float, count: int) -> list[float]:
    step = (stop - start) / (count - 1)
    return [start + i * step for i in range(count - 1)] + [stop]


MITIGATION_THRESHOLDS = evenly_spaced(0.05, 0.9, 18)


def bin_edges(bins: int) -> list[float]:
    return evenly_spaced(0.0, 1.0, bins + 1)


def calibration_bin(probability: Column, bins: int = 10, edges: str = "closed0") -> Column:
    """Number (from 1) of the equal-width bin of a probability.

    ``closed0``: (l, u] and the first bin also holds 0. ``open0``: (l, u], 0 is in no bin
    (NULL). ``left``: [l, u) and the last bin also holds 1.
    """
    inner = bin_edges(bins)[1:-1]
    if edges == "left":
        return count_reached(probability, inner) + 1
    number = count_reached(probability, inner, inclusive=False) + 1
    if edges == "closed0":
        return number
    if edges == "open0":
        return F.when(probability > 0.0, number)
    raise ValueError(f"unknown edge rule: {edges}")
