"""SQL text for classification metrics, written from their definitions."""

from __future__ import annotations

from collections.abc import Sequence

from plumbline.functions.grids import bin_edges
from plumbline.plans.views import r


def bin_sql(p: str = "y_prob", edges: str = "closed0", bins: int = 10) -> str:
    inner = bin_edges(bins)[1:-1]
    sign = ">=" if edges == "left" else ">"
    number = "1 + " + " + ".join(f"cast({p} {sign} {e!r}e0 as int)" for e in inner)
    return f"case when {p} > 0 then {number} end" if edges == "open0" else number


def metrics_sql(
    name: str,
    source: str,
    keys: Sequence[str],
    threshold: str = "0.25e0",
    edges: str = "closed0",
    one_class_ap: str | None = "0e0",
    min_rows: int = 0,
    guess: str | None = None,
) -> str:
    """CTEs ending in one called ``name`` with the keys and all metrics, unrounded."""
    k = ", ".join(keys)
    hit = guess or f"y_prob >= {threshold}"
    ap = "case when auc is not null then ap end" if one_class_ap is None else f"coalesce(ap, {one_class_ap})"
    return f"""
{name}_c as (
  select {k}, count(*) as n, count(*) filter (where {hit} and y_true = 1) as tp,
         count(*) filter (where not ({hit}) and y_true = 0) as tn, count(*) filter (where {hit} and y_true = 0) as fp,
         count(*) filter (where not ({hit}) and y_true = 1) as fn, avg((y_prob - y_true) * (y_prob - y_true)) as brier
  from {source} group by {k} having count(*) >= {min_rows}),
{name}_b as (
  select {k}, {bin_sql(edges=edges)} as bin, count(*) as n, abs(sum(y_true) - sum(y_prob)) as g
  from {source} group by {k}, bin),
{name}_e as (select {k}, coalesce(sum(g) filter (where bin is not null), 0) / sum(n) as ece from {name}_b group by {k}),
{name}_s as (
  select {k}, y_prob as s, sum(y_true) as pos, count(*) - sum(y_true) as neg from {source} group by {k}, y_prob),
{name}_r as (
  select *, sum(pos) over (partition by {k} order by s desc) as tpc, sum(neg) over (partition by {k} order by s desc) as fpc,
         sum(pos) over (partition by {k}) as np, sum(neg) over (partition by {k}) as nn from {name}_s),
{name}_a as (
  select {k}, sum(cast(pos as double) / nullif(np, 0) * tpc / (tpc + fpc)) as ap,
         sum(cast(neg as double) * (tpc - pos / 2e0)) / nullif(max(cast(np as double) * nn), 0) as auc
  from {name}_r group by {k}),
{name} as (
  select {k}, n as rows, tp as true_positive, tn as true_negative, fp as false_positive, fn as false_negative,
         (tp + fn) * 1e0 / n as positive_rate_true, (tp + fp) * 1e0 / n as positive_rate_predicted,
         (tp + tn) * 1e0 / n as accuracy, 1e0 - (tp + tn) * 1e0 / n as error_rate,
         coalesce(tp * 1e0 / nullif(tp + fp, 0), 0) as "precision", coalesce(tp * 1e0 / nullif(tp + fn, 0), 0) as recall,
         tn * 1e0 / nullif(tn + fp, 0) as specificity, fp * 1e0 / nullif(fp + tn, 0) as false_positive_rate,
         fn * 1e0 / nullif(fn + tp, 0) as false_negative_rate, tn * 1e0 / nullif(tn + fn, 0) as negative_predictive_value,
         coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1,
         case when tp + fn = 0 then tn * 1e0 / nullif(tn + fp, 0) when tn + fp = 0 then tp * 1e0 / (tp + fn)
              else (tp * 1e0 / (tp + fn) + tn * 1e0 / (tn + fp)) / 2 end as balanced_accuracy,
         {ap} as pr_auc, brier as brier_score, ece, auc as roc_auc
  from {name}_c join {name}_e using ({k}) join {name}_a using ({k}))"""


COUNTS = ["rows", "true_positive", "true_negative", "false_positive", "false_negative"]


def pick(names: Sequence[str]) -> str:
    """Select list: counts as whole numbers, everything else rounded."""
    cells = []
    for n in names:
        plain, alias = f'"{n}"', f'"{n}"'
        cells.append(f"cast({plain} as bigint) as {alias}" if n in COUNTS else f"{r(plain)} as {alias}")
    return ", ".join(cells)


def long_groups_sql(name: str, source: str, features: Sequence[str], keep: str) -> str:
    """CTE with one row per record and group column."""
    parts = " union all ".join(
        f"select {keep}, '{f}' as subgroup_feature, coalesce(cast({f} as varchar), '__NULL__') as subgroup_value from {source}"
        for f in features
    )
    return f"{name} as ({parts})"


def sweep_sql(name: str, source: str, keys: Sequence[str], thresholds: Sequence[float], fixed: str | None) -> str:
    """CTEs with metrics per key and threshold; ``fixed`` names the CTE of threshold-free metrics."""
    k = ", ".join(keys)
    values = ", ".join(f"({t!r}e0)" for t in thresholds)
    kt = f"{k}, threshold" if k else "threshold"
    extra = f", pr_auc, brier_score, ece, roc_auc from {name}_c join {fixed} using ({k})" if fixed else f" from {name}_c"
    return f"""
{name}_t as (select * from (values {values}) t(threshold)),
{name}_c as (
  select {kt}, count(*) as rows, count(*) filter (where y_prob >= threshold and y_true = 1) as tp,
         count(*) filter (where y_prob >= threshold and y_true = 0) as fp,
         count(*) filter (where y_prob < threshold and y_true = 1) as fn,
         count(*) filter (where y_prob < threshold and y_true = 0) as tn
  from {source}, {name}_t group by {kt}),
{name} as (
  select {kt}, {name}_c.rows, (tp + fn) * 1e0 / {name}_c.rows as positive_rate_true,
         (tp + fp) * 1e0 / {name}_c.rows as positive_rate_predicted,
         coalesce(tp * 1e0 / nullif(tp + fp, 0), 0) as "precision", coalesce(tp * 1e0 / nullif(tp + fn, 0), 0) as recall,
         coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1, tp, fp, fn, tn{extra})"""
