"""Exponentially weighted means as window sums inside the JVM, nulls inside the series included.

The series starts at its first value. A value that comes g rows after the last one before it gives
``y = r * y_before + (1 - r) * x`` with ``r = (1-a)**g / ((1-a)**g + a)``, which is the plain recursion for g = 1; a null row
repeats the last mean.

Inside a block of rows this is a running sum of ``(1 - r_i) * x_i / R_i``, scaled by ``R_t``, the running product of r.
Blocks keep the products finite. The mean that enters a block is folded from the ends of the blocks before it and counts
``R_t`` times.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import SERIES


def span(n: float) -> float:
    return 2.0 / (n + 1.0)


def ewm(df: DataFrame, specs: dict[str, tuple[str, float]], min_periods: dict[str, int] | None = None,
        block: int | None = None) -> DataFrame:
    """Add one column per ``out: (column, alpha)``; all columns share the same two extra window passes."""
    need = min_periods or {}
    size = block or min(512, int(260 / -math.log10(1 - max(a for _, a in specs.values()))))
    series = f"OVER ({SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND %s)"
    values = sorted({x for x, _ in specs.values()})
    d = df.withColumn("_ew_row", F.expr(f"row_number() OVER ({SERIES}) - 1"))
    d = d.withColumns({"_ew_pos": F.expr(f"_ew_row % {size}"), "_ew_blk": F.expr(f"_ew_row div {size}"), **{
        f"_ew_last{i}": F.expr(f"last_value(CASE WHEN {x} IS NOT NULL THEN _ew_row END) IGNORE NULLS {series % '1 PRECEDING'}") for i, x in enumerate(values)}, **{
        f"_ew_n{i}": F.expr(f"count({x}) {series % 'CURRENT ROW'}") for i, x in enumerate(values)}})
    kept = {}
    for k, (x, a) in specs.items():
        last = f"_ew_last{values.index(x)}"
        faded = f"power({1 - a!r}D, _ew_row - {last})"
        kept[f"_ew_r_{k}"] = F.expr(f"CASE WHEN {x} IS NOT NULL AND {last} IS NOT NULL THEN greatest({faded} / ({faded} + {a!r}D), 1e-17D) END")
    d = d.withColumns(kept)
    inside = "OVER (PARTITION BY ticker, _ew_blk ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    d = d.withColumns({f"_ew_p_{k}": F.expr(f"exp(coalesce(sum(ln(_ew_r_{k})) {inside}, 0D))") for k in specs})
    d = d.withColumns({f"_ew_s_{k}": F.expr(f"coalesce(sum({x} * (1D - coalesce(_ew_r_{k}, 0D)) / _ew_p_{k}) {inside} * _ew_p_{k}, 0D)") for k, (x, _) in specs.items()})
    ends = ", ".join(f"'s_{k}', _ew_s_{k}, 'p_{k}', _ew_p_{k}" for k in specs)
    d = d.withColumn("_ew_ends", F.expr(f"collect_list(CASE WHEN _ew_pos = {size - 1} THEN named_struct({ends}) END) {series % '1 PRECEDING'}"))
    result = {}
    for k, (x, _) in specs.items():
        entering = f"aggregate(_ew_ends, 0D, (y, e) -> e.s_{k} + e.p_{k} * y)"
        result[k] = F.expr(f"CASE WHEN _ew_n{values.index(x)} >= {max(1, need.get(k, 1))} THEN _ew_s_{k} + _ew_p_{k} * {entering} END")
    d = d.withColumns(result)
    return d.drop(*[k for k in d.columns if k.startswith("_ew_")])
