"""Window specs and null-aware column expressions.

A panel is keyed by (ticker, date) with a calendar date, so one ticker window holds at most one row per calendar
day: its size is bounded by the calendar, however many raw rows the ticker had. Windows over one *date* have no
such bound and are never used here; see ``operators.ordered``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPS = 1e-9


SERIES = "PARTITION BY ticker ORDER BY date"


def c(x) -> Column:
    """A column from a name; columns pass through."""
    return F.col(x) if isinstance(x, str) else x


def by_ticker(start: int | None = None, end: int | None = None):
    """One time series per ticker, optionally with a row frame."""
    w = Window.partitionBy("ticker").orderBy("date")
    if start is None and end is None:
        return w
    lo = Window.unboundedPreceding if start is None else start
    hi = Window.unboundedFollowing if end is None else end
    return w.rowsBetween(lo, hi)


def trailing(n: int):
    return by_ticker(-(n - 1), 0)


def rolling(fn: str, x: str, n: int, need: int | None = None) -> Column:
    """Aggregate ``fn`` of ``x`` over the last ``n`` rows; null until ``need`` (default ``n``) values are present.

    Written as SQL text: a wide feature block has hundreds of these, and one parsed string costs one call into the JVM.
    """
    w = f"OVER ({SERIES} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    call = fn.replace("?", x) if "?" in fn else f"{fn}({x})"
    return F.expr(f"CASE WHEN count({x}) {w} >= {n if need is None else need} THEN {call} {w} END")


def rmean(x, n, need=None):
    return rolling("avg", x, n, need)


def rsum(x, n, need=None):
    return rolling("sum", x, n, need)


def rmin(x, n, need=None):
    return rolling("min", x, n, need)


def rmax(x, n, need=None):
    return rolling("max", x, n, need)


def rstd(x, n, need=None):
    return rolling("stddev_samp", x, n, need)


def rstdp(x, n, need=None):
    return rolling("stddev_pop", x, n, need)


def rquantile(x, n, q, need=None):
    return rolling(f"percentile(?, {q})", x, n, need)


def lag(x: str, n: int = 1) -> Column:
    return F.expr(f"lag({x}, {n}) OVER ({SERIES})")


def lead(x: str, n: int = 1) -> Column:
    return F.expr(f"lead({x}, {n}) OVER ({SERIES})")


def diff(x: str, n: int = 1) -> Column:
    return F.expr(f"{x} - lag({x}, {n}) OVER ({SERIES})")


def ratio(a, b) -> Column:
    """a / b, null when b is 0 or either side is null."""
    if isinstance(a, str) and isinstance(b, str):
        return F.expr(f"try_divide({a}, {b})")
    return F.try_divide(c(a), c(b))


def sdiv(a, b) -> Column:
    """a / (b + 1e-9): the small constant keeps flat bars finite."""
    if isinstance(a, str) and isinstance(b, str):
        return F.expr(f"try_divide({a}, ({b}) + 1e-9D)")
    return F.try_divide(c(a), c(b) + F.lit(EPS))


def change(x: str, n: int = 1) -> Column:
    return F.expr(f"try_divide({x}, lag({x}, {n}) OVER ({SERIES})) - 1")


def clip(x, lo: float, hi: float) -> Column:
    x = c(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def flag(cond: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is null."""
    return F.when(cond, 1).otherwise(0).cast("int")


def zroll(x: str, n: int, need: int | None = None) -> Column:
    """Rolling z-score against the population deviation of the window."""
    need = max(5, n // 3) if need is None else need
    return ratio(c(x) - rmean(x, n, need), rstdp(x, n, need))


def ffill(x: str) -> Column:
    return F.expr(f"last_value(nanvl({x}, NULL)) IGNORE NULLS OVER ({SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")


def bfill(x: str) -> Column:
    """The next value, carried back: a running last value over the series read backwards, so the cost is linear."""
    return F.expr(f"last_value(nanvl({x}, NULL)) IGNORE NULLS OVER (PARTITION BY ticker ORDER BY date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")


def drop_temps(df: DataFrame) -> DataFrame:
    """Drop the working columns, whose names start with an underscore."""
    return df.select(*[k for k in df.columns if not k.startswith("_")])
