"""Query registry: a Spark callable and, where SQL can say it, the statement that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, tuple[list[str], str]] = {}


def query(key: str, oracle: str | None = None):
    def add(fn):
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn

    return add


def cte(name: str, deps: str, body: str) -> None:
    CTES[name] = (deps.split(), body)


def with_(targets: str, body: str) -> str:
    """Prefix a statement with the named common table expressions it needs, in dependency order."""
    done: list[str] = []

    def visit(n):
        if n in done:
            return
        for d in CTES[n][0]:
            visit(d)
        done.append(n)

    for t in targets.split():
        visit(t)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in done) + "\n" + body


def nudge(nd: int) -> float:
    """Prices are short decimals, so means and differences often fall exactly between two rounded values, where the last bit
    of a sum decides. Both engines add the same small share of the last digit first, which settles those ties alike."""
    return 3.7e-4 * 10.0 ** -nd if nd < 8 else 0.0


def sr(expr: str, nd: int = 6) -> str:
    """SQL side of the output rounding. Adding zero turns -0.0 into 0.0."""
    return f"round(CAST({expr} AS DOUBLE) + {nudge(nd)!r}::DOUBLE, {nd}) + 0.0"


def shown(df: DataFrame, nd: int | dict[str, int] = 6) -> DataFrame:
    """Spark side: dates as text, whole numbers as long, doubles rounded."""
    cols = []
    for f in df.schema.fields:
        x = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            digits = nd.get(f.name, nd.get("*", 6)) if isinstance(nd, dict) else nd
            x = F.round(x.cast("double") + F.lit(nudge(digits)), digits) + F.lit(0.0)
        elif isinstance(f.dataType, T.DateType):
            x = F.date_format(x, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.BooleanType)):
            x = x.cast("long")
        cols.append(x.alias(f.name))
    return df.select(*cols)


def panel_sql(src: str, cols: str, nd: int | dict[str, int] = 6, ints: str = "") -> str:
    parts = ["ticker", "strftime(date, '%Y-%m-%d') AS date"]
    for k in cols.split():
        digits = nd.get(k, nd.get("*", 6)) if isinstance(nd, dict) else nd
        parts.append(f"{sr(k, digits)} AS {k}")
    parts += [f"CAST({k} AS BIGINT) AS {k}" for k in ints.split()]
    return with_(src, f"SELECT {', '.join(parts)} FROM {src.split()[-1]}")


def panel_query(key: str, fn, src: str, cols: str, nd: int | dict[str, int] = 6, ints: str = "") -> None:
    """A query that shows some columns of a panel operator row by row."""
    from ..sources.bars import bars

    names = cols.split() + ints.split()

    def run(spark, sf_dir):
        return shown(fn(bars(spark, sf_dir)).select("ticker", "date", *names), nd)

    QUERIES[key] = run
    ORACLES[key] = panel_sql(src, cols, nd, ints)
