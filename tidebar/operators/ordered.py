"""Order statistics over groups of any size.

A rank, a running total by score or an exact quantile needs a group in order. A window over the group would put it in
one task, so a date or class holding a third of the rows would not fit. Here equal values are combined first, the
distinct values are range-partitioned over the cluster, each slice is totalled, and the totals of the slices before it
are added. The work is spread evenly whatever the group sizes; only one row per (group, slice) is summed serially.

Range bounds are sampled, so the placed rows are checkpointed before they are read twice. The checkpoint also cuts the
lineage, and it is reliable storage, so losing an executor does not lose the placement.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import c


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the session names; a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="tidebar-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def pinned(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder: fixed placement, short lineage, safe against lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def unpinned(df: DataFrame) -> None:
    """Delete the rows of a pinned frame that nothing reads any more, such as those a model has been fitted on."""
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def drop_unused(spark: SparkSession) -> None:
    """Let Spark delete shuffle files and persisted blocks that no frame refers to any more. It does so when the driver collects
    garbage, which a driver with little to do may put off until the disks are full."""
    spark._jvm.System.gc()


def running_totals(df: DataFrame, by: list[str], order: list[Column | str], sums: dict[str, Column],
                   keep: list[str] | None = None, unique: bool = False) -> DataFrame:
    """Per distinct (by, order keys) row: its own totals, ``<name>_before``, the totals of all rows ordered earlier in the
    group, and ``<name>_total``, the totals of the whole group.

    ``order`` takes column names or sort columns named in ``keep``. With ``unique`` the rows are already distinct and
    are not combined.
    """
    names = [o for o in order if isinstance(o, str)] if keep is None else keep
    alone = not by
    if alone:
        df, by = df.withColumn("_all", F.lit(0)), ["_all"]
    small = df.withColumns(sums) if unique else df.groupBy(*by, *names).agg(*[v.alias(k) for k, v in sums.items()])
    placed = pinned(small.repartitionByRange(*[F.col(b) for b in by], *[c(o) for o in order])
                    .withColumn("_slice", F.spark_partition_id()))
    slices = placed.groupBy(*by, "_slice").agg(*[F.sum(k).alias(f"_{k}_own") for k in sums])
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(
        *by, "_slice",
        *[F.coalesce(F.sum(f"_{k}_own").over(earlier), F.lit(0)).alias(f"_{k}_off") for k in sums],
        *[F.sum(f"_{k}_own").over(Window.partitionBy(*by)).alias(f"{k}_total") for k in sums],
    )
    inner = Window.partitionBy(*by, "_slice").orderBy(*[c(o) for o in order]).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(slices, [*by, "_slice"])
    out = out.withColumns({f"{k}_before": F.col(f"_{k}_off") + F.coalesce(F.sum(k).over(inner), F.lit(0)) for k in sums})
    return out.drop("_slice", *[f"_{k}_off" for k in sums], *(["_all"] if alone else []))


#: Most frequent values whose ranks are broadcast, and rows that make a value frequent.
HOT_VALUES, HOT_ROWS = 1000, 50_000


def add_ranks(df: DataFrame, by: list[str], value: str, descending: bool = True, prefix: str = "") -> DataFrame:
    """Add dense, first and average rank of ``value`` inside each group; null values stay unranked.

    Ranks are found per distinct value. The most frequent values, at most ``HOT_VALUES``, hand them out by a broadcast, so that
    rows which share one value stay where they are; the rows of all others meet theirs in a shuffle.
    """
    some = df.where(F.col(value).isNotNull())
    order = F.col(value).desc() if descending else F.col(value).asc()
    tot = running_totals(some, by, [order], {"_n": F.count(F.lit(1)), "_d": F.max(F.lit(1))}, keep=[value])
    names = [f"{prefix}dense_rank", f"{prefix}first_rank", f"{prefix}average_rank"]
    first = F.col("_n_before") + 1
    ranks = tot.select(*by, value, "_n", (F.col("_d_before") + 1).alias(names[0]), first.alias(names[1]), (F.col("_n_before") + (F.col("_n") + 1) / 2).alias(names[2]))
    hot = pinned(ranks.where(F.col("_n") >= HOT_ROWS).orderBy(F.desc("_n"), *by, value).limit(HOT_VALUES).drop("_n"))
    hot = F.broadcast(hot.withColumnsRenamed({k: f"_hot_{k}" for k in names}))
    d = df.join(hot, [*by, value], "left")
    # A row with a hot value looks up a number of its own instead, which spreads such rows; what it may find there is not used.
    spread = F.xxhash64(*df.columns).cast(df.schema[value].dataType)
    d = d.withColumn("_key", F.when(F.col(f"_hot_{names[0]}").isNull(), F.col(value)).otherwise(spread))
    d = d.join(ranks.drop("_n").withColumnRenamed(value, "_key"), [*by, "_key"], "left")
    return d.select(*df.columns, *[F.coalesce(f"_hot_{k}", k).alias(k) for k in names])


#: Groups up to so many rows are ordered whole; the sketches of larger ones err by one in ACCURACY rows.
SMALL_GROUP, ACCURACY, FEW_GROUPS = 10_000, 10_000, 100_000


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float], pin: bool = True) -> DataFrame:
    """Linearly interpolated quantiles per group, one row per group. With ``pin`` the values are checkpointed, as they are read
    more than once; a frame that is pinned already needs none. A counting job runs when this is called.

    A group of up to ``SMALL_GROUP`` rows is one exact aggregate. In larger ones mergeable sketches give each quantile a bracket
    that must hold it; rows outside are only counted, and the distinct values inside, a few in ten thousand, are put in order.
    No row is shuffled for that, whatever the size of a group.
    """
    keys = by or ["_all"]
    some = df.where(F.col(value).isNotNull()).select(*by, value)
    some = some if by else some.withColumn("_all", F.lit(0))
    some = pinned(some) if pin else some
    sizes = pinned(some.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")))
    groups, most, least = sizes.agg(F.count(F.lit(1)), F.max("_size"), F.min("_size")).first()
    large, small = (most or 0) > SMALL_GROUP, (least or 0) <= SMALL_GROUP
    if large and small:
        some = some.join(F.broadcast(sizes) if groups <= FEW_GROUPS else sizes, keys)
    parts = []
    if small:
        own = some.where(F.col("_size") <= SMALL_GROUP) if large else some
        parts.append(own.groupBy(*keys).agg(*[F.percentile(value, F.lit(p)).alias(k) for k, p in probs.items()]).select(*by, *probs))
    if large:
        parts.append(_bracketed(some.where(F.col("_size") > SMALL_GROUP) if small else some, keys, value, probs, groups).select(*by, *probs))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _bracketed(some: DataFrame, keys: list[str], value: str, probs: dict[str, float], groups: int) -> DataFrame:
    """Quantiles of groups that are larger than the error of their sketches."""
    eps = 4 / ACCURACY
    ends = [x for p in probs.values() for x in (max(p - eps, 0.0), min(p + eps, 1.0))]
    near = F.percentile_approx(value, F.array(*[F.lit(x) for x in ends]), ACCURACY).alias("_ends")
    sketches = pinned(some.groupBy(*keys).agg(near, F.count(F.lit(1)).alias("_total"), F.min(value).alias("_min"), F.max(value).alias("_max")))
    d = some.join(F.broadcast(sketches) if groups <= FEW_GROUPS else sketches, keys)
    v = F.col(value)
    low = [F.col("_min") if x == 0.0 else F.col("_ends")[2 * i] for i, x in enumerate(ends[::2])]
    high = [F.col("_max") if x == 1.0 else F.col("_ends")[2 * i + 1] for i, x in enumerate(ends[1::2])]
    inside = F.lit(False)
    for lo, hi in zip(low, high):
        inside = inside | ((v >= lo) & (v <= hi))
    under = [F.when(hi < v, hi) for hi in high]
    # Rows between two brackets count as one value that follows all of the lower bracket.
    place = F.when(inside, v).otherwise(F.greatest(*under) if len(under) > 1 else under[0])
    d = d.select(*keys, "_total", place.alias("_v"), F.when(inside, 0).otherwise(1).alias("_out"))
    tot = running_totals(d, [*keys, "_total"], ["_v", "_out"], {"_n": F.count(F.lit(1))})
    first, after = F.col("_n_before"), F.col("_n_before") + F.col("_n")
    found = F.when(F.col("_out") == 0, F.col("_v")).otherwise(F.raise_error(F.lit("a quantile lies outside its bracket")))
    aggs, cols = [], []
    for name, p in probs.items():
        at = (F.col("_total") - 1) * F.lit(p)
        for tag, k in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            aggs.append(F.max(F.when((first <= k) & (k < after), found)).alias(f"_{name}_{tag}"))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        cols.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return tot.groupBy(*keys, "_total").agg(*aggs).select(*keys, *cols)
