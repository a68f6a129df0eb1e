"""Ordered-row operators without a global sort in one task: fill-down, serial numbers, batches, distinct in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.sources.scratch import settled

#: Buckets that even_buckets cuts a key into: COARSE runs of COARSE.
COARSE = 32


def even_buckets(df: DataFrame, key: str) -> Column:
    """Ranges of a numeric key with about as many rows each, by approximate quantiles, however the key is spread."""
    shares = [i / COARSE**2 for i in range(1, COARSE**2)]
    cuts = df.agg(F.percentile_approx(key, shares, 20 * COARSE**2)).first()[0] or []
    if not cuts:
        return F.lit(0)
    runs = F.array(*[F.array(*map(F.lit, cuts[i : i + COARSE])) for i in range(0, len(cuts), COARSE)])
    below = lambda values: F.size(F.filter(values, lambda c: c <= F.col(key)))
    first = F.size(F.filter(runs, lambda r: r[0] <= F.col(key)))
    return F.when(first == 0, 0).otherwise((first - 1) * COARSE + below(F.get(runs, first - 1)))


def _ranged(ends: DataFrame) -> DataFrame:
    """One row a bucket, dealt out in order: _part numbers the partitions, which order buckets as _bucket does."""
    return settled(ends.repartitionByRange("_bucket").withColumn("_part", F.spark_partition_id()))


def fill_down(df: DataFrame, cols: list[str], order: list[str], bucket: Column) -> DataFrame:
    """Each null of cols takes the last value above it in `order`.

    bucket must not fall as order rises (a file number, a range of keys): rows are ordered within buckets only, what a bucket
    ends with is carried on over the buckets of a partition, and what a partition ends with over the partitions.
    """
    df = df.withColumn("_bucket", bucket)
    ends = _ranged(df.groupBy("_bucket").agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in cols]))
    parts = ends.groupBy("_part").agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_bucket"))).alias(c) for c in cols])
    above = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = parts.select(F.col("_part").alias("_p"), *[F.last(c, ignorenulls=True).over(above).alias(f"_carried_{c}") for c in cols])
    inside = Window.partitionBy("_part").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.join(F.broadcast(parts), F.col("_part") == F.col("_p"))
    carried = carried.select(F.col("_bucket").alias("_of"), *[F.coalesce(F.last(c, ignorenulls=True).over(inside), f"_carried_{c}").alias(f"_from_{c}") for c in cols])
    within = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(carried, F.col("_bucket").eqNullSafe(F.col("_of")))
    for c in cols:
        joined = joined.withColumn(c, F.coalesce(F.last(c, ignorenulls=True).over(within), f"_from_{c}"))
    return joined.drop("_bucket", "_of", *[f"_from_{c}" for c in cols])


def totals_before(df: DataFrame, count: str, name: str, order: list[str]) -> DataFrame:
    """df with `name`: the total of `count` over all rows before in `order`, without a task that sees all rows."""
    ranged = settled(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy("_part").agg(F.sum(count).alias("_n"))
    parts = parts.select(F.col("_part").alias("_p"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a partition
    own = F.sum(count).over(Window.partitionBy("_part").orderBy(*order)) - F.col(count)
    return ranged.join(F.broadcast(parts), F.col("_part") == F.col("_p")).withColumn(name, F.col("_before") + own).drop("_part", "_p", "_before")


def serial(df: DataFrame, name: str, order: list[str], bucket: Column) -> DataFrame:
    """df with 1, 2, 3 ... in `order`; bucket as in fill_down."""
    df = df.withColumn("_bucket", bucket)
    starts = totals_before(df.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")), "_n", "_start", ["_bucket"]).select("_bucket", "_start")
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return df.join(starts, "_bucket").withColumn(name, F.col("_start") + within).drop("_bucket", "_start")


def batches(df: DataFrame, position: str, size: int) -> DataFrame:
    """df with batch_id B%06d: runs of `size` rows by a 1-based position."""
    return df.withColumn("batch_id", F.format_string("B%06d", F.floor((F.col(position) - 1) / size) + 1))


def distinct_in_order(df: DataFrame, cols: list[str], order: str) -> DataFrame:
    """Distinct rows of cols with the least order value at which each occurs."""
    return df.groupBy(*cols).agg(F.min(order).alias(order))


def unpivot_filled(df: DataFrame, ids: list[str], cols: list[str], key: str, value: str) -> DataFrame:
    """Long form of cols, empty values left out."""
    return df.unpivot(ids, cols, key, value).where(F.coalesce(F.col(value), F.lit("")) != "")


def last_write_wins(df: DataFrame, keys: list[str], priority: str, position: str) -> DataFrame:
    """Of the rows of a key, the one of the highest priority, at the first position of the key."""
    rest = [c for c in df.columns if c not in (*keys, priority, position)]
    got = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(priority, position)).alias("_x"), F.min(position).alias(position))
    return got.select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest], position)


def overlay(df: DataFrame, over: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Non-null cols of over replace those of df by key."""
    slim = over.select(*keys, *[F.col(c).alias(f"_{c}") for c in cols])
    out = df.join(slim, keys, "left")
    for c in cols:
        out = out.withColumn(c, F.coalesce(f"_{c}", c))
    return out.drop(*[f"_{c}" for c in cols])
