"""Incremental processing: micro-batches staged idempotently, with a cursor that moves on only past batches that passed."""

from __future__ import annotations

from collections.abc import Callable
from threading import Event

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.rows import batches
from weftline.sources.files import replace_batch
from weftline.streaming.carried import Carried


def stage(rows: DataFrame, path: str, batch_no: int) -> None:
    """Write one batch in place of an earlier try at it; stage_seq keeps batches in the order of their numbers."""
    replace_batch(rows.withColumn("batch_id", F.format_string("B%06d", F.lit(batch_no))).withColumn("stage_seq", F.lit(batch_no)), path)


def run_stream(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | Carried, files_a_batch: int = 1, max_batches: int | None = None, passes: Callable[[DataFrame], bool] | None = None) -> int:
    """Process the files of a folder that earlier runs haven't, batch by batch; a batch that is replayed replaces itself.

    The stream's checkpoint is the cursor: it moves when a batch has been staged and `passes`, if given, is true of it; a batch
    that fails is tried again by the next run. Returns the number of batches that passed. With max_batches the query is
    stopped from outside after so many; what it may have begun by then isn't staged and is left to the next run. A Carried
    transform also takes over what earlier batches left: values filled down, the last number given out.
    """
    done: list[int] = []
    enough = Event()

    def one(frame: DataFrame, number: int) -> None:
        if enough.is_set():
            raise Halted
        made = transform(frame, number) if isinstance(transform, Carried) else transform(frame)
        stage(made, out, number + 1)
        if passes is not None and not passes(made):
            enough.set()
            raise Halted
        done.append(number)
        if max_batches is not None and len(done) >= max_batches:
            enough.set()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException:
        # the only failure that is meant is the one that one() raises itself
        if not enough.is_set():
            raise
    return len(done)


class Halted(Exception):
    """A batch that isn't to be taken in this run."""


def progress(rows: DataFrame, staged: DataFrame, position: str, size: int, failed: DataFrame | None = None) -> DataFrame:
    """One row: rows in all, rows staged, rows that are left, the next batch, and the state; the cursor stops before the first
    failed batch."""
    planned = batches(rows, position, size).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    have = staged.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_staged")).withColumn("passed", F.lit(True))
    if failed is not None:
        have = have.join(failed.select("batch_id", F.lit(False).alias("ok")).distinct(), "batch_id", "left").withColumn("passed", F.coalesce("ok", "passed")).drop("ok")
    both = planned.join(have, "batch_id", "full")
    told = both.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum("n_staged"), F.lit(0)).alias("n_staged"),
        F.min(F.when(F.col("n").isNotNull() & ~F.coalesce("passed", F.lit(False)), F.col("batch_id"))).alias("next_batch"),
    )
    return told.select("n_rows", "n_staged", "next_batch", F.when(F.col("next_batch").isNull(), "complete").otherwise("open").alias("state"))


def qc(rows: DataFrame, cells: DataFrame, items: DataFrame, relations: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Coverage errors: cells without items, related items without relation or open question, items of unknown rows."""
    bare = cells.join(items.select("cell_id").distinct(), "cell_id", "left_anti").select("row_id", F.lit("cell without items").alias("error"))
    related = items.where("role != 'main'")
    told = relations.select(F.col("related_item_id").alias("item_id")).unionByName(unresolved.select(F.explode("related_item_ids").alias("item_id"))).distinct()
    lost = related.join(told, "item_id", "left_anti").select("row_id", F.lit("item without relation").alias("error"))
    stray = items.join(rows.select("row_id"), "row_id", "left_anti").select("row_id", F.lit("item of unknown row").alias("error"))
    return bare.unionByName(lost).unionByName(stray)


def gaps(df: DataFrame, position: str, batch: str) -> DataFrame:
    """Batches whose positions aren't contiguous."""
    got = df.groupBy(batch).agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count_distinct(position).alias("n"))
    return got.where(F.col("last") - F.col("first") + 1 != F.col("n"))
