"""Review commands as table edits: overrides are upserted or cleared, jobs move through their states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions.fixed import RELATION_TYPES
from weftline.operators.rows import last_write_wins

STATES = ("queued", "running", "done", "failed")


def upsert(overrides: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """overrides with the rows of new in place of those of the same keys."""
    return overrides.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def clear(overrides: DataFrame, **match) -> DataFrame:
    """overrides without the rows that meet all of match."""
    hit = F.lit(bool(match))
    for c, v in match.items():
        hit &= F.col(c).eqNullSafe(F.lit(v))
    return overrides.where(~hit)


def relation_errors(new: DataFrame, items: DataFrame) -> DataFrame:
    """Manual relations (main_item_id, related_item_id, relation_type) that can't be: unknown items, other rows, wrong roles."""
    side = lambda name: items.select(F.col("item_id").alias(f"{name}_item_id"), F.col("row_id").alias(f"{name}_row"), F.col("role").alias(f"{name}_role"))
    names = F.create_map(*[F.lit(x) for kv in RELATION_TYPES.items() for x in kv])
    both = new.join(side("main"), "main_item_id", "left").join(side("related"), "related_item_id", "left")
    error = (
        F.when(F.col("main_row").isNull() | F.col("related_row").isNull(), "unknown item")
        .when(F.col("main_row") != F.col("related_row"), "items of different rows")
        .when((F.col("main_role") != "main") | (F.col("related_role") == "main"), "not a main and a related item")
        .when(F.coalesce(names[F.col("related_role")], F.lit("")) != F.col("relation_type"), "type doesn't fit the role")
    )
    return both.withColumn("error", error).where("error is not null").select(*new.columns, "error")


def job_states(events: DataFrame) -> DataFrame:
    """Latest state of each job of an event table (job_id, state, at, error)."""
    return last_write_wins(events.withColumn("_first", F.col("at")), ["job_id"], "at", "_first").withColumnRenamed("_first", "created")


def after_restart(states: DataFrame) -> DataFrame:
    """Jobs that were open when the service stopped count as failed."""
    open_ = F.col("state").isin("queued", "running")
    return states.withColumn("error", F.when(open_, "interrupted by a restart").otherwise(F.col("error"))).withColumn("state", F.when(open_, "failed").otherwise(F.col("state")))


def admitted(states: DataFrame, wanted: int, workers: int, slots: int) -> bool:
    """Whether a batch fits: all of it or nothing."""
    return states.where(F.col("state").isin("queued", "running")).count() + wanted <= workers + slots


def dealt(states: DataFrame, workers: int) -> DataFrame:
    """Queued jobs that start now, the oldest first, each with the number of the free worker that takes it."""
    busy = states.where("state = 'running'").count()
    free = max(0, workers - busy)
    first = states.where("state = 'queued'").orderBy("created", "job_id").limit(free)  # no more than there are workers
    return first.withColumn("worker", F.row_number().over(Window.orderBy("created", "job_id")) + busy)


def gauges(devices: DataFrame, states: DataFrame, slots: int) -> DataFrame:
    """One row: devices and their memory in all and in use, jobs that run and wait, and slots that are left."""
    memory = devices.agg(F.count(F.lit(1)).alias("devices"), F.coalesce(F.sum("total"), F.lit(0)).alias("memory_total"), F.coalesce(F.sum("used"), F.lit(0)).alias("memory_used"))
    jobs = states.agg(F.count_if(F.col("state") == "running").alias("running"), F.count_if(F.col("state") == "queued").alias("queued"))
    return memory.join(F.broadcast(jobs)).withColumn("free_slots", F.greatest(F.lit(0), F.lit(slots) - F.col("queued")))  # two rows of one


def with_references(items: DataFrame, references: DataFrame) -> DataFrame:
    """items (index) with the one shared reference, or each with that of its own index; any other number of them is an error."""
    n, m = items.count(), references.count()
    if m == 1:
        return items.join(F.broadcast(references.drop("index")))  # one row
    if m != n:
        raise ValueError("give one reference for all items, or one for each")
    return items.join(references, "index")
