"""Shared storage, graph components and small helpers of the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of one Arrow batch: long texts make batches of fewer rows, not larger ones.
BATCH_BYTES = 4 << 20
#: Edges that one task settles by union-find: some tens of MB, whatever the input.
ONE_TASK = 300_000


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one where it is unset (local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables stashed inside are deleted at the end, but for those whose paths are taken off the list: for steps whose results
    have been written when they end."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.remove(made)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in made:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = session_of(df)
    path = f"{shared_dir(spark)}/stash/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for made in _scopes:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def unstash(df: DataFrame) -> None:
    """Delete the files of a stashed table that nothing reads any more."""
    spark = session_of(df)
    root = shared_dir(spark)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for file in df.inputFiles():
        if "/stash/" in file and root.split(":", 1)[-1].rstrip("/") in file:
            path = jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(conf).delete(path, False)


def drop_shuffles(spark: SparkSession) -> None:
    """Let the driver collect the plans of finished steps now: Spark deletes a shuffle's files when nothing refers to it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, so that very long texts don't add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: What operators remember from task to task in a Python worker, by operator.
remembered: dict[str, dict] = {}


def memory_of(owner: str) -> dict:
    """What an operator remembers in this worker; what others remembered goes, since workers outlive tasks and stages."""
    for other in [o for o in remembered if o != owner]:
        del remembered[other]
    return remembered.setdefault(owner, {})


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str, owner: str = "") -> DataFrame:
    """df.mapInArrow for any column names, dots and repeated cases included; owner is the operator whose memory may stay."""
    names = df.columns

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory_of(owner)
        yield from run(batch.rename_columns(names) for batch in batches)
        # workers outlive tasks: what this one needed isn't held against the next
        pa.default_memory_pool().release_unused()

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(named, schema)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; one of a single file is dealt out over all cores, larger ones come in enough parts."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.repartition(spark.sparkContext.defaultParallelism) if len(df.inputFiles()) == 1 else df


def as_id(name: str) -> Column:
    """An id column as long; null where it is null or no whole number."""
    return F.col(f"`{name}`").try_cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _changed(old: DataFrame, new: DataFrame) -> bool:
    """Whether two edge sets without repeated rows differ, by count and two order-free sums."""
    digest = lambda d: d.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"),
    ).first()
    return tuple(digest(old)) != tuple(digest(new))


def spanning(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Those of the pairs that connect n vertices as all of them do."""
    up, out = list(range(n)), []
    for a, b in pairs.tolist():
        a0, b0 = a, b
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((a0, b0))
    return out


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one task; (id, component) of its vertices."""
    up: dict[int, int] = {}

    def root(a: int) -> int:
        while (b := up.setdefault(a, a)) != a:
            up[a] = up[b]
            a = up[a]
        return a

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    ids = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([root(a) for a in ids], pa.int64())], names=["id", "component"])


def components(edges: DataFrame, max_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """Connected components of undirected edges (u, v) of longs: one row (id, component) per vertex that has an edge.

    component is the smallest id reachable. Alternating large-star and small-star rounds; the smallest neighbour comes from
    a partially aggregated minimum and goes back by a join, so a vertex with very many neighbours isn't gathered in one task.
    As soon as no more than one_task edges are left (16 bytes each), an executor settles them by union-find.
    Null ends and loops are dropped. An empty input gives an empty result.
    """
    spark = session_of(edges)
    shared_dir(spark)
    now = stash(
        edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    for _ in range(max_rounds):
        if now.count() <= one_task:
            return now.coalesce(1).mapInArrow(_settle, "id long, component long")
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.where(F.col("u") != F.col("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        new = stash(small, "edges")
        done = not _changed(now, new)
        unstash(now)
        now = new
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
