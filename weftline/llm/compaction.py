"""Compaction of a table of many small files into few: files of a day are packed first-fit by falling size, and the packed groups
are rewritten, each as one file, while all others stay as they are.

Where packing looks for "the earliest group with room", a Fenwick tree over compressed residuals answers: its nodes hold
multisets of group numbers as heaps that forget lazily, and a suffix-minimum query reads the heads of a few of them.

All that passes through one task is a day's list of files (sizes, not rows). A file is written, and later read back for its
digest, by one task as a stream, since a file is an ordered whole.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import bounded_batches, fresh, map_batches, session_of, shared_dir


class EarliestFit:
    """Open groups by what room they have left; asked for the earliest one with room for a size.

    Residuals are compressed to the number of known sizes that they admit, so a tree of as many places as there are sizes is
    exact. Node k of the tree covers a range of places and keeps a heap of the groups that were put there; a group that has
    moved to another place since is dropped from a heap when it comes to its head.
    """

    def __init__(self, sizes: list[int]):
        self.sizes = sorted(set(sizes))
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(len(self.sizes) + 1)]
        self.place: list[int] = []
        self.left: list[int] = []

    def put(self, group: int, room: int) -> None:
        """Group (a new number is the next one) has this much room now."""
        place = bisect_right(self.sizes, room)
        if group == len(self.left):
            self.left.append(room)
            self.place.append(0)
        self.left[group] = room
        if place == self.place[group]:
            return
        self.place[group] = place
        at = len(self.sizes) - place + 1  # the tree runs from the largest place down: a suffix is a prefix there
        while place and at < len(self.heaps):
            heappush(self.heaps[at], (group, place))
            at += at & -at

    def find(self, size: int) -> int | None:
        """The lowest number among groups with room for size (one of the known sizes)."""
        best, at = None, len(self.sizes) - bisect_left(self.sizes, size)
        while at:
            heap = self.heaps[at]
            while heap and self.place[heap[0][0]] != heap[0][1]:
                heappop(heap)
            if heap and (best is None or heap[0][0] < best):
                best = heap[0][0]
            at -= at & -at
        return best


def first_fit(sizes: list[int], capacity: int) -> list[int]:
    """Group of each size, taken in the order given: the earliest group that holds at most capacity with it, else a new one."""
    open_, out = EarliestFit(sizes), []
    for size in sizes:
        group = open_.find(size)
        room = capacity if group is None else open_.left[group]
        group = len(open_.left) if group is None else group
        open_.put(group, room - size)
        out.append(group)
    return out


@dataclass(frozen=True)
class Lots:
    """Where files stand: root, the table's own columns, the three partition columns, and the largest size of a source of a
    group and of a group, in rows."""

    root: str
    columns: tuple[str, ...]
    keys: tuple[str, str, str]
    below: int
    capacity: int

    def named(self) -> list[Column]:
        return [F.col(k).alias(n) for k, n in zip(self.keys, ("day", "lot", "piece"))]

    def read(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        return spark.read.schema(T.StructType([*schema, *(T.StructField(k, T.LongType()) for k in self.keys)])).parquet(self.root)


def share(rows: int, parts: int) -> int:
    """A size of which about `parts` fill the table: 1 + floor(rows / parts)."""
    return 1 + rows // parts


def day_of(at: Column) -> Column:
    """Whole days since 1970; null for null."""
    return F.unix_date(at.cast("date")).cast("long")


def write_lots(rows: DataFrame, root: str, id_column: str = "click_id", at: str = "arrived_at") -> Lots:
    """Write rows below root, one file for each (day, lot, piece), sorted by time and id, all columns in table order.

    A null time makes a day of its own (null), a null id hashes as empty text and sorts first. Columns that are named like the
    partition columns stay data: the partition columns get other names. An empty table writes no file.
    """
    n = rows.count()
    day, lot, piece = (fresh(rows, k) for k in ("day", "lot", "piece"))
    size, known = fresh(rows, "rows_of_day"), fresh(rows, "known_day")
    dated = rows.withColumn(day, day_of(F.col(f"`{at}`")))
    days = dated.groupBy(F.col(day).alias(known)).agg(F.count(F.lit(1)).alias(size))
    h = F.crc32(F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")))
    lots = F.lit(1) + F.floor(F.col(size) / F.lit(share(n, 150)))
    placed = (
        dated.join(days, F.col(day).eqNullSafe(F.col(known)))
        .withColumn(lot, F.floor(h / 16) % lots)
        .withColumn(piece, F.least(h % 4, F.floor(h / 4) % 4))
        .select(*[f"`{c}`" for c in rows.columns], day, lot, piece)
    )
    order = (day, lot, piece, f"`{at}`", f"`{id_column}`")
    placed.repartition(day, lot, piece).sortWithinPartitions(*order).write.option("maxRecordsPerFile", 0).partitionBy(day, lot, piece).parquet(root)
    return Lots(root, tuple(rows.columns), (day, lot, piece), share(n, 600), share(n, 500))


def plan(files: DataFrame, below: int, capacity: int) -> DataFrame:
    """(day, lot, piece, file, n_rows) of files as (..., grp, nth, members): the group in its day, the place in it (from 0) and
    its number of files. Files of `below` rows or more are groups of their own (grp null, members 1)."""

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_rows", "descending"), ("lot", "ascending"), ("piece", "ascending")])
        sizes = np.asarray(table["n_rows"])
        small = sizes < below
        groups = np.full(len(sizes), -1, np.int64)
        groups[small] = first_fit(sizes[small].tolist(), capacity)
        nth, members, seen = np.zeros(len(sizes), np.int32), np.ones(len(sizes), np.int32), {}
        for k in np.flatnonzero(small):
            nth[k] = seen[groups[k]] = seen.get(groups[k], -1) + 1
        for k in np.flatnonzero(small):
            members[k] = seen[groups[k]] + 1
        more = {"grp": pa.array(groups, mask=~small), "nth": pa.array(nth), "members": pa.array(members)}
        for name, values in more.items():
            table = table.append_column(name, values)
        return table

    return files.groupBy("day").applyInArrow(packed, "day long, lot long, piece long, file string, n_rows long, grp long, nth int, members int")


def _files(stored: DataFrame, lots: Lots) -> DataFrame:
    """(day, lot, piece, file, n_rows) of the files of a stored table; only their footers are read."""
    file = stored.metadataColumn("_metadata")["file_path"]
    return stored.select(*lots.named(), file.alias("file")).groupBy("day", "lot", "piece", "file").agg(F.count(F.lit(1)).alias("n_rows"))


def _same_place() -> Column:
    return F.col("day").eqNullSafe(F.col("d")) & (F.col("lot") == F.col("l")) & (F.col("piece") == F.col("p"))


def compact(lots: Lots, schema: T.StructType, spark: SparkSession) -> DataFrame:
    """Replace each planned group of several files by one, at the place of its first source; returns the plan, as stored.

    Groups are written by Spark beside the table, ordered by source and row number, and moved in when all are complete; then
    their sources go. Nothing else is touched. A run that fails half-way leaves a folder that nothing reads: each call has its own.
    """
    stored = lots.read(spark, schema)
    # the plan of a run is kept: what is moved and deleted below follows the same rows as the report
    planned = plan(_files(stored, lots), lots.below, lots.capacity)
    planned.write.parquet(f"{lots.root}.plan")
    planned = spark.read.schema(planned.schema).parquet(f"{lots.root}.plan")
    several = planned.where("members > 1").select(F.col("day").alias("d"), F.col("lot").alias("l"), F.col("piece").alias("p"), "grp", "nth")
    row = stored.metadataColumn("_metadata")["row_index"]
    # names of the table's columns don't count here: they are numbered until they are written
    numbered = stored.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(lots.columns)], *lots.named(), row.alias("row"))
    moving = numbered.join(several, _same_place()).repartition("day", "grp").sortWithinPartitions("day", "grp", "nth", "row")
    day, _, grp = lots.keys
    merged = moving.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(lots.columns)], F.col("day").alias(day), F.col("grp").alias(grp))
    merged.write.option("maxRecordsPerFile", 0).partitionBy(day, grp).parquet(f"{lots.root}.merged")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    disk = path(lots.root).getFileSystem(conf)
    # file names only, one at a time: their number goes with days, not with rows
    for r in planned.where("members > 1").select("day", "grp", "nth", "file").toLocalIterator():
        disk.delete(path(r.file), False)
        folder = path(r.file).getParent()
        if r.nth == 0:
            made = path(f"{lots.root}.merged/{day}={'__HIVE_DEFAULT_PARTITION__' if r.day is None else r.day}/{grp}={r.grp}")
            (new,) = [s.getPath() for s in disk.listStatus(made) if s.getPath().getName().endswith(".parquet")]
            if not disk.rename(new, path(folder, new.getName())):
                raise OSError(f"can't move {new} to {folder}")
        else:
            disk.delete(folder, True)
    disk.delete(path(f"{lots.root}.merged"), True)
    return planned


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (day, lot, piece, row, id, value), whole files in order, as one row a file; only a running hash is kept."""
    now, out = None, []

    def done() -> None:
        if now is not None:
            out.append((*now["place"], now["n"], now["low"], now["high"], now["cents"], now["hash"].hexdigest()))

    for batch in batches:
        place = [np.asarray(batch.column(k).fill_null(-(2**63))) for k in range(3)]
        turns = np.flatnonzero(np.any([x[1:] != x[:-1] for x in place], axis=0)) + 1
        cuts = [0, *turns.tolist(), batch.num_rows] if batch.num_rows else []
        for a, b in zip(cuts, cuts[1:]):
            here = tuple(batch.column(k)[a].as_py() for k in range(3))
            if now is None or now["place"] != here:
                done()
                now = {"place": here, "n": 0, "low": None, "high": None, "cents": 0, "hash": hashlib.sha256()}
            ids = batch.column(4)[a:b]
            text = ",".join("" if i is None else str(i) for i in ids.to_pylist())
            now["hash"].update(("," * bool(now["n"]) + text).encode())
            now["n"] += b - a
            ends = pc.min_max(ids).as_py()
            if ends["min"] is not None:
                now["low"] = ends["min"] if now["low"] is None else min(now["low"], ends["min"])
                now["high"] = ends["max"] if now["high"] is None else max(now["high"], ends["max"])
            v = np.asarray(batch.column(5)[a:b].fill_null(0.0), dtype=np.float64)
            now["cents"] += int(np.floor(100 * np.where(np.isfinite(v), v, 0.0) + 0.5).sum())
    done()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in [*zip(*out)][:-1]] + [pa.array([x[-1] for x in out])], names=DIGEST.replace(" long", "").replace(" string", "").split(", "))


DIGEST = "d long, l long, p long, n_rows long, min_click_id long, max_click_id long, cents long, ids_sha256 string"


def report(lots: Lots, schema: T.StructType, planned: DataFrame, id_column: str = "click_id", value: str = "value") -> DataFrame:
    """One row per file of the folder as it is now, with what its rows say and what it was made of."""
    spark = session_of(planned)
    bounded_batches(spark)
    stored = lots.read(spark, schema)
    row = stored.metadataColumn("_metadata")["row_index"]
    slim = stored.select(*lots.named(), row.alias("row"), F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{value}`").cast("double").alias("value"))
    told = map_batches(slim.repartition("day", "lot", "piece").sortWithinPartitions("day", "lot", "piece", "row"), _digests, DIGEST)
    name = F.concat_ws("-", "lot", "piece")
    # a group stands where its first source stood; what has no group stays where it was
    groups = planned.groupBy("day", F.coalesce(F.col("grp").cast("string"), name).alias("own")).agg(F.array_sort(F.collect_list(F.struct("nth", "lot", "piece", name.alias("name")))).alias("made_of"))
    first = F.element_at("made_of", 1)
    groups = groups.select(F.col("day").alias("d"), first["lot"].alias("l"), first["piece"].alias("p"), F.array_join(F.col("made_of")["name"], ",").alias("sources"), (F.size("made_of") > 1).alias("rewritten"))
    files = _files(stored, lots).drop("n_rows")
    return (
        files.join(told, _same_place())
        .drop("d", "l", "p")
        .join(groups, _same_place())
        .select("day", "lot", "piece", "n_rows", "min_click_id", "max_click_id", "cents", "sources", "ids_sha256", F.lit(",".join(lots.columns)).alias("columns"), F.col("file").alias("path"), "rewritten")
    )


def compacted(rows: DataFrame, id_column: str = "click_id", at: str = "arrived_at", value: str = "value", folder: str | None = None) -> DataFrame:
    """Write rows into a new folder, compact it and report its files; the folder stays.

    Repeated rows stay as often as they occur, ties of time and id come in any order, an empty table gives an empty folder
    and no rows. Null ids count as empty text in digests and are left out of the smallest and largest id; null values and such as
    aren't finite count 0 cents. See write_lots for null times and clashing names.
    """
    spark = session_of(rows)
    root = folder or f"{shared_dir(spark)}/compacted/{uuid.uuid4().hex}"
    lots = write_lots(rows, root, id_column, at)
    planned = compact(lots, rows.schema, spark)
    return report(lots, rows.schema, planned, id_column, value)
