"""A Merkle manifest of a table: a hash tree of eight children per group of rows, a tree over the groups' roots, and a proof for
every row.

Rows are ranked in range partitions and cut into aligned buckets of 8^4 leaves, so that no bucket depends on another. Executors
fold each bucket's levels in DuckDB (ordered string_agg and sha256 over Arrow tables); Spark combines the roots of buckets
level by level, joins the outer part of each proof to its bucket's rows and folds it.

H is the lowercase hex sha256 of its inputs, concatenated, digests as hex text.
"""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.common import bounded_batches, session_of, stash, unstash

ARITY, DEPTH = 8, 4
#: Leaves of a bucket: a full subtree, some 10 MB with all proofs.
BUCKET = ARITY**DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALONE = "array<struct<l:string,r:string>>"


def framed(c: Column) -> Column:
    """A value as the leaves take it: `-` for null, else its UTF-8 byte count, a colon and itself."""
    c = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def leaf_of(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[framed(c) for c in columns]), 256)


def levels_of(n: int) -> int:
    """Levels above n leaves until one node remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def ranked(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """df with `rank` (from 0 within group, in the order given) and `n`, the group's rows; the group may hold most rows.

    Range partitions are written with row numbers; a rank is a row's number in its part plus what earlier parts hold of its
    group. Only one row per part and group meets in a window.
    """
    ranged = df.repartitionByRange(F.asc_nulls_first(group), *[F.asc_nulls_first(o) for o in order]).sortWithinPartitions(F.asc_nulls_first(group), *[F.asc_nulls_first(o) for o in order])
    placed = stash(ranged.withColumn("at", F.monotonically_increasing_id()), "ranked")
    parts = placed.groupBy(group, F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    w = Window.partitionBy(group)
    starts = parts.select(F.col(group).alias("g"), "part", "first", (F.sum("rows").over(w.orderBy("part")) - F.col("rows")).alias("before"), F.sum("rows").over(w).alias("n"))
    return placed.withColumn("p", F.shiftright("at", 33)).join(starts, F.col(group).eqNullSafe(F.col("g")) & (F.col("p") == F.col("part"))).withColumn("rank", F.col("at") - F.col("first") + F.col("before")).drop("at", "p", "part", "first", "before", "g")


#: One level of a bucket: runs of eight nodes, their hashes, and what stands left and right of each leaf's ancestor.
RUNS = "CREATE OR REPLACE TEMP TABLE runs AS SELECT i // 8 AS i, string_agg(h, '' ORDER BY i) AS s FROM nodes GROUP BY 1"
UP = "CREATE OR REPLACE TEMP TABLE nodes AS SELECT i, sha256(s) AS h FROM runs"
STEP = """CREATE OR REPLACE TEMP TABLE leaves AS
WITH met AS (SELECT l.*, s[1:64 * (p % 8)] AS a, s[64 * (p % 8) + 65:] AS b FROM leaves l JOIN runs r ON r.i = l.p // 8)
SELECT rank, p // 8 AS p, proof || a || b AS proof, sha256(a || fold || b) AS fold FROM met"""


def fold_bucket(leaves: pa.Table, levels: int, con: duckdb.DuckDBPyConnection) -> pa.Table:
    """(rank, leaf, forged) of an aligned bucket as (rank, proof, fold, top): siblings below the bucket's root in order, the
    root as recomputed from forged, and as it is."""
    con.register("bucket", leaves)
    con.sql(f"CREATE OR REPLACE TEMP TABLE nodes AS SELECT rank % {BUCKET} AS i, leaf AS h FROM bucket")
    con.sql(f"CREATE OR REPLACE TEMP TABLE leaves AS SELECT rank, rank % {BUCKET} AS p, '' AS proof, coalesce(forged, leaf) AS fold FROM bucket")
    for _ in range(levels):
        for statement in (RUNS, STEP, UP):
            con.sql(statement)
    told = con.sql("SELECT rank, proof, fold, h AS top FROM leaves, (SELECT h FROM nodes)").to_arrow_table()
    con.unregister("bucket")
    return told


def buckets_folded(leaves: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Every bucket's rows with proof, fold and top; columns are those kept beside, with their types."""
    kept = list(columns)

    def run(table: pa.Table) -> pa.Table:
        con = duckdb.connect(config={"threads": 1, "memory_limit": "500MB"})
        try:
            slim = table.select(["rank", "leaf", "forged"])
            told = fold_bucket(slim, min(DEPTH, levels_of(table["n"][0].as_py())), con)
        finally:
            con.close()
        order = pc.sort_indices(table["rank"])
        table = table.take(order).select(kept)
        told = told.sort_by("rank")
        for name in ("proof", "fold", "top"):
            table = table.append_column(name, told[name].cast(pa.string()))
        return table

    schema = ", ".join(f"`{c}` {t}" for c, t in columns.items()) + ", proof string, fold string, top string"
    return leaves.groupBy("tree", "bucket").applyInArrow(run, schema)


def tree(nodes: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Trees over nodes (tree, i, n, h), n being a tree's number of nodes and `most` the largest: (tree, i, steps), steps being what stands
    left and right of a node's ancestors up to the root, and (tree, h) of the roots."""
    own = nodes.select("tree", "i", F.col("i").alias("up"), F.array().cast(ALONE).alias("steps"))
    now = nodes.select("tree", "i", "n", "h")
    for _ in range(levels_of(most)):
        runs = now.groupBy("tree", F.shiftright("i", 3).alias("run"), "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]), "").alias("s"))
        runs = stash(runs, "runs")
        place = (F.col("up") % ARITY).cast("int") * 64
        side = F.struct(F.col("s").substr(F.lit(1), place).alias("l"), F.col("s").substr(place + 65, F.lit(64 * ARITY)).alias("r"))
        one = runs.select(F.col("tree").alias("t"), "run", "n", "s")
        own = own.join(one, F.col("tree").eqNullSafe(F.col("t")) & (F.shiftright("up", 3) == F.col("run")))
        own = own.select("tree", "i", F.shiftright("up", 3).alias("up"), F.when(F.col("n") > 1, F.concat("steps", F.array(side))).otherwise(F.col("steps")).alias("steps"))
        # a tree of one node is done: its node stays as it is
        now = runs.select("tree", F.col("run").alias("i"), F.ceil(F.col("n") / ARITY).alias("n"), F.when(F.col("n") > 1, F.sha2("s", 256)).otherwise(F.col("s")).alias("h"))
    return own.select("tree", "i", "steps"), now.select("tree", "h")


def folded(start: Column, steps: Column) -> Column:
    return F.aggregate(steps, start, lambda acc, s: F.sha2(F.concat(s["l"], acc, s["r"]), 256))


def manifest(docs: DataFrame, forged: Column | None = None, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Leaf, subroot of its group, root and proof of every row, and the root as recomputed from the row as it is found later.

    forged: what the fields' last one is by then, where it differs (null: as it was). Leaves of a group ascend by key (null first),
    rows that repeat a key by digest. Null fields are `-`; a null group is a group of its own and comes first. An empty table
    gives no rows. Columns beside the fields are ignored. Returns key, leaf, subroot, root, proof_sha256, folded_root, verified.
    """
    spark = session_of(docs)
    bounded_batches(spark)
    columns = [F.col(f"`{c}`") for c in fields]
    now = forged if forged is not None else F.lit(None).cast("string")
    leaves = stash(
        docs.select(
            F.col(f"`{key}`").alias("key"), F.col(f"`{group}`").cast("string").alias("tree"),
            F.unhex(leaf_of(columns)).alias("leaf"), F.when(now.isNotNull(), F.unhex(leaf_of([*columns[:-1], now]))).alias("forged"),
        ),
        "leaves",
    )
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    placed = ranked(leaves, "tree", ["key", "leaf", "forged"]).select("key", "tree", hexed("leaf"), hexed("forged"), "rank", "n", F.floor(F.col("rank") / BUCKET).alias("bucket"))
    kind = dict(docs.dtypes)[key]
    inner = stash(buckets_folded(placed, {"key": kind, "tree": "string", "leaf": "string", "bucket": "bigint", "rank": "bigint", "n": "bigint"}), "buckets")
    unstash(leaves)
    if inner.isEmpty():
        none = F.lit(None).cast("string")
        return inner.select(F.col("key").alias(key), "leaf", none.alias("subroot"), none.alias("root"), none.alias("proof_sha256"), none.alias("folded_root"), F.lit(False).alias("verified"))
    tops = inner.where(F.col("rank") % BUCKET == 0).select("tree", F.col("bucket").alias("i"), F.ceil(F.col("n") / BUCKET).alias("n"), F.col("top").alias("h"))
    within, subroots = tree(tops, tops.agg(F.max("n")).first()[0])
    # the tree over the groups: all subroots in one order
    one = ranked(subroots.select(F.lit("").alias("all"), "tree", "h"), "all", ["tree"])
    subs = stash(one.select(F.col("all").alias("tree"), F.col("rank").alias("i"), "n", "h", F.col("tree").alias("name")), "subroots")
    above, roots = tree(subs.drop("name"), subs.agg(F.max("n")).first()[0])
    root = roots.first()["h"]
    per_tree = subs.select("i", "name", F.col("h").alias("subroot")).join(above.select("i", F.col("steps").alias("over")), "i").drop("i")
    outer = within.join(per_tree, F.col("tree").eqNullSafe(F.col("name"))).select(F.col("tree").alias("t"), F.col("i").alias("b"), "subroot", F.concat("steps", "over").alias("steps"))
    outer = stash(outer, "outer")
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["l"], s["r"])), "")
    found = inner.join(outer, F.col("tree").eqNullSafe(F.col("t")) & (F.col("bucket") == F.col("b"))).withColumn("folded_root", folded(F.col("fold"), F.col("steps")))
    return found.select(
        F.col("key").alias(key), "leaf", "subroot", F.lit(root).alias("root"), F.sha2(F.concat("proof", siblings), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified")
    )


def lower_a_to_z(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def third_tampered(docs: DataFrame) -> DataFrame:
    """manifest() where the text of every row whose key's crc32 three divides has had its A-Z lower-cased since."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return manifest(docs, F.when(hit, lower_a_to_z(F.col("text"))))
