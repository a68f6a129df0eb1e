"""Embedding near-dedup by sorted projection passes.

Each pass gives a vector a key of KEY_BITS sign bits of random projections, most significant first, and sorts all vectors by
(label, key): vectors at a small angle share a long prefix in some pass. Neighbours within a window of that order are compared,
whatever label or task they fall into: what lies across the end of a partition is compared in a second step. What is sorted is
a few numbers a vector, not the vector itself; a sketch of SKETCH_BITS further sign bits tells pairs that can be close enough,
and only these fetch their vectors. Verified pairs of all passes are united.

Passes come in rounds. The first looks at the NEAR next neighbours only, which connects groups of any number of near copies;
later rounds look at whole windows but only for pairs that no links connect yet and that weren't refused before. Each label goes
on until what its last two rounds found says that no more than MISSED of its own links are missing, whatever other labels hold;
labels that aren't done after ROUNDS are compared in full, block by block. Within the components, every pair is compared that way
in the end, so that the number of links is complete even where more vectors lie close together than a window holds.

Equal vectors are one class, compared once and counted with their number.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import as_id, components, session_of, spanning, stash, unstash

COSINE = 0.98
#: Neighbours after a vector in a pass that it is compared with; in the first round NEAR of them.
WINDOW, NEAR = 64, 2
#: Passes of a round, rounds before a label is compared in full, and the share of a label's links that may be missing at its end.
PASSES, ROUNDS, MISSED = 8, 16, 1e-3
KEY_BITS, SKETCH_BITS = 62, 256
#: Vectors of a component that one task compares with as many others.
TILE = 512

SKETCH = [f"s{i}" for i in range(SKETCH_BITS // 64)]
ORDERED = ["seg", "rep", "component", *SKETCH]


def _unit(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    """Rows scaled to length one in double precision; they have the same number of finite components, not all zero."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _keyed(classes: DataFrame, first: int, passes: int, seed: int) -> DataFrame:
    """(pass, group, dim, key, rep, component, s0, s1 ...): the keys of each class in the passes from `first`, and its sketch."""

    def run(batches):
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        high = np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            dims = batch.column(3).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                if dim not in planes:
                    planes[dim] = (
                        np.stack([np.random.default_rng([seed, dim, first + p]).standard_normal((dim, KEY_BITS)) for p in range(passes)]),
                        np.random.default_rng([seed, dim]).standard_normal((dim, SKETCH_BITS)),
                    )
                x = _unit(part.column(4), part.num_rows)
                sketch = [pa.array(s) for s in np.packbits(x @ planes[dim][1] > 0, axis=1).view("<i8").T]
                rep, component, group = (part.column(i) for i in range(3))
                for p in range(passes):
                    key = ((x @ planes[dim][0][p] > 0) << high).sum(axis=1)
                    seg = np.full(part.num_rows, first + p, np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(seg), group, part.column(3), pa.array(key, pa.int64()), rep, component, *sketch], names=["pass", "group", "dim", "key", "rep", "component", *SKETCH])

    picked = classes.select("rep", "component", "group", "dim", "embedding")
    return picked.mapInArrow(run, "pass int, group long, dim int, key long, rep long, component long, " + ", ".join(f"{s} long" for s in SKETCH))


def unlike_bits(cosine: float) -> int:
    """Sketch bits that may differ: 4.5 deviations above the mean at the threshold, so that about one pair in 3e5 there differs
    in more."""
    p = math.acos(min(max(cosine, -1.0), 1.0)) / math.pi
    return int(SKETCH_BITS * p + 4.5 * math.sqrt(SKETCH_BITS * p * (1 - p)))


def _close(a: list[np.ndarray], b: list[np.ndarray], most: int) -> np.ndarray:
    """Whether rows a and b (as ORDERED) are of one segment, not connected yet, and alike by their sketches."""
    unlike = sum(np.bitwise_count((x ^ y).view(np.uint64)).astype(np.int16) for x, y in zip(a[3:], b[3:]))
    return (a[0] == b[0]) & (a[2] != b[2]) & (unlike <= most)


def _neighbours(window: int, most: int):
    """Pairs (u, v) within the window of a sorted partition, then its first and last rows as (side, at, size)."""
    kind = [*ORDERED, "part"]

    def run(batches):
        before = [np.empty(0, np.int64) for _ in ORDERED]
        head, size, part = None, 0, None
        for batch in batches:
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(kind))]
            if not len(rows[0]):
                continue
            part, rows = int(rows.pop()[0]), rows
            size += len(rows[0])
            head = rows if head is None else head if len(head[0]) >= window else [np.concatenate(x) for x in zip(head, rows)]
            old = len(before[0])
            rows = [np.concatenate(x) for x in zip(before, rows)]
            u, v = [], []
            for d in range(1, min(window, len(rows[0]) - 1) + 1):
                start = max(0, old - d)  # pairs of rows that came before have been compared
                a, b = [x[start : len(x) - d] for x in rows], [x[start + d :] for x in rows]
                ok = _close(a, b, most)
                u.append(np.minimum(a[1], b[1])[ok])
                v.append(np.maximum(a[1], b[1])[ok])
            before = [x[-window:].copy() for x in rows]
            if u:
                u, v = np.concatenate(u), np.concatenate(v)
                yield pa.RecordBatch.from_pydict({"u": pa.array(u), "v": pa.array(v), **{c: pa.nulls(len(u), pa.int64()) for c in (*ORDERED, "part", "at", "size")}})
        if part is not None:
            for rows, at in (([x[:window] for x in head], 0), (before, -len(before[0]))):
                n = len(rows[0])
                yield pa.RecordBatch.from_pydict(
                    {"u": pa.nulls(n, pa.int64()), "v": pa.nulls(n, pa.int64()), **{c: pa.array(x, pa.int64()) for c, x in zip(ORDERED, rows)},
                     "part": pa.array([part] * n, pa.int64()), "at": pa.array(np.arange(n) + at, pa.int64()), "size": pa.array([size] * n, pa.int64())}
                )

    return run


def _across(window: int, most: int):
    """Pairs of the last rows of a partition (at below 0) with the first rows of those after it."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        at = table["at"].to_numpy()
        rows = [table[c].to_numpy() for c in ORDERED]
        last = int((at < 0).sum())
        u, v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i in range(last):
            stop = int(np.searchsorted(at, at[i] + window, side="right"))
            if stop > last:
                a, b = [np.full(stop - last, x[i]) for x in rows], [x[last:stop] for x in rows]
                ok = _close(a, b, most)
                u.append(np.minimum(a[1], b[1])[ok])
                v.append(np.maximum(a[1], b[1])[ok])
        return pa.table({"u": np.concatenate(u), "v": np.concatenate(v)})

    return run


def _candidates(classes: DataFrame, first: int, passes: int, window: int, cosine: float, seed: int) -> DataFrame:
    """Distinct pairs (u, v) of classes of different components that are neighbours in a pass and alike by their sketches."""
    spark = session_of(classes)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    order = ["pass", "group", "dim", "key", "rep"]
    most = unlike_bits(cosine)
    ranged = _keyed(classes, first, passes, seed).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = ranged.select(F.xxhash64("pass", "group", "dim").alias("seg"), *ORDERED[1:], F.spark_partition_id().cast("long").alias("part"))
    kind = ", ".join(f"{c} long" for c in ("u", "v", *ORDERED, "part", "at", "size"))
    told = stash(rows.mapInArrow(_neighbours(window, most), kind), "neighbours")
    pairs = told.where("u is not null").select("u", "v")
    ends = told.where("u is null")
    sizes = sorted((r["part"], r["size"]) for r in ends.select("part", "size").distinct().collect())  # one row a partition
    links = []  # (partition, the one whose last rows meet its first ones, rows between the two)
    for i, (p, _) in enumerate(sizes):
        between = 0
        for q, n in reversed(sizes[:i]):
            if between >= window:
                break
            links.append((p, q, between))
            between += n
    if links:
        # no more than `window` rows of this a partition
        reach = spark.createDataFrame(links, "part long, to long, between long")
        heads = ends.where("at >= 0").join(F.broadcast(reach), "part").select(F.col("to").alias("part"), (F.col("at") + F.col("between")).alias("at"), *ORDERED)
        tails = ends.where("at < 0").select("part", "at", *ORDERED)
        pairs = pairs.unionByName(tails.unionByName(heads).groupBy("part").applyInArrow(_across(window, most), "u long, v long"))
    out = stash(pairs.distinct(), "candidates")
    unstash(told)
    return out


def _verified(pairs: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    """The pairs as (u, v, group, near): whether their vectors meet the threshold."""

    def run(batches):
        for batch in batches:
            u, v = batch.column(0), batch.column(1)
            dims = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            ok = np.zeros(batch.num_rows, bool)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                a, b = (_unit(batch.column(i).take(pa.array(at)), len(at)) for i in (2, 3))
                ok[at] = np.einsum("ij,ij->i", a, b) >= cosine
            yield pa.RecordBatch.from_arrays([u, v, batch.column(4), pa.array(ok)], names=["u", "v", "group", "near"])

    side = lambda end, name, *more: classes.select(F.col("rep").alias(end), F.col("embedding").alias(name), *more)
    both = pairs.join(side("u", "a", "group"), "u").join(side("v", "b"), "v").select("u", "v", "a", "b", "group")
    return stash(both.mapInArrow(run, "u long, v long, group long, near boolean"), "links")


def _blocks(table: pa.Table, cosine: float):
    """(rows of the left side, rows of the right, hits) of each group in a task's tiles; a vector doesn't hit itself."""
    comp, side, rep = (table[c].to_numpy() for c in ("component", "side", "rep"))
    cut = np.flatnonzero(np.concatenate([[True], comp[1:] != comp[:-1], [True]]))
    for a, b in zip(cut[:-1], cut[1:]):
        x = _unit(table["embedding"].slice(a, b - a), b - a)
        left = np.flatnonzero(side[a:b] != 2)  # 0 both sides, 1 left, 2 right
        right = np.flatnonzero(side[a:b] != 1)
        yield a + left, a + right, (x[left] @ x[right].T >= cosine) & (rep[a + left][:, None] != rep[a + right][None])


def _tile_counts(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("component", "ascending"), ("side", "ascending")])
        rep, mult = table["rep"].to_numpy(), table["mult"].to_numpy()
        out_rep, out_n = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for left, right, hit in _blocks(table, cosine):
            out_rep.append(rep[left])
            out_n.append((hit @ mult[right]).astype(np.int64))
        return pa.table({"rep": np.concatenate(out_rep), "others": np.concatenate(out_n)})

    return run


def _tile_spans(cosine: float):
    """Links of a tile, but for those that connect what its others connect."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("component", "ascending"), ("side", "ascending")])
        rep, out = table["rep"].to_numpy(), []
        for left, right, hit in _blocks(table, cosine):
            ends, flat = np.unique(rep[np.concatenate([left, right])], return_inverse=True)
            i, j = np.nonzero(hit)
            out += [(int(ends[a]), int(ends[b])) for a, b in spanning(len(ends), np.stack([flat[: len(left)][i], flat[len(left) :][j]], axis=1))]
        u, v = zip(*out) if out else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _connected(classes: DataFrame, cosine: float, window: int, passes: int, seed: int) -> DataFrame:
    """(rep, component) of the classes that are linked with another."""
    links = stash(classes.select(F.col("rep").alias("u"), F.col("rep").alias("v")).limit(0), "links")
    refused = links
    comp = stash(components(links).withColumnRenamed("id", "rep"), "components")
    # a label with what its rounds found: all, and in the last one
    labels = stash(classes.groupBy("group").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("group", F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("last")), "labels")
    for round_ in range(ROUNDS):
        active = classes.join(labels.select("group"), "group", "left_semi")
        named = active.join(comp, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        pairs = _candidates(named, round_ * passes, passes if round_ else -(-passes // 2), window if round_ else min(NEAR, window), cosine, seed)
        told = _verified(pairs.join(refused, ["u", "v"], "left_anti") if round_ else pairs, classes, cosine)
        unstash(pairs)
        refused = refused.unionByName(told.where("not near").select("u", "v"))
        fresh = told.where("near")
        found = labels.join(fresh.groupBy("group").agg(F.count(F.lit(1)).alias("new")), "group", "left").fillna(0, ["new"])
        # of what a round left, the next one finds the same share: this much is still missing, with one link more than were found
        more, less = F.col("new") + 1, F.col("last") - F.col("new") - 1
        missing = F.when((F.col("new") == 0) & (F.col("last") == 0), 0.0).otherwise(more * more / F.greatest(less, F.lit(1)))
        total = F.col("total") + F.col("new")
        # the first round leaves all pairs alone that aren't next to each other
        going = (missing > F.greatest(F.lit(0.5), MISSED * total)) if round_ else F.lit(True)
        left = stash(found.where(going).select("group", total.alias("total"), F.col("new").alias("last")), "labels")
        if not fresh.isEmpty():
            links = links.unionByName(fresh.select("u", "v"))
            unstash(comp)
            comp = stash(components(links).withColumnRenamed("id", "rep"), "components")
        unstash(labels)
        labels = left
        if labels.isEmpty():
            return comp
    rest = classes.join(labels.select("group"), "group", "left_semi")
    # dimensions don't mix in a tile
    part = rest.select("rep", F.xxhash64("group", "dim").alias("component"))
    spans = _tiles(rest.withColumn("mult", F.lit(1).cast("long")), part).applyInArrow(_tile_spans(cosine), "u long, v long")
    return stash(components(links.unionByName(spans)).withColumnRenamed("id", "rep"), "components")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, passes: int = PASSES, window: int = WINDOW, seed: int = 7) -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row; passes are those of a round.

    Only vectors with equal, non-null labels and as many components are compared. Vectors that are null, empty, zero or hold
    null or non-finite components link with nothing, nor do rows whose id is null or no whole number (null component, kept).
    Rows that repeat an id count as vectors of their own. Other columns are left out; an empty table gives no rows.
    """
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(as_id(id_col).alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("embedding"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    fine = F.coalesce(fine & F.col("label").isNotNull() & F.col("id").isNotNull(), F.lit(False))
    rows = rows.withColumn("ok", fine).select(
        "id",
        F.when(F.col("ok"), F.xxhash64("label", v)).alias("k1"),
        F.when(F.col("ok"), F.xxhash64(F.lit(1), v, "label")).alias("k2"),
        F.xxhash64("label").alias("group"),
        F.when(F.col("ok"), F.col("embedding")).alias("embedding"),
    )
    rows = stash(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    named = stash(rows.where("k1 is not null").groupBy("k1", "k2").agg(F.min("row").alias("rep"), F.min("id").alias("least"), F.count(F.lit(1)).alias("mult")), "names")
    classes = stash(rows.select(F.col("row").alias("rep"), "group", F.size("embedding").alias("dim"), "embedding").join(named.select("rep", "mult"), "rep"), "classes")
    comp = _connected(classes.select("rep", "group", "dim", "embedding"), cosine, window, passes, seed)
    least = named.join(comp, "rep").groupBy("component").agg(F.min("least").alias("component_id"))
    of = named.join(comp.join(least, "component").select("rep", "component_id"), "rep", "left").join(_count(classes, comp, cosine), "rep", "left")
    return (
        rows.select("id", "k1", "k2")
        .join(of, ["k1", "k2"], "left")
        .select(
            F.col("id").alias(id_col),
            F.coalesce(F.coalesce("others", F.lit(0)) + F.col("mult") - 1, F.lit(0)).alias("n_links"),
            F.coalesce("component_id", "least", "id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("component_id") == F.col(f"`{id_col}`"), F.lit(True)))
    )


def _count(classes: DataFrame, comp: DataFrame, cosine: float) -> DataFrame:
    """(rep, others): the vectors of other classes that a class is linked with, by comparing all of each component in tiles."""
    return _tiles(classes, comp).applyInArrow(_tile_counts(cosine), "rep long, others long").groupBy("rep").agg(F.sum("others").alias("others"))


def _tiles(classes: DataFrame, comp: DataFrame):
    """Classes (rep, mult, embedding) dealt to pairs of tiles in which all of each component (rep, component) meets."""
    size = comp.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    total = comp.count()
    member = classes.select("rep", "mult", "embedding").join(comp, "rep").join(size, "component").withColumn("tiles", F.ceil(F.col("size") / TILE).cast("int"))
    few = member.where("tiles = 1").select(
        F.pmod(F.xxhash64("component"), F.lit(max(1, total // TILE))).alias("g"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "component", "rep", "mult", "embedding"
    )
    tile = F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")
    many = member.where("tiles > 1").withColumn("own", tile).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    left = F.struct(F.col("own").alias("i"), F.col("to").alias("j"), F.when(F.col("own") == F.col("to"), 0).otherwise(1).alias("side"))
    right = F.when(F.col("own") != F.col("to"), F.struct(F.col("to").alias("i"), F.col("own").alias("j"), F.lit(2).alias("side")))
    many = many.withColumn("x", F.explode(F.array_compact(F.array(left, right)))).select(F.col("component").alias("g"), "x.i", "x.j", "x.side", "component", "rep", "mult", "embedding")
    tiles = few.withColumn("big", F.lit(False)).unionByName(many.withColumn("big", F.lit(True)))
    return tiles.groupBy("big", "g", "i", "j")
