"""MinHash near-dedup as a chosen-path set similarity join.

Every document has a set of word shingles and COORDS minwise values of it. A tree sends a document to the node named by CHOSEN
coordinates and their values; at a node, further coordinates are chosen by a hash of the node. Each level gives a document
BRANCHES children, more than a similar pair loses, so that similar documents keep common paths at any depth and dissimilar ones
part. TREES independent trees meet the target recall.

At a node, everybody is first compared with one leader. Documents that are connected already need no further comparison, which
settles groups of any number of near copies in one round without their pairs. From large nodes with several components left
those go whose shingles too seldom are in another component to meet the threshold with any of it. The rest are compared
exhaustively across components where that is linear work (SMALL pairs a document) and branched otherwise; what is left at the
last level is compared exhaustively too, so nothing is dropped. A document that is in many nodes with the same others is
compared with these in the largest only. Comparisons start with a 4-bit sketch and end with the full sets.

Exact copies are one class from the start. Only class representatives take part; membership is by the set's 128-bit digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import as_id, bounded_batches, components, fresh, session_of, spanning, stash, unstash

WORDS, PERCENT = 5, 80
COORDS = 64
#: Coordinates that a level chooses. A pair of similarity s stays together for a level with probability s ** CHOSEN.
CHOSEN = 2
#: Children of a document below a node. At 0.8 a pair shares 1.28 of them on average, and all paths below a node part, at any
#: depth, with probability (0.36 / 0.64) ** 2 = 0.32 at most.
BRANCHES = 2
#: At 0.8, a pair parts at the first level of all trees with probability (1 - 0.64) ** 18 = 1e-8, and at any number of levels with
#: (0.36 + 0.64 * 0.32) ** 18 = 3e-5.
TREES = 18
LEADERS = 4
#: Nodes with at most so many pairs a document that aren't connected yet are compared exhaustively.
SMALL = 1024
#: Nodes of so many documents or fewer list their pairs; larger ones are compared in tiles of TILE rows a side, SHINGLES at a time.
PAIRED, TILE, SHINGLES = 16, 512, 4096
#: Pairs of one leader that a task confirms.
SHARE = 2048
#: Levels; the last one is compared exhaustively.
DEPTH = 12
NIBBLES = 0x1111111111111111
SKETCH = ["s0", "s1", "s2", "s3"]

_rng = np.random.default_rng(20240611)
_mul = _rng.integers(1, 2**63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_add = _rng.integers(0, 2**63, COORDS, dtype=np.uint64)
_step = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_hash = xxhash.xxh3_64_intdigest


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; A-Z lower-cased, words between ASCII white space."""
    own = (text or b"").lower().split()
    n = len(own)
    if not n:
        return np.empty(0, np.uint64)
    if n < words:
        return np.array([_hash(b"\n".join(own), seed=n)], np.uint64)
    one = np.fromiter(map(_hash, own), np.uint64, n)
    h = one[: n - words + 1].copy()
    for i in range(1, words):
        h *= _step
        h += one[i : n - words + 1 + i]
    return np.unique(_mix(h))


def minwise(hashes: np.ndarray) -> np.ndarray:
    """The COORDS minwise values of a non-empty set, of any size in bounded memory."""
    low = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        x = hashes[at : at + 1024, None] * _mul
        x += _add
        np.minimum(low, x.min(axis=0), out=low)
    return _mix(low)


def _sketch(sig: np.ndarray) -> np.ndarray:
    nib = (sig & np.uint64(15)).reshape(4, 16)
    return (nib << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64).view(np.int64)


def signed(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, row, n, key, sig, s0..s3) of each row, row being a hash of id and text; key and sig null for empty sets."""
    bounded_batches(session_of(docs))
    schema = T.StructType.fromDDL("id long, row long, n long, key binary, sig array<long>, s0 long, s1 long, s2 long, s3 long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, sigs, sketches = [], [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                s = shingles(text, words)
                n.append(len(s))
                if len(s):
                    sig = minwise(s)
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sigs.append(sig.view(np.int64))
                    sketches.append(_sketch(sig).tolist())
                else:
                    keys.append(None)
                    sigs.append(None)
                    sketches.append([0] * 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int64())), *(pa.array(c, pa.int64()) for c in (zip(*sketches) if sketches else [[]] * 4))],
                names=schema.names,
            )

    return docs.select(as_id(id_col).alias("id"), _row(id_col, text_col).alias("row"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)


def _row(id_col: str, text_col: str):
    """What tells rows apart that repeat an id with other texts."""
    return F.xxhash64(as_id(id_col), F.col(f"`{text_col}`"))


def full_sets(docs: DataFrame, id_col: str, text_col: str, words: int, wanted: DataFrame) -> DataFrame:
    """(id, hashes) of the rows that are in wanted (id), id being their hash."""
    schema = T.StructType.fromDDL("id long, hashes array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x, words).view(np.int64) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=schema.names)

    picked = docs.select(_row(id_col, text_col).alias("id"), F.col(f"`{text_col}`").alias("text")).join(wanted.hint("merge"), "id", "left_semi")
    return picked.mapInArrow(run, schema)


def _child(node, branch: int = 0):
    """A node below a node: chosen by two coordinates that a hash of the node picks for the branch, and the values there."""
    at = [F.pmod(F.xxhash64(node, F.lit(b)), F.lit(COORDS)) for b in range(branch * CHOSEN, (branch + 1) * CHOSEN)]
    return F.xxhash64(node, *at, *[F.element_at("sig", (a + 1).cast("int")) for a in at])


def least_equal(percent: int) -> int:
    """Equal 4-bit minwise values of COORDS from which a pair is checked: six deviations below the mean at the threshold, so
    that about one pair in 1e9 there has fewer."""
    p = percent / 100 + (1 - percent / 100) / 16
    return int(COORDS * p - 6 * (COORDS * p * (1 - p)) ** 0.5)


def _alike(a: str, b: str, percent: int):
    """The sizes allow the threshold and the sketches agree often enough."""
    equal = sum(
        (F.lit(16) - F.bit_count(_fold(F.col(f"{a}{s}").bitwiseXOR(F.col(f"{b}{s}")))) for s in SKETCH),
        F.lit(0),
    )
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (equal >= least_equal(percent))


def _fold(x):
    y = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    y = y.bitwiseOR(F.shiftrightunsigned(y, 2))
    return y.bitwiseAND(F.lit(NIBBLES))


def _with_first_set(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (u, v) with the set of u as a. A leader of many pairs gets its set sent once to each SHARE of them, so that no task
    has all of them."""
    hot = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares")).where("shares > 1")
    dealt = pairs.join(hot, "u", "left").select("u", "v", F.pmod(F.xxhash64("v"), F.coalesce("shares", F.lit(1))).cast("int").alias("share"))
    spread = sets.select(F.col("id").alias("u"), F.col("hashes").alias("a")).join(hot, "u", "left")
    spread = spread.select("u", "a", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)).alias("share"))
    return dealt.join(spread, ["u", "share"]).drop("share")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets meet the threshold."""
    pairs = stash(pairs.distinct(), "pairs")
    if pairs.isEmpty():
        return pairs
    links = (
        _with_first_set(pairs, sets)
        .join(sets.select(F.col("id").alias("v"), F.col("hashes").alias("b")), "v")
        .withColumn("both", F.size(F.array_intersect("a", "b")))
        .where(100 * F.col("both") >= percent * (F.size("a") + F.size("b") - F.col("both")))
        .select("u", "v")
    )
    out = stash(links, "links")
    unstash(pairs)
    return out


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows of nodes with several components, with their number (all), the number of pairs within components (within), the
    largest component (major) and its rows (most), and whether few pairs a row are left."""
    each = rows.groupBy("node", "component").agg(F.count(F.lit(1)).alias("c"))
    per = each.groupBy("node").agg(F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("within"), F.max(F.struct("c", "component")).alias("m"))
    per = per.where("all * all > within").select("node", "all", "within", F.col("m.component").alias("major"), F.col("m.c").alias("most"))
    return rows.join(per.withColumn("few", (F.col("all") * F.col("all") - F.col("within")) / 2 <= SMALL * F.col("all")), "node")


def _linkable(rows: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The rows without those that no other component among them can have a link to: a link shares `percent` of a set's shingles
    at least, and so many are in no other component. held: (id, component, hashes) of all rows. A shingle is held against two
    members of its component at most, which lets more rows stay than need to, but never too few."""
    each = held.select("id", "component", F.explode("hashes").alias("h"))
    own = each.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("id").alias("a"), F.max("id").alias("b")).where("low = high")
    own = own.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("own"))
    sizes = held.select(F.col("id").alias("rep"), F.size("hashes").alias("size"))
    gone = sizes.join(own, "rep").where(100 * (F.col("size") - F.col("own")) < percent * F.col("size")).select("rep")
    return rows.join(gone, "rep", "left_anti")


def _compared(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that connect the components of each node as all links between them do.

    Similar documents meet in the nodes of most trees. They are compared in the largest node of each first (its home), with those
    that are at home there too; then nodes compare what isn't in their largest group of the same home, or of the same component,
    with everybody.
    """
    homes = rows.groupBy("rep").agg(F.max(F.struct("all", "node"))["node"].alias("home"))
    rows = stash(rows.join(homes, "rep").select("node", "rep", "component", "major", "most", "home"), "dense")
    strange = F.col("component") != F.col("major")
    at_home = _tiled(rows.where("node = home").withColumn("minor", strange), sets, percent)
    each = rows.groupBy("node", "home").agg(F.count(F.lit(1)).alias("c"))
    main = each.groupBy("node").agg(F.max(F.struct("c", "home")).alias("m")).select("node", F.col("m.c").alias("settled"), F.col("m.home").alias("of"))
    guests = rows.join(main, "node").withColumn("minor", F.when(F.col("settled") > F.col("most"), F.col("home") != F.col("of")).otherwise(strange))
    out = stash(at_home.unionByName(_tiled(guests, sets, percent)).distinct(), "links")
    unstash(rows)
    return out


def _tiled(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the minor members of each node and all members of other components, worked out tile by tile on the full
    sets; a tile is bounded by TILE rows a side, so no node has to fit a task, and no pairs are listed. Only as many links as connect a tile's
    documents are returned."""
    size = rows.groupBy("node").agg(F.ceil(F.count_if("minor") / TILE).cast("int").alias("down"), F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("across"), F.count(F.lit(1)).alias("all"))
    size = size.where("down > 0 and all > 1").drop("all")
    cut = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), n).cast("int")
    spread = lambda n: F.sequence(F.lit(0), n - 1)
    whole = rows.select("node", "rep", "component", "minor").join(size, "node")
    left = F.when(F.col("minor"), F.transform(spread(F.col("across")), lambda j: F.struct(cut(F.col("down"), 1).alias("i"), j.alias("j"), F.lit(True).alias("left"))))
    right = F.transform(spread(F.col("down")), lambda i: F.struct(i.alias("i"), cut(F.col("across"), 2).alias("j"), F.lit(False).alias("left")))
    placed = whole.withColumn("t", F.explode(F.concat(F.coalesce(left, F.array().cast("array<struct<i:int,j:int,left:boolean>>")), right)))
    placed = placed.select("node", "t.i", "t.j", "t.left", "component", "rep").join(sets.withColumnRenamed("id", "rep"), "rep")

    def compare(table: pa.Table) -> pa.Table:
        is_left = table["left"].to_numpy(zero_copy_only=False)
        rep, comp = table["rep"].to_numpy(), table["component"].to_numpy()
        column = table["hashes"].combine_chunks()
        flat, sizes = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
        # shingles as numbers, only those that more than one row has
        code, count = np.unique(flat, return_inverse=True, return_counts=True)[1:]
        row = np.repeat(np.arange(len(rep)), sizes)
        keep = count[code] > 1
        number = np.cumsum(count > 1) - 1
        code, row = number[code[keep]], row[keep]
        a, b = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        place = np.zeros(len(rep), np.int64)
        place[a], place[b] = np.arange(len(a)), np.arange(len(b))
        both = np.zeros((len(a), len(b)), np.float32)
        for at in range(0, int(number[-1]) + 1 if len(number) else 0, SHINGLES):
            here = (code >= at) & (code < at + SHINGLES)
            side = np.zeros((2, max(len(a), len(b)), SHINGLES), np.float32)
            side[np.where(is_left[row[here]], 0, 1), place[row[here]], code[here] - at] = 1
            both += side[0, : len(a)] @ side[1, : len(b)].T
        union = sizes[a][:, None] + sizes[b][None] - both
        hit = (100 * both >= percent * union) & (comp[a][:, None] != comp[b][None])
        ends = np.concatenate([rep[a], rep[b]])
        names, index = np.unique(ends, return_inverse=True)
        i, j = np.nonzero(hit)
        chosen = spanning(len(names), np.stack([index[i], index[len(a) + j]], axis=1))
        return pa.table({"u": pa.array([names[x] for x, _ in chosen], pa.int64()), "v": pa.array([names[y] for _, y in chosen], pa.int64())})

    return placed.groupBy("node", "i", "j").applyInArrow(compare, "u long, v long").distinct()


def links(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The signed rows, the class representatives, and edges (u, v) between these that connect what is linked: not all links,
    but the same components."""
    rows = stash(signed(docs, id_col, text_col, words), "signed")
    alive = rows.where((F.col("n") > 0) & F.col("id").isNotNull())
    reps = stash(alive.groupBy("key").agg(F.min(F.struct("id", "row", "n", *SKETCH, "sig")).alias("x")).select("key", F.col("x.row").alias("rep"), F.col("x.id").alias("least"), "x.n", *[f"x.{s}" for s in SKETCH], "x.sig"), "reps")
    sigs = reps.select("rep", "sig")
    paths = reps.withColumn("node", F.explode(F.array(*[_child(F.lit(t)) for t in range(TREES)])))
    nodes = paths.select("node", "rep", "n", *SKETCH)
    # a leader by one of a few hashes, so that trees name different ones, but not each its own
    rank = F.xxhash64("rep", F.pmod("node", F.lit(LEADERS)))
    size = nodes.select("node", "rep").groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min_by("rep", rank).alias("leader")).where("size > 1")
    full = stash(nodes.join(size, "node"), "nodes")
    # whoever shares a node with another: their texts are read once more, for the full sets
    sets = stash(full_sets(docs, id_col, text_col, words, full.select(F.col("rep").alias("id")).distinct()), "sets")
    lead = full.where("rep = leader").select("node", *[F.col(c).alias(f"l_{c}") for c in ("n", *SKETCH)])
    star = full.where("rep != leader").join(lead, "node").where(_alike("", "l_", percent))
    found = [_confirm(star.select(F.col("leader").alias("u"), F.col("rep").alias("v")), sets, percent)]
    comp = stash(components(found[0]), "comp").select(F.col("id").alias("rep"), "component")
    named = full.drop("size", "leader").join(comp, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    for depth in range(DEPTH):
        rest = stash(_mixed(named), "mixed")
        narrow = F.col("few") & (F.col("all") <= PAIRED)
        wide = rest.where(~narrow)
        held = None
        if not wide.isEmpty():
            held = stash(sets.join(wide.select(F.col("rep").alias("id"), "component").distinct(), "id"), "held")
            before = rest
            rest = stash(rest.where(narrow).unionByName(_mixed(_linkable(wide.select(*named.columns), held, percent))), "mixed")
            unstash(before)
        last = depth == DEPTH - 1
        few = rest if last else rest.where("few")
        # whoever isn't in the node's largest component, against all others there: pairs where these are few, else tiles
        sparse = few.where(F.col("all") <= PAIRED)
        other = sparse.select("node", *[F.col(c).alias(f"o_{c}") for c in ("rep", "n", "component", *SKETCH)])
        pairs = sparse.where("component != major").join(other, "node").where((F.col("component") != F.col("o_component")) & _alike("", "o_", percent))
        found.append(_confirm(pairs.select(F.least("rep", "o_rep").alias("u"), F.greatest("rep", "o_rep").alias("v")), sets, percent))
        dense = few.where(F.col("all") > PAIRED)
        if held is not None and not dense.isEmpty():
            found.append(_compared(dense, held.drop("component"), percent))
        if held is not None:
            unstash(held)
        large = rest.where("not few")
        if last or large.isEmpty():
            unstash(rest)
            break
        below = F.array(*[_child(F.col("node"), b) for b in range(BRANCHES)])
        above = named
        named = stash(large.join(sigs, "rep").withColumn("node", F.explode(F.array_distinct(below))).select("node", "rep", "n", *SKETCH, "component"), "branches")
        unstash(rest)
        if depth:
            unstash(above)
    unstash(full)
    unstash(sets)
    return rows, reps, _union(found)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _judged(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(id, row, n, component_id, kept) of every row."""
    rows, reps, edges = links(docs, id_col, text_col, words, percent)
    comp = components(edges).withColumnRenamed("id", "rep")
    both = reps.select("key", "rep", "least").join(comp, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    lowest = both.groupBy("component").agg(F.min("least").alias("component_id"))
    named = both.join(lowest, "component").select("key", "component_id")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    told = rows.select("id", "row", "n", "key").join(named, "key", "left").select("id", "row", "n", own.alias("component_id"))
    return told.withColumn("kept", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) of every row.

    Documents are linked where 100 * intersection >= percent * union of their shingle sets; component_id is the smallest id
    reachable. Null, empty or wordless texts link with nothing. Rows that repeat an id are judged by their own texts; a row
    whose id is null or no whole number links with nothing, has a null component and is kept. An empty table gives no rows.
    """
    told = _judged(docs, id_col, text_col, words, percent)
    return told.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents without the near copies: of each component, the one with the smallest id, with its own columns. Rows are
    decided one by one: rows that repeat an id by their own texts, equal rows alike."""
    key = fresh(docs, "_gone")
    gone = _judged(docs, id_col, text_col, words, percent).where(~F.col("kept")).select(F.col("row").alias(key)).distinct()
    return docs.join(stash(gone, "gone"), _row(id_col, text_col) == F.col(key), "left_anti")
