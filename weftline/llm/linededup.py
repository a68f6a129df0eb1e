"""Line dedup by a log-template tree of fixed depth.

A text is cut into lines and these into sentences. A unit goes down the tree by its number of tokens and its LEAD first tokens,
tokens with a digit being read as a wildcard. In the leaf, units of WHOLE tokens or more belong to two similarity groups: those
that agree in all but the first half of what follows the lead, and those that agree in all but the second half. So a field that
varies within either half is generalised to a wildcard by the lines that are seen to share the rest, while shorter units must
agree in every token. A group is known by the hash of its path and constant tokens, so no task has to see a whole leaf, and what
a unit belongs to doesn't depend on the order or the number of lines.

A template found in two or more documents recurs. Only its smallest and largest document id are gathered, by a partial
aggregation that no hot template can skew. Runs of recurring units with LEAST_TOKENS tokens or more in all are dropped from
every document but the first that holds each; what recurs alone and is shorter (`Yes.`) is ordinary language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import as_id, bounded_batches, fresh, map_batches, session_of, stash, unstash

LEAD, WHOLE = 4, 10
LEAST_TOKENS = 6
#: With spare_copies: share of the larger document's words that a document must have from one earlier document to be left whole.
COPY = 2 / 3
WILD = b"<*>"

_cut = re.compile(rb"(\n+|(?<=[.!?])[ \t]+)")
_digit = re.compile(rb"[0-9]")
_hash = xxhash.xxh3_64_digest


def units(text: bytes) -> list[bytes]:
    """Units at even places, the white space after each at odd ones."""
    return _cut.split(text)


def templates(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the templates that the units of a text belong to, in order, and with each its unit's number of tokens, or -1
    if it is a unit's second key. Units without tokens have none."""
    keys, sizes = [], []
    for unit in units(text)[::2]:
        tokens = unit.split()
        n = len(tokens)
        if not n:
            continue
        if _digit.search(unit):
            tokens = [WILD if _digit.search(t) else t for t in tokens]
        if n < WHOLE:
            keys.append(_hash(b" ".join(tokens), n))
            sizes.append(n)
        else:
            half = (LEAD + n) // 2
            keys += _hash(b" ".join(tokens[:LEAD] + tokens[half:]), n), _hash(b" ".join(tokens[:half]), n + (1 << 31))
            sizes += n, -1
    return np.frombuffer(b"".join(keys), ">i8").astype(np.int64), np.array(sizes, np.int32)


def parsed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, keys, sizes) of each document with an id and a text."""
    bounded_batches(session_of(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [templates(text) for text in batch.column(2).cast(pa.binary()).to_pylist()]
            ends = pa.array(np.cumsum([0, *(len(k) for k, _ in found)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x) if x else np.empty(0, t), t)) for x, t in zip(zip(*found) if found else ((), ()), (pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["id", "text_hash", "keys", "sizes"])

    text = F.col(f"`{text_col}`")
    picked = docs.select(as_id(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).where("id is not null and text is not null")
    return picked.mapInArrow(run, "id long, text_hash long, keys array<long>, sizes array<int>")


def recurring(seen: DataFrame, spare_copies: bool = False) -> DataFrame:
    """(id, gone, first, words): per document that has any, the templates that an earlier document holds too; with spare_copies
    also the first holder of each and its number of words."""
    flat = seen.select("id", F.explode(F.array_distinct("keys")).alias("key"))
    common = flat.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where(F.col("first") != F.col("last")).select("key", "first")
    if not spare_copies:
        hits = flat.join(common, "key").where(F.col("id") != F.col("first"))
        none = F.lit(None).cast("array<long>")
        return hits.groupBy("id").agg(F.collect_set("key").alias("gone")).select("id", "gone", none.alias("first"), none.alias("words"))
    # of rows that repeat an id the longest counts; a document is the first holder of no more templates than it has
    words = F.aggregate("sizes", F.lit(0).cast("long"), lambda s, n: s + F.greatest(n, F.lit(0)))
    size = seen.groupBy(F.col("id").alias("first")).agg(F.max(words).alias("words"))
    hits = flat.join(common.join(size, "first"), "key").where(F.col("id") != F.col("first"))
    got = hits.groupBy("id").agg(F.collect_set(F.struct("key", "first", "words")).alias("x"))
    return got.select("id", F.col("x.key").alias("gone"), F.col("x.first").alias("first"), F.col("x.words").alias("words"))


def dropped(keys: np.ndarray, sizes: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Numbers of the units in runs of recurring ones that have LEAST_TOKENS tokens or more."""
    begins = np.flatnonzero(sizes >= 0)
    hit = np.logical_or.reduceat(np.isin(keys, gone), begins)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    total = np.concatenate([[0], np.cumsum(sizes[begins])])
    runs = [np.arange(a, b) for a, b in zip(edge[::2], edge[1::2]) if total[b] - total[a] >= LEAST_TOKENS]
    return np.concatenate(runs) if runs else np.empty(0, np.int64)


def is_copy(keys: np.ndarray, sizes: np.ndarray, gone: np.ndarray, first: np.ndarray, words: np.ndarray) -> bool:
    """Whether one earlier document holds COPY or more of the words of the larger of the two."""
    begins = np.flatnonzero(sizes >= 0)
    unit, size = np.cumsum(sizes >= 0) - 1, sizes[begins]
    order = np.argsort(gone)
    at = order[np.minimum(np.searchsorted(gone[order], keys), len(gone) - 1)]
    ok = gone[at] == keys
    # a unit counts once for each document that holds it first under either key
    pairs = np.unique(np.stack([first[at[ok]], unit[ok]]), axis=1)
    holders, place = np.unique(pairs[0], return_inverse=True)
    shared = np.bincount(place, weights=size[pairs[1]], minlength=len(holders))
    of = dict(zip(first.tolist(), words.tolist()))
    return any(n >= COPY * max(int(size.sum()), of[h]) for h, n in zip(holders.tolist(), shared.tolist()))


def drops(docs: DataFrame, id_col: str, text_col: str, spare_copies: bool) -> DataFrame:
    """(id, text_hash, units): the numbers of the units to drop of the documents that lose any."""
    seen = stash(parsed(docs, id_col, text_col), "templates")
    found = recurring(seen, spare_copies)

    def lists(column: pa.ListArray) -> list[np.ndarray]:
        flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for keys, sizes, gone, first, words in zip(*(lists(batch.column(i)) for i in range(2, 7))):
                none = not len(keys) or (spare_copies and is_copy(keys, sizes, gone, first, words))
                out.append(np.empty(0, np.int64) if none else dropped(keys, sizes, gone))
            some = [i for i, x in enumerate(out) if len(x)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(some, pa.int64())) for i in (0, 1)), pa.array([out[i] for i in some], pa.list_(pa.int32()))], names=["id", "text_hash", "units"])

    both = seen.join(found, "id").select("id", "text_hash", "keys", "sizes", "gone", "first", "words")
    out = stash(both.mapInArrow(run, "id long, text_hash long, units array<int>").distinct(), "gone")
    unstash(seen)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spare_copies: bool = False, count_col: str = "n_dropped") -> DataFrame:
    """docs with recurring units removed from the text, plus count_col (long), the number of units removed.

    With spare_copies, a document of which one earlier document holds most is left whole, for near-duplicate removal to decide
    on: without the shared units nothing would tell it for a copy. Null texts stay null; empty ones have nothing to remove.
    Ids are whole numbers; rows whose id is null or no number are neither compared nor changed. Rows that repeat an id are one
    document, so what they share doesn't recur, nor do repeats inside a document. An empty table stays empty; a column
    of docs named count_col is replaced, and any other names may occur in docs.
    """
    bounded_batches(session_of(docs))
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != count_col.lower()])
    names = docs.columns
    key, text_hash, gone = (fresh(docs, c) for c in ("_id", "_text_hash", "_units"))
    found = drops(docs, id_col, text_col, spare_copies).select(F.col("id").alias(key), F.col("text_hash").alias(text_hash), F.col("units").alias(gone))
    joined = docs.join(found, (as_id(id_col) == F.col(key)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(text_hash)), "left").drop(key, text_hash)
    schema = T.StructType([*docs.schema.fields, T.StructField(count_col, T.LongType(), False)])
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, told = batch.column(at), batch.column(len(names))
            counts = told.value_lengths().fill_null(0).cast(pa.int64())
            if told.null_count < len(told):
                texts = column.cast(pa.binary()).to_pylist()
                for i in np.flatnonzero(counts.to_numpy()).tolist():
                    parts, drop, out, nth = units(texts[i]), set(told[i].as_py()), [], -1
                    for k in range(0, len(parts), 2):
                        nth += bool(full := parts[k].strip())
                        if not full or nth not in drop:
                            out += parts[k : k + 2]
                    texts[i] = b"".join(out).rstrip()
                column = pa.array(texts, pa.binary()).cast(column.type)
            yield pa.RecordBatch.from_arrays([*(column if k == at else batch.column(k) for k in range(len(names))), counts], names=[*names, count_col])

    return map_batches(joined, run, schema)
