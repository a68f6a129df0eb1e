"""LM scoring by cross-entropy difference (lower-cased words, bigrams).

A target and a background model with one vocabulary, one order and one smoothing are counted over all documents of their
corpora; a document's score is the mean over its tokens of the background loss less the target loss. A document's own counts
are left out of both models while it is scored, so that no text is judged by itself.

Every word is in the vocabulary and every bigram in the models, whatever the size of the corpus; both are known by hashes, whose
length grows with the corpus up to 64 bits.
Documents are written in blocks of a few MB, a row each. A block's distinct words and bigrams with their counts are sent, sorted
and packed, to buckets of the hashes; a bucket adds them up and answers each block, in the order in which it asked, which keys
several documents hold and how often. A key that no other document holds needs no answer: without its own counts nothing is left
of it. A block is then scored with its texts at hand. So a key costs some bytes a block on the way there and few bits on the way
back, and neither the driver nor any task holds a model.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import as_id, bounded_batches, drop_shuffles, session_of, stash

#: Pseudo-counts of the backed-off distribution in a context, and of an unseen word.
BACKOFF, UNSEEN = 50.0, 0.5
#: Word keys of their own: the context of a first word, and any token.
START, TOKEN = 0, 2
#: Keys that a bucket adds up at once, about.
BUCKET = 1 << 22
#: Bytes of a text whose words are listed at once.
SLICE = 1 << 22
#: Bytes of the texts of a block, about; target ids up to which they are shipped instead of dealt with the texts.
BLOCK, SHIPPED = 3 << 19, 1 << 20
#: Keys are cut to so many bits more than it takes to number them: one in 3e7 shares its bits with another then.
SPARE = 25
#: Counts that travel with a key: tokens, tokens of target documents, these as the last word of a text, documents.
COUNTS = 5

_hash = xxhash.xxh3_64_intdigest
_space = re.compile(rb"[\x20\x09-\x0D]")
_ODD = np.uint64(1)


def _slices(text: bytes) -> Iterator[bytes]:
    """A text in parts that end between words."""
    at = 0
    while len(text) - at > SLICE:
        end = m.start() if (m := _space.search(text, at + SLICE)) else len(text)
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def word_keys(text: bytes | None, memo: dict[bytes, int]) -> np.ndarray:
    """Keys of the words of a text; even numbers."""
    out = []
    for part in _slices(text or b""):
        words = part.lower().split()
        for w in set(words).difference(memo):
            memo[w] = _hash(w) & ~1
        out.append(np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)))
    return np.concatenate(out)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Keys of bigrams; odd numbers."""
    x = (first + _ODD) * np.uint64(0x9E3779B97F4A7C15)
    x = ((x ^ (x >> np.uint64(32))) + second) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
    return (x ^ (x >> np.uint64(32))) | _ODD


def cut_keys(keys: np.ndarray, bits: int) -> np.ndarray:
    """The highest bits of keys, words even and bigrams odd as before."""
    return (keys >> np.uint64(64 - bits)) & ~_ODD | keys & _ODD if bits < 64 else keys


class Terms:
    """The distinct keys of some documents (with words), and where each token's word, context and bigram are among them.

    keys are sorted; group numbers the distinct (key, document) pairs, with the key of each, its document and own counts.
    """

    def __init__(self, texts: list[bytes | None], targets: list[bool], bits: int = 64) -> None:
        memo: dict[bytes, int] = {}
        words = [word_keys(t, memo) for t in texts]
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.target = np.array(targets, bool)
        full = np.flatnonzero(self.sizes)
        doc = np.repeat(np.arange(len(texts)), self.sizes)
        w = np.concatenate(words) if words else np.empty(0, np.uint64)
        n, begins = len(w), (np.cumsum(self.sizes) - self.sizes)[full]
        before = np.concatenate([[np.uint64(START)], w[:-1]]) if n else w
        before[begins] = START
        last = np.zeros(n, bool)
        last[(np.cumsum(self.sizes) - 1)[full]] = True
        # words, bigrams, and for each text its start and its tokens
        m = len(full)
        every = np.concatenate([cut_keys(w, bits), cut_keys(pair_keys(before, w), bits), np.full(m, START, np.uint64), np.full(m, TOKEN, np.uint64)])
        of = np.concatenate([doc, doc, full, full])
        weight = np.concatenate([np.ones(2 * n + m, np.int64), self.sizes[full]])
        final = np.concatenate([last, np.zeros(n + 2 * m, bool)])
        order = np.argsort(every, kind="stable")
        k, d = every[order], of[order]
        new_key = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.empty(0, bool)
        new_group = new_key.copy()
        new_group[1:] |= d[1:] != d[:-1]
        at = np.flatnonzero(new_group)
        self.keys, self.doc = k[new_key], d[at]
        self.key_of = np.cumsum(new_key)[at] - 1
        self.own = np.add.reduceat(weight[order], at) if len(at) else weight
        self.last = np.add.reduceat(final[order].astype(np.int64), at) if len(at) else np.empty(0, np.int64)
        group = np.empty(len(k), np.int64)
        group[order] = np.cumsum(new_group) - 1
        self.word, self.pair = group[:n], group[n : 2 * n]
        start = np.empty(len(texts), np.int64)
        start[full] = group[2 * n : 2 * n + m]
        self.tokens = np.zeros(len(texts), np.int64)
        self.tokens[full] = group[2 * n + m :]
        self.context = np.concatenate([[0], self.word[:-1]]) if n else self.word
        self.context = self.context.copy()
        self.context[begins] = start[full]
        self.token_doc = doc

    def counts(self) -> np.ndarray:
        """COUNTS by key over these documents."""
        hit = self.target[self.doc]
        rows = (self.own, self.own * hit, self.last, self.last * hit, np.ones(len(self.doc), np.int64))
        return np.stack([np.bincount(self.key_of, weights=x, minlength=len(self.keys)) for x in rows]).astype(np.int64)


def _planes(rows: np.ndarray) -> bytes:
    """Rows of numbers by place value, compressed."""
    return pa.compress(np.ascontiguousarray(np.ascontiguousarray(rows.astype("<u8")).view(np.uint8).reshape(len(rows), -1, 8).transpose(0, 2, 1)).tobytes(), codec="zstd", asbytes=True)


def _rows(blob: bytes, height: int, width: int) -> np.ndarray:
    raw = pa.decompress(blob, decompressed_size=height * width * 8, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(height, 8, width).transpose(0, 2, 1)).view("<u8")[:, :, 0]


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A question: sorted keys, as steps, with their COUNTS."""
    return len(keys).to_bytes(4, "little") + _planes(np.concatenate([np.diff(keys, prepend=np.uint64(0))[None], counts.astype(np.uint64)]))


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows = _rows(blob[4:], COUNTS + 1, int.from_bytes(blob[:4], "little"))
    return np.cumsum(rows[0], dtype=np.uint64), rows[1:].astype(np.int64)


def answer(shared: np.ndarray, counts: np.ndarray) -> bytes:
    """An answer: which of the keys asked for several documents hold, and the first counts of these over all documents."""
    bits = np.packbits(shared).tobytes()
    return len(shared).to_bytes(4, "little") + bits + _planes(counts[: COUNTS - 1, shared])


def answered(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """shared and counts of answer(), zero where no other document holds a key."""
    n = int.from_bytes(blob[:4], "little")
    stop = 4 + -(-n // 8)
    shared = np.unpackbits(np.frombuffer(blob[4:stop], np.uint8), count=n).astype(bool)
    counts = np.zeros((COUNTS - 1, n), np.int64)
    counts[:, shared] = _rows(blob[stop:], COUNTS - 1, int(shared.sum()))
    return shared, counts


def blocks(docs: DataFrame) -> DataFrame:
    """(block, ids, targets, sizes, texts): docs in rows of some BLOCK bytes of text; texts end to end and compressed, sizes
    their bytes, null for null texts."""
    codec = ("zstd", 3)

    def whole(held: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        texts = [t for c in table["text"].chunks for t in c.cast(pa.binary()).to_pylist()]
        raw = b"".join(t for t in texts if t)
        listed = lambda x: pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), x)
        flat = lambda c: pa.concat_arrays(table[c].chunks)
        sizes = pa.array([None if t is None else len(t) for t in texts], pa.int64())
        packed_ = pa.Codec(codec[0], compression_level=codec[1]).compress(raw, asbytes=True) if raw else b""
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), listed(flat("id")), listed(flat("target")), listed(sizes), pa.array([packed_], pa.binary())], names=["block", "ids", "targets", "sizes", "texts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            # a batch may be larger than a block
            begins = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))).astype(np.int64) // BLOCK
            ends = [0, *(np.flatnonzero(np.diff(begins)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
            for a, b in zip(ends[:-1], ends[1:]):
                held.append(batch.slice(a, b - a))
                size += pc.sum(pc.binary_length(held[-1].column(1))).as_py() or 0
                if size >= BLOCK:
                    yield whole(held, number)
                    number, held, size = number + 1, [], 0
        if held:
            yield whole(held, number)

    return docs.select("id", "text", "target").mapInArrow(run, "block long, ids array<long>, targets array<boolean>, sizes array<long>, texts binary")


def _terms(bits: int, targets: pa.ListScalar, sizes: pa.ListScalar, texts: pa.BinaryScalar) -> Terms:
    own = sizes.values.to_pylist()
    total = sum(n or 0 for n in own)
    raw = pa.decompress(texts.as_py(), decompressed_size=total, codec="zstd", asbytes=True) if total else b""
    ends = np.cumsum([0, *(n or 0 for n in own)]).tolist()
    return Terms([raw[a:b] for a, b in zip(ends[:-1], ends[1:])], targets.values.to_pylist(), bits)


def _cut(keys: np.ndarray, shift: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of sorted keys, and where each begins and the last one ends."""
    place = (keys >> shift).astype(np.int64) if shift < 64 else np.zeros(len(keys), np.int64)
    begins = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(keys) else np.empty(0, np.int64)
    return place[begins], np.concatenate([begins, [len(keys)]])


def sent(base: DataFrame, bits: int, shift: np.uint64) -> DataFrame:
    """(bucket, block, blob): the questions of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = _terms(bits, *(batch.column(k)[i] for k in (1, 2, 3)))
                counts, (bucket, ends) = x.counts(), _cut(x.keys, shift)
                blobs = [packed(x.keys[a:b], counts[:, a:b]) for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array([batch.column(0)[i].as_py()] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "block", "blob"])

    return base.select("block", "targets", "sizes", "texts").mapInArrow(run, "bucket long, block long, blob binary")


def returned(messages: DataFrame) -> DataFrame:
    """(block, bucket, words, blob): the answer of each bucket to each block that has one; and per bucket one row of a null block
    with the number of distinct words."""

    def add(table: pa.Table) -> pa.Table:
        got = [unpacked(b.as_py()) for b in table["blob"]]
        ends = np.cumsum([0, *(len(k) for k, _ in got)])
        keys, at = np.unique(np.concatenate([k for k, _ in got]), return_inverse=True)
        total = np.zeros((COUNTS, len(keys)), np.int64)
        for i, (_, counts) in enumerate(got):
            total[:, at[ends[i] : ends[i + 1]]] += counts
        shared = total[-1] > 1
        rows = [(b, answer(shared[mine], total[:, mine])) for i, b in enumerate(table["block"].to_pylist()) if shared[mine := at[ends[i] : ends[i + 1]]].any()]
        words = int((keys & _ODD == 0).sum() - np.isin(keys, [START, TOKEN]).sum())
        return pa.table(
            {"block": pa.array([*(b for b, _ in rows), None], pa.int64()), "bucket": pa.array([table["bucket"][0].as_py()] * (len(rows) + 1), pa.int64()),
             "words": pa.array([0] * len(rows) + [words], pa.int64()), "blob": pa.array([*(a for _, a in rows), None], pa.binary())}
        )

    return messages.groupBy("bucket").applyInArrow(add, "block long, bucket long, words long, blob binary")


def losses(x: Terms, shared: np.ndarray, counts: np.ndarray, types: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean target and background loss in nats of each text's tokens, its own counts left out, given which keys others hold too
    and their counts; texts without words get nan."""
    whole, known = counts[:, x.key_of].astype(float), shared[x.key_of]
    mine = x.target[x.doc]
    # a key that isn't shared has no counts but its own
    rest = lambda total, own: np.where(known, total - own, 0.0)
    sides = ((rest(whole[1], x.own * mine), rest(whole[3], x.last * mine)), (rest(whole[0], x.own), rest(whole[2], x.last)))
    # background counts are brought to the size of the target, so that smoothing weighs as much in both
    in_all, in_target = (float(counts[i, np.searchsorted(x.keys, np.uint64(TOKEN))]) for i in (0, 1))
    out, d = [], x.token_doc
    for (own, last), share in zip(sides, (1.0, in_target / max(in_all, 1.0))):
        p_word = (share * own[x.word] + UNSEEN) / (share * own[x.tokens][d] + UNSEEN * types)
        pair, seen = share * own[x.pair], share * (own - last)[x.context]
        loss = -np.log((pair + BACKOFF * p_word) / (np.maximum(seen, pair) + BACKOFF))
        out.append(np.bincount(d, weights=loss, minlength=len(x.sizes)) / np.where(x.sizes > 0, x.sizes, np.nan))
    return out[0], out[1]


def score(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(id_col, n_tokens, target_loss, background_loss, score, in_target) of every row of docs; targets holds ids in id_col.

    The background is all of docs. score is background_loss - target_loss: above 0, the text is more like the target. Texts
    that are null or have no word have no losses and a null score. Ids are whole numbers, others count as null; rows that repeat
    an id are scored, and counted, one by one; null ids are never targets. Other columns are left out; an empty table gives no
    rows, an empty target is a model of pseudo-counts alone. `bucket` bounds what a task adds up and changes no result.
    """
    spark = session_of(docs)
    bounded_batches(spark)
    chosen = targets.select(as_id(id_col).alias("id")).where("id is not null").distinct().withColumn("target", F.lit(True))
    keyed = docs.select(as_id(id_col).alias("id"), F.col(f"`{text_col}`").alias("text"))
    chosen = F.broadcast(chosen) if chosen.count() <= SHIPPED else chosen
    base = stash(blocks(keyed.join(chosen, "id", "left").withColumn("target", F.coalesce("target", F.lit(False)))), "blocks")
    size = base.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, n: s + F.coalesce(n, F.lit(0))))).first()[0] or 0
    # a token is some six bytes, and brings two keys at the most
    bits = min(64, (size // 3).bit_length() + SPARE)
    shift = np.uint64(bits - (max(1, size // 3 // bucket) - 1).bit_length())
    back = stash(returned(sent(base, bits, shift)), "counts")
    drop_shuffles(spark)
    types = (back.agg(F.sum("words")).first()[0] or 0) + 1

    def judge(texts: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        for i in range(texts.num_rows):
            ids, targets = texts["ids"][i], texts["targets"][i]
            x = _terms(bits, targets, texts["sizes"][i], texts["texts"][i])
            t = b = np.full(len(x.sizes), np.nan)
            if len(x.keys):
                shared, counts = np.zeros(len(x.keys), bool), np.zeros((COUNTS - 1, len(x.keys)), np.int64)
                held = dict(zip(told["bucket"].to_pylist(), told["blob"]))
                bucket, ends = _cut(x.keys, shift)
                for k, begin, end in zip(bucket.tolist(), ends[:-1], ends[1:]):
                    if k in held:
                        shared[begin:end], counts[:, begin:end] = answered(held[k].as_py())
                t, b = losses(x, shared, counts, types)
            number = lambda v: pa.array(v, pa.float64(), from_pandas=True)
            out.append(pa.table({"id": ids.values, "n": pa.array(x.sizes), "t": number(t), "b": number(b), "in_target": targets.values}))
        return pa.concat_tables(out) if out else pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "t": pa.array([], pa.float64()), "b": pa.array([], pa.float64()), "in_target": pa.array([], pa.bool_())})

    answers = back.where("block is not null").select("block", "bucket", "blob")
    told = base.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(judge, "id long, n long, t double, b double, in_target boolean")
    return told.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), F.col("t").alias("target_loss"), F.col("b").alias("background_loss"), (F.col("b") - F.col("t")).alias("score"), "in_target")
