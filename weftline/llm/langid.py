"""Language identification: hashed subword embeddings, averaged over a text, under a linear softmax; trained by stochastic
gradient descent in numpy and calibrated by temperature, with a rejection threshold from held-back rows.

The training sample is bounded: PER_LANG rows of each language, those with the smallest hash of a key. Texts are turned into
counts of hashed n-grams on the executors, so that at most PER_LANG x languages x BUCKETS counts reach the driver. Prediction
reads whole texts; since the model is linear, only the product of embeddings and output weights is shipped, BUCKETS x languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftline.llm.common import bounded_batches, map_batches, session_of

BITS, DIM, ORDERS = 15, 24, (1, 2, 3, 4)
BUCKETS = 1 << BITS
PER_LANG, EPOCHS, BATCH, RATE, EMB_RATE = 500, 12, 32, 1.0, 5.0
#: Share of the sample that is held back for calibration.
HELD = 0.2
UNKNOWN = "und"
CHUNK = 1 << 18

_fold: np.ndarray | None = None


def _table() -> np.ndarray:
    """Per code point: its lower-case letter, or 0 for what is no letter."""
    global _fold
    if _fold is None:
        _fold = np.array([(ord(c.lower()) if len(c.lower()) == 1 else i) if (c := chr(i)).isalpha() else 0 for i in range(0x110000)], np.uint32)
    return _fold


def _hashed(x: np.ndarray, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and bucket of the n-grams of folded code points x that start before stop; none spans two words, but an end of a
    word may be its first or last sign."""
    letter, x = x != 0, x.astype(np.uint64)
    h, inner = np.zeros(len(x), np.uint64), np.ones(len(x), bool)
    at, buckets = [], []
    for n in range(1, max(ORDERS) + 1):
        m = len(x) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x100000001B3) + x[n - 1 :]
        if n > 2:
            inner = inner[:m] & letter[n - 2 : n - 2 + m]
        if n in ORDERS:
            ok = letter[:m] if n == 1 else letter[:m] | letter[1 : 1 + m] if n == 2 else inner[:m]
            start = np.flatnonzero(ok[:stop])
            at.append(start)
            buckets.append(((h[start] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(at), np.concatenate(buckets)


def _folded(text: str) -> np.ndarray:
    fold = _table()
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return fold[raw]


def _slices(x: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """x in parts of bounded size that overlap by what the longest n-gram needs, and where each part's own starts end."""
    for at in range(0, len(x), CHUNK):
        yield x[at : at + CHUNK + max(ORDERS) - 1], CHUNK


def ngrams(text: str) -> np.ndarray | None:
    """Counts of the hashed n-grams of the words of a text; None if it has no letter."""
    x = np.concatenate([[0], _folded(text), [0]]).astype(np.uint32)
    if not x.any():
        return None
    return sum(np.bincount(_hashed(part, stop)[1], minlength=BUCKETS) for part, stop in _slices(x))


def sums(texts: list[str | None], scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of scores over the n-grams of each text, and their number: 0 where a text is null or has no letter."""
    total, n = np.zeros((len(texts), scores.shape[1])), np.zeros(len(texts), np.int64)
    gap, i = np.zeros(1, np.uint32), 0
    while i < len(texts):
        parts, owner, size = [gap], [], 1
        while i < len(texts) and (size == 1 or size + len(texts[i] or "") < CHUNK):
            x = _folded(texts[i] or "")
            owner.append((i, size))
            parts += [x, gap]
            size += len(x) + 1
            i += 1
        x = np.concatenate(parts)
        rows, begins = np.array(owner).T
        done = 0
        for part, stop in _slices(x):
            at, bucket = _hashed(part, stop)
            # a gap before a text starts an n-gram of that text
            own = rows[np.searchsorted(begins, at + done + 1, side="right") - 1]
            n += np.bincount(own, minlength=len(texts))
            for k in range(scores.shape[1]):
                total[:, k] += np.bincount(own, weights=scores[bucket, k], minlength=len(texts))
            done += stop
    return total, n


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # BUCKETS x languages: embedding times output weight, over the temperature
    bias: np.ndarray
    threshold: float


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def train(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_langs: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings times weights, and bias, by SGD over batches; features are (bucket, count) pairs of arrays."""
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = rng.standard_normal((DIM, n_langs)).astype(np.float32), np.zeros(n_langs, np.float32)
    steps, done = EPOCHS * -(-len(labels) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for a in range(0, len(order), BATCH):
            rows = order[a : a + BATCH]
            x = np.zeros((len(rows), BUCKETS), np.float32)
            for i, r in enumerate(rows):
                x[i, features[r][0]] = features[r][1] / features[r][1].sum()
            hidden = x @ emb
            err = _softmax(hidden @ out + bias)
            err[np.arange(len(rows)), labels[rows]] -= 1
            rate = RATE * (1 - done / steps)
            back = err @ out.T
            out -= rate * hidden.T @ err / len(rows)
            bias -= 0.1 * rate * err.mean(axis=0)
            emb -= EMB_RATE * rate * (x.T @ back) / len(rows)
            done += 1
    return emb @ out, bias


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = PER_LANG) -> Model | None:
    """A model from the rows with a language and a text with letters; None if there are none."""
    bounded_batches(session_of(docs))
    told = docs.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("order")).where("lang is not null and text is not null")
    # Only hashes are ranked, the smallest ones of each task first; texts stay where they are. A model has a column a language,
    # so there are few of these.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order"))
    last = told.select("lang", "order").withColumn("rank", rank).where(F.col("rank") <= per_lang).groupBy("lang").agg(F.max("order").alias("last"))
    sample = told.join(F.broadcast(last), "lang").where(F.col("order") <= F.col("last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, order, at, n = [], [], [], []
            for label, t, o in zip(*(batch.column(i).to_pylist() for i in range(3))):
                counts = ngrams(t)
                if counts is not None:
                    langs.append(label)
                    order.append(o)
                    at.append(np.flatnonzero(counts).astype(np.int32))
                    n.append(counts[at[-1]].astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(order, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.float32()))], names=["lang", "order", "at", "n"])

    features = sample.select("lang", "text", "order").mapInArrow(run, "lang string, order long, at array<int>, n array<float>")
    # rows that repeat key, text and language are one
    rows = features.groupBy("lang", "order").agg(F.min(F.struct("at", "n")).alias("x")).select("lang", "order", "x.*").toPandas()
    if rows.empty:
        return None
    rows = rows.sort_values(["order", "lang"], kind="stable").reset_index(drop=True)
    langs = sorted(rows["lang"].unique())
    labels = rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()
    features = [(np.asarray(a, np.int32), np.asarray(n, np.float32)) for a, n in zip(rows["at"], rows["n"])]
    held = np.arange(len(rows)) % round(1 / HELD) == 0 if len(rows) >= 50 else np.zeros(len(rows), bool)
    keep = np.flatnonzero(~held)
    scores, bias = train([features[i] for i in keep], labels[keep], len(langs))
    temperature, threshold = 1.0, 0.0
    if held.any():
        at = np.flatnonzero(held)
        z = np.stack([features[i][1] @ scores[features[i][0]] / features[i][1].sum() for i in at]) + bias
        grid = np.geomspace(0.05, 20, 60)
        temperature = float(min(grid, key=lambda t: -np.log(_softmax(z / t)[np.arange(len(at)), labels[at]] + 1e-12).mean()))
        best = _softmax(z / temperature)
        right = best.max(axis=1)[best.argmax(axis=1) == labels[at]]
        # texts less sure than all but one in a hundred of those that are told right
        threshold = float(np.quantile(right, 0.01)) if len(right) else 0.0
    return Model(langs, (scores / temperature).astype(np.float32), (bias / temperature).astype(np.float32), threshold)


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs without text, with lang_pred, score (calibrated, 0 to 1) and rejected (less sure than the model's threshold).

    Null texts and texts without letters are `und` with score 0 and rejected, as is everything without a model; an empty
    table stays empty; columns of docs with the result's names are replaced.
    """
    bounded_batches(session_of(docs))
    gone = {"lang_pred", "score", "rejected"}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c == text or c.lower() not in gone])
    names = [c for c in docs.columns if c != text]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            if model and texts:
                total, n = sums(texts, model.scores)
                p = _softmax(total / np.maximum(n, 1)[:, None] + model.bias)
                told = [model.langs[k] if c else UNKNOWN for k, c in zip(p.argmax(axis=1).tolist(), n.tolist())]
                score = np.where(n > 0, np.minimum(p.max(axis=1), 1.0), 0.0).tolist()
            else:
                told, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            low = model.threshold if model else 1.0
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(told, pa.string()), pa.array(score, pa.float64()), pa.array([t == UNKNOWN or s < low for t, s in zip(told, score)], pa.bool_())],
                names=schema.names,
            )

    return map_batches(docs, run, schema)
