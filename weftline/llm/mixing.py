"""Mixing to target weights with soft membership.

A linear softmax over hashed presence of words and of their beginnings and a few shape features, fitted on a bounded sample of
the labelled table, gives each document posteriors over the domains. Rates are then fitted by projected gradient on the least
squares between expected and wanted token totals of the domains: ROUNDS plain steps, then one implicit step, which no domain's
rareness slows down. Its length is 1 over RIDGE times the rarest domain's share: what it leaves of the squares is no more than
that times its own square, so totals are met as far as posteriors allow, while rates stay as near as they can to where the plain
steps left them, instead of resting on the few documents whose posteriors are purest. The step is p times a small vector, which
Newton's method finds. A document's state is its tokens and posteriors; since all its steps follow from the residuals of the
rounds before, each round ships those few numbers and adds up the totals anew. No rate is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftline.llm.common import as_id, bounded_batches, map_batches, session_of, stash

BITS = 16
#: Labelled documents of each domain that the classifier is fitted on, those with the smallest hash. Up to 1000 Spark keeps the
#: smallest ones of each task before it shuffles, so that no task sees a whole domain.
PER_DOMAIN = 1000
#: Signs of a word's beginning that are a feature beside the word, documents that a feature must stand in, and standard errors by
#: which its share must differ.
PREFIX, LEAST_DOCS, LEAST_Z = 6, 5, 4.0
STEPS, RATE, DECAY = 400, 1.0, 1e-4
#: Words whose features a task remembers.
REMEMBERED = 60_000
ROUNDS = 24
#: Share of the rarest domain's total that the implicit step may leave, and the least share that a domain counts with.
RIDGE, LEAST_SHARE = 0.01, 1e-6
#: Newton rounds of the implicit step, and step lengths that a round tries at once.
NEWTON, LENGTHS = 60, 0.25 ** np.arange(12)
#: Share of the wanted total by domain; `anchor` is the domain that is to be kept in full.
WEIGHTS = {"good": 0.9, "low": 0.1, "toxic": 0.0}
ANCHOR = "good"

_hash = xxhash.xxh32_intdigest


def domain(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from quality and toxic; several rows of one document count as the worst of them."""
    worst = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    return worst.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").otherwise("good").alias("domain"))


def _of_word(raw: bytes) -> tuple[int, int]:
    """Buckets of a word without its marks and of its beginning; twice the word's where it is no longer."""
    w = raw.strip(b".,;:!?\"'()").lower()
    at = _hash(w) >> (32 - BITS)
    return at, _hash(w[:PREFIX], 1) >> (32 - BITS) if len(w) > PREFIX else at


def features(text: bytes, memo: dict[bytes, tuple[int, int]]) -> tuple[np.ndarray, int]:
    """Distinct hashed features of a whole text, and its number of words; memo is a task's, for words that come again."""
    words = text.split()
    n = len(words)
    kinds = set(words)
    own: set[int] = set()
    for w in kinds:
        got = memo.get(w)
        if got is None:
            got = _of_word(w)
            if len(memo) < REMEMBERED:
                memo[w] = got
        own.update(got)
    m = max(n, 1)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower = int(hist[65:91].sum()), int(hist[97:123].sum())
    shape = (len(kinds) / m, upper / max(upper + lower, 1), int(hist[[33, 35, 36, 37, 38, 42, 60, 62, 124]].sum()) / m, min(n, 100) / 100)
    own.update(_hash(b"\0%d:%d" % (i, int(8 * min(x, 1)))) >> (32 - BITS) for i, x in enumerate(shape))
    return np.fromiter(own, np.int64, len(own)), n


@dataclass
class Model:
    domains: list[str]
    weights: np.ndarray  # features x domains
    bias: np.ndarray


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def train(rows: list[np.ndarray], y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a softmax on the features whose share of documents differs between a domain and the rest by more than
    LEAST_Z standard errors; gradient descent with momentum, domains weighing the same whatever their number of rows."""
    size = 1 << BITS
    at = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    n = np.bincount(y, minlength=k).astype(float)
    df = np.stack([np.bincount(at[y[row] == j], minlength=size) for j in range(k)], axis=1).astype(float)
    rest_n, rest = np.maximum(n.sum() - n, 1), df.sum(axis=1, keepdims=True) - df
    pooled = (df.sum(axis=1, keepdims=True) + 1) / (n.sum() + 2)
    z = np.abs(df / np.maximum(n, 1) - rest / rest_n) / np.sqrt(pooled * (1 - pooled) * (1 / np.maximum(n, 1) + 1 / rest_n))
    strength = np.where(df.sum(axis=1) >= LEAST_DOCS, z.max(axis=1), 0)
    pick = np.flatnonzero(strength > LEAST_Z)
    new = np.full(size, -1)
    new[pick] = np.arange(len(pick))
    ok = new[at] >= 0
    col, row = new[at[ok]], row[ok]
    weight = 1.0 / n[y] / k
    w, b, vw, vb = np.zeros((len(pick), k)), np.zeros(k), np.zeros((len(pick), k)), np.zeros(k)
    for _ in range(STEPS):
        logit = np.stack([np.bincount(row, weights=w[col, j], minlength=len(rows)) for j in range(k)], axis=1) + b
        err = _softmax(logit)
        err[np.arange(len(y)), y] -= 1
        err *= weight[:, None]
        g = np.stack([np.bincount(col, weights=err[row, j], minlength=len(pick)) for j in range(k)], axis=1) + DECAY * w
        vw = 0.9 * vw - RATE * g
        vb = 0.9 * vb - RATE * err.sum(axis=0)
        w, b = w + vw, b + vb
    full = np.zeros((size, k))
    full[pick] = w
    return full, b


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_domain: int = PER_DOMAIN) -> Model | None:
    """The domain classifier. The sample is chosen from the labels alone; priors are those of all labelled rows."""
    spark = session_of(docs)
    bounded_batches(spark)
    named = domain(labels)
    rank = F.row_number().over(Window.partitionBy("domain").orderBy(F.xxhash64("doc_id"), "doc_id"))
    # at most per_domain rows of each domain: this side is small whatever the tables
    chosen = stash(named.withColumn("rank", rank).where(F.col("rank") <= per_domain).select("doc_id", "domain"), "sample")
    counts = {r["domain"]: r["count"] for r in named.groupBy("domain").count().collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, tuple[int, int]] = {}
        for batch in batches:
            got = [features(t or b"", memo)[0].astype(np.int32) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(got, pa.list_(pa.int32()))], names=["id", "domain", "at"])

    picked = docs.select(as_id(id_col).alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("doc_id")).select("id", "text", "domain")
    rows = picked.mapInArrow(run, "id long, domain string, at array<int>").toPandas().sort_values(["id", "domain"], kind="stable")
    if rows.empty:
        return None
    names = sorted(rows["domain"].unique())
    y = rows["domain"].map({d: i for i, d in enumerate(names)}).to_numpy()
    w, b = train([np.asarray(a, np.int64) for a in rows["at"]], y, len(names))
    prior = np.array([counts[d] for d in names], float)
    return Model(names, w.astype(np.float32), b + np.log(prior / prior.sum()) - np.log(1 / len(names)))


def posteriors(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without text, with n_tokens (words) and p, an array of posteriors in the order of model.domains."""
    bounded_batches(session_of(docs))
    names = [c for c in docs.columns if c != text_col]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("n_tokens", T.LongType()), T.StructField("p", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, tuple[int, int]] = {}
        for batch in batches:
            got = [features(t or b"", memo) for t in batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist()]
            p = [_softmax(model.weights[at].sum(axis=0) + model.bias) for at, _ in got]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array([n for _, n in got], pa.int64()), pa.array([x.tolist() for x in p], pa.list_(pa.float64()))], names=schema.names
            )

    return map_batches(docs, run, schema)


def replay(p: np.ndarray, history: list[np.ndarray], most: float | None) -> np.ndarray:
    """Rates after the steps of the rounds so far: from 1, down the gradient, back into [0, most] each time."""
    r = np.ones(len(p))
    for step in history:
        r = np.clip(r + p @ step, 0, most)
    return r


def _wanted(all_: np.ndarray, domains: list[str], weights: dict[str, float], anchor: str) -> np.ndarray:
    """Wanted totals by domain, given those of all documents at rate 1."""
    share = np.array([weights.get(d, 0.0) for d in domains])
    budget = all_[domains.index(anchor)] / share[domains.index(anchor)] if anchor in domains and weights.get(anchor) else all_.sum()
    return budget * share


def fit_rates(state: DataFrame, domains: list[str], weights: dict[str, float], anchor: str, most: float | None, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Steps by domain and round. state holds n_tokens and p; each round reads it once and returns one small vector a task."""
    k = len(domains)

    def totals(history: list[np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(k)
            for batch in batches:
                p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                n = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
                sums += p.T @ (n * replay(p, history, most))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(sums, pa.float64())], names=["i", "x"])

        rows = state.select("n_tokens", "p").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(k)
        for r in rows:
            out[r["i"]] = r["x"]
        return out

    now = totals([])
    scale = now.sum()
    if scale <= 0:
        return []
    want, history, last = _wanted(now, domains, weights, anchor), [], None
    for _ in range(rounds):
        residual = (now - want) / scale
        if np.abs(residual).max() < 1e-4 or (last is not None and np.abs(last - residual).max() < 1e-6):
            break
        last = residual
        # with tokens as the metric a step is p times the residual, and the curvature is at most the largest domain's share
        history.append(-residual * 1.2 / max(np.maximum(now, want).max() / scale, 1e-9))
        now = totals(history)
    return history


def settled(state: DataFrame, domains: list[str], weights: dict[str, float], anchor: str, most: float | None, history: list[np.ndarray]) -> list[np.ndarray]:
    """The steps of history and the implicit one; RuntimeError if it is not found.

    With r = clip(before + p @ x, 0, most) and eps * x = -residual(r), a projected-gradient step of length 1 / eps by the residual
    at its own end: the one minimum of the squares plus eps times those of the change, tokens being the metric.
    """
    k = len(domains)

    def sums(history: list[np.ndarray], tried: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """By step tried: the convex function's sum, totals, and curvature."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((len(tried), 1 + k + k * k))
            for batch in batches:
                p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                n = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
                before = replay(p, history, most)
                for row, step in zip(out, tried):
                    z = before + p @ step
                    r = np.clip(z, 0, most)
                    free = n * ((z > 0) & (z < (np.inf if most is None else most)))
                    row += np.concatenate([[n @ (r * z - r * r / 2)], p.T @ (n * r), ((p * free[:, None]).T @ p).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size), pa.int32()), pa.array(out.ravel(), pa.float64())], names=["i", "x"])

        out = np.zeros((len(tried), 1 + k + k * k))
        for r in state.select("n_tokens", "p").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
            out.flat[r["i"]] = r["x"]
        return [(x[0], x[1 : 1 + k], x[1 + k :].reshape(k, k)) for x in out]

    all_ = sums([], np.zeros((1, k)))[0][1]
    scale = all_.sum()
    if scale <= 0:
        return history
    want = _wanted(all_, domains, weights, anchor)
    own = np.maximum(all_, LEAST_SHARE * scale)
    eps = RIDGE * own.min() / scale
    x = np.zeros(k)
    at = sums(history, x[None])[0]

    def slope(x: np.ndarray, at) -> np.ndarray:
        return eps * x + (at[1] - want) / scale

    def value(x: np.ndarray, at) -> float:
        return eps * (x @ x) / 2 + (at[0] - want @ x) / scale

    for _ in range(NEWTON):
        g = slope(x, at)
        if np.abs(g).max() <= max(1e-4 * eps, 1e-12):
            return [*history, x]
        way = -np.linalg.solve(at[2] / scale + eps * np.eye(k), g)
        tried = x + LENGTHS[:, None] * way
        got = sums(history, tried)
        falls = [i for i, a in enumerate(LENGTHS) if value(tried[i], got[i]) <= value(x, at) + 1e-4 * a * (g @ way)]
        # rounding hides the fall close to the minimum; the slope still tells
        best = falls[0] if falls else min(range(len(tried)), key=lambda i: np.abs(slope(tried[i], got[i])).max())
        x, at = tried[best], got[best]
    raise RuntimeError(f"the implicit step did not settle in {NEWTON} rounds: slope {np.abs(slope(x, at)).max():.1e}, step {x}")


def rates(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: dict[str, float] | None = None, anchor: str = ANCHOR, most: float | None = None) -> tuple[DataFrame, list[str]]:
    """docs without text, with n_tokens, p, rate and copies, and the domains in the order of p.

    copies is the rate rounded up or down by a hash of the id, right in expectation; most bounds the rate (None: it is only
    nonnegative, so domains can be raised). Null and empty texts have no tokens, only shape features. Repeated rows and ties get equal rates; an empty
    table gives no rows; without labels every rate is 1.
    """
    gone = {"n_tokens", "p", "rate", "copies"}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c in (id_col, text_col) or c.lower() not in gone])
    model = fit(docs, labels, id_col, text_col) or Model([anchor], np.zeros((1 << BITS, 1), np.float32), np.zeros(1))
    state = stash(posteriors(docs, model, text_col), "posteriors")
    history = fit_rates(state, model.domains, weights or WEIGHTS, anchor, most)
    history = settled(state, model.domains, weights or WEIGHTS, anchor, most, history)
    schema = T.StructType([*state.schema.fields, T.StructField("rate", T.DoubleType())])
    at, k = state.columns.index("p"), len(model.domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(replay(p, history, most), pa.float64())], names=schema.names)

    chance = F.pmod(F.xxhash64(F.lit("mix"), F.col(f"`{id_col}`")), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")
    return map_batches(state, run, schema).withColumn("copies", copies.cast("int")), model.domains


def totals(rated: DataFrame, domains: list[str], weights: dict[str, float] | None = None, anchor: str = ANCHOR) -> DataFrame:
    """(domain, tokens, expected, wanted): expected tokens of each domain at rate 1, at the fitted rates, and as the weights say."""
    sums = [F.coalesce(F.sum(F.col("n_tokens") * F.element_at("p", i + 1) * r), F.lit(0.0)) for r in (F.lit(1.0), F.col("rate")) for i in range(len(domains))]
    got = np.array(rated.agg(*[c.alias(f"x{i}") for i, c in enumerate(sums)]).first()).reshape(2, -1)
    want = _wanted(got[0], domains, weights or WEIGHTS, anchor)
    return session_of(rated).createDataFrame([(d, float(a), float(b), float(w)) for d, a, b, w in zip(domains, got[0], got[1], want)], "domain string, tokens double, expected double, wanted double")


def mix(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: float | None = 1.0, **options) -> DataFrame:
    """docs with each row as often as its copies say, with its own columns; by default no row more than once.

    Rows are decided one by one: by their own text's posteriors, and by a hash of the id where a rate is no whole number.
    Null texts count as empty, null and repeated ids as any others; an empty table stays empty.
    """
    text, key = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.xxhash64(key, text).alias("row"), key.alias("id"), text.alias("text"))
    # equal rows share a number, and are decided alike
    rated, _ = rates(whole.select("row", "id", "text"), labels, "id", "text", most=most, **options)
    taken = stash(rated.where("copies != 1").groupBy("row").agg(F.max("copies").alias("copies")), "copies")
    out = whole.join(taken, "row", "left").withColumn("copies", F.coalesce("copies", F.lit(1))).where("copies > 0")
    return out.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
