"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation estimates how far each can be trusted,
and a document's posterior probability of being good decides, instead of a test that every rule must pass.

One pass over the texts yields counts and the vote pattern. Only pattern counts reach the driver: at most 3 ** len(RULES) rows,
however large the input. The posterior of a pattern is a small table again, joined back to the documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import bounded_batches, map_batches, session_of, stash

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Words above which windows are compared by ranks in numpy instead of tuples, for memory.
LONG_TEXT = 50_000
KEEP_AT = 0.5

#: name: (feature, good from, good to, bad below, bad above); a value in neither range abstains.
RULES = {
    "enough_words": ("n_words", 50, None, 20, None),
    "word_length": ("mean_word", 2.5, 11.0, 1.5, 16.0),
    "few_symbols": ("symbols_a_word", 0.0, 0.1, None, 0.3),
    "few_symbol_words": ("symbol_words", 0.0, 0.05, None, 0.2),
    "few_symbol_chars": ("symbol_chars", 0.0, 0.02, None, 0.06),
    "few_repeated_lines": ("dup_lines", 0.0, 0.1, None, 0.3),
    "few_repeated_windows": ("repeat_words", 0.0, 0.1, None, 0.3),
    "mixed_case": ("upper", 0.0, 0.25, None, 0.5),
    "calm_punctuation": ("shouts_a_word", 0.0, 0.1, None, 0.3),
    "no_ruling_word": ("top_word", 0.0, 0.2, None, 0.35),
    "varied_words": ("variety", 0.78, None, 0.65, None),
    "no_stutter": ("stutter", 0.0, 0.05, None, 0.2),
    "mostly_letters": ("letters", 0.75, None, 0.6, None),
}

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = [*(T.StructField(c, T.LongType(), False) for c in COUNTS), T.StructField("votes", T.LongType(), False)]

_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_upper = np.zeros(256, bool)
_upper[65:91] = True
_letter = np.zeros(256, bool)
_letter[97:123] = True
_letter[0xC3:0xF5] = True  # lead bytes of letters beyond ASCII; other signs there are rare
_letter |= _upper


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of 8 words found twice or more in the text, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    if n > LONG_TEXT:  # exact ranks by doubling: a window's rank is that of the pair of its halves
        ids: dict[bytes, int] = {}
        rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
        for half in (1, 2, 4):
            pair = rank[:-half] * (int(rank.max()) + 1) + rank[half:]
            rank = np.unique(pair, return_inverse=True)[1]
        twice = np.bincount(rank)[rank] > 1
    else:
        windows = list(zip(*(words[i : n + i] for i in range(WINDOW))))
        if len(set(windows)) == n:
            return 0
        count = Counter(windows)
        twice = np.fromiter((count[w] > 1 for w in windows), bool, n)
    edge = np.zeros(n + WINDOW, np.int64)
    at = np.flatnonzero(twice)
    edge[at] += 1
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(text: bytes) -> tuple[tuple[int, int, int, int, int], dict[str, float]]:
    """The base counts of one text and the features that the rules look at."""
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    n = len(words)
    spaces = int(hist[_space].sum())
    points = len(text) - int(hist[0x80:0xC0].sum())
    symbols = int(sum(hist[c] for c in SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeated = repeat_words(words)
    count = Counter(words)
    word_chars, m, letters = points - spaces, max(n, 1), int(hist[_letter].sum())
    return (n, word_chars, symbols, dup_lines, repeated), {
        "n_words": n,
        "mean_word": word_chars / m,
        "symbols_a_word": symbols / m,
        "symbol_words": sum(c for w, c in count.items() if w[-1] in SYMBOLS) / m,
        "symbol_chars": symbols / max(word_chars, 1),
        "dup_lines": dup_lines / max(len(lines), 1),
        "repeat_words": repeated / m,
        "upper": int(hist[_upper].sum()) / max(letters, 1),
        "shouts_a_word": int(hist[33] + hist[63]) / m,
        "top_word": (max(count.values(), default=1) - 1) / m,
        # Herdan's C: the share of distinct words falls with length, the ratio of the logarithms hardly does
        "variety": math.log(len(count)) / math.log(n) if n > 1 else 1.0,
        "stutter": sum(map(eq, words, words[1:])) / m,
        "letters": letters / max(word_chars, 1),
    }


def vote(features: dict[str, float]) -> int:
    """The votes as digits to base 3, first rule lowest: 0 abstains, 1 bad, 2 good."""
    code = 0
    for i, (name, low, high, below, above) in enumerate(RULES.values()):
        x = features[name]
        if (below is not None and x < below) or (above is not None and x > above):
            code += 3**i
        elif (low is None or x >= low) and (high is None or x <= high):
            code += 2 * 3**i
    return code


def measured(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs plus the base counts and `votes`; null text counts as a text without words."""
    bounded_batches(session_of(docs))
    clash = {f.name for f in SCHEMA}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c == text or c.lower() not in clash])
    names = [c for c in docs.columns if keep_text or c != text]
    schema = T.StructType([*(docs.schema[c] for c in names), *SCHEMA])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list[int]] = [[] for _ in SCHEMA]
            for raw in batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist():
                counts, features = measure(raw or b"")
                for col, x in zip(cols, (*counts, vote(features))):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), *(pa.array(c, pa.int64()) for c in cols)], names=[*names, *(f.name for f in SCHEMA)])

    return map_batches(docs, run, schema)


def estimate(patterns: dict[int, int], rounds: int = 100) -> tuple[dict[int, float], np.ndarray, float]:
    """EM over vote patterns: posterior of each pattern, P(vote | class) of each rule as [rule, class, vote], and the prior.

    It starts from rules that are right far more often than not and a prior of 0.8; pseudo-counts on the side of that start keep a rule
    that never votes bad, or a table without bad documents, from turning the classes round.
    """
    codes = np.array(sorted(patterns), np.int64)
    n = np.array([patterns[c] for c in codes.tolist()], float)
    k = len(RULES)
    votes = (codes[:, None] // 3 ** np.arange(k)) % 3
    # [class, vote], class 0 bad: a bad document breaks one or two rules, a good one hardly any
    start = np.array([[0.1, 0.35, 0.55], [0.08, 0.02, 0.9]])
    table, prior = np.repeat(start[None], k, axis=0), 0.8
    post = np.zeros(len(codes))
    weight = max(1.0, 0.01 * n.sum())
    for _ in range(rounds):
        log = np.log(table)[np.arange(k), :, votes].sum(axis=1) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -700, 700)))
        stop, post = np.abs(new - post).max(initial=0) < 1e-9, new
        if stop or not len(codes):
            break
        for c, w in ((0, n * (1 - post)), (1, n * post)):
            for v in range(3):
                table[:, c, v] = ((votes == v) * w[:, None]).sum(axis=0) + weight * start[c, v]
        table /= table.sum(axis=2, keepdims=True)
        prior = float((n @ post + 0.8 * weight) / (n.sum() + weight))
    return dict(zip(codes.tolist(), post.tolist())), table, prior


def judge(docs: DataFrame, text: str = "text", keep_text: bool = True, keep_at: float = KEEP_AT) -> DataFrame:
    """docs with base counts, base_failed, quality (posterior) and kept.

    Null, empty and short texts fail the base rules; repeated rows and ties get the same verdict each; an empty table stays
    empty. Columns of docs that clash with the result's are replaced.
    """
    spark = session_of(docs)
    gone = {"base_failed", "quality", "kept"}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c == text or c.lower() not in gone])
    seen = stash(measured(docs, text, keep_text), "votes")
    found, _, _ = estimate({r[0]: r[1] for r in seen.groupBy("votes").count().collect()})  # at most 3 ** len(RULES) rows
    small = spark.createDataFrame(list(found.items()), "votes long, quality double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        seen.join(F.broadcast(small), "votes", "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_at))
        .drop("votes")
    )


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that judge() keeps, with their own columns only."""
    verdict = judge(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(f"`{text}`").alias("_text")), "_text", keep_text=False)
    return verdict.where("kept").select("_doc.*")
