"""Quality rules: base counts against a plain reading of their definition, and verdicts against labels."""

import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import quality
from weftline.llm.queries import op2_quality_rules


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            hit.update(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\t#\x1cé ", max_size=120))
def test_base_counts(text):
    assert quality.measure(text.encode())[0] == plain(text)


def test_long_text_ranks_are_exact(monkeypatch):
    words = [b"%d" % (i * i % 7) for i in range(200)] + [b"x%d" % i for i in range(50)]
    want = quality.repeat_words(words)
    monkeypatch.setattr(quality, "LONG_TEXT", 5)
    assert quality.repeat_words(words) == want > 0


def test_odd_rows(spark):
    rows = [(1, None, 9), (2, "", 9), (None, "a b", 9), (2, "", 9)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, N_words int")).collect()
    assert len(got) == 4 and all(r.base_failed and not r.kept for r in got)
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table_against_labels(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op2_quality_rules(spark, d).collect()}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        g = got.pop(r.doc_id)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == plain(r.text)
        assert g.base_failed == (g.n_words < 20 or 100 * g.n_repeat_words > 30 * g.n_words)
        got[-1 - r.doc_id] = g
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    good = [got[-1 - k].kept for k, v in labels.items() if v == 1 and not got[-1 - k].base_failed]
    bad = [got[-1 - k].kept for k, v in labels.items() if v == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_keep_good_returns_the_columns_it_got(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("kept", F.lit("x"))
    out = quality.keep_good(docs)
    assert out.columns == docs.columns and 0 < out.count() < docs.count()


def plain_em(rows, rounds=100):
    """The same model document by document: start, pseudo-counts of a hundredth of the rows, posteriors."""
    k = len(quality.RULES)
    start = {0: [0.1, 0.35, 0.55], 1: [0.08, 0.02, 0.9]}
    table = {c: [list(start[c]) for _ in range(k)] for c in start}
    prior, weight, post = 0.8, max(1.0, 0.01 * len(rows)), []
    for _ in range(rounds):
        new = []
        for votes in rows:
            like = [1 - prior, prior]
            for j, v in enumerate(votes):
                like = [like[c] * table[c][j][v] for c in (0, 1)]
            new.append(like[1] / sum(like))
        stop = post and max(abs(a - b) for a, b in zip(post, new)) < 1e-9
        post = new
        if stop:
            break
        for c in (0, 1):
            own = [p if c else 1 - p for p in post]
            for j in range(k):
                n = [weight * start[c][v] + sum(w for w, votes in zip(own, rows) if votes[j] == v) for v in range(3)]
                table[c][j] = [x / sum(n) for x in n]
        prior = (sum(post) + 0.8 * weight) / (len(rows) + weight)
    return post, table, prior


def test_verdicts_against_plain_em(spark):
    """The query's posterior and verdict of every document of the table, worked out without patterns."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    codes = [quality.vote(quality.measure((r.text or "").encode())[1]) for r in docs]
    post, table, prior = plain_em([[c // 3**j % 3 for j in range(len(quality.RULES))] for c in codes])
    got = {r.doc_id: r for r in op2_quality_rules(spark, d).collect()}
    for r, p in zip(docs, post):
        assert abs(got[r.doc_id].quality - p) < 1e-6
        assert got[r.doc_id].kept == (not got[r.doc_id].base_failed and p >= quality.KEEP_AT)


def test_em_finds_how_far_rules_can_be_trusted():
    r = np.random.default_rng(3)
    k, n = len(quality.RULES), 20_000
    good = r.random(n) < 0.7
    right = r.uniform(0.75, 0.95, k)
    silent = r.uniform(0, 0.3, k)
    votes = np.where(r.random((n, k)) < silent, 0, np.where((r.random((n, k)) < right) == good[:, None], 2, 1))
    codes, counts = np.unique((votes * 3 ** np.arange(k)).sum(axis=1), return_counts=True)
    post, table, prior = quality.estimate(dict(zip(codes.tolist(), counts.tolist())))
    assert abs(prior - 0.7) < 0.02
    for j in range(k):
        assert abs(table[j, 1, 2] / (table[j, 1, 1] + table[j, 1, 2]) - right[j]) < 0.03
        assert abs(table[j, 0, 1] / (table[j, 0, 1] + table[j, 0, 2]) - right[j]) < 0.05
    told = np.array([post[c] for c in (votes * 3 ** np.arange(k)).sum(axis=1).tolist()]) > 0.5
    assert (told == good).mean() > 0.99
