"""Language identification: held-out accuracy, and features against a plain n-gram count."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import langid
from weftline.llm.queries import op7_language_id


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aÉß 1.\n😀ж𐐀𠀀", max_size=30)), max_size=6))
def test_sums_match_counts_of_each_text(texts):
    scores = np.random.default_rng(0).random((langid.BUCKETS, 3)).astype(np.float32)
    total, n = langid.sums(texts, scores)
    for t, s, k in zip(texts, total, n):
        counts = langid.ngrams(t or "")
        assert (counts is None) == (k == 0) == (not any(c.isalpha() for c in t or ""))
        if counts is not None:
            assert counts.sum() == k and np.allclose(counts @ scores, s, rtol=1e-4)


def test_texts_longer_than_a_slice(monkeypatch):
    text = "Thé quick-brown ñandú jumps " * 40
    scores = np.random.default_rng(0).random((langid.BUCKETS, 2)).astype(np.float32)
    want, n = langid.ngrams(text), langid.sums(["a b", text, None, "c"], scores)[1]
    monkeypatch.setattr(langid, "CHUNK", 37)
    assert (langid.ngrams(text) == want).all()
    total, m = langid.sums(["a b", text, None, "c"], scores)
    assert (m == n).all() and np.allclose(total[1], want @ scores, rtol=1e-4)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = op7_language_id(spark, d).collect()
    assert len(got) == len(docs)
    own = [r for r in got if r.held_out and docs[r.doc_id].lang is not None and len(docs[r.doc_id].text.split()) >= 20]
    assert sum(docs[r.doc_id].lang == r.lang_pred for r in own) >= 0.98 * len(own) > 0
    assert all(0 <= r.score <= 1 for r in got) and sum(r.rejected for r in got) < 0.1 * len(got)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 .. !", None), (4, "😀😀 😀", "en"), (None, "abc", "en")], "doc_id long, text string, lang string").withColumn("Score", F.lit("x"))
    told = {r.doc_id: r for r in langid.identify(df, langid.fit(df)).collect()}
    assert [told[k].lang_pred for k in (1, 2, 3, 4)] == ["und"] * 4 and told[None].lang_pred == "en"
    assert {r.lang_pred for r in langid.identify(df, langid.fit(df.limit(0))).collect()} == {"und"}
    assert langid.identify(df.limit(0), None).count() == 0
