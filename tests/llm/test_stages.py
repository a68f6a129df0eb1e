"""Every stage of the pipeline on odd rows: nulls, empty and very long texts, repeated rows, ties, clashing and odd column names."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

D = "/root/testdata/sf0.01"
CLASHES = ["_gone", "_gone_id", "_id", "_text_hash", "_units", "_doc", "_text", "doc", "row", "id", "copies", "p", "rate", "votes", "kept", "quality", "n_dropped", "n_words", "component_id", "length", "piece", "base", "a.b", "n_tokens"]


def prose(r, n):
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randrange(1, 4)))
    return " ".join(" ".join(word() for _ in range(r.randrange(6, 15))).capitalize() + "." for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(8)
    a, b, c = prose(r, 12), prose(r, 15), prose(r, 9)
    texts = [(1, a), (1, a), (2, a), (3, b), (3, c), (None, c), (None, prose(r, 10)), (4, None), (5, ""), (6, " \n "), (7, prose(r, 9000)), (8, b + " " + prose(r, 1)), (9, "short"), (None, None)]
    rows = [(i, t, "en", "src0", len(t or ""), k) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, nth int")
    docs = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])
    docs.cache().count()
    return docs


def nths(df):
    return sorted(r.nth for r in df.collect())


def same(df, docs):
    """Columns as they were, and clashing ones untouched."""
    assert df.columns == docs.columns
    for r in df.select("nth", *[F.col(f"`{c}`") for c in CLASHES]).collect():
        assert list(r[1:]) == [f"own {c}" for c in CLASHES]


def test_quality_rules(spark, odd):
    out = P.quality_rules(spark, odd, D)
    same(out, odd)
    # null, empty and short texts go; equal texts share a verdict
    kept = nths(out)
    assert not {7, 8, 9, 12, 13} & set(kept) and {0, 1, 2} <= set(kept) or not {0, 1, 2} & set(kept)


def test_line_dedup(spark, odd):
    out = P.line_dedup(spark, odd, D)
    same(out, odd)
    by = {r.nth: r for r in out.collect()}
    before = {r.nth: r for r in odd.collect()}
    assert sorted(by) == list(range(14))
    # copies are left whole, whatever else stays as it is is left alone
    for k in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 13):
        assert by[k].text == before[k].text and by[k].n_chars == before[k].n_chars


def test_near_dedup(spark, odd):
    out = P.near_dedup(spark, odd, D)
    same(out, odd)
    # id 2 copies id 1, id 8 nearly copies the text of a row of id 3; rows with null ids and texts without words stay
    assert {0, 1, 3, 4, 5, 6, 7, 8, 9, 10, 12, 13} <= set(nths(out)) and 2 not in nths(out)


def test_mix_sources(spark, odd):
    out = P.mix_sources(spark, odd, D)
    same(out, odd)
    assert len(set(nths(out))) == len(nths(out)) and set(nths(out)) <= set(range(14))


def test_packing(spark, odd):
    out = P.pack(spark, odd, D).collect()
    first = [r for r in out if r.piece == 0]
    assert len(first) == 14 and sorted(r.length for r in out if r.doc_id in (4, 5, 6)) == [1, 1, 1]
    assert all(r.length <= 4096 for r in out) and max(r.piece for r in out if r.doc_id == 7) > 3


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_empty_tables(spark, odd, name, stage):
    out = stage(spark, odd.limit(0), D)
    assert out.count() == 0 and (name == "packing" or out.columns == odd.columns)


def test_scratch_tables_go(spark, tmp_path):
    from weftline.llm.common import scratch, stash

    with scratch(spark) as made:
        gone, kept = stash(spark.range(3), "gone"), stash(spark.range(4), "kept")
        made.pop()
    assert kept.count() == 4
    with pytest.raises(Exception, match="(?i)exist|not.?found"):
        gone.count()
