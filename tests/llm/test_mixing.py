"""Mixing: rates against a plain projected gradient, totals against targets, and held-out posteriors."""

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import mixing as M
from weftline.llm.common import read
from weftline.llm.queries import op5_mixing

D = "/root/testdata/sf0.1"


def test_rates_follow_the_plain_gradient(spark):
    r = np.random.default_rng(0)
    p = r.dirichlet([4, 1, 0.6], 400)
    n = r.integers(0, 500, 400)
    state = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, p array<double>").repartition(3)
    history = M.fit_rates(state, ["good", "low", "toxic"], M.WEIGHTS, "good", 1.0)
    rate, total = np.ones(400), lambda x: p.T @ (n * x)
    want = total(rate)[0] / 0.9 * np.array([0.9, 0.1, 0])
    start = np.square(total(rate) - want).sum()
    scale = total(rate).sum()
    for step in history:
        residual = (total(rate) - want) / scale
        assert np.allclose(step, -residual * 1.2 / (np.maximum(total(rate), want).max() / scale))
        rate = np.clip(rate + p @ step, 0, 1)
    assert np.allclose(rate, M.replay(p, history, 1.0)) and (rate >= 0).all()
    assert np.square(total(rate) - want).sum() < 0.8 * start


def test_unbounded_rates_meet_the_targets(spark):
    p = np.repeat(np.eye(3), [60, 30, 10], axis=0)
    state = spark.createDataFrame([(100, x.tolist()) for x in p], "n_tokens long, p array<double>")
    weights = {"a": 0.5, "b": 0.4, "c": 0.1}
    history = M.fit_rates(state, ["a", "b", "c"], weights, "none", None, rounds=60)
    got = p.T @ (100 * M.replay(p, history, None))
    assert np.allclose(got / got.sum(), [0.5, 0.4, 0.1], atol=0.01)


def test_whole_table(spark):
    got = {r.doc_id: r for r in op5_mixing(spark, D).collect()}
    docs = read(spark, D, "documents").select("doc_id").collect()
    assert set(got) == {r.doc_id for r in docs}
    labels = {r.doc_id: r.domain for r in M.domain(read(spark, D, "labels")).collect()}
    kept = {d: np.mean([got[i].copies for i, x in labels.items() if x == d]) for d in ("good", "low", "toxic")}
    print("kept", kept)
    assert kept["good"] > 0.97 and kept["toxic"] < 0.25


def test_totals_of_the_whole_table_meet_the_targets(spark):
    rated, domains = M.rates(read(spark, D, "documents").select("doc_id", "text"), read(spark, D, "labels"))
    told = {r.domain: r for r in M.totals(rated, domains).collect()}
    print(told)
    all_ = sum(r.tokens for r in told.values())
    assert set(told) == {"good", "low", "toxic"} and told["toxic"].wanted == 0
    for r in told.values():
        assert abs(r.expected - r.wanted) <= 0.01 * all_
    assert told["toxic"].expected <= 0.25 * told["toxic"].tokens
    assert rated.agg({"rate": "max"}).first()[0] <= 2


def test_rows_are_decided_one_by_one(spark):
    """Null and repeated ids share no fate: toxic rows go, the others stay with their own columns."""
    docs = read(spark, D, "documents")
    labels = read(spark, D, "labels")
    bad = "trash pathetic idiot disgusting worthless stupid loser clown scum moron " * 8
    some = docs.where("lang = 'en' and n_chars between 500 and 2000").orderBy("doc_id").limit(20)
    text = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" " + bad))).otherwise(F.col("text"))
    odd = some.withColumn("row", F.col("doc_id")).withColumn("text", text).withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(-1).cast("long"))
    same = docs.withColumn("row", F.lit(None).cast("long")).unionByName(odd)
    out = M.mix(same, labels)
    assert out.columns == same.columns
    kept = [r.row for r in out.where("row is not null").collect()]
    fine = {r.row for r in odd.collect() if r.row % 2}
    assert len(kept) == len(set(kept)) and len(fine - set(kept)) <= 1 and len(set(kept) - fine) <= 1


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "a b", 1), (3, "a b", 1), (3, "a b", 1)], "doc_id long, text string, P int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rated, domains = M.rates(df, none)
    assert domains == ["good"] and [r.rate for r in rated.collect()] == [1.0] * 5
    out = M.mix(df, none)
    assert out.columns == df.columns and out.count() == 5 and M.mix(df.limit(0), none).count() == 0


def test_rare_domains_reach_the_optimum(spark):
    for toxic in (30, 3):
        p = np.repeat(np.eye(3), [900, 100 - toxic // 3, toxic], axis=0)
        state = spark.createDataFrame([(100, x.tolist()) for x in p], "n_tokens long, p array<double>").repartition(3)
        how = (state, ["good", "low", "toxic"], M.WEIGHTS, "good", 1.0)
        rate = M.replay(p, M.settled(*how, M.fit_rates(*how)), 1.0)
        assert rate[:900].min() > 0.999 and rate[-toxic:].max() < 0.01


def test_soft_rates_are_optimal(spark):
    r = np.random.default_rng(1)
    p, n = r.dirichlet([4, 1, 0.05], 400), r.integers(1, 500, 400)
    state = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, p array<double>").repartition(3)
    how = (state, ["good", "low", "toxic"], M.WEIGHTS, "good", 1.0)
    rate = M.replay(p, M.settled(*how, M.fit_rates(*how)), 1.0)
    own = p.T @ n
    residual = (p.T @ (n * rate) - own[0] / 0.9 * np.array([0.9, 0.1, 0])) / own.sum()
    step = np.clip(rate - p @ residual / (own.min() / own.sum()), 0, 1)
    assert (p.T @ (n * np.abs(step - rate)) <= 0.005 * own).all()
