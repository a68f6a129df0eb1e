"""LM scoring against a plain count of the same models."""

import math
import random
from collections import Counter

import numpy as np

from weftline.llm import lmscore as L
from weftline.llm.queries import op3_lm_scoring


def brute(rows, targets):
    words = {i: [w.decode() for w in (t or "").encode().lower().split()] for i, t in rows}
    ids = {i: ["<s>", *x] for i, x in words.items()}

    def model(of):
        uni, ctx, big = Counter(), Counter(), Counter()
        for i in of:
            uni.update(ids[i][1:])
            ctx.update(ids[i][:-1])
            big.update(zip(ids[i], ids[i][1:]))
        return uni, ctx, big

    everything, target = model(ids), model(targets)
    types = len(everything[0]) + 1
    even = sum(target[0].values()) / sum(everything[0].values())
    out = {}
    for i, x in ids.items():
        if len(x) == 1:
            out[i] = (0, None, None)
            continue
        own = model([i])
        loss = []
        for (uni, ctx, big), less, share in ((target, i in targets, 1.0), (everything, True, even)):
            total, s = share * (sum(uni.values()) - less * (len(x) - 1)), 0.0
            for a, b in zip(x, x[1:]):
                p = (share * (uni[b] - less * own[0][b]) + L.UNSEEN) / (total + L.UNSEEN * types)
                pair = share * (big[a, b] - less * own[2][a, b])
                seen = share * (ctx[a] - less * own[1][a])
                s -= math.log((pair + L.BACKOFF * p) / (max(seen, pair) + L.BACKOFF))
            loss.append(s / (len(x) - 1))
        out[i] = (len(x) - 1, *loss)
    return out


def test_against_plain_counts(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(r.choice(words[: 20 if i % 3 else 40]) for _ in range(r.randrange(1, 60))).title()) for i in range(80)] + [(100, None), (101, " \n"), (102, "once only")]
    targets = {i for i, _ in rows if i % 3 == 1}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = L.score(df, spark.createDataFrame([(i,) for i in targets] + [(None,)], "doc_id long")).collect()
    want = brute(rows, targets)
    assert len(got) == len(rows)
    for x in got:
        n, t, b = want[x.doc_id]
        assert x.n_tokens == n and x.in_target == (x.doc_id in targets)
        assert (t is None) == (x.target_loss is None) == (x.score is None)
        if t is not None:
            assert np.allclose([x.target_loss, x.background_loss, x.score], [t, b, b - t], atol=1e-5)


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b a b"), (1, "a b a b"), (None, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert len(L.score(df, none).collect()) == 3
    assert L.score(df.limit(0), none).count() == 0


def test_query_on_the_whole_table(spark):
    """The registered query against plain counts of all its documents."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    targets = {r.doc_id for r in spark.read.parquet(f"{d}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
    want = brute([(r.doc_id, r.text) for r in docs], targets & {r.doc_id for r in docs})
    got = {r.doc_id: r for r in op3_lm_scoring(spark, d).collect()}
    assert set(got) == set(want)
    for i, (n, t, b) in want.items():
        assert got[i].n_tokens == n and (t is None or np.allclose([got[i].target_loss, got[i].background_loss], [t, b], atol=2e-6))


def test_packing_of_counts():
    r = np.random.default_rng(0)
    for n in (1, 5, 1000):
        keys = np.unique(r.integers(0, 2**64 - 1, n, dtype=np.uint64))
        counts = r.integers(0, 2**40, (L.COUNTS, len(keys)))
        k, c = L.unpacked(L.packed(keys, counts))
        assert (k == keys).all() and (c == counts).all()
        for share in (0, 0.4, 1):
            shared = r.random(len(keys)) < share
            got, c = L.answered(L.answer(shared, counts))
            assert (got == shared).all() and (c == np.where(shared, counts[:-1], 0)).all()


def test_long_texts_by_slices(monkeypatch):
    text = b" One two\x0bthree  \xc3\x89 four\n" * 50
    want = L.word_keys(text, {})
    monkeypatch.setattr(L, "SLICE", 17)
    assert (L.word_keys(text, {}) == want).all() and len(want) == 250 and not (want & np.uint64(1)).any()
    assert len(L.word_keys(b"x" * 100, {})) == 1 and len(L.word_keys(None, {})) == 0


def test_models_grow_with_the_corpus(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(70_000)] * 2
    r.shuffle(words)
    rows = [(i, " ".join(words[i * 700 : i * 700 + 700] + ["the", "end"])) for i in range(200)] + [(300, "the end of w1")]
    targets = set(range(0, 200, 3))
    want = brute(rows, targets)
    df, chosen = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame([(i,) for i in targets], "doc_id long")
    for x in L.score(df, chosen).collect():
        assert np.allclose([x.target_loss, x.background_loss], want[x.doc_id][1:], atol=1e-5)


def test_buckets_change_no_score(spark):
    r = random.Random(3)
    rows = [(i % 150, " ".join(f"w{int(r.paretovariate(0.7))}" for _ in range(r.randrange(1, 80)))) for i in range(160)] + [(None, "w1 w2 w9"), (7, "w1 w2"), (7, "w1 w2")]
    df, chosen = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame([(i,) for i in range(0, 150, 2)], "doc_id long")
    told = [sorted((x.doc_id or -1, x.n_tokens, round(x.target_loss, 9), round(x.background_loss, 9)) for x in L.score(df, chosen, bucket=bucket).collect()) for bucket in (1, 200, 1 << 21)]
    assert len(told[0]) == len(rows) and told[0] == told[1] == told[2]
