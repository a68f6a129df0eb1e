"""Embedding near-dedup against brute force."""

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import embeddings
from weftline.llm.queries import op10_embedding_near_dedup


def brute(rows, cosine=0.98):
    ok = [(i, lab, np.array(v, float)) for i, v, lab in rows if lab is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {i: [0, i] for i, _, _ in rows}
    up = {i: i for i in out}
    root = lambda a: a if up[a] == a else root(up[a])
    for lab, dim in {(lab, len(v)) for _, lab, v in ok}:
        own = [(i, v / np.linalg.norm(v)) for i, x, v in ok if x == lab and len(v) == dim]
        x = np.stack([v for _, v in own])
        for a, b in np.argwhere(np.triu(x @ x.T >= cosine, 1)):
            i, j = own[a][0], own[b][0]
            out[i][0] += 1
            out[j][0] += 1
            i, j = root(i), root(j)
            up[max(i, j)] = min(i, j)
    return {i: (n, root(i)) for i, (n, _) in out.items()}


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    got = op10_embedding_near_dedup(spark, d).collect()
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_dense_groups_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 16)
    r = np.random.default_rng(1)
    base = r.standard_normal((6, 16))
    rows, n = [], 0
    for k in range(300):
        rows.append((n := n + 1, (base[k % 6] + r.standard_normal(16) * (0.05 if k % 6 else 0.14)).tolist(), k % 2))
    rows += [(n + 1 + k, rows[5][1], rows[5][2]) for k in range(90)]
    n += 100
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] * 16, rows[0][1][:8]]
    rows += [(n + k, v, 0) for k, v in enumerate(odd)] + [(n + 50, rows[0][1], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embeddings.near_duplicates(df.select("*", F.lit(1).alias("rep"), F.lit(2).alias("component"), F.lit(3).alias("a.b")), window=8).collect()
    assert {x.vec_id: (x.n_links, x.component_id) for x in got} == brute(rows)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    lost = embeddings.near_duplicates(spark.createDataFrame([(None, rows[0][1], 0), (1, rows[0][1], 0)], df.schema)).collect()
    assert {(x.vec_id, x.n_links, x.component_id, x.kept) for x in lost} == {(None, 0, None, True), (1, 0, 1, True)}


def test_repeated_ids_are_vectors_of_their_own(spark):
    a, b = [1.0, 0.0, 0.0, 0.1], [0.0, 1.0, 0.1, 0.0]
    df = spark.createDataFrame([(1, a, 0), (1, b, 0), (2, a, 0), (3, b, 0), (3, b, 0)], "vec_id long, embedding array<float>, label int")
    got = sorted((x.vec_id, x.n_links, x.component_id) for x in embeddings.near_duplicates(df).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (3, 2, 1)]


def test_windows_across_partitions(spark):
    """All pairs of a sorted order within the window, by brute force, whatever the partitions' sizes."""
    for n, parts, window in ((7, 9, 4), (60, 8, 20), (60, 30, 9), (300, 8, 5)):
        classes = spark.createDataFrame([(k, [1.0, k * 1e-7], 0, 2, k) for k in range(n)], "rep long, embedding array<double>, group long, dim int, component long")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = embeddings._candidates(classes, 0, 1, window, 0.98, 7).collect()
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        # keys are equal, so the order is that of rep
        assert sorted((r.u, r.v) for r in got) == [(a, b) for a in range(n) for b in range(a + 1, min(n, a + window + 1))]


def test_recall_in_crowded_labels(spark):
    """20,000 vectors of one label around one direction, mutual cosine about 0.8, with 1,000 planted pairs at 0.982."""
    r = np.random.default_rng(5)
    centre = r.standard_normal(64)
    x = centre + r.standard_normal((20_000, 64)) * 0.5
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(1000):
        off = r.standard_normal(64)
        off -= (off @ x[k]) * x[k]
        x[k + 1000] = 0.982 * x[k] + np.sqrt(1 - 0.982**2) * off / np.linalg.norm(off)
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(8)
    got = {r.vec_id: r.component_id for r in embeddings.near_duplicates(df).collect()}
    assert sum(got[k] == got[k + 1000] for k in range(1000)) >= 995


def test_labels_do_not_weigh_on_each_other(spark):
    """One crowded label with few links beside one that is rich in them: the first one's links are found all the same."""
    r = np.random.default_rng(6)
    centre, n, pairs = r.standard_normal(48), 5000, 60
    x = centre + r.standard_normal((n, 48)) * 0.37
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(pairs):
        off = r.standard_normal(48)
        off -= (off @ x[k]) * x[k]
        x[k + pairs] = 0.982 * x[k] + np.sqrt(1 - 0.982**2) * off / np.linalg.norm(off)
    near = r.standard_normal((300, 48)).repeat(20, axis=0) + r.standard_normal((6000, 48)) * 0.05
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)] + [(n + k, v.tolist(), 1) for k, v in enumerate(near)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(8)
    got = {r.vec_id: r.component_id for r in embeddings.near_duplicates(df).collect()}
    assert sum(got[k] == got[k + pairs] for k in range(pairs)) >= pairs * 0.99


def test_labels_that_do_not_settle_are_compared_in_full(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "ROUNDS", 0)
    monkeypatch.setattr(embeddings, "TILE", 32)
    r = np.random.default_rng(2)
    rows = [(k, (r.standard_normal(8 if k % 2 else 4) * 0.2 + (k // 40)).tolist(), k % 3) for k in range(240)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {x.vec_id: (x.n_links, x.component_id) for x in embeddings.near_duplicates(df).collect()} == brute(rows)
