"""Near duplicates against brute force over all pairs."""

import random
import re

from pyspark.sql import functions as F

from weftline.llm import minhash
from weftline.llm.common import components


def brute(rows, percent, words=5):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    ids = sorted(sets)
    edges = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}


def corpus(seed=5):
    r = random.Random(seed)
    word = lambda: r.choice("ab cd ef gh ij kl mn op qr st uv wx yz".split()) + str(r.randrange(400))
    line = " ".join(word() for _ in range(14))
    rows = []
    for _ in range(120):
        base = [word() for _ in range(r.randrange(3, 160))]
        rows.append(base)
        for _ in range(r.choice([0, 0, 1, 2, 9])):
            copy = list(base)
            for _ in range(r.randrange(0, 4)):
                copy[r.randrange(len(copy))] = word()
            rows.append(copy)
    hot = [word() for _ in range(120)]
    for _ in range(150):  # a chain of drifting near copies, more than a small node
        hot = list(hot)
        hot[r.randrange(len(hot))] = word()
        rows.append(hot)
    out = [" ".join(x) for x in rows]
    out = [x + "\n" + line if r.random() < 0.4 else x for x in out]
    out += [None, "", " \n\t", "One", "one", "ONE two", out[3].upper(), out[3]]
    r.shuffle(out)
    return list(enumerate(out))


def test_against_brute_force(spark):
    rows = corpus()
    for percent in (80, 85):
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, percent)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_nodes_branch_down_to_the_last_level(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 2)
    monkeypatch.setattr(minhash, "DEPTH", 2)
    monkeypatch.setattr(minhash, "TILE", 20)
    monkeypatch.setattr(minhash, "SHINGLES", 100)
    rows = corpus(9)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 80)


def test_odd_rows(spark):
    rows = [(1, "a b c d e f", 1), (1, "a b c d e f", 1), (None, "a b c d e f", 1), (2, "a b c d e f", 1), (3, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, N long")
    got = sorted(minhash.near_duplicates(df).collect(), key=str)
    assert [(r.doc_id, r.component_id, r.kept) for r in got] == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (None, None, True)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns and kept.count() == 4


def test_rows_that_repeat_an_id(spark):
    """Each is judged by its own text, and no text is taken for that of another row of its id."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(3, a), (3, b), (5, b + " more"), (7, c), (1, c), (9, a), (9, "own words that nobody else has at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == [(1, 36, 1, True), (3, 36, 3, True), (3, 36, 3, True), (5, 37, 3, False), (7, 36, 1, False), (9, 4, 9, True), (9, 36, 3, False)]
    assert sorted((r.doc_id, r.text[0]) for r in minhash.keep_one(df).collect()) == [(1, "c"), (3, "a"), (3, "b"), (9, "o")]


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 400), (500, 500), (None, 3)]
    df, want = spark.createDataFrame(edges, "u long, v long"), {**{i: 0 for i in range(201)}, 400: 400, 500: 400}
    for one_task in (0, 10**6):
        assert {r.id: r.component for r in components(df, one_task=one_task).collect()} == want
    assert components(df.limit(0)).count() == 0
    got = {r.id: r.component for r in components(df, one_task=50).collect()}
    assert got == {**{i: 0 for i in range(201)}, 400: 400, 500: 400}


def test_recall_in_a_family_below_the_threshold(spark, monkeypatch):
    """Nodes of a family at 0.71 branch on for several levels; pairs at 0.82 within it stay together."""
    monkeypatch.setattr(minhash, "SMALL", 4)
    common = " ".join(f"c{i}" for i in range(150))
    rows = [(i, common + "".join(f" x{i}.{j}" for j in range(30))) for i in range(260)]
    # 13 of the 30 own words are those of the partner
    rows += [(1000 + i, common + "".join(f" x{i}.{j}" if j < 13 else f" y{i}.{j}" for j in range(30))) for i in range(40)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()}
    assert [i for i in range(40) if got[1000 + i] != i] == [] and len(set(got.values())) == 260


def test_a_family_is_compared_at_home_not_in_every_tree(spark, monkeypatch):
    """Variants of one text by edits that many of them share, at 0.4 to 1: all trees have them in one node."""
    r = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    edits = [(k * 6 + 2, f"e{k}.{v}") for k in range(24) for v in range(2)]
    rows = []
    for i in range(300):
        own = list(base)
        for at, word in r.sample(edits, r.randrange(2, 9)):
            own[at] = word
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(base[:100] + [f"o{i}.{k}" for k in range(40)])) for i in range(60)]  # too much of their own
    given, tiled = [], minhash._tiled

    def counted(rows, sets, percent):
        minor = F.col("minor") if "minor" in rows.columns else F.col("component") != F.col("major")
        given.append(rows.where(minor).count())
        return tiled(rows, sets, percent)

    monkeypatch.setattr(minhash, "_tiled", counted)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute(rows, 85)
    assert 0 < sum(given) <= 3 * len(rows), given
