"""Normalisation of dirty cells, link status of typed grids, and review commands."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from weftline.functions import text as text_rules
from weftline.operators import catalog, commands, grids, normalize
from weftline.plans import queries

ENTRIES = [("Литол-24", "ГОСТ 21150"), ("ЦИАТИМ-201", "ГОСТ 6267"), ("ЦИАТИМ-203", "ГОСТ 8773"), ("Смазка А", "ТУ 1"), ("Смазка Б", "ТУ 1"), ("Масло (зимнее и летнее)", "ТУ 7; 8"), ("Двойная", "ТУ 2"), ("Двойная", "ТУ 3"), ("Mobil X", "-DIN 5")]


def test_splitting():
    assert normalize.groups("a; b (c; d) ;; e") == ["a", "b (c; d)", "e"]
    assert normalize.clauses("А по X и Б по Y, В по Z") == ["А по X", "Б по Y", "В по Z"]
    assert normalize.clauses("А, Б по X") == ["А, Б по X"]
    assert normalize.pieces("А, Б (и В) и Г\nИгла", normalize.cuts("А, Б (и В) и Г\nИгла", normalize.SOFT)) == ["А", "Б (и В)", "Г", "Игла"]
    assert normalize.with_suffix(["А", "Б (x)", "В (зим)"]) == ["А (зим)", "Б (x)", "В (зим)"] and normalize.with_suffix(["А"]) == ["А"]


def test_analysis(spark):
    book = normalize.Catalog(ENTRIES)
    text = lambda raw: book.analyze(raw)[0]
    assert text("Литол-24 по ГОСТ 21150; ЦИАТИМ-201 по ГОСТ 6267") == "Литол-24 по ГОСТ 21150; ЦИАТИМ-201 по ГОСТ 6267"
    assert text("литол 24") == "Литол-24 по ГОСТ 21150"
    assert text("Смазка А, Смазка Б по ТУ 1") == "Смазка А по ТУ 1; Смазка Б по ТУ 1"
    assert text("Двойная") == "- по -" and text("- по ТУ 1") == "- по ТУ 1"
    assert text("JIитoл-24 ГОСТ 21150") == "Литол-24 по ГОСТ 21150"
    assert not book.analyze("Неведомая по ГОСТ 999")[1]
    assert book.strict("Литол-24 по ГОСТ 21150<!-- x -->; Двойная по ТУ 3") == [("Литол-24", "ГОСТ 21150"), ("Двойная", "ТУ 3")]
    assert book.strict("Литол-24") is None and book.strict("") == []
    entries = spark.createDataFrame([(*e, i) for i, e in enumerate(ENTRIES)], "brand string, document string, order int")
    got = normalize.normalize(spark.createDataFrame([(1, "литол 24"), (2, None), (3, " ")], "id int, t string"), entries, "t").orderBy("id").collect()
    assert got[0].normal.text == "Литол-24 по ГОСТ 21150" and got[1].normal.text is None and got[2].normal.items is None


def test_both_ways_agree(spark):
    """Shipped and joined catalogs give the same analysis of texts put together from all kinds of parts."""
    r = random.Random(5)
    parts = ["Литол-24", "литол 24", "ЦИАТИМ-201", "ЦИАТIM 203", "Смазка А", "Смазка", "Двойная", "Mobil X", "-DIN 5", "ГОСТ 21150", "по ГОСТ 6267", "по ТУ 1", "ТУ 2", "Неведомая по ГОСТ 999", "- по ТУ 1", "по", "Масло (зимнее", "и летнее)", "x"]
    texts = ["", " ", None, ";", "Литол-24 по ГОСТ 21150", "Смазка А, Смазка Б по ТУ 1; ЦИАТИМ-201 по ГОСТ 6267", "Новое масло по ТУ 7; 8"]
    texts += [r.choice(["", " "]).join(x for p in r.choices(parts, k=r.randrange(1, 6)) for x in (p, r.choice([" ", ", ", "; ", " и "]))) for _ in range(150)]
    entries = spark.createDataFrame([(*e, i) for i, e in enumerate(ENTRIES)], "brand string, document string, order int")
    cells = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    one, two = ({x.id: x.normal for x in normalize.normalize(cells, entries, "t", shipped=n).collect()} for n in (100, 0))
    for i, t in enumerate(texts):
        a, b = one[i], two[i]
        assert (a and a.text) == (b and b.text) and (a and a.resolved) == (b and b.resolved) and (a and a["items"]) == (b and b["items"]), t
    book = normalize.Catalog(ENTRIES)
    got = {x.id: x.pairs for x in normalize.strict(cells, entries, "t").collect()}
    for i, t in enumerate(texts):
        want = book.strict(t or "")
        assert got[i] == (None if want is None else [" по ".join(e) for e in want]), t


def test_proposals():
    book = normalize.Catalog(ENTRIES)
    item = lambda raw: book.analyze(raw)[2][0][4]
    assert item("Неведомая по ГОСТ 999") == ("Неведомая", "ГОСТ 999") and item("Чудо ГОСТ 21150") == ("ЧУДО", "ГОСТ 21150")
    assert item("Литол-24") is None and item("Двойная") is None and item("- по ТУ 1") is None and item("Xyz ISO 77") == ("Xyz", "ISO 77")


def test_resolution_against_brute_force(spark, monkeypatch):
    """All distinct texts against all entries, and no result depends on how they are dealt out."""
    r = random.Random(2)
    entries = ["ABCDEF", "ABXCDYEF", "AB1CD1EF", "Q", "QR", "МС-20", "МС 20 П", "Литол-24", "ЛИТОЛ 24 Р", ""] + ["".join(r.choices("ABCD12", k=r.randrange(3, 12))) for _ in range(60)]
    texts = ["ABZCDWEF", "AB1CD1EF", "x Q y", "мс20", "литол24", "", "по ABCDEF и ещё"] + ["".join(r.choices("ABCD12 -", k=r.randrange(2, 25))) for _ in range(120)]
    f = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")
    e = spark.createDataFrame([(x,) for x in entries], "name string")
    want = {}
    for k, t in enumerate(texts):
        scored = [(text_rules.likeness(normalize.bare(t), normalize.bare(x)), x) for x in set(entries)]
        best = max(s for s, _ in scored)
        near = [x for s, x in scored if s >= max(catalog.PLAUSIBLE, best - catalog.NEAR)]
        want[k] = (round(best, 9), len(near), near[0] if best >= catalog.SURE and len(near) == 1 else None) if near else (None, None, None)
    for tile in (4096, 16):
        monkeypatch.setattr(catalog, "TILE", tile)
        got = {x.id: (x.best and round(x.best, 9), x.n_plausible, x.resolved) for x in catalog.resolve(f, e, "text", "name").collect()}
        assert got == want
    # no three signs in a row are shared here
    one, two = (spark.createDataFrame([(x,)], "t string") for x in ("ABXCDYEF", "ABZCDWEF"))
    assert [x.score for x in catalog.alike(one, "t", two.withColumnRenamed("t", "e"), "e", 0.62).collect()] == [0.75]


@pytest.mark.parametrize("least, tile", [(0.62, 64), (0.78, 4096), (0.95, 4096)])
def test_similarity_join_against_brute_force(spark, monkeypatch, least, tile):
    """All pairs of all lengths: short and long texts, queries cut to pieces, entries longer than queries, repeated and empty ones."""
    monkeypatch.setattr(catalog, "TILE", tile)
    r = random.Random(int(least * 100) + tile)
    word = lambda a, b: "".join(r.choices("ABCDEFGH12", k=r.randrange(a, b)))
    entries = [word(1, 30) for _ in range(20)] + ["", None, "AB", "AB", "A" * 100]
    spoilt = lambda t: "".join(c if r.random() > 0.15 else r.choice("ABCDEFGH12") for c in t)
    asked = [word(1, 20) for _ in range(12)] + [word(0, 30) + spoilt(r.choice(entries[:20])) + word(0, 60) for _ in range(18)] + ["", None, "AB", "AB", "A" * 90, entries[0]]
    q, e = spark.createDataFrame([(t,) for t in asked], "t string"), spark.createDataFrame([(t,) for t in entries], "e string")
    got = {(x.t, x.e): round(x.score, 9) for x in catalog.alike(q, "t", e, "e", least).collect()}
    scores = {(t, x): text_rules.likeness(t, x) for t in set(asked) - {None} for x in set(entries) - {None}}
    assert got == {k: round(s, 9) for k, s in scores.items() if s >= least} and len(got) > 3
    assert catalog.alike(q, "t", e.limit(0), "e", least).count() == catalog.alike(q.limit(0), "t", e, "e", least).count() == 0


def test_longest_common_subsequence():
    r = random.Random(4)
    for _ in range(200):
        a, b = ("".join(r.choices("ABC", k=r.randrange(1, 90))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for j, y in enumerate(b):
                row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
        assert text_rules.in_order(a, text_rules.places(b), len(b)) == row[-1]
        if len(b) <= catalog.WORD:
            assert catalog.runs_in_order(["", a], ["", b])(np.array([1, 0, 1]), np.array([1, 1, 0])).tolist() == [row[-1], 0, 0]
    assert list(catalog.alike_in([("k", "AB", True)], [], 0.62)) == []


def test_resolution_query_against_brute_force(spark):
    """The registered query on its whole table."""
    d = "/root/testdata/sf0.01"
    names = sorted({r[0] for r in spark.read.parquet(f"{d}/nation.parquet").select("n_name").collect()})
    memo = {}
    got = queries.queries()["fuzzy_resolution"](spark, d).collect()
    assert len(got) == spark.read.parquet(f"{d}/customer.parquet").count()
    for r in got:
        if r.text not in memo:
            scored = [(text_rules.likeness(normalize.bare(r.text), normalize.bare(x)), x) for x in names]
            best = max(s for s, _ in scored)
            near = [x for s, x in scored if s >= max(catalog.PLAUSIBLE, best - catalog.NEAR)]
            memo[r.text] = (round(best, 6), len(near), near[0] if best >= catalog.SURE and len(near) == 1 else None) if near else (None, None, None)
        assert (r.best, r.n_plausible, r.resolved) == memo[r.text]


def test_likeness_is_the_best_ratio():
    r = random.Random(9)
    for _ in range(300):
        q, t = ("".join(r.choices("ABCD", k=r.randrange(1, 12))) for _ in range(2))
        spans = [q] + [q[a : a + n] for n in range(max(1, len(t) - 2), len(t) + 3) for a in range(len(q) - n + 1)]
        want = 1.0 if q == t else 0.9 if t in q else max(SequenceMatcher(None, s, t).ratio() for s in spans)
        assert text_rules.likeness(q, t) == want


def test_grid_status_and_export(spark):
    L, C, A, B = (" по ".join(e) for e in (ENTRIES[0], ENTRIES[1], ENTRIES[3], ENTRIES[4]))
    entries = spark.createDataFrame([(*e, i) for i, e in enumerate(ENTRIES)], "brand string, document string, order int")
    kinds = ["primary", "duplicate", "duplicate_reserve", "applicable_ground", "nato_index", "other"]
    rows = [[L, C, A, "+", "X-1", "note"], [L, "нет такой", "", "?", "", ""], [C, "", "", "-", "", ""], ["", "", "", "", "", "z"]]
    cells = spark.createDataFrame([(1, r, c, kinds[c], v) for r, row in enumerate(rows) for c, v in enumerate(row)], "grid int, row int, col int, kind string, value string")
    relations = spark.createDataFrame([(L, "дублирующая", C), (L, "дублирующая", A), (L.upper(), "РЕЗЕРВНАЯ", A)], "first string, type string, second string")
    attributes = spark.createDataFrame([(*ENTRIES[0], "applicable_ground", "+"), (*ENTRIES[0], "nato_index", "X-1"), (*ENTRIES[1], "applicable_ground", "+")], "brand string, document string, kind string, value string")
    got = {(r.row, r.col): r.status for r in grids.status(cells, entries, relations, attributes).collect()}
    assert [got[0, c] for c in range(6)] == ["linked"] * 5 + [""]
    assert [got[1, c] for c in range(6)] == ["relation-missing", "brand-missing", "", "applicability-invalid", "", ""]
    assert [got[2, c] for c in range(6)] == ["relation-missing", "", "", "applicability-missing", "", ""] and got[3, 5] == ""
    errors = {(r.row, r.error) for r in grids.export_errors(cells, entries).collect()}
    assert errors == {(1, "not in the catalog"), (1, "mark is neither + nor -"), (3, "no primary brand")}
    assert {(r.first, r.type, r.second) for r in grids.edges(cells, entries).where("row = 0").collect()} == {(L, "дублирующая", C), (L, "дублирующая", A), (L, "резервная", A)}
    pair = spark.createDataFrame([(2, 0, 0, "obsolete", A), (2, 0, 1, "prospective", B)], cells.schema)
    assert {r.status for r in grids.status(pair, entries, relations, attributes).collect()} == {"relation-missing"}
    assert grids.export_errors(pair, entries).count() == 0 and grids.edges(pair, entries).count() == 2


def test_commands(spark):
    o = spark.createDataFrame([("i1", "A"), ("i2", "B")], "item_id string, brand string")
    o = commands.upsert(o, spark.createDataFrame([("i2", "C")], o.schema), ["item_id"])
    assert {tuple(r) for r in o.collect()} == {("i1", "A"), ("i2", "C")}
    assert [tuple(r) for r in commands.clear(o, item_id="i1").collect()] == [("i2", "C")] and commands.clear(o).count() == 2
    items = spark.createDataFrame([("m", "R1", "main"), ("d", "R1", "duplicate"), ("x", "R2", "reserve")], "item_id string, row_id string, role string")
    new = spark.createDataFrame([("m", "d", "Дублирующая"), ("m", "d", "Резервная"), ("m", "x", "Резервная"), ("m", "?", "Резервная"), ("d", "d", "Дублирующая")], "main_item_id string, related_item_id string, relation_type string")
    assert sorted(r.error for r in commands.relation_errors(new, items).collect()) == ["items of different rows", "not a main and a related item", "type doesn't fit the role", "unknown item"]
    jobs = spark.createDataFrame([("a", "queued", 1, None), ("a", "running", 2, None), ("b", "queued", 3, None), ("b", "done", 5, None)], "job_id string, state string, at int, error string")
    now = commands.job_states(jobs)
    assert {r.job_id: (r.state, r.created) for r in now.collect()} == {"a": ("running", 1), "b": ("done", 3)}
    assert {r.job_id: r.state for r in commands.after_restart(now).collect()} == {"a": "failed", "b": "done"}
    assert commands.admitted(now, 2, 1, 2) and not commands.admitted(now, 3, 1, 2)
