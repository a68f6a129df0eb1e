"""Sidecars: every rule that a marker can break, defined results for odd documents, and the canonical form."""

import json

from weftline.operators import sidecars as S

SCHEMA = {"note": {"body": "text"}, "table": {"cells": "grid", "body": "text"}}
GRID = {"x": [0, 0.5, 1], "y": [0, 1]}
REGION = {"field": "body", "page": 1, "rect": [0, 0, 1, 1]}
CELLS = {**REGION, "field": "cells", "grid": GRID}


def document(meta, kind="region", of="note"):
    return f'<!-- object {{"type":"{of}"}} -->\n<!-- {kind} {meta if isinstance(meta, str) else json.dumps(meta)} -->\nx\n'


def grid(**changed):
    return document({**CELLS, "grid": {**GRID, **changed}}, "table", "table")


CASES = [
    (document(REGION), None),
    (document({**REGION, "page": "2", "rotation": "-90", "status": None}), None),
    (document({**REGION, "page": 1.9, "rotation": 450, "rect": ["0.5", 0, 0.5, 1.000001]}), None),
    (document(CELLS, "table", "table"), None),
    (grid(columnTypes=["primary", None], statuses=[["error", "lost", "more"], 5]), None),
    (document('{"field":}'), "not JSON"),
    (document({**REGION, "field": "cells"}), "unknown field"),
    (document({}), "unknown field"),
    (document(REGION, "table"), "marker of the wrong kind"),
    (document(CELLS, "region", "table"), "marker of the wrong kind"),
    (document({**REGION, "page": None}), "page isn't a number"),
    (document({**REGION, "page": "1.5"}), "page isn't a number"),
    (document({**REGION, "page": 0}), "no such page"),
    (document({**REGION, "page": 4}), "no such page"),
    (document({**REGION, "status": "done"}), "unknown status"),
    (document({**REGION, "rect": [0, 0, 1]}), "rect isn't a list of four numbers"),
    (document({**REGION, "rect": [0, 0, 1, "wide"]}), "rect isn't a list of four numbers"),
    (document({**REGION, "rect": "0011"}), "rect isn't a list of four numbers"),
    (document({**REGION, "rect": [-0.0000001, 0, 1, 1]}), "rect isn't on the page"),
    (document({**REGION, "rect": [0, 0, 0, 1]}), "rect isn't on the page"),
    (document({**REGION, "rotation": "left"}), "rotation isn't a number"),
    (document({**REGION, "rotation": 45}), "rotation isn't a quarter turn"),
    (document({**CELLS, "grid": [0]}, "table", "table"), "table without a grid"),
    (grid(x=[0]), "grid.x isn't a list of two numbers or more"),
    (grid(x=[0, 0.4, 0.4, 1]), "grid.x doesn't rise from 0 to 1"),
    (grid(y=[0.1, 1]), "grid.y doesn't rise from 0 to 1"),
    (grid(y="no"), "grid.y isn't a list of two numbers or more"),
    (grid(columnTypes=["primary"]), "grid.columnTypes doesn't fit the columns"),
    (grid(columnTypes=None), "grid.columnTypes doesn't fit the columns"),
    (grid(columnTypes=["primary", "wide"]), "grid.columnTypes has an unknown type"),
]


def parsed(spark, texts, pages=3):
    return S.parsed(spark.createDataFrame([(i, t, pages, "clash") for i, t in enumerate(texts)], "source int, text string, page_count int, objects string"), SCHEMA)


def test_each_rule(spark):
    docs = parsed(spark, [t for t, _ in CASES]).cache()
    got = {r.source: (r.object_no, r.region_no, r.error) for r in S.rejections(docs).collect()}
    for i, (text, error) in enumerate(CASES):
        assert got.get(i) == (error and (1, 1, error)), text
    good = {r.source: r for r in S.regions(docs).collect()}
    assert set(good) == {i for i, (_, error) in enumerate(CASES) if error is None}
    assert (good[1].page, good[1].rotation, good[1].status) == (2, 270, "pending") and (good[2].page, good[2].rotation, good[2].rect) == (1, 90, [0.5, 0, 0.5, 1.000001])
    assert good[4].grid.statuses == [["error", "pending"]] and good[4].grid.columnTypes == ["primary", ""] and good[3].grid.columnTypes == ["", ""]
    docs.unpersist()


def test_documents_as_a_whole(spark):
    first = document(REGION)
    texts = [None, "", " \n", "words", "words\n" + first, document(REGION, of="lost"), '<!-- object {"type":"note"} -->\nwords\n', '<!-- region {"field":"body"} -->\n' + first + document({}), '<!-- object {"type":"note"} -->', "<!-- object {type} -->" + first]
    docs = parsed(spark, texts)
    got = {r.source: ([tuple(w) for w in r.rejections], len(r.objects)) for r in docs.collect()}
    assert got[0] == got[1] == got[2] == ([], 0) and got[8] == ([], 1)
    assert got[3][0] == [(0, 0, "no markers")] and got[4][0] == [(0, 0, "text before the first marker")]
    assert got[5][0] == [(1, 0, "unknown type")] and got[6][0] == [(1, 0, "text before the first region")] and got[9][0] == [(1, 0, "not JSON")]
    assert got[7] == ([(0, 1, "region before any object"), (2, 1, "unknown field")], 2)
    assert parsed(spark, []).count() == 0 and S.regions(parsed(spark, [])).count() == 0
    # without page_count, any page goes; rows that repeat a source are read one by one
    twice = S.parsed(spark.createDataFrame([("s", document({**REGION, "page": 99}))] * 2, "source string, text string"), SCHEMA)
    assert S.regions(twice).count() == 2 and S.rejections(twice).count() == 0


def test_canonical_form(spark):
    told = document({**REGION, "status": "error", "error": " why "}) + document({**REGION, "error": "stale", "status": "running"})
    cell = '| Norm <!-- tool:ocr "a \\" b" --> | B |'
    table = f'<!-- tool:object {{"type":"table"}} -->\n<!-- TOOL:TABLE {json.dumps(CELLS)} -->\r\n\n{cell}\n\n'
    long = "word\n" * 200_000
    docs = parsed(spark, [told + table + f'<!-- region {json.dumps(REGION)} -->\n{long}'])
    (out,) = S.serialized(docs, "tool").collect()
    assert "why" in out.text and "stale" not in out.text and "running" not in out.text and "| Norm | B |" in out.text and 'ocr' not in out.text
    assert out.text.startswith('<!-- tool:object {"type":"note"} -->\n<!-- tool:region {"field":"body","page":1,"rect":[0.0,0.0,1.0,1.0],"rotation":0,"status":"error","error":"why"} -->\nx\n\n<!-- tool:object')
    assert out.text.endswith("word\n") and out.text.count("word") == 200_000
    again = parsed(spark, [out.text])
    assert again.collect()[0].objects == docs.collect()[0].objects and S.serialized(again, "tool").collect()[0].text == out.text
    assert [r.text for r in S.serialized(parsed(spark, [told, document({}), " "])).orderBy("source").collect()][1:] == [None, ""]


def test_nothing_is_shuffled(spark):
    docs = parsed(spark, [document(REGION)])
    plan = S.regions(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
