"""File checks, office views, page arithmetic, paths, options, manifests and queues."""

import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import geometry as G
from weftline.functions import text as X
from weftline.functions.fixed import IMAGE_BYTES, IMAGE_KINDS, PDF_BYTES
from weftline.operators import commands
from weftline.sources import files, office


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_refused_files(spark):
    raw = [b"%PDF-1.7", b"", b"\x89PNG\r\n\x1a\n..", b"RIFF....WEBPVP8 ", b"\xff\xd8\xff\xe0", b"GIF89a", None]
    df = spark.createDataFrame(list(enumerate(raw)), "id int, content binary").select("id", files.refused(F.col("content"), ("pdf",), PDF_BYTES).alias("pdf"), files.refused(F.col("content"), IMAGE_KINDS, IMAGE_BYTES).alias("image"), files.refused(F.col("content"), IMAGE_KINDS, 4).alias("small"))
    got = {r.id: r for r in df.collect()}
    assert got[0].pdf is None and got[1].pdf == "empty file" and got[6].image == "empty file" and "not one of" in got[2].pdf
    assert [got[k].image for k in (2, 3, 4)] == [None] * 3 and "not one of" in got[5].image and got[2].small == "more than 0 MB"
    assert one(spark, files.wrong_suffix(F.lit("a/b.DOCX"), (".docx",)), files.wrong_suffix(F.lit("b.txt"), (".docx",)))[:] == (None, "unsupported file type .txt; expected .docx")


def test_paths_and_values(spark):
    got = one(spark, X.asset_path(F.lit("img\\a.png")), X.asset_path(F.lit("../a")), X.markdown_path(F.lit("x/y.z.pdf")), X.markdown_path(F.lit("x/.hidden")), X.sidecar_path(F.lit("a.pdf")), X.upload_name(F.lit(" C:\\d\\a%20b<1>.PDF ")), X.upload_name(F.lit("a.txt")), X.upload_name(F.lit(".pdf")))
    assert got[:] == ("img/a.png", None, "x/y.z.md", "x/.hidden.md", "a.pdf.regions.md", "a b_1_.PDF", None, None)
    now = one(spark, X.utc_now())[0]
    assert abs((dt.datetime.fromisoformat(now) - dt.datetime.now(dt.timezone.utc)).total_seconds()) < 300
    values = one(spark, X.json_value(F.lit(dt.date(2024, 2, 3)), T.DateType()), X.json_value(F.lit("2024-02-03 04:05:06").cast("timestamp_ntz"), T.TimestampNTZType()), X.json_value(F.expr("interval '1 02:03:04.5' day to second"), T.DayTimeIntervalType()), X.json_value(F.lit(5), T.IntegerType()))
    assert values[:3] == ("2024-02-03", "2024-02-03T04:05:06", "93784.5") and values[3] == "5"


def test_page_arithmetic(spark):
    box = G.letterbox(F.lit(200), F.lit(100), 50)
    got = one(spark, box, G.unletterbox(box, F.lit(200), F.lit(100)), G.centred(F.lit(5.0), F.lit(20), F.lit(100)), G.centred(F.lit(95.0), F.lit(300), F.lit(100)))
    assert got.c0[:] == (50, 25, 0, 12) and got.c1.part[:] == (0, 12, 50, 37) and got.c1.x_factor == 4 and got.c2[:] == (0, 20) and got.c3[:] == (0, 100)
    mask = F.struct(F.lit(40).alias("left"), F.lit(40).alias("top"), F.lit(60).alias("right"), F.lit(50).alias("bottom"))
    assert one(spark, G.crop_box(mask, F.lit(100), F.lit(80), 0.5))[0][:] == (30, 25, 70, 65)
    assert one(spark, G.clamped(F.lit(700), 1, 500), G.clamped(F.lit(-3), 1, 500))[:] == (500, 1)


def test_office_views():
    made = office.new_docx(["One", "", "Two", "Three"])
    view = files.docx_view(made, 2)
    assert [p["text"] for p in view["paragraphs"]] == ["One", "Two"] and view["paragraph_count"] == 3 and view["truncated"] and view["paragraphs"][1]["index"] == 2
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    cell = lambda t, inner="": f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p>{inner}</w:tc>"
    nested = f"<w:tbl><w:tr>{cell('deep')}</w:tr></w:tbl>"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="h1"/></w:pPr><w:r><w:t>T</w:t></w:r></w:p><w:tbl><w:tr>{cell("a")}{cell("b", nested)}</w:tr></w:tbl></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{w}"><w:style w:styleId="h1"><w:name w:val="Heading 1"/></w:style></w:styles>')
        z.writestr("word/header1.xml", f'<w:hdr xmlns:w="{w}"><w:p><w:r><w:t>top</w:t></w:r></w:p></w:hdr>')
    view = files.docx_view(out.getvalue(), 10)
    assert view["paragraphs"] == [{"index": 0, "style": "Heading 1", "text": "T"}] and view["tables"] == [{"index": 0, "rows": 1, "columns": 2, "values": [["a", "b"]]}] and not view["truncated"]
    assert {t for _, _, t in files.docx_paragraphs(out.getvalue())} == {"T", "a", "b", "deep", "top"}
    book = office.new_xlsx({"S": {"A1": "x", "B2": "=A1", "AA3": "5"}, "E": {}})
    view = files.xlsx_view(book, most_rows=2, most_columns=2)
    assert view["sheet_names"] == ["S", "E"] and view["sheets"][0]["truncated"] and not view["sheets"][1]["truncated"]
    assert [[c["value"] for c in r] for r in view["sheets"][0]["rows"]] == [["x", None], [None, "=A1"]]
    part = files.xlsx_view(book, "S", "Z2:AA3")["sheets"][0]
    assert [[c["cell"] for c in r] for r in part["rows"]] == [["Z2", "AA2"], ["Z3", "AA3"]] and part["rows"][1][1]["data_type"] == "number" and not part["truncated"]
    with pytest.raises(ValueError):
        files.xlsx_view(book, "none")
    with pytest.raises(ValueError):
        office.checked_output("a", "a")
    assert office.checked_output("a", "a", True) == "a"


def test_schema_and_options():
    field = {"name": " F ", "prompt": {"instruction": "i", "input": "{x}"}}
    told = files.domain_schema({"types": {"t": {"name": "T", "fields": {"f": field, "g": {**field, "kind": "grid"}}}}})
    assert told["types"]["t"]["fields"]["f"] == {"name": "F", "kind": "text", "prompt": {"instruction": "i", "input": "{x}"}}
    assert files.public_schema(told) == {"types": {"t": {"name": "T", "fields": {"f": {"name": "F", "kind": "text"}, "g": {"name": "F", "kind": "grid"}}}}}
    for bad in ({}, {"types": {}}, {"types": {"t": {"name": "T", "fields": {}}}}, {"types": {"t": {"name": "T", "fields": {"f": {**field, "kind": "x"}}}}}, {"types": {"t": {"name": "T", "fields": {"f": {"name": "F"}}}}}, {"types": 1, "x": 2}):
        with pytest.raises(ValueError):
            files.domain_schema(bad)
    how = ({"useTable": "table", "useSeal": "seal", "threshold": "threshold"}, ("cloud",), ("useTable",), {"table": "t", "seal": "s"}, {"t"})
    assert files.predict_options({"threshold": 0.5, "cloud": 1}, *how) == {"table": True, "seal": False, "threshold": 0.5}
    for bad in ({"x": 1}, {"useTable": False}, {"useSeal": True}):
        with pytest.raises(ValueError):
            files.predict_options(bad, *how)


def test_manifest_bundle_and_results(spark, tmp_path):
    rows = [(0, "a.png", "r0", 5, "o0.png", None, b"0"), (1, "b.png", "r1", 6, None, "bad mask", None)]
    df = spark.createDataFrame(rows, "index int, source_name string, request_id string, seed long, output string, error string, content binary")
    told = files.write_bundle(df, f"{tmp_path}/all.zip")
    assert (told["count"], told["successful"], told["failed"]) == (2, 1, 1)
    with zipfile.ZipFile(tmp_path / "all.zip") as z:
        assert z.read("o0.png") == b"0" and json.loads(z.read("manifest.json"))["items"][1]["error"] == "bad mask"
    results = spark.createDataFrame([("j1", "img/a.png"), ("j1", "b"), ("j2", "img/a.png")], "job_id string, asset string")
    assert files.results_of(results, "j1").count() == 2 and files.results_of(results, "j1", "img\\a.png").count() == 1
    with pytest.raises(ValueError):
        files.results_of(results, "j1", "../x")


def test_queues(spark):
    states = spark.createDataFrame([("a", "running", 1), ("b", "queued", 3), ("c", "queued", 2), ("d", "queued", 4), ("e", "done", 0)], "job_id string, state string, created int")
    assert [(r.job_id, r.worker) for r in commands.dealt(states, 3).orderBy("worker").collect()] == [("c", 2), ("b", 3)] and commands.dealt(states, 1).count() == 0
    devices = spark.createDataFrame([(10, 4), (20, 5)], "total long, used long")
    assert commands.gauges(devices, states, 8).first()[:] == (2, 30, 9, 1, 3, 5)
    items, refs = (spark.createDataFrame([(i, f"{n}{i}") for i in range(3)], f"index int, {n} string") for n in ("item", "ref"))
    assert {(r.item, r.ref) for r in commands.with_references(items, refs).collect()} == {(f"item{i}", f"ref{i}") for i in range(3)}
    assert {r.ref for r in commands.with_references(items, refs.limit(1)).collect()} == {"ref0"}
    with pytest.raises(ValueError):
        commands.with_references(items, refs.limit(2))


def test_candidates_come_in_pages(spark):
    from weftline.operators import relations as R

    purposes = spark.createDataFrame([(f"P{k:04}", "b || d" if k < 300 else f"b || {k}", "b") for k in range(1000)] + [("P9", None, None)], "purpose_row_id string, match_key string, match_brand string")
    items = spark.createDataFrame([("b || d", "b")] * 5 + [("b || x", "b"), ("c || d", "c"), (None, None)], "match_key string, match_brand string")
    got = R.purpose_candidates(items, purposes, page=50).collect()
    ids = {}
    for r in got:
        assert len(r.purpose_row_ids) < 150
        ids.setdefault((r.match_key, r.by), []).extend(r.purpose_row_ids)
    assert {k: sorted(v) for k, v in ids.items()} == {("b || d", "exact"): [f"P{k:04}" for k in range(300)], ("b || x", "brand_only"): [f"P{k:04}" for k in range(1000)]}
    full = items.withColumns({c: F.lit("") for c in ("group", "subgroup")})
    told = R.match_purposes(full, purposes.withColumn("purpose", F.lit("one")).withColumn("purpose_index", F.substring("purpose_row_id", 2, 9).cast("int")).withColumns({c: F.lit("") for c in ("group", "subgroup")}))
    assert {(r.match_key, r.match_type, r.n_candidates) for r in told.collect()} == {("b || d", "exact", 300), ("b || x", "brand_only", 1000), ("c || d", "not_found", 0), (None, "not_found", 0)}


def test_top_candidates_of_all_items(spark):
    import random

    from weftline.operators import relations as R

    pick = random.Random(5)
    brand = lambda: pick.choice(["", "a", "ab", "abc", "abcd", "xabcdx", "bcd", "zz", "abcabc", None])
    side = lambda: pick.choice(["g", "h", None])
    row = lambda: (pick.choice(["k1", "k2", "k3", None]), brand(), side(), side())
    held = [(i, *row()) for i in range(600)]
    asked = [row() for _ in range(60)] * 2
    names = "match_key string, match_brand string, group string, subgroup string"
    purposes, items = spark.createDataFrame(held, f"purpose_row_id int, {names}"), spark.createDataFrame(asked, names)

    def best(item, limit):
        found = []
        for i, *p in held:
            same = [a is not None and a == b for a, b in zip(item, p)]
            part = item[1] and p[1] is not None and item[1] in p[1]
            if base := 100 if same[0] else 70 if same[1] and part else 30 if part else 0:
                found.append((-base - 10 * same[2] - 10 * same[3], i))
        return [(i, -s) for s, i in sorted(found)[:limit]]

    for limit in (1, 7, 100):
        got = {}
        for r in R.top_candidates(items, purposes, limit).orderBy("rank").collect():
            got.setdefault(tuple(r[:4]), []).append((r.purpose_row_id, r.score))
        assert got == {item: told for item in set(asked) if (told := best(item, limit))}
    assert R.top_candidates(items.limit(0), purposes).count() == R.top_candidates(items, purposes.limit(0)).count() == 0
    plan = R.top_candidates(items, purposes)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
