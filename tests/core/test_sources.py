"""Table sources, headers, items and the document pipeline on small own fixtures."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import chunks, documents, relations
from weftline.sources import files as files_module
from weftline.sources import tables

BRANDS = """<table>
<tr><th rowspan=2>Группа ГСМ</th><th rowspan=2>Подгруппа ГСМ</th><th colspan=3>Применяемость</th><th colspan=4>Марки</th><th rowspan=2>Примечание</th></tr>
<tr><th>Наземная техника</th><th>Авиационная техника</th><th>Морская техника</th><th>Основная марка</th><th>Дублирующая марка</th><th>Резервная марка</th><th>Зарубежная марка</th></tr>
<tr><td rowspan=2>Масла</td><td>Моторные</td><td>+</td><td>-</td><td>?</td><td>1) А-1 по ГОСТ 10<br>2) А-2 по ТУ 20</td><td>Д-1 по ГОСТ 11<br>Д-2 по ТУ 21</td><td></td><td>Oil X</td><td>сн. 1</td></tr>
<tr><td>Осевые</td><td>нет</td><td></td><td></td><td>Б-1 по ГОСТ 30</td><td></td><td>Р-1, ТУ 5; Р-2 по ТУ 6</td><td></td><td></td></tr>
</table>"""
PURPOSES = """<table><tr><th>Группа</th><th>Марка ГСМ</th><th>Назначение</th></tr>
<tr><td>Масла</td><td>А-1 по ГОСТ 10</td><td>для  двигателей</td></tr><tr><td></td><td>А-2</td><td>иное</td></tr><tr><td>Пусто</td><td></td><td></td></tr></table>"""
MARKDOWN = """Text
| Основная | Дублирующая | Резервная | Зарубежная |
|---|:---:|---|---|
| М \\| 1 по ГОСТ 1 | Д<br>Е |  | x |

| a |
"""


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("pages")
    (d / "a.html").write_text(BRANDS + PURPOSES, encoding="utf-8")
    (d / "a.md").write_text("| not | read |\n|---|---|\n| 1 | 2 |", encoding="utf-8")
    (d / "b.md").write_text(MARKDOWN, encoding="utf-8")
    found = tables.with_headers(tables.extract_tables(tables.discover(spark, str(d)))).cache()
    brand = tables.select_tables(found, "brand")
    return found, brand, tables.select_tables(found, "purpose", without=brand)


def test_tables_and_headers(parts):
    got = parts[0].orderBy("document_order").collect()
    assert [(r.table_id, r.source_format, r.row_count, r.column_count) for r in got] == [("T000001", "html", 4, 10), ("T000002", "html", 4, 3), ("T000003", "markdown", 2, 4)]
    one, two, three = got
    assert one.brand_candidate.valid and one.brand_candidate.header_depth == 2 and one.brand_candidate.column_map["main"] == 5
    assert two.purpose_candidate.valid and not two.brand_candidate.valid
    assert one.matrix[3][0] == "Масла" and three.matrix[1] == ["М | 1 по ГОСТ 1", "Д\nЕ", "", "x"]


def test_rows_items_relations(spark, parts):
    rows = relations.source_rows(parts[1]).orderBy("row_index").collect()
    assert [(r.row_id, r.group, r.subgroup, r.ground, r.aviation, r.marine, r.row_flags) for r in rows] == [
        ("R000001", "Масла", "Моторные", True, False, None, ["unrecognized_marine_equipment_marker"]),
        ("R000002", "Масла", "Осевые", False, None, None, []),
        ("R000003", "Масла", "Осевые", None, None, None, []),
    ]
    items = relations.items(relations.source_cells(relations.source_rows(parts[1]))).cache()
    got = {r.item_id: (r.brand, r.document, r.review_flags) for r in items.collect()}
    assert got["R000001.main.01"] == ("А-1", "ГОСТ 10", []) and got["R000001.main.02"][:2] == ("А-2", "ТУ 20")
    assert got["R000002.reserve.01"] == ("Р-1", "ТУ 5", ["normdoc_without_po"]) and got["R000002.reserve.02"][0] == "Р-2"
    assert got["R000001.foreign.01"] == ("Oil X", None, ["normdoc_not_found"])
    pairs, open_ = relations.map_relations(items)
    assert {(r.main_brand, r.related_brand, r.mapping_basis) for r in pairs.collect()} == {
        ("А-1", "Д-1", "positional"), ("А-2", "Д-2", "positional"), ("Б-1", "Р-1", "single-main"), ("Б-1", "Р-2", "single-main"), ("М | 1", "Д", "single-main"), ("М | 1", "Е", "single-main"), ("М | 1", "x", "single-main")}
    assert [(r.row_id, r.role, r.flag) for r in open_.collect()] == [("R000001", "foreign", "ambiguous_relation_mapping")]
    want = relations.purposes(parts[2])
    named = items.join(relations.source_rows(parts[1]).select("row_id", "group", "subgroup"), "row_id").where("role = 'main'")
    told = {r.brand: (r.match_type, r.purpose_text) for r in relations.match_purposes(named, want).collect()}
    assert told == {"А-1": ("exact", "для двигателей"), "А-2": ("brand_only", "иное"), "Б-1": ("not_found", None), "М | 1": ("not_found", None)}


def test_text_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(X.clean_text(F.lit(" a  b​\r\n\r\n\n\n c\t"))) == "a b\n\nc" and value(X.clean_text(F.lit(None))) == ""
    assert value(X.comparison_text(F.lit("«Ёж»  Straße – x"))) == "еж strasse - x"
    assert value(X.cell_items(F.lit("• A по ГОСТ 1; B по ТУ 2\n1. C; D"))) == ["A по ГОСТ 1", "B по ТУ 2", "C; D"]
    assert value(X.match_text(F.lit("Maсло  ёl"))) == "МАСЛО Е1" and value(X.compact(F.lit("a-1 / б"))) == "А1Б"
    assert value(X.similarity(F.lit("МАСЛО"), F.lit("МАСЛО"))) == 1.0 and value(X.similarity(F.lit("XМАСЛОX"), F.lit("МАСЛО"))) == 0.9
    assert value(X.brand_item(F.lit("Mасло по ГОСТ 1"), F.lit("ТУ 2"))).flags == ["mixed_latin_cyrillic", "normdoc_conflict_with_separate_column"]
    assert value(X.clean_markup(F.lit("# T\n![i](x) <div>a &amp; b</div>  "))) == "T\n a & b"


def test_chunks_keep_the_budget(spark):
    head = "<table><tr><th>A</th><th>B</th></tr>"
    block = head + "".join(f"<tr><td>{i}</td><td>{'слово ' * (3 if i != 5 else 200)}</td></tr>" for i in range(40)) + "</table>"
    parts = chunks.block_chunks(block, "table", 120)
    assert len(parts) > 3 and all(chunks.tokens(p) <= 120 for p in parts)
    assert "".join(parts).count("<th>A</th>") >= 3 and "<th>Поле</th>" in "".join(parts)
    text = "word " * 50 + "x" * 900
    cut = chunks.text_chunks(text, 40)
    assert "".join("".join(cut).split()) == "".join(text.split()) and all(chunks.tokens(p) <= 40 for p in cut)
    df = spark.createDataFrame([(1, text, "text"), (2, None, "text"), (3, "short", None)], "id int, content string, label string")
    assert [(r.id, r.chunk_no) for r in chunks.chunked(df, budget=40).orderBy("id", "chunk_no").collect()] == [(1, i) for i in range(len(cut))] + [(3, 0)]
    one = spark.range(1).select(X.approximate_tokens(F.lit(block)).alias("n")).first().n
    assert one == chunks.tokens(block)


def test_recognition_results(spark):
    lines = [
        '{"result":{"layoutParsingResults":[{"prunedResult":{"overall_ocr_res":{"rec_texts":["a","b"]}}}]}}',
        '{"result":{"layoutParsingResults":[{"prunedResult":{"parsing_res_list":[{"block_label":"image","block_content":"x"},{"block_label":"text","block_content":" c "}]}}]}}',
        '{"result":{"markdown":{"text":"md"}}}',
        '{"result":{}}',
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert [r.text for r in chunks.flatten(df).collect()] == ["a\nb", "c", "md", None]
    assert spark.createDataFrame([('{"input_path":1,"a":[{"page_index":2,"b":"ё"}]}',)], "v string").select(chunks.prune("v")).first()[0] == '{"a":[{"b":"ё"}]}'
    got = chunks.recognised(spark.createDataFrame([(1, b"ok"), (2, b"bad")], "id int, content binary"), lambda raw: raw.decode() if raw == b"ok" else 1 / 0).orderBy("id").collect()
    assert got[0].text == "ok" and got[1].text is None and "ZeroDivisionError" in got[1].error


def test_sidecar_round_trip(spark):
    text = '<!-- object: {"type": "t"} -->\n<!-- region: {"kind": "text", "field": "f", "page": 1, "rect": [0, 0, 1, 0.5], "status": "running"} -->\nhello\n<!-- end -->\n'
    rows = documents.parse("d", text)
    assert rows[0][9] == "pending" and rows[0][11] == "hello"
    again = documents.serialize(rows)
    assert documents.serialize(documents.parse("d", again)) == again
    assert documents.regions(spark.createDataFrame([("d", text)], "source string, text string")).count() == 1
    assert documents.render_prompt("{a}-{b}", {"a": "1", "b": "2"}) == "1-2"
    with pytest.raises(KeyError):
        documents.render_prompt("{c}", {})


def test_csv_catalog(spark, tmp_path):
    (tmp_path / "c.csv").write_text("﻿Марка ГСМ;Нормативный документ\nA;ГОСТ 1\na;гост 1\n\"B;C\";ТУ 2\n;\nD;\n", encoding="utf-8")
    (tmp_path / "w.csv").write_bytes("Марка ГСМ,Нормативный документ\nЖ,ОСТ 3\n".encode("cp1251"))
    rows = files_module.read_csv(spark, str(tmp_path))
    got = files_module.catalog(rows, F.col("cells")["марка гсм"], F.col("cells")["нормативный документ"], F.concat_ws("|", X.match_text(F.col("brand")), X.match_text(F.col("document"))), F.struct("path", "line"))
    assert {(r.brand, r.document, r.error) for r in got.collect()} == {("A", "ГОСТ 1", None), ("B;C", "ТУ 2", None), ("D", "", "incomplete"), ("Ж", "ОСТ 3", None)}


def test_batches_replace_themselves(spark, tmp_path):
    from weftline.streaming import incremental

    src, out = f"{tmp_path}/src", f"{tmp_path}/out"
    spark.range(0, 10).write.parquet(f"{src}")
    n = incremental.run_stream(spark, src, "id long", out, f"{tmp_path}/cp", lambda df: df.withColumn("v", F.col("id") * 2))
    assert n == len([1 for _ in range(n)]) > 0 and spark.read.parquet(out).count() == 10
    assert incremental.run_stream(spark, src, "id long", out, f"{tmp_path}/cp", lambda df: df.withColumn("v", F.col("id") * 2)) == 0
    incremental.stage(spark.range(3).withColumn("v", F.col("id")), out, 1)
    incremental.stage(spark.range(5).withColumn("v", F.col("id")), out, 1)
    assert spark.read.parquet(out).where("batch_id = 'B000001'").count() == 5
