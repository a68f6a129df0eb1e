"""HTML files in pieces: the tables and rows of the whole file, with no task that holds a file or a table."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import relations
from weftline.plans import queries as P
from weftline.sources import tables

HEAD = "<table><tr><th>Группа</th><th colspan=4>Марки</th></tr><tr><th></th><th>Основная марка</th><th>Дублирующая марка</th><th>Резервная марка</th><th>Зарубежная марка</th></tr>"
ROWS = [
    "<tr><td rowspan=2>Масла</td><td>А по ГОСТ 1</td><td>Д по ТУ 2</td><td></td></tr><tr><td>Б по ГОСТ 3</td><td></td><td>Р по ТУ 4</td></tr>",
    "<tr><td></td><td>В по ГОСТ 5<table><tr><td>n</td><td>m</td></tr><tr><td>1</td><td>2</td></tr></table></td><td>x</td><td></td><td>wide</td></tr>",
    "<tr><td>Смазки</td><td>Г по ГОСТ 6</td><td>Ж по ТУ 7</td><td></td></tr>",
    "<tr><td></td><td>З по ГОСТ 8</td><td>И по ТУ 9</td><td rowspan=9></td></tr>",
]
#: Two long tables, one of a single row and one that stays open, each text above a cut.
PAGE = ["<p>Text</p>", HEAD, *ROWS[:3], ROWS[3] + "</table><tr><td>stray</td></tr><table><tr><td>one</td><td>row</td></tr></table>", HEAD, "", ROWS[0] * 3, "<tr><td>а</td></tr></table> more ", HEAD + ROWS[2]]


def _pieces(spark, pages):
    rows = [(name, i - 2, text.encode()) for name, texts in pages.items() for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "path string, piece int, content binary").repartition(3)


def _whole(spark, pages):
    return spark.createDataFrame([(name, "".join(texts).encode()) for name, texts in pages.items()], "path string, content binary")


@pytest.mark.parametrize("block", [5, 4096])
def test_pieces_hold_the_tables_of_their_files(spark, monkeypatch, block):
    monkeypatch.setattr(tables, "BLOCK", block)
    pages = {"b.html": PAGE, "A.html": PAGE[1:5] + ["</table>"], "c.html": ["none"], "d.html": ["".join(PAGE)]}
    want = {r.table_id: r for r in tables.with_headers(tables.extract_tables(_whole(spark, pages))).collect()}
    found, blocks = tables.extract_pieced(_pieces(spark, pages))
    got = {r.table_id: r for r in tables.with_headers(found).collect()}
    assert len(want) == 10 and got.keys() == want.keys()
    for name, w in want.items():
        g = got[name]
        assert (g.source_file, g.document_order, g.row_count, g.column_count) == (w.source_file, w.document_order, w.row_count, w.column_count)
        assert (g.brand_candidate, g.purpose_candidate, g.matrix) == (w.brand_candidate, w.purpose_candidate, w.matrix[: tables.DEEPEST + 1])
    held = {}
    for r in blocks.of(found).orderBy("table_id", "first_row").collect():
        rows = held.setdefault(r.table_id, [])
        assert r.first_row == len(rows) and len(r.matrix) <= tables.BLOCK
        rows += [line + [""] * (r.column_count - len(line)) for line in r.matrix]
    assert held == {name: w.matrix for name, w in want.items()}


def test_rows_of_pieces_are_the_rows_of_their_files(spark):
    pages = {"b.html": PAGE, "A.html": PAGE[1:5] + ["</table>"]}
    want = relations.source_rows(tables.select_tables(tables.with_headers(tables.extract_tables(_whole(spark, pages))), "brand"))
    found, blocks = tables.extract_pieced(_pieces(spark, pages))
    got = relations.source_rows(tables.select_tables(tables.with_headers(found), "brand"), blocks)
    assert got.columns == want.columns and want.count() > 15
    assert got.orderBy("row_index").collect() == want.orderBy("row_index").collect()


@pytest.mark.parametrize("texts, why", [
    ([HEAD + "<tr><td>a", "b</td></tr></table>"], "within a cell"),
    ([HEAD + "<tr><td rowspan=2>a</td><td>b</td></tr>", "<tr><td>c</td></tr></table>"], "spans rows of two pieces"),
    ([HEAD, "<tr><td>a<table><tr><td>b</td></tr>", "</table></td></tr></table>"], "within a cell"),
    ([HEAD, "<table><tr><td>b</td></tr>", "</table></table>"], "goes on in another piece"),
])
def test_pieces_that_cut_what_belongs_together_are_refused(spark, texts, why):
    with pytest.raises(Exception, match=why):
        tables.extract_pieced(_pieces(spark, {"a.html": texts}))[0].collect()


def test_pages_of_parts_are_bounded(spark, tmp_path):
    n = 60_000
    part = spark.range(n).select(F.col("id").alias("p_partkey"), F.lit("hot bolt").alias("p_name"), F.lit("Brand#7").alias("p_brand"), F.lit("LARGE").alias("p_type"), (F.col("id") % 50).cast("int").alias("p_size"))
    part.write.parquet(f"{tmp_path}/part.parquet")
    longest, total = P._brand_pages(spark, str(tmp_path)).agg(F.max(F.length("content")), F.sum(F.length("content"))).first()
    assert total > 7_000_000 and longest < 4_000_000


def test_table_pipeline_in_small_pieces(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    monkeypatch.setattr(P, "PAGE_KEYS", 10**9)
    want = sorted(map(tuple, P.table_pipeline(spark, d).collect()))
    monkeypatch.setattr(P, "PAGE_KEYS", 7)
    assert len(want) == 200 and sorted(map(tuple, P.table_pipeline(spark, d).collect())) == want
