"""Folded rows: flags are numbered by counts alone, and only where a report names them."""

from weftline.operators import nested as E
from weftline.plans import queries as Q

ROWS = "row_id string, batch_id string, row_index int, source_file string, table_id string, `group` string, subgroup string, ground boolean, aviation boolean, marine boolean, note string, row_flags array<string>"
ITEMS = "item_id string, row_id string, role string, index int, brand string, document string, brand_key string, raw_item string, review_flags array<string>, match_type string, purpose_text string, match_flags array<string>, reviewed boolean, cell_id string"


def test_numbers_run_through_a_batch_where_a_row_repeats_an_id(spark):
    row = lambda i, batch, n, note: (i, batch, n, "f", "T", "", "", None, None, None, note, ["x"])
    rows = spark.createDataFrame([row("R1", "B1", 1, "a"), row("R2", "B1", 2, "b"), row("R2", "B1", 2, "c"), row("R3", "B1", 3, ""), row("R2", "B2", 9, "d")], ROWS)
    items = spark.createDataFrame([("i1", "R1", "reserve", 1, "p", None, "p", "p", ["empty_brand"], "exact", "u", [], False, "R1.reserve")], ITEMS)
    got = sorted(r.flag_id + r.category for r in E.flags(E.fold(rows, items)).collect())
    # the open question of R1 comes last in its batch
    assert got == ["B1:F0001x", "B1:F0002empty_brand", "B1:F0003x", "B1:F0004x", "B1:F0005x", "B1:F0006missing_main_item", "B2:F0001x"]
    bare = E.flags(E.fold(rows, items, numbered=False))
    assert bare.where("flag_id is null").count() == len(got)


def test_reports_shuffle_no_nested_rows_by_batch(spark):
    plan = lambda f: f(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    for f in (Q.batch_quality, Q.row_lineage, Q.staged_brands):
        assert "Window" not in plan(f) and "Scan parquet" in plan(f), f.__name__
