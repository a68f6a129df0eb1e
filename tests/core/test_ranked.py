"""Ranked purposes with parts in either direction."""

from pyspark.sql import functions as F

from weftline.operators import relations as R
from weftline.plans import queries as Q


def test_parts_count_both_ways_where_asked(spark):
    p = spark.createDataFrame([("P1", "brand 17"), ("P2", "brand 1"), ("P3", "brand 170"), ("P4", ""), ("P5", "other"), ("P6", None)], "purpose_row_id string, match_brand string")
    p = p.select("*", F.lit("").alias("match_key"), F.lit("g").alias("group"), F.lit("").alias("subgroup"))
    ask = lambda **kw: [(r.purpose_row_id, r.score) for r in R.candidates(p, F.lit(None), F.lit("brand 17"), F.lit(None), F.lit(None), 100, **kw).collect()]
    assert ask() == [("P1", 70), ("P3", 30)]
    assert ask(either=True) == [("P1", 70), ("P2", 30), ("P3", 30)]


def test_the_query_ranks_parts_both_ways(spark):
    assert "OR contains((SELECT p_brand FROM part WHERE p_partkey = 1), p_brand)" in Q.oracle_sql()["ranked_candidates"]
    assert Q.ranked_candidates(spark, "/root/testdata/sf0.01").where("score in (30, 40)").count() > 0
