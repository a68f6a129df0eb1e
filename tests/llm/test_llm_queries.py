"""Registered queries with SQL, on the whole small tables."""

import math

import duckdb
import pytest

from weftline.llm import queries as Q

D = "/root/testdata/sf0.01"


def norm(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) and math.isfinite(v) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in "documents embeddings conversations labels pages".split():
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    sql = Q.oracle_sql()[name]
    names = sorted(c[0] for c in con.sql(sql).description)
    got = Q.queries()[name](spark, D)
    assert sorted(got.columns) == names
    cols = ", ".join(f'"{n}"' for n in names)
    assert norm(map(tuple, got.select(*[f"`{n}`" for n in names]).collect())) == norm(con.sql(f"select {cols} from ({sql})").fetchall())


def test_every_operator_has_its_query():
    assert sorted(n.split("_")[0] for n in Q.queries()) == sorted([*(f"op{k}" for k in range(1, 14)), "pipeline"])
