"""Compaction against a plain program over the same rows, on whole small tables and odd ones."""

import hashlib
import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from weftline.llm import compaction as C

D = "/root/testdata/sf0.001"


def plain(rows):
    """(day, lot, piece) of the first source -> (ids in file order, sources, rewritten), by lists and a scan of all groups."""
    n = len(rows)
    s = lambda x: 1 + n // x
    days = defaultdict(list)
    for r in rows:
        days[None if r[1] is None else (r[1] - datetime(1970, 1, 1)).days].append(r)
    out = {}
    for day, own in days.items():
        files = defaultdict(list)
        for r in own:
            h = zlib.crc32(b"" if r[0] is None else str(r[0]).encode())
            files[h // 16 % (1 + len(own) // s(150)), min(h % 4, h // 4 % 4)].append(r)
        for f in files.values():
            f.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[0] is not None, r[0] or 0))
        small = sorted((k for k, f in files.items() if len(f) < s(600)), key=lambda k: (-len(files[k]), k))
        groups = []
        for k in small:
            for g in groups:
                if sum(len(files[x]) for x in g) + len(files[k]) <= s(500):
                    g.append(k)
                    break
            else:
                groups.append([k])
        for g in groups + [[k] for k in files if k not in small]:
            ids = [r[0] for k in g for r in files[k]]
            cents = sum(int((100 * (r[2] or 0) + 0.5) // 1) for k in g for r in files[k])
            out[(day, *g[0])] = (ids, cents, ",".join(f"{a}-{b}" for a, b in g), len(g) > 1)
    return out


def check(spark, df, tmp):
    root = str(tmp / "lots")
    names = df.columns
    lots = C.write_lots(df, root)
    before = {p: p.read_bytes() for p in Path(root).rglob("*.parquet")}
    planned = C.compact(lots, df.schema, spark)
    got = C.report(lots, df.schema, planned).collect()
    want = plain([(r.click_id, r.arrived_at, r.value) for r in df.collect()])
    assert sorted(((r.day, r.lot, r.piece) for r in got), key=str) == sorted(want, key=str)
    for r in got:
        ids, cents, sources, rewritten = want[r.day, r.lot, r.piece]
        text = ",".join("" if i is None else str(i) for i in ids)
        known = [i for i in ids if i is not None]
        assert (r.n_rows, r.min_click_id, r.max_click_id) == (len(ids), min(known, default=None), max(known, default=None))
        assert (r.cents, r.sources, r.rewritten, r.ids_sha256) == (cents, sources, rewritten, hashlib.sha256(text.encode()).hexdigest())
        assert r.columns == ",".join(names)
        path = Path(r.path.removeprefix("file:"))
        read = pq.ParquetFile(path)
        assert read.schema_arrow.names == names and read.read(["click_id"])["click_id"].to_pylist() == ids
        assert rewritten or before[path] == path.read_bytes()
    assert {p for p in Path(root).rglob("*.parquet")} == {Path(r.path.removeprefix("file:")) for r in got}
    return got


def test_whole_table(spark, tmp_path):
    got = check(spark, spark.read.parquet(f"{D}/clicks.parquet"), tmp_path)
    assert any(r.rewritten for r in got) and any(not r.rewritten for r in got)


def test_every_call_has_a_folder_of_its_own(spark):
    df = spark.read.parquet(f"{D}/clicks.parquet").where("client_id = 91")
    a, b = (C.compacted(df).collect() for _ in range(2))
    assert not {r.path for r in a} & {r.path for r in b}
    assert {(r.day, r.lot, r.piece, r.ids_sha256) for r in a} == {(r.day, r.lot, r.piece, r.ids_sha256) for r in b}
    shared = spark.conf.get("spark.checkpoint.dir").split(":", 1)[-1]
    assert all(r.path.removeprefix("file:").startswith(shared) for r in a)


def test_odd_rows(spark, tmp_path):
    r = random.Random(5)
    start = datetime(1969, 12, 30, 23)
    rows = [(k if k % 17 else None, None if k % 29 == 0 else start + timedelta(hours=r.randrange(90)), r.choice([None, 1.005, -2.5, float(k)]), f"own {k}", k) for k in range(3000)]
    rows += rows[:50]
    df = spark.createDataFrame(rows, "click_id long, arrived_at timestamp_ntz, value double, day string, Lot int").withColumn("a.b", F.lit("x"))
    got = check(spark, df, tmp_path)
    assert {r.day for r in got} >= {None, -2, -1, 0}
    assert got[0].columns == "click_id,arrived_at,value,day,Lot,a.b"


def test_not_finite_values_count_nothing_and_empty_tables_give_no_rows(spark):
    when = datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, when, float("nan")), (2, when, float("inf")), (3, when, 2.5)], "click_id long, arrived_at timestamp_ntz, value double")
    assert sum(r.cents for r in C.compacted(df).collect()) == 250
    assert C.compacted(df.where("false")).collect() == []


@pytest.mark.parametrize("seed", range(30))
def test_earliest_fit_is_first_fit(seed):
    r = random.Random(seed)
    capacity = r.choice([1, 7, 100, 10**6])
    sizes = [r.randint(1, capacity) for _ in range(r.randrange(1, 300))]
    rooms, want = [], []
    for s in sizes:
        g = next((k for k, room in enumerate(rooms) if room >= s), len(rooms))
        if g == len(rooms):
            rooms.append(capacity)
        rooms[g] -= s
        want.append(g)
    assert C.first_fit(sizes, capacity) == want
