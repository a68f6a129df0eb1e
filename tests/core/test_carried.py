"""Streams that carry values and numbers over micro-batches: killed, replayed and resumed, they end as one batch run."""

import random
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from weftline.streaming import incremental
from weftline.streaming.carried import Carried

SCHEMA = "ord long, source string, grp string, sub long, brand string"


def rows(n, pick):
    # the first source has a third of all rows; groups are far apart and reach over files
    cut = n // 3
    return [(k, "hot" if k < cut else f"s{(k - cut) // 40}", f"g{k}" if pick.random() < 0.03 else None, k if pick.random() < 0.05 else None, pick.choice(["b", "b", None])) for k in range(n)]


def wanted(all_rows):
    out, carried, number = [], {}, 0
    for k, source, grp, sub, brand in all_rows:
        for c, v in (("grp", grp), ("sub", sub)):
            if v is not None:
                carried[c] = (source, v)
        held = {c: carried[c][1] if c in carried and carried[c][0] == source else None for c in ("grp", "sub")}
        if brand is not None:
            number += 1
            out.append((k, source, held["grp"], held["sub"], number))
    return out


def source_of(spark, all_rows, folder, files):
    step = -(-len(all_rows) // files)
    for f in range(files):
        spark.createDataFrame(all_rows[f * step : (f + 1) * step], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)  # files are taken by their time


def run(spark, tmp_path, transform=None, **how):
    carried = transform or Carried(f"{tmp_path}/state", ["grp", "sub"], "ord", "row_no", F.col("brand").isNotNull(), "source")
    return incremental.run_stream(spark, f"{tmp_path}/src", SCHEMA, f"{tmp_path}/out", f"{tmp_path}/cp", carried, **how)


def staged(spark, tmp_path):
    return sorted((r.ord, r.source, r.grp, r.sub, r.row_no) for r in spark.read.parquet(f"{tmp_path}/out").collect())


def test_a_resumed_stream_equals_one_run(spark, tmp_path):
    all_rows = rows(900, random.Random(4))
    source_of(spark, all_rows, f"{tmp_path}/src", 4)
    assert run(spark, tmp_path, max_batches=1) == 1
    assert run(spark, tmp_path, max_batches=1) == 1
    assert len(staged(spark, tmp_path)) == len([r for r in wanted(all_rows) if r[0] < 450])
    assert run(spark, tmp_path) == 2
    assert staged(spark, tmp_path) == wanted(all_rows)
    # files that come later go on where the stream stood
    more = [(k + 900, s, g, b, x) for k, s, g, b, x in rows(60, random.Random(5))]
    source_of(spark, more, f"{tmp_path}/src", 1)
    assert run(spark, tmp_path) == 1 and staged(spark, tmp_path) == wanted(all_rows + more)


def test_a_batch_that_fails_is_replayed_with_the_same_numbers(spark, tmp_path, monkeypatch):
    all_rows = rows(300, random.Random(6))
    source_of(spark, all_rows, f"{tmp_path}/src", 3)
    assert run(spark, tmp_path, max_batches=1) == 1
    write = incremental.stage

    def broken(*_):
        raise OSError("lost")

    # the state of the second batch is there, its rows are not
    monkeypatch.setattr(incremental, "stage", broken)
    with pytest.raises(StreamingQueryException):
        run(spark, tmp_path)
    assert (tmp_path / "state" / "000000001").exists()

    # now its rows are there as well, but the stream doesn't know
    def late(*a):
        write(*a)
        raise OSError("lost")

    monkeypatch.setattr(incremental, "stage", late)
    with pytest.raises(StreamingQueryException):
        run(spark, tmp_path)
    monkeypatch.setattr(incremental, "stage", write)
    # a batch that doesn't pass is tried again, too
    assert run(spark, tmp_path, passes=lambda made: False) == 0
    assert run(spark, tmp_path) == 2
    assert staged(spark, tmp_path) == wanted(all_rows)


def test_empty_batches_hand_the_state_on(spark, tmp_path):
    all_rows = [(0, "a", "g", None, "b"), (1, "a", None, None, None), (2, "a", None, None, "b"), (3, "a", None, 5, None), (4, "a", None, None, "b"), (5, "b", None, None, "b")]
    carried = Carried(f"{tmp_path}/state", ["grp", "sub"], "ord", "row_no", F.col("brand").isNotNull(), "source")
    got = []
    for number, part in enumerate([[], all_rows[:1], [], all_rows[1:2], all_rows[2:4], all_rows[4:]]):
        got += [(r.ord, r.source, r.grp, r.sub, r.row_no) for r in carried(spark.createDataFrame(part, SCHEMA), number).collect()]
    assert sorted(got) == wanted(all_rows) == [(0, "a", "g", None, 1), (2, "a", "g", None, 2), (4, "a", "g", 5, 3), (5, "b", None, None, 4)]
