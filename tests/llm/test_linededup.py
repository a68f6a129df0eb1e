"""Line dedup against a plain version, and what it leaves alone."""

import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.llm import linededup as L


def plain_units(text):
    """(unit, groups): what a unit must share with another document's to recur, written out as tuples."""
    out = []
    for line in re.split(r"\n+", text):
        for unit in re.split(r"(?<=[.!?])[ \t]+", line):
            words = ["#" if any(c in "0123456789" for c in w) else w for w in re.split(r"[ \t\r\x0b\x0c]+", unit) if w]
            n = len(words)
            if n >= 10:
                half = (4 + n) // 2
                groups = {(n, "a", *words[:4], *words[half:]), (n, "b", *words[:half])}
            else:
                groups = {(n, *words)} if n else set()
            out.append((unit, n, groups))
    return out


def plain(rows):
    """n_dropped and the units left, by document."""
    own = {}
    for i, t in rows:
        own.setdefault(i, []).extend(plain_units(t))
    holders = {}
    for i, found in own.items():
        for _, _, groups in found:
            for g in groups:
                holders.setdefault(g, set()).add(i)
    out = {}
    for i, found in own.items():
        hit = [any(min(holders[g]) < i for g in groups) for _, _, groups in found]
        gone = [False] * len(found)
        for k in range(len(found)):
            if hit[k]:
                run = [k]
                for step in (1, -1):
                    j = k + step
                    while 0 <= j < len(found) and (hit[j] or not found[j][1]):
                        run.append(j)
                        j += step
                gone[k] = sum(found[j][1] for j in run if hit[j]) >= 6
        out[i] = sum(gone), [u for (u, n, _), g in zip(found, gone) if n and not g]
    return out


def corpus():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    passage = " ".join(sentence(n) for n in (9, 12, 2, 14, 8, 1, 11))
    rows = []
    for i in range(200):
        parts = [sentence(r.randrange(2, 15)) for _ in range(20)] + ["Yes."]
        if i % 5 == 0:
            parts.insert(7, passage)
        if i % 4 == 0:
            parts.insert(3, f"Page viewed on day {i} by visitor number {i * 7} from the town hall.\n")
        if i % 3 == 0:
            parts.insert(11, f"This notice was put up for {word()} in the hall of the old town.")
        rows.append((i, " ".join(parts)))
    return rows + [(500 + k, rows[k][1]) for k in range(10)], passage


def test_against_plain_version(spark):
    rows, passage = corpus()
    got = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = plain(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r.n_dropped == want[r.doc_id][0]
        assert [u.strip() for u, n, _ in plain_units(r.text) if n] == [u.strip() for u in want[r.doc_id][1]]
    by = {r.doc_id: r for r in got}
    # every sentence of the passage, short ones too, stands in one document
    for s in passage.split(". "):
        assert sum(s in r.text for r in got) == 1
    assert sum("Page viewed" in r.text for r in got) == 1
    assert sum("This notice" in r.text for r in got) == 1
    assert "Yes." in by[1].text and by[1].text == dict(rows)[1]
    assert by[501].text == ""


def test_whole_table_against_plain_version(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = plain([(r.doc_id, r.text) for r in df.collect() if r.text is not None])
    got = {r.doc_id: r.n_dropped for r in L.dedup_lines(df).collect()}
    assert {i: n for i, (n, _) in want.items()} == {i: got[i] for i in want}


def test_copies_can_be_spared(spark):
    rows, _ = corpus()
    changed = rows[1][1].replace("Yes.", "No.")
    rows = [*rows, (600, changed)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    by = {r.doc_id: r.text for r in L.dedup_lines(df, spare_copies=True).collect()}
    assert all(by[500 + k] == rows[k][1] for k in range(10)) and by[600] == changed
    assert sum("Page viewed" in by[i] for i in range(200)) == 1
    # most of a short text from a longer one is no copy of it
    part = " ".join(rows[3][1].split(". ")[:4]) + "."
    by = {r.doc_id: r for r in L.dedup_lines(spark.createDataFrame([*rows[:5], (9, rows[0][1].split("\n")[0])], df.schema), spare_copies=True).collect()}
    assert by[9].n_dropped > 0 and part


@pytest.mark.parametrize("id_type", ["long", "int", "string"])
def test_odd_rows(spark, id_type):
    s = "One two three four five six seven."
    rows = [(1, s), (1, s), (2, None), (3, ""), (None, s), (4, s + " Something of its own that is long enough to count as more than a fifth."), (5, " \n\n "), (6, s), (6, s)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.select(F.col("doc_id").cast(id_type), "text", F.lit("x").alias("N_dropped"), F.lit(1).alias("_gone_id"), F.lit(2).alias("_gone_keys"), F.lit(3).alias("a.b"), F.lit(4).alias("id"))
    out = L.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "_gone_id", "_gone_keys", "a.b", "id", "n_dropped"]
    got = sorted(((r.doc_id and int(r.doc_id), r.text, r.n_dropped) for r in out.collect()), key=repr)
    assert got == sorted([(1, s, 0), (1, s, 0), (2, None, 0), (3, "", 0), (None, s, 0), (4, rows[5][1].removeprefix(s + " "), 1), (5, " \n\n ", 0), (6, "", 1), (6, "", 1)], key=repr)
    assert L.dedup_lines(df.limit(0)).count() == 0


def test_very_long_text(spark):
    long = " ".join(f"Sentence {chr(97 + k % 26)} {'x' * (k % 50)} with a few words of text in it." for k in range(60_000))
    got = {r.doc_id: r for r in L.dedup_lines(spark.createDataFrame([(1, "A b c d e f g."), (2, long + " A b c d e f g.")], "doc_id long, text string")).collect()}
    assert got[2].n_dropped == 1 and got[2].text == long
