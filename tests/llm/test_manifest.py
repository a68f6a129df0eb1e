"""The manifest against a plain program that builds every tree in lists."""

import hashlib
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from weftline.llm import manifest as M

KIND = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def grown(nodes):
    """Siblings (left, right) of every node up to the root, and the root."""
    way, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
            way[k].append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        at = [i // 8 for i in at]
        nodes = [H(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return way, nodes[0]


def plain(rows):
    known = sorted(((r[2] is not None, (r[2] or "").encode()), (r[0] is not None, r[0] or 0), leaf(r), r) for r in rows)
    subs = []
    for lang, own in groupby(known, key=lambda x: x[0]):
        own = list(own)
        subs.append((own, *grown([x[2] for x in own])))
    above, root = grown([s[2] for s in subs])
    out = []
    for (own, ways, sub), over in zip(subs, above):
        for x, way in zip(own, ways):
            r = x[3]
            fold = x[2]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                fold = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for a, b in way + over:
                fold = H(a, fold, b)
            out.append((r[0], x[2], sub, root, H(*[a + b for a, b in way + over]), fold, fold == root))
    return sorted(out, key=repr)


def told(spark, rows):
    got = M.third_tampered(spark.createDataFrame(rows, KIND))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, got.collect()), key=repr)


def test_buckets_and_levels_above_them(spark):
    n = 2 * M.BUCKET + 77
    rows = [(k * 3 % n, "s", "en" if k % 9 else None, k, f"Text {k}" if k % 3 else "plain") for k in range(n)]
    rows += [(n + k, None, lang, None, None) for k, lang in enumerate(["é", "zz", "Z", "", "a" * 50, *[f"l{j}" for j in range(9)]])]
    got = told(spark, rows)
    assert got == plain(rows)
    assert not all(r[-1] for r in got)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_sizes_around_full_runs(spark, n):
    rows = [(k, "s", "en", 1, f"A{k}") for k in range(n)]
    assert told(spark, rows) == plain(rows)


def test_nulls_repeats_and_extra_columns(spark):
    long = "Ünï𝄞 " * 30000
    rows = [(None, None, None, None, None), (None, "s", "en", 3, "Abc"), (5, "s", "en", 3, "Abc"), (5, "s", "en", 3, "Abc"), (5, "s", "en", 3, "Abd"), (6, "", "", 0, ""), (7, "s", "de", 10, long)]
    assert told(spark, rows) == plain(rows)
    df = spark.createDataFrame(rows, KIND)
    more = df.select("*", *[F.lit(1).alias(c) for c in ("leaf", "rank", "tree", "root", "a.b", "N")])
    assert sorted(map(tuple, M.third_tampered(more).collect()), key=repr) == plain(rows)
    assert M.third_tampered(df.where("false")).collect() == []


def test_root_follows_every_field(spark):
    rows = [(k, "s", "en", k, f"t{k}") for k in range(20)]
    root = lambda x: M.manifest(spark.createDataFrame(x, KIND)).first()["root"]
    base = root(rows)
    assert base == root(rows[::-1])
    for at, new in enumerate([99, "S", "fr", 0, "T3"]):
        changed = list(rows[3])
        changed[at] = new
        assert root([*rows[:3], tuple(changed), *rows[4:]]) != base
