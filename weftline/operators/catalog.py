"""Catalog lookups, fuzzy resolution, link status of typed grids, and merges into the stores."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions import text as X
from weftline.sources.scratch import settled

PLAUSIBLE, NEAR, SURE = 0.62, 0.055, 0.76
#: Likeness that is searched first (any value from PLAUSIBLE on gives the same results).
CLEAR = 0.78
DOCUMENT_LEAST, DOCUMENT_NEAR = 0.78, 0.035
#: Texts and entries that one task compares with one another, and how many signs of either it holds at the most (one text at the least).
TILE, TILE_SIGNS = 4096, 1 << 22
#: Rows of texts whose letters are counted against all entries of a tile at once.
STRIP = 256
#: Signs of an entry that stand for the bits of one number.
WORD = 62
#: Entries of a class differ in length by this factor at the most.
GROWTH = 1.25


def classes(entries: DataFrame) -> DataFrame:
    """(class, lo, hi, n): lengths and number of the texts in each class of lengths; few rows, whatever the table."""
    size = F.length("text")
    by = F.floor(F.log(size) / F.log(F.lit(GROWTH))).cast("int").alias("class")
    return entries.groupBy(by).agg(F.min(size).alias("lo"), F.max(size).alias("hi"), F.count(F.lit(1)).alias("n"))


def pieces(queries: DataFrame, kinds: list[Row], least: float) -> DataFrame:
    """(class, key, text, whole): what of each query can reach `least` with entries of a class.

    A query that isn't much longer than the class's entries is taken whole. A longer one, whose ratio as a whole can't be enough,
    is cut into overlapping pieces: each of its parts of up to two signs more than an entry lies in one of them. Entries too long
    for a query to match aren't asked.
    """
    reach = (2 - least) / least
    told = lambda k: (k["class"], k["lo"], int(max(2 * (k["hi"] + 2), k["hi"] * reach + 1)), k["hi"] + 2, (k["hi"] + 3) // 2)
    given = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("class", "lo", "limit", "widest", "step"), told(k))]) for k in kinds])
    size = F.length("text")
    asked = queries.select("key", "text", F.explode(F.filter(given, lambda c: c["lo"] <= size * reach + 1e-6)).alias("c"))
    whole = size <= F.col("c.limit")
    starts = F.when(whole, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(size - F.col("c.widest"), F.lit(0)), F.col("c.step")))
    cut = asked.select("c", "key", "text", whole.alias("whole"), F.explode(starts).alias("at"))
    part = F.when(F.col("whole"), F.col("text")).otherwise(F.substring("text", F.col("at") + 1, F.col("c.step") + F.col("c.widest") - 1))
    return cut.select("c.class", "key", part.alias("text"), "whole")


def runs_in_order(texts: list[str], held: list[str]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of pairs (numbers of texts, numbers of held ones, none longer than WORD): lengths of their longest common subsequences, all pairs at
    once with the places of a held text as the bits of one number."""
    signs = {c: i for i, c in enumerate(sorted(set("".join(held))), 1)}
    spots = np.zeros((len(signs) + 1, len(held)), np.uint64)
    for k, t in enumerate(held):
        for c, bits in X.places(t).items():
            spots[signs[c], k] = bits
    full = np.array([(1 << len(t)) - 1 for t in held], np.uint64)
    codes = np.zeros((max(map(len, texts)), len(texts)), np.int32)
    for i, t in enumerate(texts):
        codes[: len(t), i] = [signs.get(c, 0) for c in t]

    def lengths(i: np.ndarray, k: np.ndarray) -> np.ndarray:
        left = all_ = full[k]
        for row in codes:
            hit = left & spots[row[i], k]
            left = (left + hit | left - hit) & all_
        return np.bitwise_count(all_).astype(int) - np.bitwise_count(left)

    return lengths


def alike_in(asked: list[tuple[str, str, bool]], held: list[str], least: float) -> Iterator[tuple[str, str, float, bool]]:
    """(key, entry, score, contained) of the pairs of a tile's (key, text, whole) and entries that reach `least` or contain the entry.

    Two bounds are taken before the ratio: the letters that both have, all pairs at once as products of 0/1 rows (a sign's k-th
    occurrence is a column), and, of the pairs left, the longest subsequence that both have, since a ratio counts signs in order.
    """
    if not held:
        return
    columns = {f: i for i, f in enumerate(sorted({(c, k) for t in held for c, n in Counter(t).items() for k in range(n)}))}

    def rows(of: list[str]) -> np.ndarray:
        out = np.zeros((len(of), len(columns)), np.float32)
        for row, t in zip(out, of):
            row[[columns[c, k] for c, n in Counter(t).items() for k in range(n) if (c, k) in columns]] = 1
        return out

    letters, size = rows(held).T, np.array([len(t) for t in held])
    for at in range(0, len(asked), STRIP):
        some = asked[at : at + STRIP]
        texts = [t for _, t, _ in some]
        # no span is shorter than this, and a ratio is twice the signs matched by the length of both
        need = least * (np.minimum(np.array([len(t) for t in texts])[:, None], np.maximum(size - 2, 1)[None]) + size) / 2 - 1e-6
        left, right = np.nonzero(rows(texts) @ letters >= need)
        if size.max() <= WORD:
            common = runs_in_order(texts, held)(left, right)
        else:
            common = np.array([X.in_order(texts[i], X.places(held[k]), len(held[k])) for i, k in zip(left, right)])
        close = common >= need[left, right]
        for i, k in zip(left[close].tolist(), right[close].tolist()):
            key, text, whole = some[i]
            score, contained = X.likeness(text, held[k], least, whole), held[k] in text
            if score >= least or contained:
                yield key, held[k], score, contained


def alike(queries: DataFrame, query: str, entries: DataFrame, entry: str, least: float) -> DataFrame:
    """(query, entry, score) of all pairs of distinct compact texts whose likeness is `least` or more; null and empty ones have none.

    Entries meet, class by class of their lengths, only those pieces of queries that can be alike (pieces). Within a class both
    sides are dealt out to tiles, so neither is broadcast and no length, common or rare, fills a task. In a tile, bounds decide
    which pairs are compared (alike_in). No bound loses a pair. An index of neighbouring signs could: at 0.62 two texts may be
    alike that share no two neighbours.
    """
    q = queries.select(F.col(query).alias("text")).where(F.length("text") > 0).distinct().withColumn("key", F.sha2("text", 256))
    e = entries.select(F.col(entry).alias("text")).where(F.length("text") > 0).distinct()
    kinds = classes(e).collect()
    asked = {r["class"]: r["count"] for r in pieces(q, kinds, least).groupBy("class").count().collect()} if kinds else {}
    kinds = [k for k in kinds if k["class"] in asked]
    if not kinds:
        return q.select(F.col("text").alias(query), F.lit("").alias(entry), F.lit(0.0).alias("score")).where("false")
    parts = pieces(q, kinds, least)
    tile = {k["class"]: max(1, min(TILE, TILE_SIGNS // (2 * (k["hi"] + 2)))) for k in kinds}
    number = lambda of: F.create_map(*[F.lit(v) for k in kinds for v in (k["class"], -(-of(k) // tile[k["class"]]))])[F.col("class")]
    down, across = number(lambda k: asked[k["class"]]), number(lambda k: k["n"])
    deal = lambda n, *by: F.pmod(F.xxhash64(*by), n).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    by = F.floor(F.log(F.length("text")) / F.log(F.lit(GROWTH))).cast("int").alias("class")
    left = parts.select("class", deal(down, "text", "key").alias("i"), spread(across).alias("j"), "key", "text", "whole")
    right = e.select(by, "text").where(F.col("class").isin([k["class"] for k in kinds])).select("class", spread(down).alias("i"), deal(across, "text").alias("j"), F.lit(None).cast("string").alias("key"), "text", F.lit(True).alias("whole"))

    def compare(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table[c].to_pylist() for c in ("key", "text", "whole"))))
        found = list(alike_in([r for r in rows if r[0] is not None], [t for k, t, _ in rows if k is None], least))
        columns = zip(*found) if found else ((),) * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64(), pa.bool_()))], names=["key", "e", "score", "contained"])

    out = left.unionByName(right).groupBy("class", "i", "j").applyInArrow(compare, "key string, e string, score double, contained boolean")
    # only equal texts reach 1; a query that holds the entry scores as such, whatever its other parts do
    score = F.when(F.max("score") == 1.0, F.lit(1.0)).when(F.max("contained"), F.lit(0.9)).otherwise(F.max("score"))
    best = out.groupBy("key", "e").agg(score.alias("score")).where(F.col("score") >= least)
    return best.join(q, "key").select(F.col("text").alias(query), F.col("e").alias(entry), "score")


def resolve(fragments: DataFrame, entries: DataFrame, text: str, name: str) -> DataFrame:
    """fragments plus best (score), n_plausible and resolved: the one entry that is likely enough and has no near rival.

    entries holds `name`. Distinct texts are compared once each with the entries that may be alike (alike). Texts without a plausible
    entry get nulls.
    """
    f = settled(fragments.select(text).distinct().withColumn("_q", X.compact(F.col(text))))
    e = settled(entries.select(name).distinct().withColumn("_e", X.compact(F.col(name))))
    # texts with an entry so near that none below CLEAR can be its rival are settled by the narrower and far cheaper join
    near = settled(alike(f, "_q", e, "_e", CLEAR))
    clear = near.groupBy("_q").agg(F.max("score").alias("_top")).where(F.col("_top") >= CLEAR + NEAR + 1e-9).select("_q")
    pairs = near.join(clear, "_q", "left_semi").unionByName(alike(f.join(clear, "_q", "left_anti"), "_q", e, "_e", PLAUSIBLE))
    scored = f.join(pairs, "_q").join(e, "_e").select(text, name, F.col("score").alias("_score"))
    best = scored.groupBy(text).agg(F.max("_score").alias("best"))
    plausible = scored.join(best, text).where(F.col("_score") >= F.greatest(F.lit(PLAUSIBLE), F.col("best") - NEAR))
    got = plausible.groupBy(text).agg(F.max("best").alias("best"), F.count(F.lit(1)).alias("n_plausible"), F.max_by(name, "_score").alias("_pick"))
    got = got.withColumn("resolved", F.when((F.col("best") >= SURE) & (F.col("n_plausible") == 1), F.col("_pick"))).drop("_pick")
    return fragments.join(got, text, "left")


def every_edge(wanted: DataFrame, edges: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """Per `by`, whether all wanted edges exist."""
    have = edges.select(*keys).distinct().withColumn("_have", F.lit(True))
    return wanted.join(have, keys, "left").groupBy(*by).agg(F.every(F.coalesce("_have", F.lit(False))).alias("linked"))


def append_new(store: DataFrame, additions: DataFrame, keys: list[str]) -> DataFrame:
    """store with the additions whose keys it lacks, each once."""
    return store.unionByName(additions.dropDuplicates(keys).join(store.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def append_entries(store: DataFrame, additions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """store (brand, document, ...) with the pairs of additions whose normalised keys it lacks, one a key, other columns empty;
    and the additions that weren't taken, each with its reason."""
    tidy = additions.select(*[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("brand", "document")]).distinct()
    key = [X.match_text(F.col(c)).alias(f"_{c}") for c in ("brand", "document")]
    known = store.select(*key).distinct().withColumn("_have", F.lit(True))
    asked = tidy.select("*", *key).join(known, ["_brand", "_document"], "left")
    asked = asked.withColumn("_nth", F.row_number().over(Window.partitionBy("_brand", "_document").orderBy("brand", "document")))
    broken = F.col("brand").rlike(r"[\r\n]") | F.col("document").rlike(r"[\r\n]")
    reason = F.when((F.col("brand") == "") | (F.col("document") == ""), "incomplete").when(broken, "more than one line").when(F.col("_have") | (F.col("_nth") > 1), "exists")
    told = asked.withColumn("reason", reason)
    new = told.where("reason is null").select("brand", "document", *[F.lit("").cast(store.schema[c].dataType).alias(c) for c in store.columns if c not in ("brand", "document")])
    return store.unionByName(new), told.where("reason is not null").select("brand", "document", "reason")


def merge_values(store: DataFrame, updates: DataFrame, keys: list[str], column: str) -> tuple[DataFrame, DataFrame]:
    """store with updated values, and the updates in error: without a row in the store, or of several values for a key."""
    per = updates.groupBy(*keys).agg(F.count_distinct(column).alias("_n"), F.min(column).alias("_value"))
    missing = per.join(store.select(*keys), keys, "left_anti").select(*keys, F.lit("missing").alias("error"))
    errors = missing.unionByName(per.where("_n > 1").select(*keys, F.lit("conflicting").alias("error")))
    merged = store.join(per.where("_n = 1").select(*keys, "_value"), keys, "left").withColumn(column, F.coalesce("_value", column)).drop("_value")
    return merged, errors


def ranked(entries: DataFrame, match: Column, brand: str, document: str) -> DataFrame:
    """All entries, matching ones first, then by brand and document."""
    return entries.orderBy(F.when(match, 0).otherwise(1), brand, document)


def documents_in(texts: DataFrame, documents: DataFrame, text: str, document: str) -> DataFrame:
    """Documents named in each text as a bounded phrase, by place; (text, document, at). Found by joins on words."""
    t = texts.select(text).distinct().withColumn("_t", X.match_text(F.col(text)))
    d = documents.select(document).distinct().withColumn("_d", X.match_text(F.col(document)))
    # a document is found by its first word, which must be one of the text's
    words = lambda c: F.filter(F.split(F.regexp_replace(c, "[^0-9A-ZА-Я./-]+", " "), " "), lambda w: w != "")
    # one without any word has the empty one, as every text has
    first = F.coalesce(F.try_element_at(words(F.col("_d")), F.lit(1)), F.lit(""))
    keyed = t.withColumn("_w", F.explode(F.array_distinct(F.concat(words(F.col("_t")), F.array(F.lit("")))))).join(d.withColumn("_w", first), "_w")
    edge = F.lit("[0-9A-ZА-Я./-]")
    bounded = F.concat(F.lit("(?<!"), edge, F.lit(")\\Q"), F.col("_d"), F.lit("\\E(?!"), edge, F.lit(")"))
    hit = F.regexp_instr(F.col("_t"), bounded)
    return keyed.withColumn("at", hit).where("at > 0").select(text, document, "at").distinct()


def shard_sets(files: DataFrame, name: str, pattern: str) -> DataFrame:
    """Sets of numbered parts by (stem, total): how many there are and whether all are."""
    part = lambda i: F.regexp_extract(F.col(name), pattern, i)
    found = files.where(F.col(name).rlike(pattern)).select(F.lower(part(1)).alias("stem"), part(2).cast("int").alias("part"), part(3).cast("int").alias("total"))
    n = F.count_distinct(F.when(F.col("part").between(1, F.col("total")), F.col("part")))
    return found.groupBy("stem", "total").agg(n.alias("n_parts")).withColumn("complete", F.col("n_parts") == F.col("total"))


def status_of_marks(df: DataFrame, value: str) -> Column:
    v = F.trim(F.col(value))
    return F.when(v == "", "").when(v.isin("+", "-"), "linked").otherwise("applicability-invalid")


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
