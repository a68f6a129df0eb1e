"""Typed grids in long form (grid, row, col, kind, value): link status of each cell, and the edges to export."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.fixed import MARK_TYPES, REPLACED, TEXT_TYPES, TYPED_RELATIONS
from weftline.functions.text import match_text
from weftline.operators.normalize import strict
from weftline.sources.scratch import settled

REPLACEMENT = ("obsolete", "prospective")
BRAND_KINDS = ("primary", *TYPED_RELATIONS, *REPLACEMENT)


def _filled(cells: DataFrame, entries: DataFrame) -> DataFrame:
    return strict(cells.withColumn("value", F.trim(F.coalesce("value", F.lit("")))).where("value != ''"), entries, "value")


def _only(cells: DataFrame, kind: str) -> DataFrame:
    """Grids that have exactly one column of a kind."""
    return cells.where(F.col("kind") == kind).groupBy("grid").agg(F.count_distinct("col").alias("n")).where("n = 1").select("grid")


def edges(cells: DataFrame, entries: DataFrame) -> DataFrame:
    """(grid, row, col, first, type, second): every relation that a cell states."""
    return _stated(_filled(cells, entries), cells)


def _stated(filled: DataFrame, cells: DataFrame) -> DataFrame:
    got = filled.where(F.col("kind").isin(*BRAND_KINDS) & (F.size("pairs") > 0))
    one = lambda kind: got.where(F.col("kind") == kind).join(_only(cells, kind), "grid")
    first = one("primary").select("grid", "row", F.explode("pairs").alias("first"))
    types = F.create_map(*[x for k, v in TYPED_RELATIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    second = got.where(F.col("kind").isin(*TYPED_RELATIONS)).select("grid", "row", "col", F.explode("pairs").alias("second"), types[F.col("kind")].alias("types"))
    stated = first.join(second, ["grid", "row"]).withColumn("type", F.explode("types")).drop("types")
    old = one("obsolete").select("grid", "row", F.col("col").alias("col_a"), F.explode("pairs").alias("first"))
    new = one("prospective").select("grid", "row", F.col("col").alias("col_b"), F.explode("pairs").alias("second"))
    replaced = old.join(new, ["grid", "row"]).withColumn("col", F.explode(F.array("col_a", "col_b"))).withColumn("type", F.lit(REPLACED))
    cols = ["grid", "row", "col", "first", "type", "second"]
    return stated.select(*cols).unionByName(replaced.select(*cols))


def status(cells: DataFrame, entries: DataFrame, relations: DataFrame, attributes: DataFrame) -> DataFrame:
    """cells plus status: '', linked, brand-missing, relation-missing, applicability-invalid, applicability-missing or
    catalog-missing. relations: first, type, second; attributes: brand, document, kind, value of the catalog."""
    place = ["grid", "row", "col"]
    # texts are taken apart once: all that follows reads what was found
    got = settled(_filled(cells, entries))
    norm = lambda df: df.select(*[match_text(F.col(c)).alias(f"k_{c}") for c in ("first", "type", "second")])
    have = norm(relations).distinct().withColumn("hit", F.lit(True))
    wanted = _stated(got, cells)
    wanted = wanted.select(*place, *[match_text(F.col(c)).alias(f"k_{c}") for c in ("first", "type", "second")])
    linked = wanted.join(have, ["k_first", "k_type", "k_second"], "left").groupBy(*place).agg(F.every(F.coalesce("hit", F.lit(False))).alias("linked"))
    primary = got.where("kind = 'primary' and size(pairs) > 0").join(_only(cells, "primary"), "grid").select("grid", "row", F.explode("pairs").alias("pair"))
    known = attributes.select(F.concat_ws(" по ", "brand", "document").alias("pair"), "kind", F.col("value").alias("known"))
    brands = reduce(lambda a, b: a | b, [F.col("kind") == k for k in BRAND_KINDS])
    facts = got.where(~brands & F.col("kind").isin(*MARK_TYPES, *TEXT_TYPES))
    told = facts.join(primary, ["grid", "row"]).join(known, ["pair", "kind"], "left").groupBy(*place).agg(F.every(F.coalesce(F.col("known") == F.col("value"), F.lit(False))).alias("told"))
    mark = F.col("kind").isin(*MARK_TYPES)
    fact = facts.join(told, place, "left").select(
        *place,
        F.when(mark & ~F.col("value").isin("+", "-"), "applicability-invalid").when(F.coalesce("told", F.lit(False)), "linked").when(mark, "applicability-missing").otherwise("catalog-missing").alias("status"),
    )
    related = got.where(brands & (F.col("kind") != "primary")).join(linked, place, "left").select(
        *place, F.when(F.col("pairs").isNull(), "brand-missing").when(F.size("pairs") == 0, "linked").when(F.coalesce("linked", F.lit(False)), "linked").otherwise("relation-missing").alias("status"), F.col("kind")
    )
    counted = related.where(F.col("kind").isin(*TYPED_RELATIONS) & (F.col("status") != "brand-missing")).select("grid", "row", "status").unionByName(fact.select("grid", "row", "status"))
    whole = counted.groupBy("grid", "row").agg(F.every(F.col("status") == "linked").alias("all"))
    main = got.where("kind = 'primary'").join(whole, ["grid", "row"], "left").select(
        *place, F.when(F.col("pairs").isNull(), "brand-missing").when(F.coalesce("all", F.lit(False)) | (F.size("pairs") == 0), "linked").otherwise("relation-missing").alias("status")
    )
    found = fact.unionByName(related.select(*place, "status")).unionByName(main)
    return cells.join(found, place, "left").withColumn("status", F.coalesce("status", F.lit("")))


def export_errors(cells: DataFrame, entries: DataFrame) -> DataFrame:
    """(grid, row, error): why a grid can't be exported; nothing is written while there is any."""
    got = _filled(cells, entries)
    n = {k: F.count_distinct(F.when(F.col("kind") == k, F.col("col"))).alias(k) for k in ("primary", *REPLACEMENT)}
    shape = cells.groupBy("grid").agg(*n.values(), F.count_if(F.col("kind").isin(*TYPED_RELATIONS, *MARK_TYPES, *TEXT_TYPES)).alias("others"))
    paired = (F.col("obsolete") + F.col("prospective") > 0) & ((F.col("obsolete") != 1) | (F.col("prospective") != 1))
    needs = (F.col("primary") > 1) | ((F.col("primary") == 0) & ((F.col("others") > 0) | (F.col("obsolete") == 0)))
    bad_shape = shape.select("grid", F.lit(None).cast("int").alias("row"), F.when(paired, "replacement columns aren't paired").when(needs, "not exactly one primary column").alias("error"))
    brands = got.where(F.col("kind").isin(*BRAND_KINDS) & F.col("pairs").isNull()).select("grid", "row", F.lit("not in the catalog").alias("error"))
    marks = got.where(F.col("kind").isin(*MARK_TYPES) & ~F.col("value").isin("+", "-")).select("grid", "row", F.lit("mark is neither + nor -").alias("error"))
    rows = got.groupBy("grid", "row").agg(*[F.count_if((F.col("kind") == k) & (F.size("pairs") > 0)).alias(k) for k in ("primary", *REPLACEMENT)])
    rows = rows.join(shape.select("grid", F.col("primary").alias("has_primary")), "grid")
    lone = rows.select("grid", "row", F.when((F.col("has_primary") > 0) & (F.col("primary") == 0), "no primary brand").when((F.col("obsolete") > 0) != (F.col("prospective") > 0), "only one brand of a replacement").alias("error"))
    return bad_shape.unionByName(brands).unionByName(marks).unionByName(lone).where("error is not null")
