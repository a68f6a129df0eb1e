"""A run as one nested row per source row: its cells, items, relations, open questions and review flags in arrays.

fold() brings the items of a row together by one shuffle; all that follows from them alone (relations, flags, staging, checks) is
worked out inside the row by higher-order functions. Only counts go by batch, to number flags, and come back to their rows, which
stay where they are; a report that names no flag does without. It needs one more shuffle at most: by batch.

A folded row has the columns of rows (row_id, batch_id, row_index, source_file, table_id, group, subgroup, ground, aviation, marine,
note, row_flags) and
cells       cell_id, role, raw_cell
items       place, index, item_id, role, cell_id, brand, document, brand_key, raw_item, review_flags, match_type, purpose_text,
            match_flags, reviewed; by role, index and id
relations   main_item_id, related_item_id, relation_type, note, mapping_basis and the brands and keys that both items have now
unresolved  role, flag, main_item_ids, related_item_ids
flags       flag_id, category, cell_id, item_id, evidence, in the order of their numbers
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftline.functions import text as X
from weftline.functions.fixed import BLOCKING, MANUAL, RELATION_TYPES, ROLES
from weftline.operators.review import flag_message, role_place

ITEM = ("index", "item_id", "role", "cell_id", "brand", "document", "brand_key", "raw_item", "review_flags", "match_type", "purpose_text", "match_flags", "reviewed")
RELATION = "array<struct<main_item_id:string,related_item_id:string,relation_type:string,note:string,mapping_basis:string,main_brand:string,main_brand_key:string,related_brand:string,related_brand_key:string>>"
BRANDS = ("main_brand", "main_brand_key", "related_brand", "related_brand_key")
CELL = ("cell_id", "role", "raw_cell")
ORIGIN = ("batch_id", "source_file", "table_id", "row_id")


def _list(x: Column | str, kind: T.DataType | str) -> Column:
    return F.coalesce(x, F.array().cast(kind))


def matched(items: DataFrame, matches: DataFrame, reviewed: DataFrame | None = None) -> DataFrame:
    """items with their purpose results (item_id, match_type, purpose_text, review_flags) and, laid over these, reviewed purposes
    (item_id, purpose_text). Items without a result have no match_type; results and reviews of unknown items are left out."""
    told = matches.select("item_id", "match_type", "purpose_text", F.col("review_flags").alias("match_flags"))
    out = items.join(told, "item_id", "left")
    if reviewed is None:
        return out.withColumn("reviewed", F.lit(False))
    out = out.join(reviewed.select("item_id", F.col("purpose_text").alias("_text"), F.lit(True).alias("_hit")), "item_id", "left")
    return laid_over(out.withColumn("reviewed", F.coalesce("_hit", F.lit(False))), F.col("_text")).drop("_text", "_hit")


def laid_over(items: DataFrame, text: Column) -> DataFrame:
    """Items with a reviewed purpose in place of the matched one where they are `reviewed`."""
    hit = F.col("reviewed")
    put = lambda c, new: F.when(hit, new).otherwise(F.col(c))
    return items.withColumns({"match_type": put("match_type", F.lit(MANUAL)), "purpose_text": put("purpose_text", text), "match_flags": put("match_flags", F.array().cast("array<string>"))})


def fold(rows: DataFrame, items: DataFrame, cells: DataFrame | None = None, manual: DataFrame | None = None, numbered: bool = True) -> DataFrame:
    """Rows with all that was made of them; items carry their purpose results (see matched()). Without cells, those that have
    items stand for them, with their role as text. manual: relations made by hand (row_id, main_item_id, related_item_id, relation_type,
    note), which win over generated ones of the same items and type. Rows without items have empty arrays; items, cells and relations of unknown rows
    are left out. Row ids aren't null. Unless numbered, flags have no flag_id."""
    sides = {"items": items.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct(role_place(F.col("role")).cast("int").alias("place"), *ITEM))).alias("items"))}
    if cells is not None:
        sides["cells"] = cells.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct(*CELL))).alias("cells"))
    if manual is not None:
        made = F.struct("main_item_id", "related_item_id", "relation_type", "note", F.lit(MANUAL).alias("mapping_basis"), *[F.lit(None).cast("string").alias(c) for c in BRANDS])
        sides["manual"] = manual.groupBy("row_id").agg(F.sort_array(F.collect_list(made)).alias("manual"))
    # rows that repeat an id are told apart by their place among these
    out = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("row_id").orderBy("batch_id", "row_index", F.xxhash64(*rows.columns)))) if numbered else rows
    for name, side in sides.items():
        out = out.join(side, "row_id", "left").withColumn(name, _list(name, side.schema[name].dataType))
    if cells is None:
        out = out.withColumn("cells", F.array_distinct(F.transform("items", lambda i: F.struct(i["cell_id"].alias("cell_id"), i["role"].alias("role"), i["role"].alias("raw_cell")))))
    return _flagged(_related(out, manual is not None), numbered)


def _related(rows: DataFrame, by_hand: bool) -> DataFrame:
    """Relations of each role's items to the main ones: all to a single main item, else pair by pair where there are as many, else
    an open question."""
    types = F.create_map(*[F.lit(x) for kv in RELATION_TYPES.items() for x in kv])

    def by_role(items: Column) -> Column:
        mains = F.filter(items, lambda i: i["role"] == ROLES[0])
        others = F.filter(items, lambda i: i["role"] != ROLES[0])
        roles = F.array_distinct(F.transform(others, lambda i: i["role"]))
        return F.transform(roles, lambda r: F.struct(r.alias("role"), mains.alias("mains"), F.filter(items, lambda i: i["role"] == r).alias("own")))

    ids = lambda x: F.sort_array(F.transform(x, lambda i: i["item_id"]))
    n, k = lambda g: F.size(g["mains"]), lambda g: F.size(g["own"])
    link = lambda g, main, item, basis: F.struct(
        main["item_id"].alias("main_item_id"), item["item_id"].alias("related_item_id"), types[g["role"]].alias("relation_type"), F.col("note"), F.lit(basis).alias("mapping_basis"),
        main["brand"].alias("main_brand"), main["brand_key"].alias("main_brand_key"), item["brand"].alias("related_brand"), item["brand_key"].alias("related_brand_key"),
    )
    pairs = lambda g: (
        F.when(n(g) == 1, F.transform(g["own"], lambda i: link(g, F.get(g["mains"], F.lit(0)), i, "single-main")))
        .when(n(g) == k(g), F.transform(F.arrays_zip(g["mains"].alias("m"), g["own"].alias("o")), lambda z: link(g, z["m"], z["o"], "positional")))
        .otherwise(F.array().cast(RELATION))
    )
    open_ = lambda g: F.struct(
        g["role"].alias("role"), F.when(n(g) == 0, "missing_main_item").otherwise("ambiguous_relation_mapping").alias("flag"), ids(g["mains"]).alias("main_item_ids"), ids(g["own"]).alias("related_item_ids")
    )
    key = lambda r: F.struct(r["main_item_id"], r["related_item_id"], r["relation_type"])
    generated = lambda gs: F.flatten(F.transform(gs, pairs)).cast(RELATION)
    kept = lambda gs: F.filter(generated(gs), lambda r: ~F.array_contains(F.transform("manual", key), key(r)))
    # brands of relations made by hand are those that the items have now
    item = lambda r, side: F.get(F.filter("items", lambda i: i["item_id"] == r[f"{side}_item_id"]), F.lit(0))
    named = F.transform("manual", lambda r: r.withField("main_brand", item(r, "main")["brand"]).withField("main_brand_key", item(r, "main")["brand_key"]).withField("related_brand", item(r, "related")["brand"]).withField("related_brand_key", item(r, "related")["brand_key"]))
    links = (lambda gs: F.concat(kept(gs), named)) if by_hand else generated
    return rows.withColumn(
        "_r", X.let(by_role(F.col("items")), lambda gs: F.struct(links(gs).alias("links"), F.transform(F.filter(gs, lambda g: (n(g) != 1) & (n(g) != k(g))), open_).alias("unresolved")))
    ).select("*", F.col("_r.links").alias("relations"), F.col("_r.unresolved").alias("unresolved")).drop("_r", "manual")


def _flagged(rows: DataFrame, numbered: bool) -> DataFrame:
    """Flags of the row, of its items and of their purposes, then of open questions that no relation answers; the first of equal
    ones counts. Numbers run through each batch: all of the first kinds, by row, come before the open questions."""
    none = F.lit(None).cast("string")
    flag = lambda part, place, index, kind, at, category, evidence, item=none, cell=none: F.struct(
        F.lit(part).alias("part"), place.cast("int").alias("place"), index.cast("int").alias("index"), F.lit(kind).alias("kind"), at.cast("int").alias("at"),
        category.alias("category"), evidence.alias("evidence"), item.alias("item_id"), cell.alias("cell_id"),
    )
    zero = F.lit(0)
    of_row = F.transform(_list("row_flags", "array<string>"), lambda c, k: flag(0, zero, zero, 0, k, c, F.coalesce("note", F.lit(""))))
    own = lambda i, name, kind, evidence: F.transform(_list(i[name], "array<string>"), lambda c, k: flag(0, i["place"], i["index"], kind, k, c, evidence, i["item_id"], i["cell_id"]))
    of_items = F.flatten(F.transform("items", lambda i: F.concat(own(i, "review_flags", 1, i["raw_item"]), F.filter(own(i, "match_flags", 2, i["brand"]), lambda _: i["match_type"].isNotNull() & ~i["reviewed"]))))
    covered = F.transform("relations", lambda r: r["related_item_id"])
    lost = X.let(covered, lambda c: F.filter(F.transform("unresolved", lambda u: u.withField("lost", F.array_except(u["related_item_ids"], c))), lambda u: F.size(u["lost"]) > 0))
    of_open = F.transform(lost, lambda u: flag(1, role_place(u["role"]), zero, 0, zero, u["flag"], F.array_join(u["lost"], "; ")))
    same = lambda f: F.struct(f["category"], f["cell_id"], f["item_id"], f["evidence"])
    # equal ones stand side by side, the first one first
    side_by_side = F.sort_array(F.transform(F.concat(of_row, of_items, of_open), lambda f: F.struct(same(f).alias("same"), f.alias("f"))))
    first = X.let(side_by_side, lambda fs: F.filter(fs, lambda f, k: (k == 0) | ~f["same"].eqNullSafe(F.get(fs, k - 1)["same"])))
    kept = F.sort_array(F.transform(first, lambda x: x["f"]))
    told = lambda f, flag_id: F.struct(flag_id.alias("flag_id"), *[f[c].alias(c) for c in ("category", "cell_id", "item_id", "evidence")])
    if not numbered:
        return rows.withColumn("flags", F.transform(kept, lambda f: told(f, none)))
    rows = rows.withColumn("_flags", kept).withColumn("_late", F.size(F.filter("_flags", lambda f: f["part"] == 1)))
    batch = Window.partitionBy("batch_id")
    before = batch.orderBy("row_index", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    some = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    # only the counts of a row go to its batch and back, not the row
    counts = rows.select("row_id", "_nth", "batch_id", "row_index", (F.size("_flags") - F.col("_late")).alias("_early"), "_late")
    at = F.struct("_nth", "_early", some("_early", before).alias("e"), some("_late", before).alias("l"), some("_early", batch).alias("all"))
    places = counts.select("row_id", at.alias("_at")).groupBy("row_id").agg(F.sort_array(F.collect_list("_at")).alias("_at"))
    rows = rows.join(places, "row_id", "left").withColumn("_at", F.get("_at", F.col("_nth") - 1))
    number = lambda f, k: k + 1 + F.when(f["part"] == 0, F.col("_at.e")).otherwise(F.col("_at.all") + F.col("_at.l") - F.col("_at._early"))
    out = F.transform("_flags", lambda f, k: told(f, F.format_string("%s:F%04d", F.col("batch_id"), number(f, k))))
    return rows.withColumn("flags", out).drop("_flags", "_late", "_nth", "_at")


# ---- what is read off folded rows


def flags(folded: DataFrame) -> DataFrame:
    """Review flags, one a row, with severity and message."""
    f = folded.select("batch_id", "row_id", F.explode("flags").alias("f"))
    return f.select("f.flag_id", "batch_id", "f.category", "row_id", "f.cell_id", "f.item_id", "f.evidence", F.lit("warning").alias("severity"), flag_message(F.col("f.category")).alias("message"))


def staged(folded: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables of occurrences, by batch: brands with purposes and marks, groups, and relations. Items without a purpose
    result aren't staged."""
    held = F.filter("items", lambda i: i["match_type"].isNotNull())
    each = folded.withColumn("i", F.explode(held))
    joined = F.sort_array(F.array_union(F.array_union(_list("i.review_flags", "array<string>"), _list("i.match_flags", "array<string>")), _list("row_flags", "array<string>")))
    order = F.struct("row_index", F.col("i.place").alias("role_place"), F.col("i.index").alias("index")).alias("ord")
    of = lambda *names: [F.col(f"i.{n}").alias(n) for n in names]
    one = each.select(*ORIGIN, *of("item_id"), joined.alias("review_flags"), *of("cell_id"), F.get(F.filter("cells", lambda c: c["cell_id"] == F.col("i.cell_id")), F.lit(0))["raw_cell"].alias("raw_cell"), *of("raw_item", "brand_key", "brand", "document", "purpose_text"), "ground", "aviation", "marine", order)
    two = each.select(*ORIGIN, *of("item_id"), joined.alias("review_flags"), "group", "subgroup", *of("brand"), order)
    rel = folded.withColumn("r", F.explode("relations"))
    three = rel.select(
        *ORIGIN, "r.main_item_id", "r.related_item_id", F.array().cast("array<string>").alias("review_flags"), "r.main_brand", "r.relation_type", "r.related_brand", X.inline_text(F.col("r.note")).alias("note"),
        F.struct("row_index", "r.main_item_id", "r.related_item_id", "r.relation_type").alias("ord"),
    )
    return one, two, three


def staged_ids() -> Column:
    """Ids of a folded row's items that are staged."""
    return F.transform(F.filter("items", lambda i: i["match_type"].isNotNull()), lambda i: i["item_id"])


def with_staged(folded: DataFrame, table: DataFrame, name: str) -> DataFrame:
    """folded with the ids that a staged table really holds of each row."""
    ids = table.groupBy("row_id").agg(F.collect_list("item_id").alias(name))
    return folded.join(ids, "row_id", "left").withColumn(name, _list(name, "array<string>"))


def quality(folded: DataFrame, table1: Column | None = None, table2: Column | None = None) -> DataFrame:
    """One row a batch: its rows and items, how many relations and open flags, the errors found, and its state: failed with an
    error, else passed_with_flags with a flag, else passed. table1, table2: ids of a row's items that the staged tables hold."""
    one, two = (staged_ids() if t is None else t for t in (table1, table2))
    ids = F.transform("items", lambda i: i["item_id"])
    says = lambda pattern, found: F.transform(found, lambda x: F.format_string(pattern, x))
    bare = F.array_except(F.transform("cells", lambda c: c["cell_id"]), F.transform("items", lambda i: i["cell_id"]))
    told = F.concat(F.transform("relations", lambda r: r["related_item_id"]), F.flatten(F.transform("unresolved", lambda u: u["related_item_ids"])))
    others = F.transform(F.filter("items", lambda i: i["role"] != ROLES[0]), lambda i: i["item_id"])
    errors = F.concat(
        says("source cell %s produced no items", bare), says("item %s is missing from Table 1 staging", F.array_except(ids, one)), says("item %s is missing from Table 2 staging", F.array_except(ids, two)),
        says("non-main item %s has no relation status", F.array_except(others, told)),
    )
    per = folded.select("batch_id", F.struct("row_index", "row_id").alias("at"), F.size("items").alias("items"), F.size(staged_ids()).alias("matches"), F.size("relations").alias("relations"), F.size("flags").alias("flags"), errors.alias("errors"))
    # the list of a batch is bounded by its rows
    got = per.groupBy("batch_id").agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n_rows"), F.sum("items").alias("n_items"), F.sum("relations").alias("n_relations"), F.sum("flags").alias("open_flags"),
        F.sum("matches").alias("n_matches"), F.flatten(F.collect_list("errors")).alias("errors"),
    )
    if_ = lambda test, text: F.when(test, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    whole = F.sort_array(F.concat("errors", if_(F.col("n_items") != F.col("n_matches"), "purpose result count does not equal parsed item count"), if_(F.col("last.row_index") - F.col("first.row_index") + 1 != F.col("n_rows"), "batch rows are not a contiguous source range")))
    state = F.when(F.size("errors") > 0, "failed").when(F.col("open_flags") > 0, "passed_with_flags").otherwise("passed")
    out = got.withColumn("errors", whole)
    return out.select("batch_id", F.col("first.row_id").alias("start_row_id"), F.col("last.row_id").alias("end_row_id"), "n_rows", "n_items", "n_relations", "open_flags", "errors", state.alias("qc_status"))


def sizes(folded: DataFrame) -> DataFrame:
    """Rows, filled cells, items and the items of the fullest cell, by batch."""
    per_cell = F.transform("cells", lambda c: F.size(F.filter("items", lambda i: i["cell_id"] == c["cell_id"])))
    some = lambda c: F.sum(F.size(c)).alias(f"n_{c}")
    return folded.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_rows"), some("cells"), some("items"), F.coalesce(F.max(F.array_max(per_cell)), F.lit(0)).alias("most_in_cell"))


def cursor(folded: DataFrame, checked: DataFrame) -> DataFrame:
    """One row: what is done and what comes next. Batches count as done up to the first one that failed or wasn't checked."""
    each = folded.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row_index", "row_id")).alias("first"), F.sum(F.size("cells")).alias("cells")).join(checked.select("batch_id", "qc_status"), "batch_id", "left")
    each = each.withColumn("ok", F.coalesce(F.col("qc_status") != "failed", F.lit(False)))
    stop = each.agg(F.min(F.when(~F.col("ok"), F.col("batch_id"))).alias("next_batch"))
    done = F.col("next_batch").isNull() | (F.col("batch_id") < F.col("next_batch"))
    number = lambda c: F.coalesce(F.sum(c), F.lit(0))
    told = each.join(F.broadcast(stop)).agg(  # one row
        number("n").alias("total_rows"), number("cells").alias("total_cells"), number(F.when(done, F.col("n"))).alias("processed_rows"), number(F.when(done, F.col("cells"))).alias("processed_cells"),
        F.max(F.when(done, F.col("batch_id"))).alias("last_completed_batch"), F.max_by("qc_status", F.when(done, F.col("batch_id"))).alias("last_qc_status"),
        F.min("next_batch").alias("next_batch"), F.min(F.when(F.col("batch_id") == F.col("next_batch"), F.col("first.row_id"))).alias("next_row_id"),
    )
    state = F.when(F.col("next_batch").isNull(), "completed").when(F.col("processed_rows") == 0, "initialized").otherwise("in_progress")
    left = lambda c: F.col(f"total_{c}") - F.col(f"processed_{c}")
    return told.withColumns({"remaining_rows": left("rows"), "remaining_cells": left("cells"), "status": state})


def checks(folded: DataFrame) -> DataFrame:
    """What quality(), cursor() and blockers() read of folded rows, for runs that are written once for all of them."""
    few = lambda c, *names: F.transform(c, lambda x: F.struct(*[x[n].alias(n) for n in names])).alias(c)
    items = few("items", "index", "item_id", "role", "cell_id", "brand_key", "match_type", "purpose_text")
    return folded.select("batch_id", "row_index", "row_id", few("cells", "cell_id"), items, few("relations", "related_item_id"), few("unresolved", "related_item_ids"), few("flags", "flag_id", "category", "cell_id", "item_id", "evidence"))


def lineage(folded: DataFrame) -> DataFrame:
    """Rows with all that was made of each: items, purposes, relations, unresolved groups and flags, as arrays in order."""
    held = F.filter("items", lambda i: i["match_type"].isNotNull())
    purposes = F.transform(held, lambda i: F.struct(i["item_id"].alias("item_id"), i["match_type"].alias("match_type"), i["purpose_text"].alias("purpose_text"), i["match_flags"].alias("review_flags")))
    items = F.transform("items", lambda i: i.dropFields("place", "match_type", "purpose_text", "match_flags", "reviewed"))
    flags = F.sort_array(F.transform("flags", lambda f: f.withField("message", flag_message(f["category"]))))
    return folded.withColumn("purposes", purposes).withColumn("items", items).withColumn("flags", flags)


def _shape(category: Column, message: Column, row: Column | None = None, item: Column | None = None, key: Column | None = None, ids: Column | None = None) -> list[Column]:
    given = (("row_id", row), ("item_id", item), ("brand_key", key))
    return [category.alias("category"), message.alias("message"), *[(F.lit(None).cast("string") if c is None else c).alias(n) for n, c in given], (F.lit(None).cast("array<string>") if ids is None else ids).alias("item_ids")]


def conflicts(items: DataFrame) -> DataFrame:
    """Brands (brand_key) of staged items (item_id, brand_key, purpose_text) with several different purposes, as blockers."""
    # texts are compared once each, not once an item
    texts = items.where("purpose_text != ''").select("brand_key", "purpose_text").distinct()
    several = texts.groupBy("brand_key").agg(F.count_distinct(X.comparison_text(F.col("purpose_text"))).alias("n")).where("n > 1")
    ids = items.join(several, "brand_key").groupBy("brand_key").agg(F.max("n").alias("n"), F.sort_array(F.collect_list("item_id")).alias("ids"))
    return ids.select(*_shape(F.lit("conflicting_purpose_values"), F.format_string("Brand key has %d different purpose texts", "n"), key=F.col("brand_key"), ids=F.col("ids")))


def unfinished(state: DataFrame) -> DataFrame:
    return state.where("status != 'completed'").select(*_shape(F.lit("incomplete_processing"), F.format_string("%d source rows remain", "remaining_rows")))


def uneven(rows: DataFrame, table1: Column, table2: Column) -> DataFrame:
    """A blocker if some row's items that the two tables hold (arrays of ids) differ."""
    both = rows.select(F.sort_array(table1).alias("one"), F.sort_array(table2).alias("two")).agg(F.bool_or(F.col("one") != F.col("two")).alias("uneven")).where("uneven")
    return both.select(*_shape(F.lit("staging_coverage_mismatch"), F.lit("Table 1 and Table 2 do not cover the same items")))


def blocking(flags: DataFrame) -> DataFrame:
    return flags.where(F.col("category").isin(*BLOCKING)).select(*_shape(F.col("category"), F.col("message"), F.col("row_id"), F.col("item_id")))


def blockers(folded: DataFrame, state: DataFrame, table1: Column | None = None, table2: Column | None = None, allow_partial: bool = False) -> DataFrame:
    """All that stands in the way of an export: (category, message, row_id, item_id, brand_key, item_ids). table1, table2: ids of a
    row's items that the staged tables hold. Reports show LISTED of them."""
    found = [blocking(flags(folded))] + ([] if allow_partial else [unfinished(state)])
    found.append(uneven(folded, *(staged_ids() if t is None else t for t in (table1, table2))))
    each = folded.select(F.explode(F.filter("items", lambda i: i["match_type"].isNotNull())).alias("i")).select("i.brand_key", "i.item_id", "i.purpose_text")
    return reduce(DataFrame.unionByName, [*found, conflicts(each)])


def staged_blockers(state: DataFrame, flags: DataFrame, table1: DataFrame, table2: DataFrame, allow_partial: bool = False) -> DataFrame:
    """blockers() of a run from what has been staged of it."""
    found = [blocking(flags)] + ([] if allow_partial else [unfinished(state)])
    sides = [t.groupBy("row_id").agg(F.collect_list("item_id").alias(n)) for t, n in ((table1, "one"), (table2, "two"))]
    held = sides[0].join(sides[1], "row_id", "full")
    found.append(uneven(held, _list("one", "array<string>"), _list("two", "array<string>")))
    return reduce(DataFrame.unionByName, [*found, conflicts(table1)])
