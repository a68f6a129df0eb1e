"""From table rows to items, relations, purposes, staged facts and exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions import text as X
from weftline.functions.fixed import BLOCKING, HEADER_WORD, RELATION_TYPES, REPEATED_HEADER_STEMS, ROLES
from weftline.operators.rows import distinct_in_order, fill_down, last_write_wins, serial, unpivot_filled
from weftline.sources.tables import Blocks


#: Ids of a page of a list that may be long.
PAGE = 1000


def physical_rows(tables: DataFrame, candidate: str, roles: tuple[str, ...], blocks: Blocks | None = None) -> DataFrame:
    """Rows below the header, one column a role; a role without a column is empty. blocks: rows of tables that come in blocks.
    `run` rises with document_order and row_no and tells the blocks apart."""
    c = F.col(candidate)
    # cells are cleaned inside the array that is unfolded, so each of them once
    clean = F.transform("matrix", lambda row: F.transform(row, X.clean_text))
    held = tables.withColumn("first_row", F.lit(0)) if blocks is None else blocks.of(tables)
    run = (F.shiftleft(F.col("document_order").cast("long"), 31) + F.col("first_row")).alias("run")
    rows = held.select("table_id", "document_order", "source_file", run, "first_row", c.alias("c"), F.posexplode(clean).alias("at", "cells")).withColumn("at", F.col("first_row") + F.col("at")).where(F.col("at") >= F.col("c.header_depth"))
    cell = lambda role: F.coalesce(F.get("cells", F.try_element_at("c.column_map", F.lit(role))), F.lit("")).alias(role)
    return rows.select("table_id", "document_order", "source_file", "run", (F.col("at") + 1).alias("row_no"), *[cell(r) for r in roles])


def repeated_header(cols: dict[str, str] = REPEATED_HEADER_STEMS) -> Column:
    """Whether three of the role cells look like their own titles."""
    cells = F.array(*[F.struct(F.col(r).alias("text"), F.lit(stem).alias("stem"), F.lit(r).alias("role")) for r, stem in cols.items()])
    titled = lambda c: X.let(X.comparison_text(c["text"]), lambda t: t.contains(HEADER_WORD) & (t.contains(c["stem"]) | t.contains(c["role"])))
    return F.size(F.filter(cells, titled)) >= 3


def _excerpt(cols: list[str]) -> Column:
    return X.inline_text(F.concat_ws(" | ", *[F.nullif(F.col(c), F.lit("")) for c in cols]))


def source_rows(tables: DataFrame, blocks: Blocks | None = None) -> DataFrame:
    """Row manifest of the brand tables: groups filled down over tables, three-valued marks, flags, serial ids. blocks: as in physical_rows."""
    marks = ["ground", "aviation", "marine"]
    rows = physical_rows(tables, "brand_candidate", (*ROLES, "group", "subgroup", *marks, "note"), blocks).where(~repeated_header())
    raw = rows.select("*", *[F.col(c).alias(f"{c}_cell") for c in ("group", "subgroup", *marks)])
    for c in ("group", "subgroup"):
        raw = raw.withColumn(c, X.let(X.inline_text(F.col(c)), lambda t: F.nullif(t, F.lit(""))))
    filled = fill_down(raw, ["group", "subgroup"], ["document_order", "row_no"], F.col("run"))
    kept = filled.where(reduce(lambda a, b: a | b, [F.col(r) != "" for r in ROLES]))
    for m in marks:
        kept = kept.withColumn(m, X.let(F.col(m), X.parse_equipment))
    filled_roles = F.filter(F.array(*[F.col(r) for r in ROLES]), lambda v: v != "")
    alone = (F.col("group_cell") == "") & (F.col("subgroup_cell") == "") & (F.size(filled_roles) == 1) & F.coalesce(*marks).isNull()
    alone &= ~X.let(F.get(filled_roles, 0), lambda t: F.concat(F.lit(" "), X.comparison_text(t), F.lit(" ")).contains(" по "))
    flags = [F.when((F.col(f"{m}_cell") != "") & F.col(m).isNull(), f"unrecognized_{m}_equipment_marker") for m in marks]
    kept = kept.withColumn("row_flags", F.array_sort(F.array_compact(F.array(*flags, F.when(alone, "possible_continuation_row")))))
    kept = kept.withColumn("source_excerpt", _excerpt(["group_cell", "subgroup_cell", *ROLES, "note"])).drop(*[f"{c}_cell" for c in ("group", "subgroup", *marks)])
    numbered = serial(kept, "row_index", ["row_no"], F.col("run")).drop("run")
    return numbered.withColumn("row_id", F.format_string("R%06d", "row_index"))


def source_cells(rows: DataFrame) -> DataFrame:
    """Filled role cells in long form."""
    long = unpivot_filled(rows, ["row_id", "row_index", "source_file", "table_id"], list(ROLES), "role", "raw_cell")
    return long.withColumn("cell_id", F.concat_ws(".", "row_id", "role"))


def items(cells: DataFrame) -> DataFrame:
    """Parsed items of the cells, numbered within each."""
    # items are parsed inside the array that is unfolded, so each of them once
    parts = cells.select("*", F.posexplode(F.transform(X.cell_items(F.col("raw_cell")), lambda raw: X.brand_item(raw))).alias("_at", "_p"))
    out = parts.select("row_id", "row_index", "cell_id", "role", (F.col("_at") + 1).alias("index"), F.col("_p.brand").alias("brand"), F.col("_p.document").alias("document"), F.col("_p.raw_item").alias("raw_item"), F.col("_p.flags").alias("review_flags"))
    return keyed(out.withColumn("item_id", F.format_string("%s.%02d", "cell_id", "index")))


def keyed(df: DataFrame) -> DataFrame:
    b, d = F.col("brand"), F.col("document")
    return df.withColumn("brand_key", X.brand_key(b, d)).withColumn("match_brand", X.normalized_brand(b)).withColumn("match_key", X.normalized_brand_key(b, d))


def purposes(tables: DataFrame) -> DataFrame:
    """Purpose table rows, one per brand item, groups filled down."""
    roles = ("brand", "purpose", "group", "subgroup", "normdoc", "note")
    raw = physical_rows(tables, "purpose_candidate", roles).withColumn("excerpt", _excerpt(["group", "subgroup", "brand", "purpose", "note"]))
    for c in ("group", "subgroup"):
        raw = raw.withColumn(c, X.let(X.inline_text(F.col(c)), lambda t: F.nullif(t, F.lit(""))))
    filled = fill_down(raw, ["group", "subgroup"], ["document_order", "row_no"], F.col("run"))
    kept = filled.withColumn("purpose", X.inline_text(F.col("purpose"))).where("brand != '' and purpose != ''").withColumnRenamed("brand", "brand_raw")
    parts = kept.select("*", F.posexplode(F.transform(X.cell_items(F.col("brand_raw")), lambda raw: X.brand_item(raw, F.col("normdoc")))).alias("at", "p"))
    parts = parts.withColumn("brand", F.col("p.brand")).withColumn("document", F.col("p.document")).withColumn("review_flags", F.col("p.flags")).drop("p")
    numbered = serial(keyed(parts), "purpose_index", ["row_no", "at"], F.col("run")).drop("run")
    return numbered.withColumn("purpose_row_id", F.format_string("P%06d", "purpose_index"))


def map_relations(items: DataFrame, main: str = "main") -> tuple[DataFrame, DataFrame]:
    """Relations and unresolved groups of each row's items: with one main item, to all related ones; with as many mains as
    related items, pair by pair; otherwise unresolved. items: row_id, role, index, item_id, brand, brand_key."""
    mains = items.where(F.col("role") == main)
    related = items.where(F.col("role") != main)
    place = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy("index", "item_id"))
    n_main = mains.groupBy("row_id").agg(F.count(F.lit(1)).alias("n_main"), F.sort_array(F.collect_list("item_id")).alias("main_item_ids"))
    n_rel = related.groupBy("row_id", "role").agg(F.count(F.lit(1)).alias("n_related"), F.sort_array(F.collect_list("item_id")).alias("related_item_ids"))
    sizes = n_rel.join(n_main, "row_id", "left").fillna(0, ["n_main"])
    basis = F.when(F.col("n_main") == 1, "single-main").when(F.col("n_main") == F.col("n_related"), "positional")
    sizes = sizes.withColumn("basis", basis)
    right = related.withColumn("place", place(["row_id", "role"])).join(sizes.where("basis is not null").select("row_id", "role", "basis"), ["row_id", "role"])
    left = mains.select("row_id", place(["row_id"]).alias("place_main"), *[F.col(c).alias(f"main_{c}") for c in ("item_id", "brand", "brand_key")])
    # one equi-join: the single main has place 1, and so do all that it is joined with
    right = right.withColumn("place_main", F.when(F.col("basis") == "single-main", 1).otherwise(F.col("place")))
    pairs = right.join(left, ["row_id", "place_main"]).select("row_id", "role", "main_item_id", "main_brand", "main_brand_key", *[F.col(c).alias(f"related_{c}") for c in ("item_id", "brand", "brand_key")], F.col("basis").alias("mapping_basis"))
    flag = F.when(F.col("n_main") == 0, "missing_main_item").otherwise("ambiguous_relation_mapping")
    open_ = sizes.where("basis is null").select("row_id", "role", flag.alias("flag"), F.coalesce("main_item_ids", F.array().cast("array<string>")).alias("main_item_ids"), "related_item_ids")
    return pairs, open_


def typed(df: DataFrame) -> DataFrame:
    """Relations with their type's name."""
    names = F.create_map(*[F.lit(x) for kv in RELATION_TYPES.items() for x in kv])
    return df.withColumn("relation_type", names[F.col("role")])


def match_purposes(items: DataFrame, purposes: DataFrame) -> DataFrame:
    """Purpose of each item: by full key, else by brand alone; candidates of the same group are preferred, and only a single
    distinct purpose is taken. items need match_key, match_brand, group, subgroup; purposes also purpose, purpose_row_id,
    purpose_index.

    Purposes are reduced to one row per key, group and subgroup first (least and greatest text tell whether there is one), and
    items to their distinct keys and groups, so that neither a brand with many purposes nor one with many items is multiplied.
    n_candidates says how many purposes there were to choose from; purpose_candidates() lists them.
    """
    place = lambda c: X.comparison_text(F.coalesce(F.col(c), F.lit("")))
    p = purposes.withColumn("p_group", place("group")).withColumn("p_subgroup", place("subgroup")).withColumn("what", X.comparison_text(F.col("purpose")))
    pick = F.struct("purpose_index", "purpose", "purpose_row_id")
    slim = lambda key: p.groupBy(F.col(key).alias("key"), "p_group", "p_subgroup").agg(F.min("what").alias("low"), F.max("what").alias("high"), F.min(pick).alias("first"), F.count(F.lit(1)).alias("n"))
    signs = ["match_key", "match_brand", "i_group", "i_subgroup"]
    told = items.withColumn("i_group", place("group")).withColumn("i_subgroup", place("subgroup"))
    asked = told.select(*signs).distinct()
    known = p.select("match_key").distinct()
    full = asked.join(known, "match_key", "left_semi").withColumn("by", F.lit("exact")).join(slim("match_key"), F.col("match_key") == F.col("key"))
    brand = asked.join(known, "match_key", "left_anti").withColumn("by", F.lit("brand_only")).select(*asked.columns, "by").join(slim("match_brand"), F.col("match_brand") == F.col("key"))
    same = lambda c: (F.col(f"i_{c}") == "") | (F.col(f"p_{c}") == "") | (F.col(f"i_{c}") == F.col(f"p_{c}"))
    both = full.unionByName(brand).withColumn("fits", same("group") & same("subgroup"))
    sides = (("fit", F.col("fits")), ("all", F.lit(True)))
    one = both.groupBy(*signs, "by").agg(
        F.bool_or("fits").alias("any_fits"),
        *[F.struct(F.min(F.when(test, F.col("low"))).alias("low"), F.max(F.when(test, F.col("high"))).alias("high"), F.min(F.when(test, F.col("first"))).alias("first")).alias(side) for side, test in sides],
        F.sum("n").alias("n_candidates"),
    )
    one = one.withColumn("c", F.when(F.col("any_fits"), F.col("fit")).otherwise(F.col("all"))).select(*[F.col(s).alias(f"_{s}") for s in signs], "by", "c", "n_candidates")
    out = told.join(one, [F.col(s) == F.col(f"_{s}") for s in signs], "left")
    kind = F.when(F.col("by").isNull(), "not_found").when(F.col("c.low") != F.col("c.high"), "ambiguous").otherwise(F.col("by"))
    taken = F.when(F.col("c.low") == F.col("c.high"), F.col("c.first"))
    return out.select(*items.columns, kind.alias("match_type"), taken["purpose"].alias("purpose_text"), taken["purpose_row_id"].alias("purpose_row_id"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))


def purpose_candidates(items: DataFrame, purposes: DataFrame, page: int = PAGE) -> DataFrame:
    """The purposes that an item's key leads to, once a key and not once an item: (match_key, match_brand, by, page, purpose_row_ids),
    `by` being exact or brand_only. Lists are dealt out over pages of about `page` ids, so that a brand with very many purposes
    fills no row and no task; null keys lead nowhere."""
    asked = items.select("match_key", "match_brand").distinct()
    known = purposes.select("match_key").distinct()
    sides = []
    for by, how, key in (("exact", "left_semi", "match_key"), ("brand_only", "left_anti", "match_brand")):
        own = purposes.select(F.col(key).alias("key"), "purpose_row_id")
        pages = own.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / page).alias("pages"))
        # lists are made a key, before keys that were asked for meet them
        dealt = own.join(pages, "key").withColumn("page", F.pmod(F.xxhash64("purpose_row_id"), F.col("pages")))
        lists = dealt.groupBy("key", "page").agg(F.sort_array(F.collect_list("purpose_row_id")).alias("purpose_row_ids"))
        of = asked.join(known, "match_key", how).select("match_key", "match_brand", F.lit(by).alias("by"))
        sides.append(of.join(lists, F.col(key) == F.col("key")).drop("key"))
    return sides[0].unionByName(sides[1])


def with_overrides(items: DataFrame, over: DataFrame) -> DataFrame:
    """Reviewed brand and document in place of the parsed ones; keys follow, parser flags go."""
    gone = ["empty_brand", "mixed_latin_cyrillic", "multiple_normdocs_in_item", "normdoc_conflict_with_separate_column", "normdoc_not_found", "normdoc_without_po"]
    o = over.select("item_id", F.col("brand").alias("_brand"), F.col("document").alias("_document"), F.lit(True).alias("_hit"))
    out = items.join(o, "item_id", "left")
    hit = F.col("_hit")
    out = out.withColumn("brand", F.when(hit, F.col("_brand")).otherwise(F.col("brand"))).withColumn("document", F.when(hit, F.col("_document")).otherwise(F.col("document")))
    out = out.withColumn("review_flags", F.when(hit, F.array_except("review_flags", F.array(*map(F.lit, gone)))).otherwise(F.col("review_flags")))
    return keyed(out.drop("_brand", "_document", "_hit", "brand_key", "match_key", "match_brand"))


def with_manual_relations(generated: DataFrame, manual: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Generated relations with manual ones laid over them by key."""
    return last_write_wins(generated.withColumn("_prio", F.lit(0)).unionByName(manual.withColumn("_prio", F.lit(1))), keys, "_prio", position)


def export_brands(facts: DataFrame, order: str = "ord") -> DataFrame:
    """One row per brand_key in the order of first sight: first brand and document, first purpose there is, marks joined."""
    text = F.col("purpose_text")
    filled = F.when(F.coalesce(text, F.lit("")) != "", text)
    got = facts.groupBy("brand_key").agg(
        F.min(order).alias(order), F.min_by("brand", order).alias("brand"), F.min_by("document", order).alias("document"),
        F.min_by(filled, F.when(filled.isNotNull(), F.col(order))).alias("purpose"), *[F.bool_or(m).alias(m) for m in ("ground", "aviation", "marine")],
    )
    return got.select(order, "brand_key", F.coalesce("brand", F.lit("")).alias("brand"), F.coalesce("document", F.lit("")).alias("document"), F.coalesce("purpose", F.lit("")).alias("purpose"), *[X.equipment_mark(F.col(m)).alias(m) for m in ("ground", "aviation", "marine")])


def export_distinct(facts: DataFrame, cols: list[str], order: str = "ord") -> DataFrame:
    return distinct_in_order(facts.fillna("", cols), cols, order)


def coverage_gaps(expected: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    """Keys of either side that the other lacks, with the side."""
    a, b = expected.select(key).distinct(), staged.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("gap", F.lit("not staged")).unionByName(b.join(a, key, "left_anti").withColumn("gap", F.lit("not expected")))


def conflicts(facts: DataFrame, key: str, value: Column) -> DataFrame:
    """Keys with several values, and how many."""
    return facts.groupBy(key).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def blockers(flags: DataFrame, limit: int = 500) -> DataFrame:
    """The flags that stand in the way of an export, 500 at most, as in a review list."""
    return flags.where(F.col("category").isin(*BLOCKING)).orderBy("flag_id").limit(limit)


def candidates(purposes: DataFrame, key: Column, brand: Column, group: Column, subgroup: Column, limit: int = 10, either: bool = False) -> DataFrame:
    """Ranked purposes for one item: 100 for the full key, 70 for the brand, 30 for a brand that has it as a part (either: or is
    a part of it), 10 more each for group and subgroup. An empty brand is nobody's, nor a part."""
    part = F.col("match_brand").contains(brand) | (F.lit(either) & (F.col("match_brand") != "") & F.contains(brand, "match_brand"))
    base = F.when(F.col("match_key") == key, 100).when(brand == "", 0).when(F.col("match_brand") == brand, 70).when(part, 30).otherwise(0)
    extra = F.when(F.col("group") == group, 10).otherwise(0) + F.when(F.col("subgroup") == subgroup, 10).otherwise(0)
    return purposes.withColumn("score", base + extra).where(base > 0).orderBy(F.desc("score"), "purpose_row_id").limit(max(1, min(limit, 100)))


def contained(needles: DataFrame, needle: str, texts: DataFrame, text: str) -> DataFrame:
    """Distinct pairs (needle, text) of which the text contains the needle; nulls are in no pair, an empty needle is in all texts.

    A needle is looked up by its rarest run of three characters (itself, if it has no more), so frequent runs aren't joined.
    """
    n, t = (df.select(F.col(c).alias(c)).where(F.col(c).isNotNull()).distinct() for df, c in ((needles, needle), (texts, text)))
    runs = lambda c, k: F.transform(F.sequence(F.lit(1), F.length(c) - (k - 1)), lambda at: F.substring(c, at, k))
    of = lambda c, k: F.when(F.length(c) >= k, runs(c, k)).otherwise(F.array().cast("array<string>"))
    held = t.select(text, F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *[of(F.col(text), k) for k in (1, 2, 3)]))).alias("_run"))
    short = F.length(needle) <= 3
    asked = n.select(needle, F.when(short, F.array(needle)).otherwise(F.array_distinct(of(F.col(needle), 3))).alias("_runs"))
    often = held.groupBy("_run").agg(F.count(F.lit(1)).alias("_n"))
    each = asked.select(needle, F.size("_runs").alias("_all"), F.explode("_runs").alias("_run")).join(often, "_run")
    # a run that no text has rules the needle out
    key = each.groupBy(needle).agg(F.min_by("_run", F.struct("_n", "_run")).alias("_run"), F.count(F.lit(1)).alias("_found"), F.first("_all").alias("_all")).where("_found = _all")
    return key.join(held, "_run").where(F.contains(F.col(text), F.col(needle))).select(needle, text)


def top_candidates(items: DataFrame, purposes: DataFrame, limit: int = 10) -> DataFrame:
    """The first `limit` purposes (100 at most) of every distinct item, as candidates() ranks them for one.

    items and purposes: match_key, match_brand, group, subgroup; purposes also purpose_row_id. Returns the items' four columns,
    purpose_row_id, score and rank. Of the purposes that agree in key or brand, and in group or subgroup where that counts, only
    the first `limit` by id can be among an item's: each such list is cut before it is shuffled, and items are joined to lists.
    Nulls agree with nothing, nor do empty brands; items without candidates have no row.
    """
    limit = max(1, min(limit, 100))
    own = ["match_key", "match_brand", "group", "subgroup"]
    # 1: the group must agree, 2: the subgroup
    masks = F.explode(F.array(*map(F.lit, range(4)))).alias("_mask")
    due = lambda bit, c: F.when(F.col("_mask").bitwiseAND(bit) == 0, "").otherwise(F.col(c))
    slots = lambda df: df.where("_value is not null").select("*", masks).select("*", due(1, "group").alias("_g"), due(2, "subgroup").alias("_s")).where("_g is not null and _s is not null")
    slot = ["_kind", "_value", "_mask", "_g", "_s"]
    either = F.inline(F.array(*[F.struct(F.lit(c).alias("_kind"), F.col(c).alias("_value")) for c in ("match_key", "match_brand")]))

    ordered = Window.partitionBy(*slot).orderBy("purpose_row_id")
    lists = slots(purposes.select("purpose_row_id", *own, either)).withColumn("_nth", F.row_number().over(ordered)).where(F.col("_nth") <= limit)
    lists = lists.select(*slot, "purpose_row_id", *[F.col(c).alias(f"_{c}") for c in own])

    asked = items.select(*own).distinct()
    near = contained(asked.where("match_brand != ''"), "match_brand", purposes.select(F.col("match_brand").alias("_value")), "_value")
    probes = asked.select(*own, F.lit("match_key").alias("_kind"), F.col("match_key").alias("_value")).unionByName(asked.join(near, "match_brand").select(*own, F.lit("match_brand").alias("_kind"), "_value"))
    met = slots(probes).join(lists, slot)

    same = lambda c: F.coalesce(F.col(c) == F.col(f"_{c}"), F.lit(False))
    score = F.when(same("match_key"), 100).when(same("match_brand"), 70).otherwise(30) + F.when(same("group"), 10).otherwise(0) + F.when(same("subgroup"), 10).otherwise(0)
    told = met.groupBy(*own, "purpose_row_id").agg(F.max(score).alias("score"))
    return told.withColumn("rank", F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("score"), "purpose_row_id"))).where(F.col("rank") <= limit)
