"""A run over a source as a folder of tables: start, batches up to the first that fails, reviews, validation and export.

All rows are parsed, related and matched by one plan; a batch is a range of rows in the tables, not a loop over files. Processing
stages the next batches at once, checks them at once, and moves the cursor up to the first that failed. Reviews restage the batch
that they concern. Every call that changes the run is one commit of sources.versions: its tables, reviews and cursor change
together or not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.functions.fixed import EXPORT_BRANDS, EXPORT_GROUPS, EXPORT_RELATIONS, RELATION_TYPES
from weftline.operators import commands, nested, relations, review
from weftline.operators.rows import batches
from weftline.sources import files, tables
from weftline.sources.scratch import settled
from weftline.sources.versions import Change, Store

#: Rows of a batch and batches of a call: as a rule, and at the most.
BATCH, LARGEST_BATCH, MOST_BATCHES = 10, 20, 1000
STAGED = ("table1", "table2", "table3")
OVERRIDES = {
    "items": "item_id string, brand string, document string, source_ref string, note string",
    "purposes": "item_id string, purpose_row_id string, purpose_text string, source_ref string, note string",
    "relations": "row_id string, main_item_id string, related_item_id string, relation_type string, note string, source_ref string",
}


class JobError(ValueError):
    """What a call asks for can't be done."""


class Job:
    """The run in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.store = spark, Store(spark, folder)

    # ---- tables

    def table(self, name: str) -> DataFrame:
        return self.store.table(name)

    def overrides(self, kind: str, of: Store | Change | None = None) -> DataFrame:
        name, of = f"overrides-{kind}", of or self.store
        return of.table(name) if of.has(name) else self.spark.createDataFrame([], OVERRIDES[kind])

    def state(self) -> dict | None:
        return self.store.document("progress")

    def _known(self) -> dict:
        if (state := self.state()) is None:
            raise JobError("the job is not initialized")
        return state

    # ---- start

    def initialize(self, source: str, force: bool = False, brand_tables: list[str] | None = None, purpose_tables: list[str] | None = None) -> dict:
        """Read a source and begin; a job of the same source goes on as it is, one of another is refused unless forced, which
        clears what was generated and keeps nothing of it."""
        old = self.state()
        if old is not None and not force:
            if old["source"] != source:
                raise JobError("the job was initialized for another source; use another folder, or force")
            return {**self.progress(), "status": "already_initialized"}
        known = settled(tables.fingerprints(self.spark, source))
        change = self.store.change(fresh=True)
        n, m, chosen = self._read(change, known, tables.with_headers(tables.parsed_tables(tables.discover(self.spark, source))), brand_tables, purpose_tables)
        change.document("progress", {"source": source, **chosen, "named": brand_tables is not None or purpose_tables is not None, "total_rows": n, "total_cells": m, "processed_rows": 0, "processed_cells": 0, "batches": 0, "last_completed_batch": None, "last_qc_status": None, "status": "initialized"})
        change.commit()
        return self.progress()

    def _read(self, change: Change, known: DataFrame, parsed: DataFrame, brand_tables: list[str] | None, purpose_tables: list[str] | None) -> tuple[int, int, dict]:
        """Put what follows from the parsed tables of a source into a change: rows, cells, purposes; how many rows and cells, and the tables
        chosen."""
        change.put("files", known)
        change.put("parsed", parsed)
        found = settled(tables.numbered_tables(change.table("parsed")))
        if found.isEmpty():
            raise JobError("no HTML or Markdown tables in the source")
        brands = tables.select_tables(found, "brand", brand_tables)
        purposes = tables.select_tables(found, "purpose", purpose_tables, without=brands)
        for chosen, what in ((brands, "brand"), (purposes, "purpose")):
            if chosen.isEmpty():
                raise JobError(f"no {what} table was found: scan the source and name some")
        rows = settled(relations.source_rows(brands))
        cells, wanted = settled(relations.source_cells(rows)), settled(relations.purposes(purposes))
        n, m = rows.count(), cells.count()
        if not m or wanted.isEmpty():
            raise JobError("the chosen tables hold no brand cells or no purposes")
        for name, df in (("rows", rows), ("cells", cells), ("purposes", wanted), ("catalog", tables.scan(found))):
            change.put(name, df)
        ids = lambda df: [r[0] for r in df.select("table_id").orderBy("document_order").collect()]  # noqa: E731  (tables chosen by hand or by header)
        return n, m, {"brand_tables": ids(brands), "purpose_tables": ids(purposes)}

    def refresh(self) -> dict:
        """Bring the run up to date with its source: only files that are new or have another time or size are read and parsed; ids
        are those that a new start would give. Staged batches are staged again from the first to the last whose rows, or whose brands'
        purposes, are others now; all others and all reviews stay. One commit. Returns the files read and gone, and the batches."""
        state = dict(self._known())
        if state["named"]:
            raise JobError("tables were named by id, and ids may change: initialize again, with force")
        mark = ["path", "modified", "length"]
        known, old = settled(tables.fingerprints(self.spark, state["source"])), self.table("files")
        changed, gone = settled(known.join(old, mark, "left_anti")), old.join(known, "path", "left_anti").count()
        told = {"files": changed.count(), "gone": gone, "batches": []}
        if not told["files"] and not gone:
            return told
        same = known.join(old, mark, "left_semi").select(F.col("path").alias("source_file"))
        fresh = tables.with_headers(tables.parsed_tables(tables.contents(self.spark, state["source"], changed)))
        change = self.store.change()
        before = {n: self.table(n) for n in ("rows", "purposes")}
        n, m, chosen = self._read(change, known, self.table("parsed").join(same, "source_file", "left_semi").unionByName(fresh), None, None)
        state |= {"total_rows": n, "total_cells": m, **chosen}
        if self.store.has("staged_rows"):
            self._restage_changed(change, before, state, told)
        change.document("progress", state)
        change.commit()
        return told

    def _restage_changed(self, change: Change, before: dict[str, DataFrame], state: dict, told: dict) -> None:
        """Stage again what a change of rows and purposes concerns; the cursor stays, or goes back to what is left or passes."""
        places = settled(self.table("staged_rows").select("row_index", "batch_id"))
        content = sorted(set(before["rows"].columns) - {"row_index"})
        digest = lambda df: df.select("row_index", F.xxhash64(*[F.col(c) for c in content]).alias("is"))
        now = digest(change.table("rows"))
        other = places.join(digest(before["rows"]), "row_index").join(now.select("row_index", F.col("is").alias("new")), "row_index", "left").where(~F.col("is").eqNullSafe(F.col("new"))).select("batch_id")
        # a brand's purposes, in their order
        wanted = lambda df: df.groupBy("match_brand").agg(F.sum(F.xxhash64("match_key", "purpose", "group", "subgroup", "source_file", "document_order", "row_no", "at").cast("decimal(38,0)")).alias("is"))
        brands = wanted(before["purposes"]).join(wanted(change.table("purposes")).withColumnRenamed("is", "new"), "match_brand", "full").where(~F.col("is").eqNullSafe(F.col("new"))).select("match_brand")
        items = self.table("table1").select("batch_id", X.normalized_brand(F.col("brand")).alias("match_brand"))
        span = other.unionByName(items.join(brands, "match_brand", "left_semi").select("batch_id")).agg(F.min("batch_id").alias("first"), F.max("batch_id").alias("last")).first()
        if span.first is None:
            return
        rows = change.table("rows").join(places.where(F.col("batch_id").between(span.first, span.last)), "row_index").select(*self.table("staged_rows").columns)
        change.replace("staged_rows", rows, span.first, span.last)
        checked = [r.asDict() for r in self._stage(change, change.table("staged_rows").where(F.col("batch_id").between(span.first, span.last)), span.first, span.last).select("batch_id", "qc_status").orderBy("batch_id").collect()]  # an id and a word a batch
        told["batches"] = [c["batch_id"] for c in checked]
        if (failed := next((c["batch_id"] for c in checked if c["qc_status"] == "failed"), None)) is not None:
            for table in (*STAGED, "flags", "qc", "staged_rows"):
                change.keep_until(table, f"B{int(failed[1:]) - 1:06d}")
        done = change.table("staged_rows").agg(F.count(F.lit(1)).alias("rows"), F.max("batch_id").alias("last")).first()
        last = change.table("qc").orderBy(F.desc("batch_id")).select("qc_status").first()
        cells = change.table("cells").join(change.table("staged_rows").select("row_id"), "row_id", "left_semi").count()
        state |= {"processed_rows": done.rows, "processed_cells": cells, "batches": int(done.last[1:]) if done.last else 0, "last_completed_batch": done.last, "last_qc_status": last.qc_status if last else None}
        state["status"] = "completed" if done.rows >= state["total_rows"] else "in_progress" if done.rows else "initialized"

    # ---- what is made of rows

    def _folded(self, rows: DataFrame, of: Store | Change) -> DataFrame:
        """Nested rows of some rows (with batch_id), by the cells, purposes and reviews of a version or a change."""
        cells = of.table("cells").join(rows.select("row_id"), "row_id", "left_semi")
        items = settled(relations.with_overrides(relations.items(cells), self.overrides("items", of)))
        told = relations.match_purposes(items.join(rows.select("row_id", "group", "subgroup"), "row_id"), of.table("purposes"))
        flags = F.when(F.col("match_type") == "ambiguous", F.array(F.lit("ambiguous_purpose_match"))).when(F.col("match_type") == "not_found", F.array(F.lit("purpose_not_found"))).otherwise(F.array().cast("array<string>"))
        matches = told.select("item_id", "match_type", "purpose_text", flags.alias("review_flags"))
        manual = self.overrides("relations", of).join(rows.select("row_id"), "row_id", "left_semi")
        return settled(nested.fold(rows, nested.matched(items, matches, self.overrides("purposes", of)), cells, manual))

    def _stage(self, change: Change, rows: DataFrame, first: str, last: str) -> DataFrame:
        """Stage and check the batches of some rows, from first to last, as part of a change; the checks."""
        folded = self._folded(settled(rows), change)
        for name, table in zip(STAGED, nested.staged(folded)):
            change.replace(name, table, first, last)
        # what the files hold now is checked, not what was meant to be written
        held = folded
        for name in STAGED[:2]:
            held = nested.with_staged(held, change.table(name).where(F.col("batch_id").between(first, last)), f"_{name}")
        checked = settled(nested.quality(held, F.col("_table1"), F.col("_table2")))
        change.replace("flags", nested.flags(folded), first, last)
        change.replace("qc", checked, first, last)
        return checked

    # ---- batches

    def process(self, batch_size: int = BATCH, max_batches: int = 1, stop_on_flags: bool = False) -> list[dict]:
        """Stage the next batches; the summary of each up to the first that failed, or that has flags with stop_on_flags. Later
        ones are staged again by the next call."""
        state = dict(self._known())
        size, most = max(1, min(int(batch_size), LARGEST_BATCH)), max(1, min(int(max_batches), MOST_BATCHES))
        start, first = state["processed_rows"], state["batches"]
        if start >= state["total_rows"]:
            return []
        ahead = self.table("rows").where((F.col("row_index") > start) & (F.col("row_index") <= start + size * most))
        ahead = ahead.withColumn("at", F.col("row_index") - start + size * first)
        ahead = settled(batches(ahead, "at", size).drop("at"))
        name = lambda n: f"B{n:06d}"
        change = self.store.change()
        change.replace("staged_rows", ahead, name(first + 1), name(first + most))
        told = [r.asDict() for r in self._stage(change, ahead, name(first + 1), name(first + most)).orderBy("batch_id").collect()]  # no more than max_batches
        done, passed = [], 0
        for t in told:
            done.append(t)
            if t["qc_status"] == "failed":
                break
            passed += 1
            if stop_on_flags and t["open_flags"]:
                break
        if not passed:
            return done
        # what was staged beyond the cursor is no part of the run yet
        for table in (*STAGED, "flags", "qc", "staged_rows"):
            change.keep_until(table, name(first + passed))
        rows = sum(t["n_rows"] for t in told[:passed])
        cells = self.table("cells").join(change.table("staged_rows").where(F.col("batch_id") > name(first)).select("row_id"), "row_id", "left_semi").count()
        state |= {"processed_rows": start + rows, "processed_cells": state["processed_cells"] + cells, "batches": first + passed, "last_completed_batch": name(first + passed), "last_qc_status": told[passed - 1]["qc_status"]}
        state["status"] = "completed" if state["processed_rows"] >= state["total_rows"] else "in_progress"
        change.document("progress", state)
        change.commit()
        return done

    def progress(self) -> dict:
        """Counters, the next batch, and open flags by category."""
        state = self.state()
        if state is None:
            return {"status": "not_initialized"}
        flags = {r.category: r.n for r in review.listed_flags(self.flags())[1].collect()}  # one row a category
        left = {f"remaining_{k}": state[f"total_{k}"] - state[f"processed_{k}"] for k in ("rows", "cells")}
        return {**state, **left, "next_batch": f"B{state['batches'] + 1:06d}" if left["remaining_rows"] else None, "open_flags": sum(flags.values()), "flag_categories": flags}

    def flags(self) -> DataFrame:
        if self.store.has("flags"):
            return self.table("flags")
        return self.spark.createDataFrame([], "flag_id string, batch_id string, category string, row_id string, cell_id string, item_id string, evidence string, severity string, message string")

    def report(self) -> str:
        """The quality report, a section a batch."""
        out = ["# Quality report", ""]
        for r in self.table("qc").orderBy("batch_id").toLocalIterator():
            out += [f"## {r.batch_id}", "", f"- Rows: {r.start_row_id} … {r.end_row_id}", f"- Items: {r.n_items}", f"- Relations: {r.n_relations}", f"- Open flags: {r.open_flags}", f"- Status: {r.qc_status}"]
            out += [f"- Errors: {'; '.join(r.errors)}", ""] if r.errors else [""]
        return "\n".join(out)

    # ---- reviews

    def _reviewed(self, kind: str, df: DataFrame, batch_id: str) -> dict:
        """Put reviews and the batch that they concern in place together; the batch's checks."""
        change = self.store.change()
        change.put(f"overrides-{kind}", df.coalesce(1))
        rows = self.table("staged_rows").where(F.col("batch_id") == batch_id)
        told = self._stage(change, rows, batch_id, batch_id).first()
        if told is None:
            raise JobError(f"unknown batch: {batch_id}")
        change.commit()
        return told.asDict()

    def _item(self, batch_id: str, item_id: str):
        found = self.table("table1").where((F.col("batch_id") == batch_id) & (F.col("item_id") == item_id)).select("row_id", "brand", "document").first()
        if found is None:
            raise JobError(f"item {item_id} doesn't belong to {batch_id}")
        return found

    def override_item(self, batch_id: str, item_id: str, brand: str | None = None, document: str | None = None, no_document: bool = False, source_ref: str = "", note: str = "") -> dict:
        """Put a reviewed brand and document in place of the parsed ones; relations and purposes follow, the batch is restaged."""
        if brand is None and document is None and not no_document:
            raise JobError("give a brand, a document, or no_document")
        item = self._item(batch_id, item_id)
        tidy = lambda t: " ".join((t or "").split())
        new = tidy(brand) if brand is not None else item.brand
        if not new:
            raise JobError("the brand can't be empty")
        held = None if no_document else (tidy(document) or None) if document is not None else item.document
        row = self.spark.createDataFrame([(item_id, new, held, source_ref, note)], OVERRIDES["items"])
        return self._reviewed("items", commands.upsert(self.overrides("items"), row, ["item_id"]), batch_id)

    def override_purpose(self, batch_id: str, item_id: str, purpose_row_id: str | None = None, purpose_text: str | None = None, source_ref: str = "", note: str = "") -> dict:
        """Put a purpose, by its row or by its text, in place of what was matched; the batch is restaged."""
        self._item(batch_id, item_id)
        if purpose_row_id:
            row = self.table("purposes").where(F.col("purpose_row_id") == purpose_row_id).select("purpose", "excerpt").first()
            if row is None:
                raise JobError(f"unknown purpose row: {purpose_row_id}")
            purpose_text, source_ref = row.purpose, source_ref or row.excerpt
        if not (text := " ".join((purpose_text or "").split())):
            raise JobError("give a purpose row or a text")
        row = self.spark.createDataFrame([(item_id, purpose_row_id, text, source_ref, note)], OVERRIDES["purposes"])
        return self._reviewed("purposes", commands.upsert(self.overrides("purposes"), row, ["item_id"]), batch_id)

    def override_relation(self, batch_id: str, main_item_id: str, related_item_id: str, relation_type: str | None = None, note: str = "", source_ref: str = "") -> dict:
        """Relate two items of a row by hand; the type is that of the related item's role."""
        row = self._item(batch_id, main_item_id)
        self._item(batch_id, related_item_id)
        items = self.table("table1").where(F.col("batch_id") == batch_id).select("item_id", "row_id", F.substring_index("cell_id", ".", -1).alias("role"))
        role = items.where(F.col("item_id") == related_item_id).first().role
        new = self.spark.createDataFrame([(row.row_id, main_item_id, related_item_id, relation_type or RELATION_TYPES.get(role, ""), note, source_ref)], OVERRIDES["relations"])
        wrong = commands.relation_errors(new, items).first()
        if wrong is not None:
            raise JobError(wrong.error)
        return self._reviewed("relations", commands.upsert(self.overrides("relations"), new, ["main_item_id", "related_item_id", "relation_type"]), batch_id)

    def clear_override(self, kind: str, batch_id: str, **match) -> dict:
        """Take back the reviews of a kind that match, and restage the batch."""
        return self._reviewed(kind, commands.clear(self.overrides(kind), **match), batch_id)

    def row_detail(self, row_id: str) -> dict:
        """All that was made of one row."""
        own = self.table("rows").where(F.col("row_id") == row_id)
        if own.isEmpty():
            raise JobError(f"unknown row: {row_id}")
        staged = self.table("staged_rows").where(F.col("row_id") == row_id).limit(1) if self.store.has("staged_rows") else own.limit(0).withColumn("batch_id", F.lit(""))
        if staged.isEmpty():
            return {"row": own.first().asDict(True), "batch_id": None}
        told = nested.lineage(self._folded(settled(staged), self.store)).first().asDict(True)
        flags = [f.asDict() for f in self.flags().where(F.col("row_id") == row_id).orderBy("flag_id").collect()]  # of one row
        return {"row": own.first().asDict(True), "batch_id": told["batch_id"], **{k: told[k] for k in ("items", "purposes", "relations", "unresolved")}, "flags": flags}

    # ---- export

    def blockers(self, allow_partial: bool = False) -> DataFrame:
        state = self.progress()
        one = self.spark.createDataFrame([(state["status"], state["remaining_rows"])], "status string, remaining_rows long")
        return nested.staged_blockers(one, self.flags(), self.table("table1"), self.table("table2"), allow_partial)

    def export(self, folder: str, allow_partial: bool = False, allow_blockers: bool = False) -> dict:
        """Write the three CSV files; refused while anything stands in the way, unless that is allowed."""
        self._known()
        found = self.blockers(allow_partial)
        listed = [r.asDict() for r in found.limit(review.LISTED).collect()]
        if listed and not allow_blockers:
            raise JobError(f"{len(listed)} blockers, the first: {listed[0]['category']}: {listed[0]['message']}")
        place = F.struct("batch_id", "ord")
        facts = self.table("table1").withColumn("place", place)
        brands = relations.export_brands(facts, "place").orderBy("place").select("brand", "document", "purpose", "ground", "aviation", "marine")
        several = lambda name, cols: relations.export_distinct(self.table(name).withColumn("place", place), cols, "place").orderBy("place").select(*cols)
        outputs = {
            "brands.csv": (brands, EXPORT_BRANDS),
            "groups.csv": (several("table2", ["group", "subgroup", "brand"]), EXPORT_GROUPS),
            "relations.csv": (several("table3", ["main_brand", "relation_type", "related_brand", "note"]), EXPORT_RELATIONS),
        }
        counts = {}
        for name, (df, titles) in outputs.items():
            kept = settled(df)
            files.write_csv_file(kept, f"{folder}/{name}", titles)
            counts[name] = kept.count()
        return {"rows": counts, "blockers": listed}

