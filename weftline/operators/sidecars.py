"""Sidecars of digitised documents, checked marker by marker: objects of typed fields, whose regions are pieces of text or grids.

A marker is a comment of one line, `<!-- object {"type": ...} -->`, `<!-- region {...} -->` or `<!-- table {...} -->`; a word and a
colon may stand before its name (the program that wrote it). What follows up to the next marker is its text. A document is
one row throughout: its markers are told apart, read and checked inside that row, so nothing is shuffled and no Python runs.
"""

from __future__ import annotations

import json
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.fixed import COLUMN_TYPES, REGION_STATES, UNFINISHED
from weftline.functions.text import let

MARKER = r"(?i)<!--[ \t]*(?:\w+:)?(object|region|table)[ \t]+(\{[^\r\n]*\})[ \t]*-->"
#: Remarks that older programs left inside the cells of a table.
REMARK = r'(?is)\s*<!--\s*(?:\w+:)?ocr\s+(?:"(?:\\.|[^"\\])*"|.*?)\s*-->'
SLACK = 1e-6


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{path}" if path else "$", kind)


def _sort(v: Column) -> Column:
    """The kind of a JSON value: STRING, BIGINT, ARRAY<...>, OBJECT<...> ...; null where there is none."""
    return F.schema_of_variant(v)


def _whole(v: Column) -> Column:
    """A JSON value as a whole number: numbers without their fraction, texts of digits; null for anything else."""
    digits = let(_get(v, "", "string"), lambda t: F.when(t.rlike(r"^\s*[+-]?\d{1,9}\s*$"), F.trim(t).cast("int")))
    number = let(_get(v, "", "double"), lambda n: F.when(F.abs(n) < 1 << 31, F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)).cast("int")))
    return F.when(_sort(v) == "STRING", digits).otherwise(number)


def _numbers(v: Column) -> Column:
    """A list of finite numbers; null for anything else."""
    return let(_get(v, "", "array<double>"), lambda got: F.when(F.forall(got, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), got))


#: JSON values that count as none, besides null, as they are written.
NOTHING = ("", "false", "0", "0.0", "[]", "{}")


def _written(v: Column, name: str) -> Column:
    """A part of a JSON value as text; null where it is missing or null, false, 0 or empty. It is looked up once."""
    return let(_get(v, name, "string"), lambda t: F.when(~t.isin(*NOTHING), t))


def _rounded(xs: Column) -> Column:
    return F.transform(xs, lambda x: F.bround(x, 6))


def _inside(r: Column) -> Column:
    """Whether [x, y, width, height] isn't empty and lies on the page."""
    return (r[0] >= 0) & (r[1] >= 0) & (r[2] > 0) & (r[3] > 0) & (r[0] + r[2] <= 1 + SLACK) & (r[1] + r[3] <= 1 + SLACK)


def _rising(xs: Column) -> Column:
    """Whether cuts rise strictly from 0 to 1."""
    steps = F.zip_with(F.slice(xs, 1, F.size(xs) - 1), F.slice(xs, 2, F.size(xs) - 1), lambda a, b: a < b)
    return (F.element_at(xs, 1) == 0) & (F.element_at(xs, -1) == 1) & F.forall(steps, lambda ok: ok)


def _state(s: Column) -> Column:
    return F.when(s.isin(*UNFINISHED), "pending").otherwise(s)


def _cells(v: Column, rows: Column, columns: Column) -> Column:
    """States of a grid's cells, as many as its cuts make; what is missing or unknown is pending."""
    lines = _get(v, "", "array<variant>")

    def line(k: Column) -> Column:
        cells = let(F.get(lines, k), lambda x: _get(x, "", "array<variant>"))
        state = lambda j: let(F.struct(F.get(cells, j).alias("v")), lambda s: _get(s["v"], "", "string"))
        return F.transform(F.sequence(F.lit(0), columns - 1), lambda j: let(F.struct(state(j).alias("s")), lambda s: F.when(s["s"].isin(*REGION_STATES), _state(s["s"])).otherwise("pending")))

    return F.transform(F.sequence(F.lit(0), rows - 1), line)


def _grid(v: Column) -> Column:
    """(x, y, statuses, columnTypes, error) of a grid."""
    part = lambda n: _get(v, n, "variant")
    read = F.struct(_rounded(_numbers(part("x"))).alias("x"), _rounded(_numbers(part("y"))).alias("y"), part("statuses").alias("cells"), part("columnTypes").alias("types"))

    def typed(g: Column) -> Column:
        # without the key, no column has a type; null isn't a list
        told = F.when(g["types"].isNull(), F.array_repeat(F.lit(""), F.size(g["x"]) - 1)).otherwise(F.transform(_get(g["types"], "", "array<string>"), lambda t: F.coalesce(t, F.lit(""))))
        return g.withField("types", told)

    def finished(g: Column) -> Column:
        few = lambda c: F.coalesce(F.size(c) < 2, F.lit(True))
        error = (
            F.when(few(g["x"]), "grid.x isn't a list of two numbers or more")
            .when(~_rising(g["x"]), "grid.x doesn't rise from 0 to 1")
            .when(few(g["y"]), "grid.y isn't a list of two numbers or more")
            .when(~_rising(g["y"]), "grid.y doesn't rise from 0 to 1")
            .when(F.coalesce(F.size(g["types"]) != F.size(g["x"]) - 1, F.lit(True)), "grid.columnTypes doesn't fit the columns")
            .when(F.exists(g["types"], lambda t: (t != "") & ~t.isin(*COLUMN_TYPES)), "grid.columnTypes has an unknown type")
        )
        cells = F.when(error.isNull(), _cells(g["cells"], F.size(g["y"]) - 1, F.size(g["x"]) - 1))
        return F.struct(g["x"].alias("x"), g["y"].alias("y"), cells.alias("statuses"), g["types"].alias("columnTypes"), error.alias("error"))

    return let(let(read, typed), finished)


def _region(mark: Column, kinds: Column, pages: Column) -> Column:
    """A marker's region with the first of its errors, if any; kinds: kind by field of the object's type."""
    v, part = mark["meta"], lambda n: _get(mark["meta"], n, "variant")
    text = lambda n: F.trim(_written(v, n))
    read = F.struct(
        mark["kind"].alias("kind"), F.coalesce(text("field"), F.lit("")).alias("field"), let(F.struct(part("page").alias("v")), lambda s: _whole(s["v"])).alias("page"),
        _numbers(part("rect")).alias("rect"), F.when(_written(v, "rotation").isNull(), 0).otherwise(let(F.struct(part("rotation").alias("v")), lambda s: F.pmod(_whole(s["v"]), F.lit(360)))).alias("rotation"),
        F.coalesce(_written(v, "status"), F.lit("pending")).alias("status"), text("error").alias("message"),
        F.when((mark["kind"] == "table") & _sort(part("grid")).startswith("OBJECT"), let(F.struct(part("grid").alias("v")), lambda s: _grid(s["v"]))).alias("grid"),
        mark["text"].alias("text"), v.isNull().alias("broken"),
    )

    def checked(r: Column) -> Column:
        due = F.when(F.try_element_at(kinds, r["field"]) == "grid", "table").otherwise("region")
        error = (
            F.when(r["broken"], "not JSON")
            .when(F.try_element_at(kinds, r["field"]).isNull(), "unknown field")
            .when(r["kind"] != due, "marker of the wrong kind")
            .when(r["page"].isNull(), "page isn't a number")
            .when((r["page"] < 1) | F.coalesce(r["page"] > pages, F.lit(False)), "no such page")
            .when(~r["status"].isin(*REGION_STATES), "unknown status")
            .when(F.coalesce(F.size(r["rect"]) != 4, F.lit(True)), "rect isn't a list of four numbers")
            .when(~_inside(r["rect"]), "rect isn't on the page")
            .when(r["rotation"].isNull(), "rotation isn't a number")
            .when(~r["rotation"].isin(0, 90, 180, 270), "rotation isn't a quarter turn")
            .when((r["kind"] == "table") & r["grid"].isNull(), "table without a grid")
            .otherwise(r["grid"]["error"])
        )
        told = F.when(r["status"] == "error", r["message"])
        return F.struct(r["kind"].alias("kind"), r["field"].alias("field"), r["page"].alias("page"), _rounded(r["rect"]).alias("rect"), r["rotation"].alias("rotation"), _state(r["status"]).alias("status"), told.alias("error"), r["grid"].dropFields("error").alias("grid"), r["text"].alias("text"), error.alias("rejected"))

    return let(read, checked)


def parsed(files: DataFrame, schema: dict[str, dict[str, str]]) -> DataFrame:
    """Sidecars (source, text, and page_count if it is known) as one row each: source, objects, rejections.

    schema: type -> field -> kind, text or grid (a document format's own description, small by nature). objects: type and
    regions, in order. rejections: (object_no, region_no, error) of all markers that break a rule, in order; numbers count from
    1, 0 stands for the document's head or for the object itself. The regions of an object that is rejected itself aren't checked.
    Null and blank texts have no objects and no errors; rows that repeat a source are read one by one; other columns are left out.
    """
    pages = F.col("page_count").cast("int") if "page_count" in files.columns else F.lit(None).cast("int")
    fields = F.from_json(F.lit(json.dumps(schema, ensure_ascii=False)), "map<string,map<string,string>>")
    text = F.coalesce("text", F.lit(""))
    found = F.struct(*[F.regexp_extract_all(text, F.lit(MARKER), F.lit(k)).alias(n) for k, n in ((1, "kinds"), (2, "metas"))], F.split(text, MARKER, -1).alias("texts"), pages.alias("pages"))

    # each step is a lambda of the step before, so that no optimizer rule copies an earlier step into a later loop
    def marked(f: Column) -> Column:
        def mark(kind: Column, k: Column) -> Column:
            body = let(F.get(f["texts"], k + 1), lambda t: F.regexp_replace(t, r"^[\r\n]+|[\r\n]+\z", ""))
            # names of markers are ASCII: lower() would go through the rules of all alphabets
            name = F.translate(kind, ascii_uppercase, ascii_lowercase)
            own = F.when(name == "table", F.regexp_replace(body, REMARK, "")).otherwise(body)
            return F.struct(name.alias("kind"), F.try_parse_json(F.get(f["metas"], k)).alias("meta"), own.alias("text"))

        return F.struct(F.get(f["texts"], F.lit(0)).alias("head"), F.transform(f["kinds"], mark).alias("marks"), f["pages"].alias("pages"))

    def placed(m: Column) -> Column:
        return m.withField("places", F.filter(F.transform(m["marks"], lambda x, k: F.when(x["kind"] == "object", k)), lambda k: k.isNotNull()))

    def read(m: Column) -> Column:
        def thing(run: Column) -> Column:
            kind = F.coalesce(F.trim(_get(run[0]["meta"], "type", "string")), F.lit(""))
            return let(let(F.struct(kind.alias("type"), run.alias("run")), lambda o: o.withField("kinds", F.try_element_at(fields, o["type"]))), checked)

        def checked(o: Column) -> Column:
            error = F.when(o["run"][0]["meta"].isNull(), "not JSON").when(F.trim(o["run"][0]["text"]) != "", "text before the first region").when(o["kinds"].isNull(), "unknown type")
            regions = F.transform(F.slice(o["run"], 2, F.size(o["run"])), lambda x: _region(x, o["kinds"], m["pages"]))
            return F.struct(o["type"].alias("type"), regions.alias("regions"), error.alias("rejected"))

        cut = lambda at, k: F.slice(m["marks"], at + 1, F.coalesce(F.get(m["places"], k + 1), F.size(m["marks"])) - at)
        return m.withField("all", F.transform(F.transform(m["places"], cut), thing))

    def told(m: Column) -> Column:
        why = lambda o, r, e: F.struct(o.cast("int").alias("object_no"), r.cast("int").alias("region_no"), e.alias("error"))
        zero, n = F.lit(0), F.size(m["marks"])
        head = F.array(why(zero, zero, F.when(m["head"].rlike(r"\S"), F.when(n == 0, "no markers").otherwise("text before the first marker"))))
        early = F.transform(F.slice(m["marks"], 1, F.coalesce(F.get(m["places"], zero), n)), lambda x, k: why(zero, k + 1, F.when(x["meta"].isNull(), "not JSON").otherwise("region before any object")))
        within = F.transform(m["all"], lambda o, i: F.when(o["rejected"].isNotNull(), F.array(why(i + 1, zero, o["rejected"]))).otherwise(F.transform(o["regions"], lambda r, k: why(i + 1, k + 1, r["rejected"]))))
        objects = F.transform(m["all"], lambda o: F.struct(o["type"].alias("type"), F.transform(o["regions"], lambda r: r.dropFields("rejected")).alias("regions")))
        return F.struct(objects.alias("objects"), F.filter(F.concat(head, early, F.flatten(within)), lambda w: w["error"].isNotNull()).alias("rejections"))

    return files.select("source", let(let(let(let(found, marked), placed), read), told).alias("_r")).select("source", "_r.objects", "_r.rejections")


def rejections(docs: DataFrame) -> DataFrame:
    """(source, object_no, region_no, error) of parsed() documents; the first of a source is what a strict reader stops at."""
    return docs.select("source", F.explode("rejections").alias("r")).select("source", "r.*")


def regions(docs: DataFrame, accepted: bool = True) -> DataFrame:
    """One row a region of parsed() documents, only of those that break no rule unless accepted is False."""
    kept = docs.where(F.size("rejections") == 0) if accepted else docs
    objects = kept.select("source", F.posexplode("objects").alias("o", "object"))
    each = objects.select("source", (F.col("o") + 1).alias("object_no"), F.col("object.type").alias("object_type"), F.posexplode("object.regions").alias("r", "region"))
    return each.select("source", "object_no", "object_type", (F.col("r") + 1).alias("region_no"), "region.*")


def serialized(docs: DataFrame, program: str = "") -> DataFrame:
    """(source, text): parsed() documents in canonical form, null for those that break a rule; program is put before markers' names.

    The message of an error is written for regions in that state only; reading what was written gives the same objects.
    """
    name = f"{program}:" if program else ""
    marker = lambda kind, meta: F.concat(F.lit(f"<!-- {name}"), kind, F.lit(" "), F.to_json(meta), F.lit(" -->"))

    def region(r: Column) -> Column:
        return F.concat(marker(r["kind"], r.dropFields("kind", "text")), F.when(r["text"] != "", F.concat(F.lit("\n"), r["text"])).otherwise(""))

    thing = lambda o: F.array_join(F.concat(F.array(marker(F.lit("object"), F.struct(o["type"].alias("type")))), F.transform(o["regions"], region)), "\n")
    whole = F.concat(F.regexp_replace(F.array_join(F.transform("objects", thing), "\n\n"), r"\s+\z", ""), F.when(F.size("objects") > 0, "\n").otherwise(""))
    return docs.select("source", F.when(F.size("rejections") == 0, whole).alias("text"))
