"""Dirty cell text to catalog pairs: logical parts, brand x document expansion, resolution with a margin.

What an analysis asks of the catalog are three kinds of questions: whether a text is a pair, which documents it names, and which
entries a brand is like. A small catalog (SHIPPED entries at most, counted first) is shipped to the tasks and answers at once. For
a larger one the questions of all texts are gathered, answered by joins, and the texts gone through again with the answers, until
none is left; both ways give the same results.
"""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.fixed import CONJUNCTION, LINK, LOOKALIKES, RAW_DOCUMENT
from weftline.functions.text import compact, likeness, match_text
from weftline.operators.catalog import DOCUMENT_LEAST, DOCUMENT_NEAR, NEAR, PLAUSIBLE, SURE, alike, documents_in
from weftline.sources.scratch import settled

#: Entries up to which a catalog is shipped: some MB.
SHIPPED = 20_000

_link = re.compile(LINK, re.I)
_document = re.compile(RAW_DOCUMENT, re.I)
_open = re.compile(rf"^\s*-{LINK}(.+?)\s*$", re.I)
_same = str.maketrans(*LOOKALIKES)


def same_text(x: str) -> str:
    """The rule of functions.text.match_text for use inside a task."""
    return " ".join(unicodedata.normalize("NFKC", x).upper().translate(_same).split())


def bare(x: str) -> str:
    return re.sub("[^0-9A-ZА-Я]+", "", same_text(x))


def cuts(text: str, marks: str) -> list[tuple[int, int]]:
    """Spans outside parentheses that match one of the marks: `;`, or `,` with line ends and the conjunction as a word."""
    wanted = re.compile(r"[()]|" + marks, re.I)
    depth, out = 0, []
    for m in wanted.finditer(text):
        if m[0] in "()":
            depth = max(0, depth + (1 if m[0] == "(" else -1))
        elif not depth:
            out.append(m.span())
    return out


HARD, SOFT = ";", rf",|[\r\n]+|(?<![^\W_]){CONJUNCTION}(?![^\W_])"


def pieces(text: str, spans: list[tuple[int, int]]) -> list[str]:
    ends = [0, *(b for _, b in spans)], [*(a for a, _ in spans), len(text)]
    return [p for p in (text[a:b].strip() for a, b in zip(*ends)) if p]


def groups(text: str) -> list[str]:
    return pieces(text, cuts(text, HARD))


def clauses(text: str) -> list[str]:
    """Parts of `A по X и B по Y`: a soft mark parts where a pair stands on each side of it."""
    spans, kept, start = cuts(text, SOFT), [], 0
    for i, (a, b) in enumerate(spans):
        end = spans[i + 1][0] if i + 1 < len(spans) else len(text)
        if _link.search(text, start, a) and _link.search(text[b:end]):
            kept.append((a, b))
            start = b
    return pieces(text, kept)


def with_suffix(brands: list[str]) -> list[str]:
    """The last brand's qualifier in parentheses also holds for those before that have none."""
    at = brands[-1].find("(") if len(brands) > 1 else -1
    return [b if at <= 0 or "(" in b else f"{b} {brands[-1][at:].strip()}" for b in brands]


class Unanswered(Exception):
    """A question (kind, key) that has no answer yet."""


class Analyst:
    """Analyses of texts by three questions to a catalog, which subclasses answer."""

    def pair(self, brand: str, document: str) -> tuple[str, str] | None:
        """The entry of the keys brand and document."""
        raise NotImplementedError

    def named(self, text: str) -> list[str]:
        """Documents in a text: those that stand in it, by place; else those nearly as like it as the most like one."""
        raise NotImplementedError

    def near(self, brand: str, documents: list[str]) -> tuple[float, list[tuple[str, str]]]:
        """The best likeness of a compact brand to the entries of the documents, or to all if there are none of these, and two
        entries at most of those nearly as like it."""
        raise NotImplementedError

    def exact(self, text: str) -> tuple[str, str] | None:
        two = _link.split(text.strip(), maxsplit=1)
        return self.pair(*(same_text(x.strip()) for x in two)) if len(two) == 2 else None

    def brand_of(self, text: str, documents: list[str]) -> str:
        rest = same_text(text)
        for d in documents:
            rest = rest.replace(same_text(d), " ")
        if m := _document.search(rest):
            rest = rest[: m.start()]
        return re.sub(r"\s+ПО\s*$", "", rest).strip(" -")

    def group_fragments(self, group: str, shared: list[str]) -> list[tuple[str, bool]]:
        """(fragment, is a catalog pair as it stands) of a part between hard marks."""
        if self.exact(group):
            return [(group, True)]
        out = []
        for clause in clauses(group) if len(_link.findall(group)) > 1 else [group]:
            documents = [] if _open.match(clause) else self.named(clause) or shared
            brands = self._listed(self.brand_of(clause, documents))
            if _open.match(clause) or not brands:
                out.append(clause)
            elif documents:
                out += [f"{b} по {d}" for b in brands for d in documents]
            else:
                own = _link.split(clause, maxsplit=1)
                if len(own) != 2 and (m := _document.search(clause)):
                    own = [clause[: m.start()], clause[m.start() :]]
                if len(own) == 2 and all(x.strip() for x in own):
                    out += [f"{b} по {own[1].strip()}" for b in self._listed(own[0])]
                else:
                    out += brands
        return [(f, False) for f in out]

    @staticmethod
    def _listed(text: str) -> list[str]:
        brands = [b for b in (p.strip(" -") for p in pieces(text, cuts(text, SOFT))) if b]
        return with_suffix(brands) if brands else []

    def proposal(self, fragment: str, documents: list[str]) -> tuple[str, str] | None:
        """A pair that a fragment states and the catalog lacks."""
        own = _link.split(fragment.strip(), maxsplit=1)
        if len(own) != 2:
            if len(documents) == 1:
                at = fragment.lower().find(documents[0].lower())
                own = [fragment[:at] if at >= 0 else fragment, documents[0]]
            elif m := _document.search(fragment):
                own = [fragment[: m.start()], fragment[m.start() :]]
            else:
                return None
        brand, document = re.sub(r"(?i)\s+по\s*$", "", own[0]).strip(" ,;-"), own[1].strip(" ,;-")
        stated = brand and document and not self.pair(same_text(brand), same_text(document))
        return (brand, document) if stated else None

    def item(self, fragment: str, shared: list[str]) -> tuple | None:
        """(brand, document, value, resolved, proposal) of a fragment; None for a document that stands alone."""
        if m := _open.match(fragment):
            found = self.named(m[1])
            document = found[0] if len(found) == 1 else m[1].strip() or "-"
            return "-", document, f"- по {document}", False, None
        local = self.named(fragment)
        documents = local or shared
        brand = self.brand_of(fragment, documents)
        if local and not bare(brand):
            return None
        best, near = self.near(bare(brand), documents)
        if best >= SURE and len(near) == 1:
            return *near[0], " по ".join(near[0]), True, None
        document = documents[0] if len(documents) == 1 else "-"
        return "-", document, f"- по {document}", False, self.proposal(fragment, documents)

    def analyze(self, raw: str) -> tuple[str, bool, list[tuple]]:
        """Normalised text, whether all of it was resolved, and its items; Unanswered with all questions that are open."""
        raw, open_ = raw.strip(), set()
        shared = self.named(raw)
        shared = shared if len(shared) == 1 else []
        own, items = groups(raw), []

        def ask(f, *args):
            try:
                return f(*args)
            except Unanswered as e:
                open_.update(e.args[0])

        for fragment, exact in [x for g in own for x in ask(self.group_fragments, g, shared) or ()]:
            if exact:
                brand, document = (x.strip() for x in _link.split(fragment, maxsplit=1))
                items.append((brand, document, fragment, True, None))
            elif (got := ask(self.item, fragment, shared)) is not None:
                items.append(got)
        kept = [ask(self.exact, g) for g in own]
        if open_:
            raise Unanswered(open_)
        if not items:
            document = shared[0] if shared else "-"
            items = [("-", document, f"- по {document}", False, None)]
        whole = own and len(items) == len(own) and all(kept)
        return raw if whole else "; ".join(i[2] for i in items), all(i[3] for i in items), items


class Catalog(Analyst):
    """Entries (brand, document) in order, the first of each key."""

    def __init__(self, entries: list[tuple[str, str]]):
        self.pairs: dict[tuple[str, str], tuple[str, str]] = {}
        for e in entries:
            self.pairs.setdefault(tuple(map(same_text, e)), e)
        self.documents: dict[str, str] = {}
        self.by_document: dict[str, list[tuple[str, str]]] = {}
        for (_, k), e in self.pairs.items():
            self.documents.setdefault(k, e[1])
            self.by_document.setdefault(k, []).append(e)

    def pair(self, brand: str, document: str) -> tuple[str, str] | None:
        return self.pairs.get((brand, document))

    def named(self, text: str) -> list[str]:
        whole = same_text(text)
        found = []
        for key, name in self.documents.items():
            if key in whole and (m := re.search(rf"(?<![0-9A-ZА-Я./-]){re.escape(key)}(?![0-9A-ZА-Я./-])", whole)):
                found.append((m.start(), name))
        if found:
            return [name for _, name in sorted(found)]
        scored = sorted(((-likeness(bare(text), bare(name)), name) for name in self.documents.values()))
        best = -scored[0][0] if scored else 0.0
        return [name for s, name in scored if best >= DOCUMENT_LEAST and -s >= max(DOCUMENT_LEAST, best - DOCUMENT_NEAR)]

    def near(self, brand: str, documents: list[str]) -> tuple[float, list[tuple[str, str]]]:
        options = [e for d in dict.fromkeys(map(same_text, documents)) for e in self.by_document.get(d, ())] or list(self.pairs.values())
        scored = [(likeness(brand, bare(e[0])), e) for e in options]
        best = max((s for s, _ in scored), default=0.0)
        return best, [e for s, e in scored if s >= max(PLAUSIBLE, best - NEAR)][:2]

    def strict(self, text: str) -> list[tuple[str, str]] | None:
        """Entries of a normalised cell; None if any part isn't in the catalog."""
        found = [self.exact(g) for g in stated(text)]
        return None if None in found else found


class Answers(Analyst):
    """Answers as far as there are any, by (kind, key)."""

    def __init__(self, known: dict[str, str]):
        self.known = known

    def _get(self, kind: str, *key: str):
        key = json.dumps([kind, *key], ensure_ascii=False)
        if key not in self.known:
            raise Unanswered({key})
        return json.loads(self.known[key])

    def pair(self, brand: str, document: str) -> tuple[str, str] | None:
        got = self._get("pair", brand, document)
        return tuple(got) if got else None

    def named(self, text: str) -> list[str]:
        return self._get("named", text)

    def near(self, brand: str, documents: list[str]) -> tuple[float, list[tuple[str, str]]]:
        best, entries = self._get("near", brand, *sorted(set(map(same_text, documents))))
        return best, [tuple(e) for e in entries]


def stated(text: str) -> list[str]:
    """Parts of a normalised cell, comments left out."""
    return groups(re.sub(r"(?s)<!--.*?-->", "", text).strip())


def collected(entries: DataFrame) -> Catalog:
    """The catalog of entries (brand, document, order) in memory."""
    return Catalog([(r.brand, r.document) for r in entries.orderBy("order").collect()])


def book(entries: DataFrame) -> DataFrame:
    """(k_brand, k_document, brand, document): the first entry of each key."""
    keyed = entries.select(match_text(F.col("brand")).alias("k_brand"), match_text(F.col("document")).alias("k_document"), F.struct("order", "brand", "document").alias("x"))
    return keyed.groupBy("k_brand", "k_document").agg(F.min("x").alias("x")).select("k_brand", "k_document", "x.brand", "x.document", "x.order")


def answers(asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """(question, answer) of distinct questions, by joins with the catalog of book()."""
    q = asked.select("question", F.from_json("question", "array<string>").alias("a")).withColumn("kind", F.element_at("a", 1))
    # pairs
    p = q.where("kind = 'pair'").select("question", F.element_at("a", 2).alias("k_brand"), F.element_at("a", 3).alias("k_document"))
    p = p.join(pairs, ["k_brand", "k_document"], "left").select("question", F.when(F.col("brand").isNull(), "null").otherwise(F.to_json(F.array("brand", "document"))).alias("answer"))
    # documents
    documents = pairs.groupBy("k_document").agg(F.min_by("document", "order").alias("document"))
    n = settled(q.where("kind = 'named'").select("question", F.element_at("a", 2).alias("text")))
    stand = documents_in(n, documents, "text", "document").groupBy("text").agg(F.array_sort(F.collect_list(F.struct("at", "document"))).alias("x"))
    stand = stand.select("text", F.col("x.document").alias("names"))
    rest = n.join(stand, "text", "left_anti").withColumn("q", compact(F.col("text")))
    d = documents.select("document", compact(F.col("document")).alias("e"))
    like = rest.join(alike(rest, "q", d, "e", DOCUMENT_LEAST), "q").join(d, "e")
    best = like.groupBy("text").agg(F.max("score").alias("best"))
    like = like.join(best, "text").where(F.col("score") >= F.col("best") - DOCUMENT_NEAR).groupBy("text").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "document"))).alias("x"))
    names = stand.unionByName(like.select("text", F.col("x.document").alias("names")))
    n = n.join(names, "text", "left").select("question", F.to_json(F.coalesce("names", F.array().cast("array<string>"))).alias("answer"))
    # brands
    b = q.where("kind = 'near'").select("question", F.element_at("a", 2).alias("q"), F.slice("a", 3, 1 << 20).alias("of"))
    e = pairs.withColumn("e", compact(F.col("brand")))
    own = b.select("question", "q", F.explode("of").alias("k_document")).join(e, "k_document").select("question", "q", "e", "brand", "document")
    own = own.where((F.length("q") > 0) & (F.length("e") > 0))
    known = b.select("question", F.explode("of").alias("k_document")).join(documents, "k_document", "left_semi").select("question").distinct()
    any_ = b.join(known, "question", "left_anti")
    within = own.join(alike_pairs(own.select("q", "e").distinct(), PLAUSIBLE), ["q", "e"]).select("question", "brand", "document", "score")
    every = any_.join(alike(any_, "q", e, "e", PLAUSIBLE), "q").join(e.select("e", "brand", "document"), "e").select("question", "brand", "document", "score")
    scored = within.unionByName(every)
    top = scored.groupBy("question").agg(F.max("score").alias("best"))
    close = scored.join(top, "question").where(F.col("score") >= F.greatest(F.lit(PLAUSIBLE), F.col("best") - NEAR))
    # two are as good as more: the least and the greatest
    ends = close.groupBy("question").agg(F.max("best").alias("best"), F.array_distinct(F.array(F.min(F.array("brand", "document")), F.max(F.array("brand", "document")))).alias("x"))
    shown = F.concat(F.lit("["), F.coalesce(F.col("best"), F.lit(0.0)).cast("string"), F.lit(", "), F.to_json(F.coalesce("x", F.array().cast("array<array<string>>"))), F.lit("]"))
    b = b.select("question").join(ends, "question", "left").select("question", shown.alias("answer"))
    return p.unionByName(n).unionByName(b)


def alike_pairs(pairs: DataFrame, least: float) -> DataFrame:
    """pairs (q, e) of compact texts with their likeness as score, where it is `least` or more."""

    @F.pandas_udf("double")
    def score(q: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([likeness(a, b) for a, b in zip(q, e)], dtype=float)

    return pairs.withColumn("score", score("q", "e")).where(F.col("score") >= least)


ITEM = "struct<brand:string,document:string,value:string,resolved:boolean,proposal:struct<brand:string,document:string>>"
NORMALISED = f"text string, resolved boolean, items array<{ITEM}>"


def normalize(cells: DataFrame, entries: DataFrame, text: str, shipped: int = SHIPPED) -> DataFrame:
    """cells plus `normal`, the analysis of text against the catalog; null for null and blank texts. `shipped` bounds the
    catalog that is sent to the tasks; a larger one is joined to, with the same results."""
    if entries.count() > shipped:
        return _by_rounds(cells, entries, text)
    held = collected(entries)

    @F.pandas_udf(NORMALISED)
    def run(values: pd.Series) -> pd.DataFrame:
        memo: dict[str, tuple] = {}
        rows = []
        for v in values:
            if v is None or not v.strip():
                rows.append((None, None, None))
                continue
            if v not in memo:
                memo[v] = held.analyze(v)
            rows.append(memo[v])
        return pd.DataFrame(rows, columns=["text", "resolved", "items"])

    return cells.withColumn("normal", run(F.col(text)))


def _by_rounds(cells: DataFrame, entries: DataFrame, text: str) -> DataFrame:
    """normalize() by joins: each round answers what the texts that are left ask. An analysis asks for documents, then for
    pairs and brands of its parts, so there are a handful of rounds."""
    pairs = settled(book(entries))

    @F.pandas_udf(f"text string, resolved boolean, items array<{ITEM}>, open array<string>")
    def run(values: pd.Series, known: pd.Series) -> pd.DataFrame:
        rows = []
        for v, k in zip(values, known):
            try:
                rows.append((*Answers(dict(k) if k is not None else {}).analyze(v), None))
            except Unanswered as e:
                rows.append((None, None, None, sorted(e.args[0])))
        return pd.DataFrame(rows, columns=["text", "resolved", "items", "open"])

    left = cells.select(F.col(text).alias("raw")).where(F.trim("raw") != "").distinct().withColumn("known", F.lit(None).cast("map<string,string>"))
    done = []
    while True:
        went = settled(left.withColumn("r", run("raw", "known")))
        done.append(went.where("r.open is null").select("raw", F.struct("r.text", "r.resolved", "r.items").alias("normal")))
        rest = went.where("r.open is not null")
        if rest.isEmpty():
            break
        asked = rest.select("raw", F.explode("r.open").alias("question"))
        told = asked.join(answers(asked.select("question").distinct(), pairs), "question").groupBy("raw").agg(F.map_from_entries(F.collect_list(F.struct("question", "answer"))).alias("new"))
        left = settled(rest.join(told, "raw").select("raw", F.when(F.col("known").isNull(), F.col("new")).otherwise(F.map_concat("known", "new")).alias("known")))
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    return cells.join(found.withColumnRenamed("raw", "_raw"), F.col(text) == F.col("_raw"), "left").drop("_raw")


def strict(cells: DataFrame, entries: DataFrame, text: str) -> DataFrame:
    """cells plus `pairs`, their catalog entries as `brand по document`; null where a part isn't in the catalog. The parts of
    distinct texts are joined to the catalog by key, whatever its size."""

    @F.pandas_udf("array<struct<k_brand:string,k_document:string>>")
    def parts(values: pd.Series) -> pd.Series:
        two = lambda g: [same_text(x.strip()) for x in _link.split(g.strip(), maxsplit=1)]
        return pd.Series([[(k if len(k := two(g)) == 2 else (None, None)) for g in stated(v or "")] for v in values])

    own = cells.select(F.coalesce(F.col(text), F.lit("")).alias("_text")).distinct().withColumn("_parts", parts("_text"))
    each = own.select("_text", F.posexplode_outer("_parts").alias("at", "k")).select("_text", "at", "k.*")
    hit = each.join(book(entries).select("k_brand", "k_document", F.concat_ws(" по ", "brand", "document").alias("pair")), ["k_brand", "k_document"], "left")
    got = hit.groupBy("_text").agg(
        F.count_if(F.col("at").isNotNull() & F.col("pair").isNull()).alias("lacking"), F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "pair")))).alias("x")
    )
    got = got.select("_text", F.when(F.col("lacking") == 0, F.col("x.pair")).alias("pairs"))
    return cells.join(got, F.coalesce(F.col(text), F.lit("")) == F.col("_text"), "left").drop("_text")
