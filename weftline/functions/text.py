"""Text normalisation as column expressions; pandas UDFs only for what the JVM functions lack (NFKC, difflib)."""

from __future__ import annotations

import html
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.fixed import DOCUMENT_PREFIXES, LOOKALIKES, NO, NO_DOCUMENT, SIDECAR, YES


def _steps(x: Column, *steps: tuple[str, str]) -> Column:
    for pattern, put in steps:
        x = F.regexp_replace(x, pattern, put)
    return x


def clean_text(x: Column) -> Column:
    """Null to empty, no-break and zero-width spaces, line ends, runs of blanks, blank lines, then trimmed."""
    x = F.replace(F.replace(F.coalesce(x.cast("string"), F.lit("")), F.lit("\u00a0"), F.lit(" ")), F.lit("\u200b"), F.lit(""))
    return _steps(x, (r"\r\n?", "\n"), (r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n"), (r"(?U)^\s+|\s+\z", ""))


def inline_from(clean: Column) -> Column:
    """inline_text() of a text that clean_text() has been through."""
    return _steps(clean, (r"(?U)\s+", " "), (r"^ | \z", ""))


def inline_text(x: Column) -> Column:
    return inline_from(clean_text(x))


def casefold(x: Column) -> Column:
    """Lower case with the foldings that lower() leaves out for letters of European scripts."""
    return F.translate(F.replace(F.replace(F.lower(x), F.lit("ß"), F.lit("ss")), F.lit("ŉ"), F.lit("ʼn")), "ſςµ", "sσμ")


def comparison_from(inline: Column) -> Column:
    """comparison_text() of a text that inline_text() has been through."""
    return F.translate(casefold(inline), "ё–—«»\"", "е--")


def comparison_text(x: Column) -> Column:
    return comparison_from(inline_text(x))


@F.pandas_udf(T.StringType())
def nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def unescape(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else html.unescape(t))


def normalized_brand(x: Column) -> Column:
    return comparison_text(nfkc(inline_text(x)))


def brand_key(brand: Column, document: Column) -> Column:
    return F.concat(inline_text(brand), F.lit(" || "), inline_text(F.coalesce(F.nullif(document, F.lit("")), F.lit(NO_DOCUMENT))))


def normalized_brand_key(brand: Column, document: Column) -> Column:
    return F.concat(normalized_brand(brand), F.lit(" || "), comparison_text(F.coalesce(F.nullif(document, F.lit("")), F.lit(NO_DOCUMENT))))


def parse_equipment(x: Column) -> Column:
    """Three-valued mark: true, false, or null where the mark is empty or unknown."""
    return let(comparison_text(x), lambda t: F.when(t.isin(*YES), True).when(t.isin(*NO), False))


def equipment_mark(x: Column) -> Column:
    return F.when(x, "+").when(~x, "-").otherwise("")


def match_text(x: Column) -> Column:
    """Upper case with letters and digits that look alike made the same."""
    seen, same = LOOKALIKES
    return _steps(F.translate(F.upper(nfkc(x)), seen, same), (r"(?U)\s+", " "), (r"^ | \z", ""))


def compact(x: Column) -> Column:
    return F.regexp_replace(match_text(x), "[^0-9A-ZА-Я]+", "")


def places(text: str) -> dict[str, int]:
    """Bits of the places of each sign in a text."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def in_order(text: str, of: dict[str, int], size: int) -> int:
    """Length of the longest common subsequence of a text and one of `size` signs given by its places."""
    full = (1 << size) - 1
    left = full
    for c in text:
        if hit := left & of.get(c, 0):
            left = (left + hit | left - hit) & full
    return size - left.bit_count()


def likeness(query: str, target: str, least: float = 0.0, whole: bool = True) -> float:
    """Best ratio of the target with the query or with any part of it of about the target's length; both compact.

    Ratios below `least` may come back as 0. Without `whole`, the query is a part of a longer one and no span of its own.
    """
    if not query or not target:
        return 0.0
    if query == target or target in query:
        return 1.0 if whole and query == target else 0.9
    spans = [(0, len(query))] if whole else []
    for size in range(max(1, len(target) - 2), min(len(query), len(target) + 2) + 1):
        spans += [(at, at + size) for at in range(len(query) - size + 1)]
    # the signs that a ratio counts stand in order in both, so spans are tried by their longest common subsequence
    of, size = places(target), len(target)
    bounds = sorted(((2.0 * in_order(query[a:b], of, size) / (b - a + size), a, b) for a, b in spans), reverse=True)
    best = floor = max(0.0, least - 1e-9)
    matcher = SequenceMatcher(None, "", target)
    for bound, a, b in bounds:
        if bound <= best:
            break
        matcher.set_seq1(query[a:b])
        best = max(best, matcher.ratio())
    return best if best > floor else 0.0


@F.pandas_udf(T.DoubleType())
def similarity(query: pd.Series, target: pd.Series) -> pd.Series:
    """likeness() of compact texts; equal pairs of a batch are worked out once."""
    memo: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(query.fillna(""), target.fillna("")):
        if pair not in memo:
            memo[pair] = likeness(*pair)
        out.append(memo[pair])
    return pd.Series(out, dtype=float)


def approximate_tokens(x: Column) -> Column:
    """Rough token count: a tag counts a twelfth of its length, a word a quarter, any other sign one; each rounded up."""
    found = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"(?U)(<[^>]+>|\w+|[^\w\s])"), F.lit(1))
    cost = lambda p: F.when(F.startswith(p, F.lit("<")) & (F.length(p) > 1), F.ceil(F.length(p) / 12)).when(p.rlike(r"(?U)^\w+$"), F.ceil(F.length(p) / 4)).otherwise(F.lit(1)).cast("int")
    return F.aggregate(F.transform(found, cost), F.lit(0), lambda s, n: s + n)


def without_comments(x: Column) -> Column:
    return _steps(x, (r"(?s)<!--.*?-->", ""), (r"(?U)^\s+|\s+\z", ""))


def clean_markup(x: Column) -> Column:
    """Recognised text without Markdown images, image and layout tags, heading marks and trailing blanks of lines."""
    x = _steps(x, (r"!\[[^\]]*\]\([^)]*\)", ""), (r"(?i)<img\b[^>]*>", ""), (r"(?i)</?(?:div|p|span)\b[^>]*>", ""), (r"(?m)^\s{0,3}#{1,6}\s+", ""))
    return _steps(unescape(x), (r"(?m)[ \t]+$", ""), (r"(?U)^\s+|\s+\z", ""))


def document_prefix() -> str:
    """Alternation of document prefixes, longest first, blanks matching any white space."""
    longest = sorted(DOCUMENT_PREFIXES, key=lambda p: (-len(p), p))
    return "(?:" + "|".join(r"\s+".join(p.split()) for p in longest) + ")"


def let(x: Column, f) -> Column:
    """f(x) with x worked out once, however often f names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def cell_items(x: Column) -> Column:
    """Items of a cell: one a line, list marks dropped; a line with several document prefixes also parts at semicolons."""
    some = rf"(?iuU)\b{document_prefix()}\b"
    bare = lambda p: F.regexp_replace(p, r"^[ ;]+|[ ;]+\z", "")
    none = F.array().cast("array<string>")

    def parted(line: Column) -> Column:
        several = F.contains(line, F.lit(";")) & (F.regexp_count(line, F.lit(some)) > 1)
        return F.when(several, F.transform(F.split(line, ";"), bare)).otherwise(F.array(line))

    def of(clean: Column) -> Column:
        text = _steps(clean, (r"(?mU)^\s*(?:[•·▪◦*]|\d+[.)])\s*", ""), (r"(?U)\s+(?=\d+[.)]\s+)", "\n"))
        lines = F.filter(F.transform(F.split(text, r"\n"), bare), lambda p: p != "")
        parts = F.filter(F.flatten(F.transform(lines, parted)), lambda p: p != "")
        return F.when(clean == "", none).otherwise(let(parts, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(inline_text(text)))))

    return let(clean_text(x), of)


def brand_item(raw: Column, hint: Column | None = None) -> Column:
    """Struct of an item: brand, document (nullable), raw text and sorted review flags."""
    prefix, edge = document_prefix(), r"^[ ,;]+|[ ,;]+\z"
    linked, loose = (rf"(?isuU)^(.+?){gap}({prefix}.*)\z" for gap in (r"\s+по\s+", r"(?:,|\s)+"))
    tidy = lambda t: F.regexp_replace(inline_text(t), edge, "")

    def found(text: Column) -> Column:
        """How brand and document are told apart, and both."""
        take = lambda pattern: (F.regexp_extract(text, pattern, i) for i in (1, 2))
        parts = lambda how, brand, own: F.struct(F.lit(how).alias("how"), brand.alias("brand"), own.alias("own"))
        by = [parts(how, *map(tidy, take(pattern))) for how, pattern in (("linked", linked), ("loose", loose))]
        return F.when(text.rlike(linked), by[0]).when(text.rlike(loose), by[1]).otherwise(parts("none", text, F.lit(None).cast("string")))

    def item(text: Column, at: Column, hint: Column) -> Column:
        own, brand = at["own"], at["brand"]
        lacks = own.isNull() | (own == "")
        words = F.regexp_extract_all(text, F.lit("[0-9A-Za-zА-Яа-яЁё_-]+"), F.lit(0))
        flags = {
            "mixed_latin_cyrillic": F.exists(words, lambda w: w.rlike("[A-Za-z]") & w.rlike("[А-Яа-яЁё]")),
            "multiple_normdocs_in_item": F.regexp_count(text, F.lit(rf"(?iuU)\b{prefix}\b")) > 1,
            "normdoc_without_po": at["how"] == "loose",
            "normdoc_not_found": (at["how"] == "none") & hint.isNull(),
            "normdoc_from_separate_column": lacks & hint.isNotNull(),
            "normdoc_conflict_with_separate_column": ~lacks & hint.isNotNull() & (comparison_text(hint) != comparison_text(own)),
            "empty_brand": brand == "",
        }
        named = F.array_sort(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in flags.items()])))
        return F.struct(brand.alias("brand"), F.coalesce(F.nullif(own, F.lit("")), hint, own).alias("document"), text.alias("raw_item"), named.alias("flags"))

    hint = F.nullif(inline_text(hint), F.lit("")) if hint is not None else F.lit(None).cast("string")
    text = F.regexp_replace(inline_text(raw), r"^[ ;]+|[ ;]+\z", "")
    return let(text, lambda t: let(F.struct(found(t).alias("at"), hint.alias("hint")), lambda x: item(t, x["at"], x["hint"])))


def safe_path(x: Column) -> Column:
    """Whether a path is relative, without drive letter and without empty, `.` or `..` parts."""
    parts = F.split(F.replace(x, F.lit("\\"), F.lit("/")), "/")
    return F.coalesce(~F.exists(parts, lambda p: p.isin("", ".", "..") | p.contains(":")), F.lit(False))


def cell_value(x: Column) -> Column:
    """Kind of a cell literal: formula, json or text."""
    return F.when(F.startswith(x, F.lit("=")), "formula").when(F.try_parse_json(x).isNotNull(), "json").otherwise("text")


def asset_path(x: Column) -> Column:
    """A safe asset path with plain slashes; null for any other."""
    return F.when(safe_path(x), F.replace(x, F.lit("\\"), F.lit("/")))


def markdown_path(x: Column) -> Column:
    """Where the Markdown of a source file goes: its extension replaced."""
    return F.concat(F.regexp_replace(x, r"(?<=[^/\\])\.[^./\\]*$", ""), F.lit(".md"))


def sidecar_path(x: Column, suffix: str = SIDECAR) -> Column:
    """Where the sidecar of a source file goes: beside it, under its whole name."""
    return F.concat(x, F.lit(suffix))


def upload_name(x: Column) -> Column:
    """The last part of a name, signs that file systems refuse replaced; null if nothing or no PDF is left."""
    leaf = F.element_at(F.split(F.url_decode(F.regexp_replace(F.trim(x), r"\+", "%2B")), r"[/\\]"), -1)
    plain = F.regexp_replace(F.regexp_replace(leaf, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"[. ]+$", "")
    return F.when(F.lower(plain).rlike(r".\.pdf$"), plain)


def utc_now() -> Column:
    """This moment as ISO text in UTC."""
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def json_value(x: Column, kind: T.DataType) -> Column:
    """A cell's value as JSON tools write it: dates and times as ISO text, stretches of time in seconds, all else as text."""
    if isinstance(kind, T.DateType):
        return F.date_format(x, "yyyy-MM-dd")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.regexp_replace(F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")
    if isinstance(kind, T.DayTimeIntervalType):
        return (F.extract(F.lit("DAY"), x) * 86400 + F.extract(F.lit("HOUR"), x) * 3600 + F.extract(F.lit("MINUTE"), x) * 60 + F.extract(F.lit("SECOND"), x)).cast("double").cast("string")
    return x.cast("string")
