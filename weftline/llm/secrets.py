"""Secret scans: three base patterns, and a battery of randomness tests over every other token. DataFrame functions only.

A token's alphabet is inferred from its characters. Three statistics are compared with what ordinary text would give at that
length: Pearson's chi-squared for a uniform alphabet (text is far from uniform, and ever more clearly so with length), runs of
one character class (text changes class seldom) and lag-one serial correlation with runs about the alphabet's middle, which
veto sequences and patterns. Fisher's method joins the first two into one p-value of "ordinary text". A weighted
Benjamini-Hochberg step over the tokens of the whole corpus, with more weight for lengths at which the tests have power, holds
the share of false discoveries at RATE. Only a histogram of log p-values, of BINS rows at most, reaches the driver.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import stash

BASE = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
KINDS = (*BASE, "random")
LEAST_VALUE = 6
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
RATE = 0.01
BINS, STEP = 1200, 0.05

DIGIT, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: name: (full match, symbols, excess over a uniform alphabet in ordinary text, chance that ordinary text changes class)
ENCODINGS = {
    "digits": ("[0-9]+", DIGIT, 0.6, 1.0),
    "hex": ("[0-9a-f]+", DIGIT + "abcdef", 0.6, 0.15),
    "HEX": ("[0-9A-F]+", DIGIT + "ABCDEF", 0.6, 0.15),
    "lower": ("[a-z]+", LOWER, 0.73, 1.0),
    "upper": ("[A-Z]+", UPPER, 0.73, 1.0),
    "base32": ("[A-Z2-7]+", UPPER + "234567", 1.13, 0.15),
    "lower36": ("[a-z0-9]+", LOWER + DIGIT, 1.4, 0.15),
    "upper36": ("[A-Z0-9]+", UPPER + DIGIT, 1.4, 0.15),
    "alnum": ("[A-Za-z0-9]+", UPPER + LOWER + DIGIT, 3.1, 0.15),
    "base64": (".+", UPPER + LOWER + DIGIT + "+/_-", 3.5, 0.2),
}
VETO = 3.3


#: Matches whose offsets are added up one after another; longer lists go by blocks, so that the work stays in proportion.
RUN = 64


def _let(x: Column, f) -> Column:
    """f(x) with x worked out once, also where f uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _spans(text: Column, pattern: str, keep=None) -> Column:
    """Array of (start, end, match) of the leftmost non-overlapping matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(gaps.alias("gap"), found.alias("hit"))
    # of each match only its place and itself are carried on
    sized = F.transform(F.filter(zipped, lambda x: x["hit"].isNotNull()), lambda x: F.struct(F.length(x["gap"]).cast("long").alias("gap"), F.length(x["hit"]).cast("long").alias("n"), x["hit"].alias("hit")))
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint,hit:string>>)")

    def walk(part: Column, at: Column) -> Column:
        begin = lambda acc, x: acc["at"] + x["gap"]
        return F.aggregate(
            part,
            F.struct(at.cast("long").alias("at"), empty.alias("out")),
            lambda acc, x: F.struct(
                (begin(acc, x) + x["n"]).alias("at"),
                F.concat(acc["out"], F.array(F.struct(begin(acc, x).alias("start"), (begin(acc, x) + x["n"]).alias("end"), x["hit"].alias("hit")))).alias("out"),
            ),
            lambda acc: acc["out"],
        )

    def blocks(all_: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / RUN).cast("int")), lambda i: F.slice(all_, i * RUN + 1, RUN))
        none = F.expr("cast(array() as array<bigint>)")

        def placed(parts: Column) -> Column:
            length = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda s, x: s + x["gap"] + x["n"]))
            starts = F.aggregate(
                length, F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"]
            )
            return F.flatten(F.transform(F.arrays_zip(parts.alias("part"), starts.alias("at")), lambda b: walk(b["part"], b["at"])))

        return _let(cut, placed)

    walked = _let(sized, lambda all_: F.when(F.size(all_) <= RUN, walk(all_, F.lit(0))).otherwise(blocks(all_)))
    return walked if keep is None else F.filter(walked, keep)


def _tail(z: Column) -> Column:
    """Natural log of a close bound on P(Z <= z) for a standard normal Z."""
    a = F.abs(z)
    return F.when(z < 0, F.log(F.lit(0.5)) - 0.717 * a - 0.416 * a * a).otherwise(F.lit(0.0))


def _pick(values: dict[str, object]) -> Column:
    cases = [(F.col("encoding") == name, F.lit(v)) for name, v in values.items()]
    return reduce(lambda out, c: out.when(*c), cases[1:], F.when(*cases[0]))


def battery(tokens: DataFrame, token: str = "hit") -> DataFrame:
    """tokens plus encoding, n (symbols without padding) and log_p, the log of the combined p-value; 0 where a veto holds."""
    t = tokens.withColumn("symbols", F.regexp_replace(F.col(token), "=+$", ""))
    cases = [(F.col("symbols").rlike(f"^(?:{e[0]})$"), F.lit(name)) for name, e in ENCODINGS.items()]
    t = t.withColumn("encoding", reduce(lambda out, c: out.when(*c), cases[1:], F.when(*cases[0]))).withColumn("n", F.length("symbols"))
    t = t.withColumn("alphabet", _pick({k: e[1] for k, e in ENCODINGS.items()})).withColumn("m", F.length("alphabet").cast("double"))
    # written out here, else the optimizer would work these out again for each sign inside the lambdas below
    t = stash(t.withColumn("chars", F.filter(F.split("symbols", ""), lambda c: c != "")), "tokens")
    m, n = F.col("m"), F.col("n").cast("double")
    excess, change = _pick({k: e[2] for k, e in ENCODINGS.items()}), _pick({k: e[3] for k, e in ENCODINGS.items()})
    # chi-squared against the uniform alphabet, from the squared counts of the distinct symbols
    squares = F.aggregate(F.array_distinct("chars"), F.lit(0.0), lambda s, c: s + F.pow((F.length("symbols") - F.length(F.replace(F.col("symbols"), c, F.lit("")))).cast("double"), F.lit(2)))
    t = t.withColumn("chi", m / n * squares - n)
    text_chi = m - 1 + (n - 1) * excess
    z_text = (F.col("chi") - text_chi) / F.sqrt(2 * (m - 1) + 4 * (n - 1) * excess)
    z_even = (F.col("chi") - (m - 1)) / F.sqrt(2 * (m - 1))
    # runs of one class: 0 digit, 1 lower, 2 upper, 3 other
    kind = F.transform("chars", lambda c: F.when(c.between("0", "9"), 0).when(c.between("a", "z"), 1).when(c.between("A", "Z"), 2).otherwise(3))
    t = t.withColumn("class", kind).withColumn("code", F.transform("chars", lambda c: F.instr(F.col("alphabet"), c).cast("double")))
    head, rest = (lambda a: F.slice(a, 1, F.col("n") - 1)), (lambda a: F.slice(a, 2, F.col("n") - 1))
    t = t.withColumn("changes", F.size(F.filter(F.zip_with(head("class"), rest("class"), lambda a, b: a != b), lambda x: x)))
    z_runs = ((n - 1) * change - F.col("changes")) / F.sqrt(F.greatest((n - 1) * change * (1 - change), F.lit(1e-9)))
    # serial correlation and runs about the middle of the alphabet
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    t = t.withColumn("sum", total("code")).withColumn("sum2", total(F.transform("code", lambda x: x * x)))
    t = t.withColumn("lag", total(F.zip_with(head("code"), rest("code"), lambda a, b: a * b)))
    mean = F.col("sum") / n
    lag = F.col("lag") - mean * (2 * F.col("sum") - F.element_at("code", 1) - F.element_at("code", -1)) + (n - 1) * mean * mean
    serial = lag / F.greatest(F.col("sum2") - n * mean * mean, F.lit(1e-9))
    high = F.transform("code", lambda x: (x > (F.col("m") + 1) / 2).cast("int"))
    t = t.withColumn("high", high)
    n1 = F.aggregate("high", F.lit(0), lambda s, x: s + x).cast("double")
    t = t.withColumn("n1", n1).withColumn("n0", n - F.col("n1")).withColumn("serial", serial)
    runs = 1 + F.size(F.filter(F.zip_with(head("high"), rest("high"), lambda a, b: a != b), lambda x: x))
    both = 2 * F.col("n1") * F.col("n0")
    z_mid = (runs - (both / n + 1)) / F.sqrt(F.greatest(both * (both - n) / (n * n * F.greatest(n - 1, F.lit(1.0))), F.lit(1e-9)))
    veto = (F.abs(F.col("serial") * F.sqrt(n)) > VETO) | (F.col("n1") < 1) | (F.col("n0") < 1) | (F.abs(z_mid) > VETO) | (F.abs(z_even) > VETO + 1)
    fisher = -2 * (_tail(z_text) + F.when(change < 1, _tail(z_runs)).otherwise(F.lit(0.0)))
    log_p = F.when(change < 1, -fisher / 2 + F.log(1 + fisher / 2)).otherwise(-fisher / 2)
    return t.withColumn("log_p", F.when(veto, F.lit(0.0)).otherwise(F.least(log_p, F.lit(0.0)))).drop(
        "symbols", "alphabet", "chars", "chi", "m", "class", "code", "changes", "sum", "sum2", "lag", "high", "n1", "n0", "serial"
    )


#: Relative weight of a length: too short to tell, fair, long. Scaled to a mean of one over the corpus.
WEIGHTS = ((28, 0.5), (40, 1.0), (1 << 30, 2.0))


def _weight(n: Column) -> Column:
    return F.when(n < WEIGHTS[0][0], WEIGHTS[0][1]).when(n < WEIGHTS[1][0], WEIGHTS[1][1]).otherwise(WEIGHTS[2][1])


def threshold(scored: DataFrame, rate: float = RATE) -> float:
    """The weighted Benjamini-Hochberg bound: tokens with log_p - ln(weight) at or below it are discoveries."""
    w = _weight(F.col("n"))
    bin_ = F.least(F.floor(-(F.col("log_p") - F.log(w)) / STEP), F.lit(BINS)).cast("int")
    rows = scored.groupBy(bin_.alias("bin"), w.alias("w")).count().collect()  # at most 3 * (BINS + 30) rows
    total = sum(r["count"] for r in rows)
    if not total:
        return float("-inf")
    mean = sum(r["w"] * r["count"] for r in rows) / total
    counts: dict[int, int] = {}
    for r in rows:
        counts[r["bin"]] = counts.get(r["bin"], 0) + r["count"]
    below, best = 0, float("-inf")
    for b in sorted(counts, reverse=True):
        below += counts[b]
        # the largest weighted p-value in this bin is exp(-b * STEP) * mean
        if -b * STEP + math.log(mean) <= math.log(rate * below / total):
            best = -b * STEP
    return best


def scan(docs: DataFrame, text: str = "text", rate: float = RATE) -> DataFrame:
    """docs without text, with base (array of (start, no, end, kind)), n_assign, n_access, n_hex and spans (base and random).

    Offsets are code points, end exclusive; kinds in the order of KINDS. Random spans that touch a base span are left out.
    Null text counts as empty. Repeated rows give repeated results, an empty table none; columns of docs named as the results
    are replaced, any others stay as they are, whatever their names.
    """
    gone = {"base", "spans", "n_assign", "n_access", "n_hex"}
    others = [F.col(f"`{c}`") for c in docs.columns if c != text and c.lower() not in gone]
    kept = F.struct(*others) if others else F.lit(True)
    t = docs.select(kept.alias("doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("whole"))
    long_enough = lambda s: F.length(F.regexp_extract(s["hit"], BASE["assign"], 2)) >= LEAST_VALUE
    shape = lambda no, name: lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("no"), s["end"].alias("end"), F.lit(name).alias("kind"))
    base = F.array_sort(
        F.concat(
            F.transform(_spans(F.col("whole"), BASE["assign"], long_enough), shape(0, "assign")),
            F.transform(_spans(F.col("whole"), BASE["access"]), shape(1, "access")),
            F.transform(_spans(F.col("whole"), BASE["hex"]), shape(2, "hex")),
        )
    )
    seen = stash(t.select("doc", base.alias("base"), _spans(F.col("whole"), TOKEN).alias("token")).withColumn("row", F.monotonically_increasing_id()), "spans")
    scored = battery(seen.select("row", F.explode("token").alias("x")).select("row", "x.start", "x.end", "x.hit"))
    scored = stash(scored.select("row", "start", "end", "n", "log_p"), "scored")
    bound = threshold(scored, rate)
    found = (
        scored.where(F.col("log_p") - F.log(_weight(F.col("n"))) <= F.lit(bound))
        .groupBy("row")
        .agg(F.collect_list(F.struct("start", F.lit(3).alias("no"), "end", F.lit("random").alias("kind"))).alias("extra"))
    )
    apart = lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    extra = F.filter(F.coalesce("extra", F.expr("cast(array() as array<struct<start:bigint,no:int,end:bigint,kind:string>>)")), apart)
    count = lambda kind: F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long").alias(f"n_{kind}")
    told = seen.join(found, "row", "left")
    return told.select(*(["doc.*"] if others else []), "base", count("assign"), count("access"), count("hex"), F.array_sort(F.concat("base", extra)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
