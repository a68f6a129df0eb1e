"""The corpus pipeline: documents to packed training sequences, stage by stage.

Each stage works on all that its predecessor kept and is written as Parquet before the next one starts. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import linededup, minhash, mixing, packing, quality
from weftline.llm.common import fresh, read, scratch, stash, unstash
from weftline.llm.queries import tokenizer_path

#: SQL can express none of the stages as a whole; tests hold each against a plain version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules accept; null, empty and short texts are rejected, repeated rows get one verdict."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the units that recur across documents; n_chars follows the text.

    A document that is mostly one earlier document's text is left whole: the next stage decides on copies, and would not know
    them without what they share. Null texts and ids stay as they are; rows that repeat an id are one document.
    """
    count = fresh(docs, "n_dropped")
    out = linededup.dedup_lines(docs, spare_copies=True, count_col=count)
    told = F.when(F.col(count) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars") if "n_chars" in docs.columns else None
    return out.select(*[told if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; null and empty texts and null ids are kept."""
    return minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rates say: the good domain in full, the toxic one's weight is zero. Rows are decided
    one by one, repeated ones alike; null and empty texts have no tokens and keep the rate that their features give them."""
    return mixing.mix(docs, read(spark, sf_dir, "labels"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of all documents in sequences of 4096 tokens; null text is one piece of the end id alone."""
    return packing.pack(docs.select("doc_id", "text"), tokenizer_path()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        # what a stage stashed on its way goes when its result is written, and the result when the next one is
        with scratch(spark) as made:
            docs = stash(stage(spark, docs, sf_dir), name)
            made.pop()
        if before is not None:
            unstash(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
