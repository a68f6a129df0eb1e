"""Flags of runs: what they say, and lists of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.fixed import FLAG_MESSAGES, ROLES, UNRECOGNIZED, UNRECOGNIZED_MESSAGE

#: Flags and blockers that a report lists at the most.
LISTED = 500


def flag_message(category: Column) -> Column:
    """What a flag says; a category without a message says itself."""
    known = F.create_map(*[F.lit(x) for kv in FLAG_MESSAGES.items() for x in kv])
    return F.when(F.startswith(category, F.lit(UNRECOGNIZED)), UNRECOGNIZED_MESSAGE).otherwise(F.coalesce(F.try_element_at(known, category), category))


def role_place(role: Column) -> Column:
    """Place of a role among the roles of a row."""
    return F.array_position(F.array(*map(F.lit, ROLES)), role)


def listed_flags(flags: DataFrame, categories: list[str] | None = None, row_id: str | None = None, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """The first flags that meet the filters, up to a limit from 1 to LISTED, and how many there are of each category."""
    if categories:
        flags = flags.where(F.col("category").isin(categories))
    if row_id is not None:
        flags = flags.where(F.col("row_id") == row_id)
    return flags.orderBy("flag_id").limit(max(1, min(int(limit), LISTED))), flags.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
