"""What an ordered stream carries from one micro-batch to the next: values filled down and the last number given out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from weftline.operators.rows import even_buckets, fill_down, serial
from weftline.sources.scratch import settled


class Carried:
    """A transformation for run_stream: each null of `fill` takes the last value above it, over batches too, and rows that `keep`
    is true of are numbered 1, 2, 3 ... over all batches as `name`; others are dropped once they have been filled from.

    order: a number that rises within each batch; batches follow one another as they come. Where `by` (a table, a source)
    changes, nothing is carried over. The state is one row a batch, written below `path` under the batch's number before the batch
    is staged: batch n reads that of n - 1 and nothing later, so a batch that is replayed after a failure at any point gets
    the same values and numbers again. A batch's rows are handled in ranges of the order, so that a source with most of them
    fills no task. `path` belongs to one stream's checkpoint. Null order or by: such rows stand first in their batch, and share
    values among themselves only. Empty batches hand the state on.
    """

    def __init__(self, path: str, fill: list[str], order: str, name: str, keep: Column | None = None, by: str | None = None):
        self.path, self.fill, self.order, self.name, self.keep, self.by = path, fill, order, name, keep, by

    def __call__(self, frame: DataFrame, number: int) -> DataFrame:
        before = self.state(frame, number - 1)
        by = F.col(self.by) if self.by else F.lit("")
        # a value goes with the source that it stands in
        tagged = {c: F.when(F.col(c).isNotNull(), F.struct(by.alias("by"), F.col(c).alias("value"))) for c in self.fill}
        told = settled(frame.withColumns(tagged)) if self.fill else settled(frame)
        filled = fill_down(told, self.fill, [self.order], even_buckets(told, self.order)) if self.fill else told
        if before is not None:
            filled = filled.withColumns({c: F.coalesce(c, self._literal(told, c, before[c])) for c in self.fill})
        got = filled.withColumns({c: F.when(F.col(f"{c}.by").eqNullSafe(by), F.col(f"{c}.value")) for c in self.fill})
        kept = settled(got.where(self.keep) if self.keep is not None else got)
        first = before["n_rows"] if before is not None else 0
        out = serial(kept, self.name, [self.order], even_buckets(kept, self.order)).withColumn(self.name, F.col(self.name) + first)
        self._write(told, kept, before, first, number)
        return out

    def state(self, frame: DataFrame, number: int) -> Row | None:
        """What the stream had carried after a batch; None before the first."""
        return frame.sparkSession.read.parquet(f"{self.path}/{number:09}").first() if number >= 0 else None

    def _literal(self, told: DataFrame, c: str, value: Row | None) -> Column:
        kind = told.schema[c].dataType
        return F.lit(None).cast(kind) if value is None else F.struct(*[F.lit(value[f.name]).cast(f.dataType).alias(f.name) for f in kind.fields])

    def _write(self, told: DataFrame, kept: DataFrame, before: Row | None, first: int, number: int) -> None:
        last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(self.order))).alias(c) for c in self.fill]
        ends = told.agg(*last, F.count(F.lit(1)).alias("_seen")).drop("_seen")
        if before is not None:
            ends = ends.withColumns({c: F.coalesce(c, self._literal(told, c, before[c])) for c in self.fill})
        n = kept.count() + first
        ends.withColumn("n_rows", F.lit(n).cast("long")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{number:09}")
