"""Best-fit packing: the plan is made from the length histogram; documents then take planned slots by rank within length.

Tokenising is the only Python step. The histogram has at most `capacity` lengths whatever the input size, so planning on the
driver is bounded; the slots are unfolded on the executors and joined to the pieces on (length, rank), an equi-join on unique
keys that no hot length can skew.
"""

from __future__ import annotations

import bisect
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftline.llm.common import bounded_batches, map_batches, memory_of, session_of, stash

CAPACITY = 4096
END_ID = 1
#: Distinct chunks of text whose ids a Python worker remembers.
MEMO = 400_000
#: Bytes of texts whose new chunks are encoded at once, and chunks of one call.
TOGETHER, LOT = 1 << 20, 2000
#: Bytes above which a chunk isn't remembered.
LONG_CHUNK = 64
#: Documents of one length that are ranked in one task, about, so that one hot length isn't sorted in one.
PART_ROWS = 1_000_000
#: Slots that one task unfolds from a plan row at most, and rows that slots are cut to on the driver, about: beyond, rows hold more.
SLOTS_A_ROW, MOST_SLOT_ROWS = 100_000, 100_000

PIECES = T.StructType(
    [
        T.StructField("piece", T.IntegerType(), False),
        T.StructField("start", T.LongType(), False),
        T.StructField("length", T.LongType(), False),
        T.StructField("ids_crc32", T.LongType(), False),
    ]
)


def _encoder(path: str, plain: bool):
    """text bytes -> little-endian ids. Only for tokenizers that drop white space, never look across it and lower-case: each
    chunk between ASCII white space is encoded once a worker and remembered. Control strings of the tokenizer in a text get
    their own ids, as its file says, or with `plain` those of ordinary text."""
    import os

    memos = memory_of("packing")
    if (path, plain) not in memos:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok, bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        tok.encode_special_tokens = plain
        # a control string parts a text before anything else looks at it, so chunks joined by one are encoded as if alone
        marks = [(i, t.content.encode()) for i, t in sorted(bare.get_added_tokens_decoder().items()) if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)]
        memos[path, plain] = tok, bare, next((m for m in marks if m[1].startswith(b"<|") and len(m[1].split()) == 1), None), {}
    tok, bare, mark, memo = memos[path, plain]

    def encoded(chunks: list[bytes]) -> dict[bytes, bytes]:
        alone = [c for c in chunks if mark is None or b"<|" in c]
        out = dict(zip(alone, [array("I", e.ids).tobytes() for e in tok.encode_batch_fast([c.decode() for c in alone], add_special_tokens=False)]))
        rest = [c for c in chunks if c not in out] if alone else chunks
        lots = [rest[i : i + LOT] for i in range(0, len(rest), LOT)]
        for lot, e in zip(lots, bare.encode_batch_fast([mark[1].join(lot).decode() for lot in lots], add_special_tokens=False) if lots else []):
            ids = np.array(e.ids, "<u4")
            ends = (4 * np.flatnonzero(ids == mark[0])).tolist()
            raw = ids.tobytes()
            out.update(zip(lot, [raw[i:j] for i, j in zip([0, *(x + 4 for x in ends)], [*ends, len(raw)])]))
        return out

    def chunks_of(text: bytes) -> list[bytes]:
        # lower-casing ASCII first changes nothing where no mark could be composed with a letter and no control string be made
        return (text if b"\xcc" in text or b"<|" in text else text.lower()).split()

    def encode(texts: list[bytes]) -> Iterator[bytes]:
        at = 0
        while at < len(texts):
            size, group = 0, []
            while at < len(texts) and (not group or size + len(texts[at]) <= TOGETHER):
                size += len(texts[at])
                group.append(chunks_of(texts[at]))
                at += 1
            known = [list(map(memo.get, chunks)) for chunks in group]
            new = encoded(list({c for chunks, ids in zip(group, known) if None in ids for c, x in zip(chunks, ids) if x is None}))
            for chunks, ids in zip(group, known):
                yield b"".join([new[c] if x is None else x for c, x in zip(chunks, ids)] if None in ids else ids)
            # by the time that it is full the frequent chunks are there; later ones are encoded where they occur
            if len(memo) < MEMO:
                memo.update((c, x) for c, x in new.items() if len(c) <= LONG_CHUNK)

    return encode


def _pieces_of(ids: bytes, capacity: int) -> tuple[list[int], list[int], list[int], list[int]]:
    n, step = len(ids) // 4, capacity
    starts = list(range(0, n, step))
    lengths = [min(step, n - s) for s in starts]
    view = memoryview(ids)
    return list(range(len(starts))), starts, lengths, [zlib.crc32(view[4 * s : 4 * (s + k)]) for s, k in zip(starts, lengths)]


def pieces(docs: DataFrame, tokenizer_path: str, text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False, plain: bool = False) -> DataFrame:
    """docs without text, plus one row per piece of at most `capacity` ids. Null text counts as empty: one piece holding end_id."""
    spark = session_of(docs)
    bounded_batches(spark)
    names = [c for c in docs.columns if c != text]
    extra = [*PIECES.fields, *([T.StructField("ids", T.BinaryType(), False)] if keep_ids else [])]
    schema = T.StructType([*docs.select(*[f"`{c}`" for c in names]).schema.fields, *extra])
    tail = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path, plain)
        for batch in batches:
            texts = [x or b"" for x in batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()]
            rows, cols, blobs = [], ([], [], [], []), []
            for i, ids in enumerate(encode(texts)):
                ids += tail
                got = _pieces_of(ids, capacity)
                rows.extend([i] * len(got[0]))
                for a, b in zip(cols, got):
                    a.extend(b)
                if keep_ids:
                    blobs.extend(ids[4 * s : 4 * (s + n)] for s, n in zip(got[1], got[2]))
            at = pa.array(rows, pa.int64())
            out = [batch.column(batch.schema.get_field_index(c)).take(at) for c in names]
            out += [pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])]
            if keep_ids:
                out.append(pa.array(blobs, pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names=[*names, *(f.name for f in extra)])

    return map_batches(docs, run, schema, "packing")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best fit over counts, longest first: (length, first rank, count, first sequence, offset) per run of equal placements.

    Sequences with the same room are one run of numbers, so a step places as many documents as the shorter of the two runs
    has. The number of rows is bounded by the lengths and the runs that they split, not by the documents.
    """
    rooms: list[int] = []  # sorted rooms that have runs
    runs: dict[int, list[tuple[int, int]]] = {}
    out, fresh_at = [], 0

    def give(room: int, first: int, n: int) -> None:
        if room <= 0 or n <= 0:
            return
        if room not in runs:
            bisect.insort(rooms, room)
            runs[room] = []
        runs[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room]
                    rooms.pop(at)
                k = min(n, left)
                out.append((length, rank, k, first, capacity - room))
                give(room - length, first, k)
                give(room, first + k, n - k)
                rank, left = rank + k, left - k
                continue
            each = capacity // length
            full, rest = divmod(left, each)
            for shelf in range(each):
                k = full + (shelf < rest)
                if k:
                    out.append((length, rank, k, fresh_at, shelf * length))
                    rank += k
            if full:
                give(capacity - each * length, fresh_at, full)
            if rest:
                give(capacity - rest * length, fresh_at + full, 1)
            fresh_at += full + bool(rest)
            left = 0
    return out


def place(cut: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS) -> DataFrame:
    """cut (with `length`) plus sequence_id and offset. Ties and repeated rows each take a slot of their own. About `part_rows`
    documents of one length are ranked in one task; that changes no result but which equal documents take which slots."""
    spark = session_of(cut)
    slim = stash(cut.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["count"] for r in slim.groupBy("length").count().collect()}  # at most `capacity` rows
    total, most = sum(histogram.values()), max(histogram.values(), default=0)
    slim = slim.withColumn("_part", F.pmod(F.xxhash64("_row"), F.lit(-(-most // part_rows) or 1)).cast("int"))
    # ranks within a length: those before a part, and within it; the join is on what the window has been dealt by
    counts = slim.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("length", "_part", (F.sum("_n").over(Window.partitionBy("length").orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_part").orderBy("_row"))
    ranked = slim.withColumn("_within", within).join(before, ["length", "_part"]).withColumn("_rank", F.col("_before") + F.col("_within") - 1)
    step = max(SLOTS_A_ROW, total // MOST_SLOT_ROWS)
    slots = [
        (length, rank + i, min(step, n - i), first + i, offset)
        for length, rank, n, first, offset in plan(histogram, capacity)
        for i in range(0, n, step)
    ]
    planned = (
        spark.createDataFrame(slots, "length long, rank long, n long, first long, offset long")
        .repartition(F.col("length"), F.col("rank"))
        .select("length", "offset", F.col("rank").alias("_r"), F.col("first").alias("_f"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("_i"))
        .select("length", "offset", (F.col("_r") + F.col("_i")).alias("_rank"), (F.col("_f") + F.col("_i")).alias("sequence_id"))
    )
    return ranked.join(planned, ["length", "_rank"]).drop("_row", "_part", "_within", "_before", "_rank")


def pack(docs: DataFrame, tokenizer_path: str, text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False, plain: bool = False) -> DataFrame:
    """Pack every document into sequences of at most `capacity` tokens; only longer documents are cut.

    Returns the other columns of docs with piece, start, length, ids_crc32, sequence_id, offset. Null or empty text is one
    piece of end_id alone; repeated rows and null ids are packed as rows of their own; an empty table gives no rows. Columns
    of docs that clash with the result's are dropped first. Control strings of the tokenizer in a text get their own ids, or
    with `plain` those of ordinary text.
    """
    taken = {"piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset", "_row", "_part", "_within", "_before", "_rank"}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c == text or c.lower() not in taken])
    return place(pieces(docs, tokenizer_path, text, capacity, end_id, keep_ids, plain), capacity)
