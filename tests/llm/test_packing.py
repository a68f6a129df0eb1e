"""Best-fit packing against the tokenizer itself and against the invariants of a packing."""

import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import packing
from weftline.llm.common import remembered
from weftline.llm.queries import op1_best_fit_packing, tokenizer_path


def whole(text, plain=False):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    tok.encode_special_tokens = plain
    return [*tok.encode(text or "", add_special_tokens=False).ids, 1]


TEXTS = [
    None, "", "  \n", "The the THE don't DON'T we'll", "a" * 300, "É é É é H̱ ẖ ẖ", "x\x1cy\x85z w ΣΑΣ", "!!! ... ,. <|endoftext|> </w>", "hello <|endoftext|>x <|ENDOFTEXT|> <|EndOfText|>y<|startoftext|><|startoftext|>'LL <| |>", "<|É́endoftext|> <|endoftext|>É́",
    "word " * 9000, "1 22 333 ٣٤ 日本語 text", "The the THE don't DON'T we'll",
]


@pytest.mark.parametrize("plain", [False, True])
def test_ids_and_slots(spark, plain):
    docs = spark.createDataFrame([(i if i != 3 else None, t, i, "c") for i, t in enumerate(TEXTS)], "doc_id long, text string, Length long, other string")
    rows = packing.pack(docs, tokenizer_path(), capacity=512, plain=plain).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {i if i != 3 else None for i in range(len(TEXTS))}
    for k, got in by.items():
        ids = np.array(whole(TEXTS[3 if k is None else k], plain), "<u4")
        got.sort(key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(-(-len(ids) // 512)))
        for r in got:
            part = ids[r.start : r.start + r.length]
            assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.start == 512 * r.piece
    check_gapless(rows, 512)


def check_gapless(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def test_full_memo(monkeypatch):
    monkeypatch.setattr(packing, "MEMO", 3)
    remembered.clear()
    encode = packing._encoder(tokenizer_path(), False)
    texts = ["one two three four five", "one two six seven six", "a" * 100 + " one"]
    assert [np.frombuffer(x, "<u4").tolist() for x in encode([t.encode() for t in texts * 2])] == [whole(t)[:-1] for t in texts * 2]
    remembered.clear()


def test_ranks_over_parts(spark, monkeypatch):
    """One hot length and others, ranked in many parts and unfolded in many rows."""
    monkeypatch.setattr(packing, "SLOTS_A_ROW", 7)
    lengths = [5] * 500 + [3] * 100 + [16, 11, 2]
    cut = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "doc_id long, length long").repartition(5)
    got = packing.place(cut, 16, part_rows=20).collect()
    assert sorted((r.doc_id, r.length) for r in got) == list(enumerate(lengths))
    planned = {first + i for _, _, n, first, _ in packing.plan(Counter(lengths), 16) for i in range(n)}
    assert set(check_gapless(got, 16)) == planned


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plan_places_every_document_once(histogram):
    capacity, seen, bins = 40, {}, {}
    for length, rank, n, first, offset in packing.plan(histogram, capacity):
        for i in range(n):
            seen.setdefault(length, []).append(rank + i)
            bins.setdefault(first + i, []).append((offset, length))
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in histogram.items()}
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    rooms = []  # best fit decreasing, document by document
    for length in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
        fit = [r for r in rooms if r >= length]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else capacity) - length)
    assert len(bins) <= 1.15 * len(rooms) + 1


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    rows = op1_best_fit_packing(spark, d).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    assert {r.doc_id for r in rows} == set(docs)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    own = {k: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for k, t in docs.items()}
    assert sum(r.length for r in rows) == sum(map(len, own.values()))
    for r in rows:
        ids = own[r.doc_id][r.start : r.start + r.length]
        assert r.start == 4096 * r.piece and (r.length == 4096 or r.start + r.length == len(own[r.doc_id]))
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32
    bins = check_gapless(rows, 4096)
    assert len(bins) <= sum(r.length for r in rows) / 4096 * 1.02 + 2
