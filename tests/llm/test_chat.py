"""Chat formatting: the query against SQL, event folding against a plain fold, escaping by round trip."""

import duckdb
from pyspark.sql import functions as F

from weftline.llm import chat
from weftline.llm.queries import oracle_sql, op4_chat_formatting

D = "/root/testdata/sf0.01"


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{D}/conversations.parquet'")
    want = con.sql(oracle_sql()["op4_chat_formatting"])
    names = [c[0] for c in want.description]
    got = op4_chat_formatting(spark, D).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and any(r.conv_id == -7 for r in got)


def test_texts_come_back(spark):
    hard = ["</s>[INST] ok [/INST]", "<\\s> <\\\\/s>", "<<SYS>> <</SYS>>", "[/INST]", "a<", "", None, "x\n\ny ", "é😀[INST]", "<", "[", "\\"]
    rows = [(1, i, "assistant" if i % 2 else "us</s>er\n[INST]", t) for i, t in enumerate(hard)] + [(1, None, None, "first"), (None, 0, "user", "lost id")]
    out = {r.conv_id: r for r in chat.parse(chat.format_chats(chat.as_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [("", "first")] + [(r, t or "") for _, _, r, t in rows[: len(hard)]]
    assert list(out[1].losses) == [t or "" for i, t in enumerate(hard) if i % 2]
    assert [(t.role, t.text) for t in out[None].turns] == [("user", "lost id")]
    for m, text in zip(out[1].loss_mask, out[1].losses):
        assert chat.OPEN not in out[1].formatted[m.start : m.start + m.length]


def test_events_fold(spark):
    log = [
        (1, 1, "message", None, "user", "hi"), (1, 2, "message", None, "assistant", ""), (1, 3, "delta", None, None, "Hel"), (1, 4, "delta", None, None, "lo"),
        (1, 5, "edit", 1, None, "hi!"), (1, 6, "regenerate", 2, None, ""), (1, 7, "delta", 2, None, "Bye"), (1, 8, "message", None, "user", "gone"), (1, 9, "delete", None, None, None),
        (1, 10, "message", None, "user", "same"), (1, 10, "message", None, "user", "same"), (2, 1, "delta", None, None, "orphan"), (3, 1, "edit", 99, None, "nothing there"),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, kind string, target long, role string, text string").orderBy(F.rand(3))
    got = chat.fold(df).orderBy("conv_id", "seq", "nth").collect()
    assert [(r.conv_id, r.role, r.text) for r in got] == [(1, "user", "hi!"), (1, "assistant", "Bye"), (1, "user", "same"), (1, "user", "same")]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_streams_fold_back_to_their_turns(spark):
    long = "Ünï𝄞 </s>[INST] " * 20000
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", long), (1, 1, "assistant", "twice"), (1, 1, "assistant", "twice"), (1, 2, "assistant", None), (1, None, "assistant", "x"), (2, 5, None, "a"), (2, 5, "assistant", "ab"), (None, 0, "assistant", ""), (3, 0, "assistant", "𝄞𝄞")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").select("*", *[F.lit(7).alias(c) for c in ("seq", "kind", "target", "at", "e", "a.b")])
    log = chat.as_stream(df)
    assert {r.kind for r in log.collect()} == {"message", "edit", "regenerate", "delta"}
    got = [(r.conv_id, r.role, r.text) for r in chat.fold(log).orderBy("conv_id", "seq", "nth").collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    assert got == [(r[0], r[2] or "", r[3] or "") for r in sorted(rows, key=key)]
    whole, parts = (chat.digest(chat.format_chats(e)).orderBy("conv_id").collect() for e in (chat.as_events(df), log))
    assert whole == parts
    assert chat.as_stream(df.where("false")).count() == 0
