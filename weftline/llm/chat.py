"""Chat formatting from event logs: conversations are rebuilt from messages, streamed deltas, edits and regenerations, and then
rendered with a turn template and a loss mask. DataFrame functions only.

Template: each turn is <s>[INST]role[/INST]text</s>. Control strings inside roles and texts get a backslash after their first
character; any that look escaped already get one more, so unescape() restores every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"
CONTROL = r"/?s>|/?INST\]|</?SYS>>"
RESETS = ("message", "edit", "regenerate", "delete")


def escape(x: Column) -> Column:
    return F.regexp_replace(x, rf"([<\[])(\\*)({CONTROL})", r"$1\\$2$3")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, rf"([<\[])\\(\\*)({CONTROL})", "$1$2$3")


def as_events(rows: DataFrame, conv: str = "conv_id", seq: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Plain turn rows as an event log of whole messages."""
    c = lambda n: F.col(f"`{n}`")
    return rows.select(c(conv).alias("conv_id"), c(seq).cast("long").alias("seq"), F.lit("message").alias("kind"), F.lit(None).cast("long").alias("target"), c(role).alias("role"), c(text).alias("text"))


#: Places between the messages of a stream, for the events that follow each.
STEP = 8


def as_stream(rows: DataFrame, conv: str = "conv_id", seq: str = "turn", role: str = "role", text: str = "text", streamed: str = "assistant", draft: int = 12) -> DataFrame:
    """Turn rows as the event log that a chat service would have written: turns of the streamed role begin with a draft (its
    first characters), which is edited, taken back by a regeneration, and then streamed in three deltas; others are whole messages.

    Folding it gives every turn back. Rows that repeat a turn are messages of their own, by role and text; null roles and texts are
    empty, a null seq sorts first, a null conv is one conversation; texts of any length and characters outside the basic plane
    are cut between code points. Other columns are left out; no rows give no events.
    """
    c = lambda n: F.col(f"`{n}`")
    t = rows.select(c(conv).alias("conv_id"), c(seq).cast("long").alias("at"), F.coalesce(c(role), F.lit("")).alias("role"), F.coalesce(c(text), F.lit("")).alias("text"))
    t = t.withColumn("seq", F.row_number().over(Window.partitionBy("conv_id").orderBy("at", "role", "text")).cast("long") * STEP)
    third = F.floor(F.length("text") / 3).cast("int")
    event = lambda k, kind, said: F.struct((F.col("seq") + k).alias("seq"), F.lit(kind).alias("kind"), (F.col("seq") if k else F.lit(None).cast("long")).alias("target"), said.alias("text"))
    piece = lambda start, n: F.col("text").substr(start, n)
    log = F.array(
        event(0, "message", piece(F.lit(1), F.lit(draft))), event(1, "edit", F.concat(piece(F.lit(1), F.lit(draft)), F.lit(" ..."))), event(2, "regenerate", F.lit("")),
        event(3, "delta", piece(F.lit(1), third)), event(4, "delta", piece(third + 1, third)), event(5, "delta", piece(third * 2 + 1, F.length("text"))),
    )
    told = t.withColumn("e", F.explode(F.when(F.col("role") == streamed, log).otherwise(F.array(event(0, "message", F.col("text"))))))
    return told.select("conv_id", "e.seq", "e.kind", "e.target", F.when(F.col("e.kind") == "message", F.col("role")).alias("role"), "e.text")


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, seq, nth, role, text) of an event log (conv_id, seq, kind, target, role, text).

    kind: message opens a message; delta appends to one; edit and regenerate replace what it holds so far (deltas may follow);
    delete removes it unless a later edit restores it. target is the seq of the message meant; null means the latest one
    before. Events of one seq come by kind (message first), role, text; messages of one seq are messages of their own, and events aimed at
    that seq go to the first. Null texts and roles count as empty; a null seq sorts first; events before any message are dropped.
    """
    opens = F.col("kind") == "message"
    e = events.select("conv_id", "seq", "kind", "target", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    e = e.withColumn("later", F.when(opens, 0).otherwise(1)).withColumn("seq", F.coalesce("seq", F.lit(-(2**63))))
    order = Window.partitionBy("conv_id").orderBy("seq", "later", "kind", "role", "text")
    e = e.withColumn("at", F.row_number().over(order))
    # the first message of a seq is number 0: what is aimed at the seq joins it
    e = e.withColumn("first", F.last(F.when(opens, F.col("seq")), ignorenulls=True).over(order))
    e = e.withColumn("nth", F.when(opens, F.sum(F.when(opens, 1).otherwise(0)).over(Window.partitionBy("conv_id", "seq").orderBy("at")) - 1).otherwise(F.lit(0)))
    e = e.withColumn("message", F.when(opens, F.col("seq")).otherwise(F.coalesce("target", "first")))
    got = e.where(F.col("message").isNotNull()).groupBy("conv_id", "message", "nth").agg(F.array_sort(F.collect_list(F.struct("at", "kind", "role", "text"))).alias("log"))
    resets = F.filter("log", lambda x: x["kind"].isin(*RESETS))
    last = F.element_at(resets, -1)
    since = F.filter("log", lambda x: x["at"] >= last["at"])
    return (
        got.where(F.size(resets) > 0)
        .where(F.exists("log", lambda x: x["kind"] == "message") & (last["kind"] != "delete"))
        .select(
            "conv_id",
            F.col("message").alias("seq"),
            "nth",
            F.element_at("log", 1)["role"].alias("role"),
            F.array_join(F.transform(since, lambda x: x["text"]), "").alias("text"),
        )
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_mask) per conversation; the mask is an array of (start, length) in code points of formatted."""
    m = messages.select("conv_id", "seq", "nth", "role", escape(F.col("role")).alias("r"), escape(F.col("text")).alias("t"))
    m = m.withColumn("turn", F.concat(F.lit(OPEN), F.col("r"), F.lit(MIDDLE), F.col("t"), F.lit(CLOSE)))
    order = Window.partitionBy("conv_id").orderBy("seq", "nth")
    before = F.sum(F.length("turn").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("turn")
    start = before + len(OPEN) + F.length("r") + len(MIDDLE)
    m = m.withColumn("span", F.when(F.col("role") == loss_role, F.struct(start.alias("start"), F.length("t").cast("long").alias("length"))))
    turns = F.array_sort(F.collect_list(F.struct("seq", "nth", "turn", "span")))
    return (
        m.groupBy("conv_id")
        .agg(turns.alias("turns"))
        .select("conv_id", F.array_join(F.transform("turns", lambda x: x["turn"]), "").alias("formatted"), F.filter(F.transform("turns", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss_mask"))
    )


def format_chats(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Rebuild and render every conversation of an event log; an empty log gives no rows, a null conv_id is one conversation."""
    return render(fold(events), loss_role)


def parse(formatted: DataFrame) -> DataFrame:
    """formatted with `turns`, an array of (role, text) read back from the text, and `losses`, the unescaped texts under the mask."""
    pieces = F.split("formatted", CLOSE, -1)
    body = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda x: F.substring(x, len(OPEN) + 1, 2**31 - 1))
    role = lambda x: F.substring_index(x, MIDDLE, 1)
    turns = F.transform(body, lambda x: F.struct(unescape(role(x)).alias("role"), unescape(x.substr(F.length(role(x)) + len(MIDDLE) + 1, F.length(x))).alias("text")))
    losses = F.transform("loss_mask", lambda m: unescape(F.col("formatted").substr((m["start"] + 1).cast("int"), m["length"].cast("int"))))
    return formatted.withColumn("turns", turns).withColumn("losses", losses)


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and hashes of each conversation as read back from its rendered text and mask."""
    loss = F.array_join("losses", "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parse(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
