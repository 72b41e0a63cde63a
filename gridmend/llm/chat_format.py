"""Chat formatting from event logs, in DataFrame code.

A log row is (conv_id, seq, msg, kind, role, text). The log is partitioned by conversation, sorted by sequence and
folded into final messages:

* ``message`` opens a message under ``msg`` with its text;
* ``delta`` appends its text to the message ``msg``, and opens it where there is none;
* ``edit`` replaces what the message ``msg`` holds by then;
* ``regenerate`` empties the message ``msg``, whatever its own row says, and removes what later messages hold by then.

Events of a conversation happen in the order of seq, kind, role, text and msg.

Messages are then rendered in the order of ``msg``: <|turn role=ROLE|>, a line break, the text, <|end|> and a line
break. Within roles and texts the five characters that control strings need (& < > | [) are written as entities,
which is undone exactly. The rendered text comes in segments, each under the loss mask or not; assistant texts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import let, table

#: Fixed values of the template. "&" is escaped first and restored last.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("|", "&#124;"), ("[", "&#91;"))
OPEN, MID, CLOSE = "<|turn role=", "|>\n", "<|end|>\n"


def escape(text: Column) -> Column:
    for plain, entity in ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescape(text: Column) -> Column:
    for plain, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


#: The order in which events happen, and that in which they are rendered.
HAPPEN = ("seq", "kind", "role", "text", "msg")
ORDER = ("msg", "seq", "kind", "role", "text")


def fold(log: DataFrame) -> DataFrame:
    """The events of ``log`` that survive edits and regenerations.

    An event is gone if a later edit or regeneration names its message, or a later regeneration an earlier message. Events
    are numbered as they happen, so of several with one seq just one is the last. Both are running maxima over the sorted log, so a
    long conversation costs no more for an event than a short one. A regeneration has no text.
    """
    log = log.withColumn("at", F.row_number().over(W.partitionBy("conv_id").orderBy(*HAPPEN)))
    by_msg = W.partitionBy("conv_id", "msg")
    before = W.partitionBy("conv_id").orderBy(F.col("msg").cast("decimal(20,0)")).rangeBetween(W.unboundedPreceding, -1)
    at = lambda *kinds: F.when(F.col("kind").isin(*kinds), F.col("at"))
    marked = log.withColumns({"own": F.max(at("edit", "regenerate")).over(by_msg), "earlier": F.max(at("regenerate")).over(before)})
    left = marked.where(F.col("at") >= F.coalesce(F.greatest("own", "earlier"), F.col("at")))
    return left.withColumn("text", F.when(F.col("kind") == "regenerate", "").otherwise(F.col("text"))).select("conv_id", *ORDER)


def render(events: DataFrame) -> DataFrame:
    """``events`` with their place in the conversation and their segments (text, loss). A message has the role of its
    first surviving event."""
    run = W.partitionBy("conv_id").orderBy(*ORDER)
    opens = F.coalesce((F.col("kind") == "message") | (F.col("msg") != F.lag("msg").over(run)), F.lit(True))
    placed = events.withColumns({"opens": opens, "place": F.row_number().over(run)})
    order = W.partitionBy("conv_id").orderBy("place")
    placed = placed.withColumns({"says": F.last(F.when(F.col("opens"), F.col("role")), ignorenulls=True).over(order), "ends": F.coalesce(F.lead("opens").over(order), F.lit(True))})
    head = F.concat(F.lit(OPEN), escape(F.col("says")), F.lit(MID))
    made = F.array(
        F.struct(F.when(F.col("opens"), head).otherwise("").alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(F.col("text")).alias("text"), (F.col("says") == "assistant").alias("loss")),
        F.struct(F.when(F.col("ends"), CLOSE).otherwise("").alias("text"), F.lit(False).alias("loss")),
    )
    return placed.select("conv_id", "place", F.filter(made, lambda s: s["text"] != "").alias("segments"))


def format_chats(log: DataFrame) -> DataFrame:
    """(conv_id, formatted, segments) for each conversation of ``log`` (conv_id, seq, msg, kind, role, text).

    Null texts and roles are empty; a null seq or msg sorts first; a null kind is a delta; a null conv_id is a
    conversation of its own. Ties in seq are broken by kind, role, text and msg, so the order of rows never counts.
    Equal rows are equal events, which happen one after the other: of two equal edits the second replaces the first. A conversation none of whose events survives has no row; an empty
    log gives an empty result. The log is shuffled once, by conversation, and sorted with spilling; a conversation is
    one row of the result, which must fit in memory.
    """
    least = F.lit(-(2**63)).cast("long")
    events = log.select(
        "conv_id",
        F.coalesce(F.col("msg").cast("long"), least).alias("msg"),
        F.coalesce(F.col("seq").cast("long"), least).alias("seq"),
        F.coalesce(F.col("kind"), F.lit("delta")).alias("kind"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    chats = render(fold(events)).groupBy("conv_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("place", "segments"))), lambda x: x["segments"])).alias("segments"))
    return chats.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def parsed(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.array_remove(F.split(formatted, r"<\|end\|>\n"), "")
    halves = lambda x: F.split(x, r"\|>\n", 2)
    turn = lambda h: F.struct(unescape(F.substring(h[0], len(OPEN) + 1, 2**31 - 1)).alias("role"), unescape(h[1]).alias("text"))
    return F.transform(pieces, lambda x: let(halves(x), turn))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return unescape(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""))


def as_events(rows: DataFrame) -> DataFrame:
    """The log of conversations that came about by streaming: (conv_id, turn, role, text) as (conv_id, seq, msg, kind,
    role, text), whose fold gives the rows' turns again.

    An assistant's message is streamed: it opens with a draft, is regenerated and comes in two deltas. Every other
    message in even places opens with a wrong text, which an edit replaces; those in odd places are plain messages.
    """
    run = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    text = F.coalesce("text", F.lit(""))
    rows = rows.select("conv_id", F.row_number().over(run).cast("long").alias("msg"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    event = lambda k, kind, said: F.struct((F.col("msg") * 4 + k).alias("seq"), F.lit(kind).alias("kind"), said.alias("text"))
    draft = F.concat(F.lit("draft of "), F.col("role"))
    streamed = F.array(event(0, "message", draft), event(1, "regenerate", F.lit("")), event(2, "delta", F.substring("text", F.lit(1), half)), event(3, "delta", F.substring("text", half + 1, F.length("text"))))
    edited = F.array(event(0, "message", draft), event(1, "edit", F.col("text")))
    events = F.when(F.col("role") == "assistant", streamed).when(F.col("msg") % 2 == 0, edited).otherwise(F.array(event(0, "message", F.col("text"))))
    return rows.select("conv_id", "msg", "role", F.explode(events).alias("e")).select("conv_id", "e.seq", "msg", "e.kind", "role", "e.text")


def op6_chat_format(spark, sf_dir: str) -> DataFrame:
    """Digests of all conversations, read back from their formatted texts. Each table row becomes a message by the events
    of a log: openings, deltas, edits and regenerations. Null texts and roles are empty, null turns come first, equal turns go by
    role and text, repeated rows are turns of their own, very long texts are formatted whole; an empty table gives conversation -1 alone."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(probe).alias("text"))
    chats = format_chats(as_events(rows.union(extra)))
    both = F.struct(parsed(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"))
    read = chats.select("conv_id", "formatted", F.explode(F.array(both)).alias("x"))
    said = F.array_join(F.transform("x.turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("x.turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("x.loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("x.loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
