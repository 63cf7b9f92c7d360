r"""Chat records from event logs. DataFrame functions only.

The log has one row an event: ``conv`` (conversation), ``seq`` (order of arrival), ``message`` (its
place among the conversation's messages), ``role``, ``kind`` and ``text``. Kinds: ``message`` sets a
message's text, ``delta`` appends to it, ``edit`` replaces it, ``regenerate`` starts it anew and voids
whatever earlier events gave to later messages. Events are partitioned by conversation, sorted by
sequence and folded to final messages; these are rendered by a template.

Template: ``<turn>role\ntext</turn>\n`` for each message. Inside roles and texts a backslash becomes
``\b`` and the marks ``<turn>`` and ``</turn>`` become ``\o`` and ``\c`` (in roles also a line break
``\n``), so a text can't close its turn, and ``unescape`` gives it back unchanged. The loss mask
covers exactly the texts of assistant messages.

Nulls: a null text or role counts as empty, a null kind as ``message``; a null conversation is one
conversation. Events equal in (conversation, message, seq) go by kind, then text. A message whose
events are all void is left out; an empty table gives no rows; columns beyond those named are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>", "</turn>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(out, F.lit(OPEN), F.lit("\\o")), F.lit(CLOSE), F.lit("\\c"))


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\o"), F.lit(OPEN)), F.lit("\\c"), F.lit(CLOSE))
    return F.replace(F.replace(out, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv, message, role, text) of a log."""
    kind = F.coalesce("kind", F.lit("message"))
    by_seq = Window.partitionBy("conv").orderBy("seq")
    later = by_seq.rangeBetween(1, Window.unboundedFollowing) if dict(events.dtypes)["seq"] in ("int", "bigint") else by_seq.rowsBetween(1, Window.unboundedFollowing)
    events = events.withColumn("kind", kind)
    events = events.withColumn("__void", F.min(F.when(F.col("kind") == "regenerate", F.col("message"))).over(later))
    alive = events.where(F.col("__void").isNull() | (F.col("message") <= F.col("__void")))
    anew = F.max(F.when(F.col("kind") != "delta", F.col("seq"))).over(Window.partitionBy("conv", "message"))
    # An event without a role takes the one its message has had.
    alive = alive.withColumn("role", F.max("role").over(Window.partitionBy("conv", "message")))
    alive = alive.withColumn("__anew", anew).where(F.col("__anew").isNull() | (F.col("seq") >= F.col("__anew")))
    part = F.struct("seq", (F.col("kind") == "delta").alias("late"), F.coalesce("text", F.lit("")).alias("text"))
    return alive.groupBy("conv", "message").agg(F.max(F.coalesce("role", F.lit(""))).alias("role"), F.sort_array(F.collect_list(part)).alias("parts")).select("conv", "message", "role", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row a conversation: conv, formatted, and turns (array of start, loss_start, loss_end in code points; loss bounds null outside the mask)."""
    header = F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    body = escape(F.col("text"))
    rows = messages.withColumns({"__header": header, "__body": body}).withColumn("__turn", F.concat("__header", "__body", F.lit(CLOSE + "\n")))
    before = Window.partitionBy("conv").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__start", F.coalesce(F.sum(F.length("__turn").cast("long")).over(before), F.lit(0)))
    from_, to = F.col("__start") + F.length("__header"), F.col("__start") + F.length("__header") + F.length("__body")
    learnt = F.col("role") == LOSS_ROLE
    turn = F.struct("message", F.col("__start").alias("start"), F.when(learnt, from_).alias("loss_start"), F.when(learnt, to).alias("loss_end"), F.col("__turn").alias("text"))
    folded = rows.groupBy("conv").agg(F.sort_array(F.collect_list(turn)).alias("__turns"))
    return folded.select("conv", F.array_join(F.transform("__turns", lambda t: t["text"]), "").alias("formatted"), F.transform("__turns", lambda t: F.struct(t["start"].alias("start"), t["loss_start"].alias("loss_start"), t["loss_end"].alias("loss_end"))).alias("turns"))


def parse(records: DataFrame) -> DataFrame:
    """Read ``formatted`` and its mask back: conv, formatted, messages (array of role, text) and learnt (texts under the mask, unescaped)."""
    split = F.split("formatted", CLOSE + "\n", -1)
    pieces = F.slice(split, 1, F.size(split) - 1)
    role = lambda p: F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), "\n", 1)
    read = lambda p: F.struct(unescape(role(p)).alias("role"), unescape(F.substr(p, F.length(role(p)) + len(OPEN) + 2)).alias("text"))
    masked = F.zip_with("__pieces", "turns", lambda p, t: F.when(t["loss_start"].isNotNull(), unescape(F.substr(p, (t["loss_start"] - t["start"] + 1).cast("int"), (t["loss_end"] - t["loss_start"]).cast("int")))))
    out = records.withColumn("__pieces", pieces)
    return out.select("conv", "formatted", F.transform("__pieces", read).alias("messages"), F.filter(masked, lambda x: x.isNotNull()).alias("learnt"))


def format_log(events: DataFrame) -> DataFrame:
    return render(fold(events))
