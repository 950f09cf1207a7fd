"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log is rows (conversation, seq, kind, message, role, text). ``reconstruct`` folds it into final messages:

* ``message`` starts a message, ``delta`` appends to it in the order of seq;
* ``edit`` replaces what the message had so far (deltas may follow);
* ``regenerate`` does that too and drops everything earlier that belongs to later messages.

The fold is a set of running windows over the conversation (each keeps one number), then a group by message; events
are never gathered by conversation. ``render`` turns each message into text on its own row and only then joins the
finished strings of a conversation, which is the row asked for and has to fit one row anyway.

Template: ``### Role: text</turn>`` and a line end. The characters ``\\``, ``#``, ``<``, ``:`` and line feed of roles and
``\\``, ``#``, ``<`` of texts are written as a backslash and a letter, so no text can hold a control string and reading back
is exact. ``turn_spans`` has for each turn the code points its text takes and whether it is under the loss mask
(role ``assistant``, any case kept as it is: only that exact string).

Defined results. Null text: empty; null role: empty role; null kind: ``message``; null conversation: a conversation
of its own; ties of seq: by message, role, text; repeated rows: a turn each. Empty table: empty result. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.llm.common import table

HEAD, MID, END = "### ", ": ", "</turn>\n"
#: Backslash first when escaping, last when reading back: no escape's letter makes another escape.
TEXT_ESCAPES = (("\\", "\\s"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*TEXT_ESCAPES, (":", "\\c"), ("\n", "\\n"))
LOSS_ROLE = "assistant"


def escape(c: Column, pairs=TEXT_ESCAPES) -> Column:
    for raw, safe in pairs:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column, pairs=TEXT_ESCAPES) -> Column:
    for raw, safe in reversed(pairs):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def to_events(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a log of complete messages, numbered within the conversation."""
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    n = F.row_number().over(order).cast("long")
    return turns.select("conv_id", "turn", "role", "text").withColumn("seq", n).select(
        "conv_id", "seq", F.lit("message").alias("kind"), F.col("seq").alias("msg"), "role", "text"
    )


def reconstruct(events: DataFrame) -> DataFrame:
    """Events (conv_id, seq, kind, msg, role, text) to final messages (conv_id, msg, role, text)."""
    e = events.select(
        "conv_id", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), "msg", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    later = W.partitionBy("conv_id").orderBy(F.col("seq").desc(), F.col("msg").desc()).rowsBetween(W.unboundedPreceding, -1)
    redone = F.min(F.when(F.col("kind") == "regenerate", F.col("msg"))).over(later)
    own = W.partitionBy("conv_id", "msg")
    named = F.min(F.when(F.col("role") != "", F.struct("seq", "role"))).over(own)["role"]
    e = e.withColumns({"__redone": redone, "__named": named}).where(F.col("__redone").isNull() | (F.col("msg") < F.col("__redone")))
    reset = F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq"))).over(own)
    # a message keeps its role when what named it is regenerated away
    first_role = F.coalesce(named, F.col("__named"), F.lit(""))
    e = e.withColumns({"__reset": reset, "role": first_role}).where(F.col("__reset").isNull() | (F.col("seq") >= F.col("__reset")))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    return e.groupBy("conv_id", "msg").agg(F.first("role").alias("role"), F.array_join(parts, "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row by conversation: ``formatted`` and ``turn_spans`` array<struct<start, length, loss>> in code points."""
    head = F.concat(F.lit(HEAD), escape(F.col("role"), ROLE_ESCAPES), F.lit(MID))
    m = messages.withColumns({"__head": head, "__body": escape(F.col("text"))})
    m = m.withColumn("__turn", F.concat("__head", "__body", F.lit(END)))
    so_far = W.partitionBy("conv_id").orderBy("msg").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("__turn")).over(so_far), F.lit(0).cast("long")) + F.length("__head")
    m = m.select("conv_id", "msg", "__turn", F.struct(start.cast("long").alias("start"), F.length("__body").cast("long").alias("length"), (F.col("role") == LOSS_ROLE).alias("loss")).alias("span"))
    rows = F.sort_array(F.collect_list(F.struct("msg", F.col("__turn").alias("t"), "span")))
    return (
        m.groupBy("conv_id")
        .agg(rows.alias("__rows"))
        .select("conv_id", F.array_join(F.transform("__rows", lambda x: x["t"]), "").alias("formatted"), F.transform("__rows", lambda x: x["span"]).alias("turn_spans"))
    )


def parse(formatted: DataFrame) -> DataFrame:
    """Reads ``formatted`` back: adds ``turns`` array<struct<role, text, loss>>, one pass over the string."""
    pieces = F.split("formatted", END)
    turns = F.transform(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        lambda p, i: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(len(HEAD) + 1)), MID, 1), ROLE_ESCAPES).alias("role"),
            unescape(F.substr(p, F.instr(p, F.lit(MID)) + len(MID))).alias("text"),
            F.get(F.col("turn_spans"), i)["loss"].alias("loss"),
        ),
    )
    return formatted.withColumn("turns", turns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text")
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = parse(render(reconstruct(to_events(rows))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    back = back.withColumns({"__said": said, "__loss": loss})
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.col("__said"), 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("__loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escaped(c: str, pairs) -> str:
    for raw, safe in pairs:
        c = f"replace({c}, {'chr(10)' if raw == chr(10) else repr(raw) if raw != chr(92) else 'chr(92)'}, chr(92) || '{safe[1]}')"
    return c


SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(HEAD) + len(MID) + len(END)} + length({_sql_escaped('role', ROLE_ESCAPES)}) + length({_sql_escaped('text', TEXT_ESCAPES)}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
