"""Chat formatting from event logs, in DataFrame functions only.

A log has one row an event: (conv_id, seq, message, kind, role, text). By seq,
``start`` sets a message's role and text, ``delta`` appends a streamed piece,
``edit`` replaces the text, and ``regenerate`` empties it for new deltas and
drops the messages after it that had begun before. What is left is rendered as
turns with a loss mask over the assistant's texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import read

START, END, ANSWERS = "<|im_start|>", "<|im_end|>\n", "assistant"
#: Control strings of common chat templates, as a pattern. All begin with < or [.
CONTROL = r"(<)(?=\|)|(<)(?=/?s>)|(<)(?=</?SYS>>)|(\[)(?=/?INST\])"


def escape(text: Column) -> Column:
    r"""Doubles backslashes and puts one before the first character of a control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"\\$1$2$3$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text) of the final messages.

    Events of equal seq in a message go by kind and text. A message without a
    ``start`` has an empty role. Null texts and roles are empty; a null kind is
    a ``start``; a null conv_id is a conversation of its own; an exact repeat of
    an event counts again. An empty log gives no rows; other columns are ignored.
    """
    kind = F.coalesce("kind", F.lit("start"))
    rows = events.select("conv_id", "message", "seq", kind.alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("text", F.when(F.col("kind") == "regenerate", "").otherwise(F.col("text")))
    one = Window.partitionBy("conv_id", "message").orderBy("seq", "kind", "text")
    resets = F.sum((F.col("kind") != "delta").cast("int"))
    rows = rows.withColumns({"_reset": resets.over(one.rowsBetween(Window.unboundedPreceding, 0)), "_last": resets.over(Window.partitionBy("conv_id", "message")), "_at": F.row_number().over(one)})
    live = F.col("_reset") == F.col("_last")
    pieces = F.sort_array(F.collect_list(F.when(live, F.struct("_at", "text"))))
    messages = rows.groupBy("conv_id", "message").agg(
        F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"),
        F.max_by("role", F.when(F.col("kind") == "start", F.col("_at"))).alias("role"),
        F.min("seq").alias("_begun"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("_again"),
    )
    earlier = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    dropped = F.max("_again").over(earlier) > F.col("_begun")
    return messages.withColumn("_dropped", F.coalesce(dropped, F.lit(False))).where("not _dropped").select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), "text")


def format_chats(messages: DataFrame) -> DataFrame:
    r"""(conv_id, formatted, segments) of messages (conv_id, message, role, text).

    A turn is START, the role, \n, the text and END, with control strings inside
    role and text escaped, and line ends in a role too. ``segments`` holds the
    same string as pieces (text, loss); loss marks the assistant's texts. A
    conversation is one row by definition, so it has to fit into one; ties of
    message go by role and text.
    """
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\\n"))
    turns = messages.select("conv_id", F.struct("message", role.alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"), (F.coalesce(F.col("role") == ANSWERS, F.lit(False))).alias("loss")).alias("turn"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))

    def pieces(t: Column) -> Column:
        return F.array(
            F.struct(F.concat(F.lit(START), t["role"], F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
            F.struct(t["text"].alias("text"), t["loss"].alias("loss")),
            F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
        )

    segments = F.flatten(F.transform("turns", pieces))
    return grouped.select("conv_id", segments.alias("segments")).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted) parsed from formatted strings and masks.

    Whatever format_chats writes is read back as it was, control strings and
    the template's own marks in texts included. A null or empty string has no
    turns; an empty table gives no rows; other columns are ignored.
    """
    head = r"(?s)^((?:[^\\\n]++|\\.)*+)\n"
    # A backslash takes the next character with it, so END within a text, whose < has one, doesn't end the turn.
    turn = r"(?s)<\|im_start\|>((?:[^\\<]++|\\.|<(?!\|im_end\|>\n))*+)<\|im_end\|>\n"
    parts = F.regexp_extract_all(F.coalesce("formatted", F.lit("")), F.lit(turn), 1)
    with_role = F.transform(parts, lambda p: F.struct(p.alias("part"), F.regexp_extract(p, head, 1).alias("role")))
    turns = F.transform(with_role, lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(F.substring(t["part"], F.length(t["role"]) + 2, F.length(t["part"]))).alias("text")))
    answers = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return formatted.select("conv_id", turns.alias("turns"), F.array_join(answers, "").alias("loss_text"), "formatted")


#: A conversation that speaks the template's language.
PLANTED = "</s>[INST] ok [/INST]"


def event_log(turns: DataFrame) -> DataFrame:
    """A log whose fold gives the turns (conv_id, turn, role, text); those of equal turn go by role and text.

    A user's or system's text comes as a draft that an edit replaces. An answer
    is streamed in three deltas after a first try, its half, was cut off and
    followed by a question that the regeneration drops.
    """
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = turns.withColumn("message", 2 * F.row_number().over(by_turn)).withColumn("text", F.coalesce("text", F.lit("")))
    third, n = F.ceil(F.length("text") / 3).cast("int"), F.length("text")

    def event(k: int, kind: str, text: Column, role: Column | None = None, stray: int = 0) -> Column:
        nothing = F.lit(None).cast("string")
        return F.struct((8 * F.col("message") + k).cast("long").alias("seq"), (F.col("message") + stray).cast("long").alias("message"), F.lit(kind).alias("kind"), (nothing if role is None else role).alias("role"), text.alias("text"))

    empty, role = F.lit(""), F.col("role")
    edited = F.array(event(0, "start", F.concat(F.col("text"), F.lit(" (draft)")), role), event(1, "edit", F.col("text")))
    streamed = F.array(
        event(0, "start", empty, role),
        event(1, "delta", F.substring("text", F.lit(1), F.floor(n / 2).cast("int"))),
        event(2, "start", F.lit("Hello?"), F.lit("user"), stray=1),
        event(3, "regenerate", empty),
        *(event(4 + k, "delta", F.substring(F.col("text"), k * third + 1, third)) for k in range(3)),
    )
    log = numbered.select("conv_id", F.explode(F.when(role == ANSWERS, streamed).otherwise(edited)).alias("e"))
    return log.select("conv_id", "e.seq", "e.message", "e.kind", "e.role", "e.text")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ANSWERS).alias("role"), F.lit(PLANTED).alias("text"))
    back = read_back(format_chats(fold_events(event_log(rows.unionByName(planted)))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = r"""
WITH events AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
written AS (SELECT *, 24 + length(role) + length(text)
  + length(role || text) - length(replace(role || text, '\', ''))
  + length(role) - length(replace(role, chr(10), ''))
  + length(regexp_extract_all(role, '<\||</?s>|<</?SYS>>|\[/?INST\]')) + length(regexp_extract_all(text, '<\||</?s>|<</?SYS>>|\[/?INST\]')) AS chars FROM events)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id
"""
