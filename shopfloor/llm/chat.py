"""Chat formatting from an event log (operator 13).

A chat server logs events: a message starts, its text is streamed in deltas,
it is edited, or it is generated anew.  ``fold`` deals the log by
conversation, sorts it by sequence number and folds it into the final
messages; ``render`` writes each conversation as one text with a loss mask
over the assistant's words; ``read_back`` gets the turns and the masked text
from that output again.  Only DataFrame and SQL functions; the text is
shuffled once, by conversation, and every later step keeps that partitioning.

Fold: a ``start``, ``edit`` or ``regenerate`` event replaces the message's
text by its own (null: empty), a ``delta`` adds to it.  A message stands
where its first event does, its role is the first one given.  Generating a
message anew drops the messages that began after it and before that, as they
answered a text that is gone.

Template: ``<turn>`` role ``<text>`` text ``</turn>`` line feed.  In roles and
texts ``\\`` is written ``\\b`` and ``<`` is written ``\\l``, one character at a
time, so no control string can occur in them, whatever they hold, and both
are read back exactly.

Defined results: a null text or role counts as empty; a null conv_id is a
conversation of its own; events without a sequence number or message, or
with an unknown kind, take no part and are returned by ``rejects`` with a
reason; events of equal sequence number are ordered by kind, then role, then
text; a conversation whose messages are all empty still has its turns; an
empty log gives an empty table; further columns are not read.  Rows of
``conversations`` are ordered by turn (nulls last), role (null as empty),
text (null as empty); a repeated row is a turn of its own.

A conversation is one row of the result, so its text must fit in one task
(and in a string of 2 GB); only its last step, joining the rendered messages,
holds it at once, all others run through sorted rows that can spill.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = "start", "delta", "edit", "regenerate"
LOSS_ROLE = "assistant"
DELTA_CHARS = 1024              # code points of a streamed delta
EVENTS_PER_TURN = 1 << 24       # room for a turn's events in the sequence numbers

TURN, TEXT, END = "<turn>", "<text>", "</turn>\n"


def escaped(col):
    return F.replace(F.replace(col, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(col):
    return F.replace(F.replace(col, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def log_of(conversations: DataFrame, delta_chars: int = DELTA_CHARS) -> DataFrame:
    """The event log of a table with a row a turn (conv_id, turn, role, text).

    Every turn starts with its role; the assistant's text arrives in deltas,
    the others' with the start.
    """
    rows = conversations.select(
        F.col("`conv_id`").cast("long").alias("conv_id"), F.col("`turn`").cast("long").alias("turn"),
        F.coalesce(F.col("`role`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("`text`").cast("string"), F.lit("")).alias("text"))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    streamed = F.col("role") == LOSS_ROLE
    parts = F.when(streamed, F.concat(F.array(F.lit("")), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{delta_chars}}}"), F.lit(0)))) \
        .otherwise(F.array("text"))
    return (rows.withColumn("message", F.row_number().over(w).cast("long"))
            .select("conv_id", "message", "role", F.posexplode(parts).alias("k", "text"))
            .select("conv_id", (F.col("message") * EVENTS_PER_TURN + F.col("k")).alias("seq"), "message",
                    F.when(F.col("k") == 0, "start").otherwise("delta").alias("kind"), "role", "text"))


def _reason():
    return (F.when(F.col("seq").isNull(), "no sequence number").when(F.col("message").isNull(), "no message")
            .when(F.col("kind").isNull() | ~F.col("kind").isin(*KINDS), "unknown kind"))


def rejects(log: DataFrame) -> DataFrame:
    """The events that ``fold`` leaves out, with the reason."""
    return log.withColumn("reason", _reason()).where("reason IS NOT NULL")


def fold(log: DataFrame) -> DataFrame:
    """conv_id, start (order in the conversation), message, role, text of the final messages."""
    events = log.where(_reason().isNull()).select("conv_id", "seq", "message", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    # one exchange, by conversation; the later groups and windows are all within it
    events = events.repartition("conv_id")
    anew = F.col("kind") != "delta"
    messages = events.groupBy("conv_id", "message").agg(
        F.min("seq").alias("start"),
        F.max(F.when(anew, F.col("seq"))).alias("reset"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("regenerated"),
        F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("events"))
    # the last of the events that share the reset's number counts
    kept = ("filter(events, (e, i) -> reset IS NULL OR i >= "
            "size(events) - array_position(reverse(transform(events, x -> x.seq = reset AND x.kind <> 'delta')), true))")
    messages = messages.select(
        "conv_id", "message", "start", "regenerated",
        F.expr("coalesce(get(filter(events, e -> e.role IS NOT NULL), 0).role, '')").alias("role"), F.expr(kept).alias("events"))
    before = Window.partitionBy("conv_id").orderBy("start", "message").rowsBetween(Window.unboundedPreceding, -1)
    answered = F.coalesce(F.max("regenerated").over(before) > F.col("start"), F.lit(False))
    return (messages.withColumn("gone", answered).where("NOT gone")
            .select("conv_id", "start", "message", "role",
                    F.expr("array_join(transform(events, e -> e.text), '')").alias("text")))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (start and length in code points of each span that is learned)."""
    body = messages.select("conv_id", "start", "message", "role", escaped(F.col("text")).alias("body"),
                           F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT)).alias("head"))
    body = body.withColumn("chars", (F.char_length("head") + F.char_length("body") + len(END)).cast("long"))
    before = Window.partitionBy("conv_id").orderBy("start", "message").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum("chars").over(before), F.lit(0)) + F.char_length("head")
    placed = body.select("conv_id", F.struct(
        F.struct("start", "message").alias("place"), F.concat("head", "body", F.lit(END)).alias("turn"),
        F.when(F.col("role") == LOSS_ROLE, F.struct(at.alias("start"), F.char_length("body").cast("long").alias("length"))).alias("loss")).alias("t"))
    return (placed.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
            .select("conv_id", F.expr("array_join(transform(turns, t -> t.turn), '')").alias("formatted"),
                    F.expr("transform(filter(turns, t -> t.loss IS NOT NULL), t -> t.loss)").alias("loss")))


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, turns (role and text), learned (all text under the loss mask), formatted.

    Texts hold no ``<``, so the output splits at the control strings; the
    masked text is cut out by its code points, four bytes each, in time in
    proportion to the output.
    """
    parts = rendered.withColumn("parts", F.split("formatted", "<", -1)).withColumn("wide", F.encode("formatted", "UTF-32"))
    turn = "named_struct('role', {0}, 'text', {1})".format(
        *[f"replace(replace(substring(parts[3 * i + {k}], {n + 1}), '\\\\l', '<'), '\\\\b', '\\\\')" for k, n in ((1, len("turn>")), (2, len("text>")))])
    return parts.select(
        "conv_id", "formatted",
        F.expr(f"transform(filter(sequence(0, (size(parts) - 1) div 3), i -> 3 * i + 3 < size(parts)), i -> {turn})").alias("turns"),
        unescaped(F.expr("array_join(transform(loss, s -> decode(substring(wide, cast(4 * s.start + 1 as int), "
                         "cast(4 * s.length as int)), 'UTF-32')), '')")).alias("learned"))


def digests(read: DataFrame) -> DataFrame:
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.expr("array_join(transform(turns, t -> concat(t.role, '\\n', t.text, '\\n')), '')"), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


#: A conversation whose texts hold the control strings of common templates.
TRAP = r"\### Assistant: </turn> ok"


def with_trap(conversations: DataFrame) -> DataFrame:
    """The table's rows and conversation -7, a user and an assistant row that say ``TRAP``."""
    trap = conversations.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRAP).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(trap)


ORACLE_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{TRAP}' UNION ALL SELECT -7, 1, 'assistant', '{TRAP}'),
t AS (SELECT conv_id, count(*) AS n_turns,
             string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text) AS turns,
             coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS LAST, role, text), '') AS learned,
             sum(20 + length(role) + length(text) + 2 * length(role || text) - length(replace(role || text, '<', ''))
                 - length(replace(role || text, '\', ''))) AS formatted_chars
      FROM c GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars,
       sha256(learned) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM t
"""
