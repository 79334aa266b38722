"""Multi-party perspective rotation of conversations, with DataFrame functions only.

For every participant the dialogue is rendered once with that speaker as the assistant; all others become named users;
the loss mask covers the speaker's own words. System messages are context in every perspective and never trained on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.archive import with_ids

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: How a mark within a text or a name begins, and what it is written as, so that no message can forge a turn.
MARK, ESCAPED = "<|im_", "<\\|im_"
#: Messages of a row of ``dialogues``.
MAX_MESSAGES = 4096


def _plain(c: Column) -> Column:
    return F.replace(c, F.lit(MARK), F.lit(ESCAPED))


def rotate(
    messages: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    speaker_col: str = "role",
    text_col: str = "text",
    system: str = "system",
) -> DataFrame:
    """One row per perspective and message: ``conv_id``, ``perspective``, ``turn``, ``role``, ``name``, ``segment``,
    ``mask_start``, ``mask_end`` (characters of the segment, end exclusive; both null where nothing is trained on).

    Segments of a perspective in turn order are the rendered dialogue. Messages are joined with their conversation's
    distinct speakers, so no conversation is gathered into one row, and a conversation that holds a third of all
    messages is split over tasks. Marks within texts and names are escaped, and line breaks in a name become blanks, so
    that neither can forge a turn or move a mask. Null speakers are the participant ``unknown``; null texts are empty; messages with a
    null conversation form one conversation; a conversation of system messages only has no perspective; equal rows
    stay. Messages of one turn have no order of their own: ``dialogues`` sorts them by their segments. Other columns are
    ignored, whatever their names.
    """
    rows = messages.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(speaker_col), F.lit("unknown")).alias("speaker"),
        _plain(F.coalesce(F.col(text_col), F.lit(""))).alias("text"),
    )
    people = (
        rows.where(F.col("speaker") != system)
        .groupBy("conv_id", "speaker")
        .agg(F.count("*").alias("n"))
        .select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective"))
    )
    own, is_system = F.col("speaker") == F.col("perspective"), F.col("speaker") == system
    role = F.when(is_system, F.lit("system")).when(own, F.lit("assistant")).otherwise(F.lit("user"))
    name = F.when(~own & ~is_system, F.col("speaker"))
    shown = _plain(F.translate(name, "\n\r", "  "))
    head = F.concat(F.lit(OPEN), role, F.coalesce(F.concat(F.lit(" name="), shown), F.lit("")), F.lit("\n"))
    return rows.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).select(
        "conv_id",
        "perspective",
        "turn",
        role.alias("role"),
        name.alias("name"),
        F.concat(head, F.col("text"), F.lit(CLOSE)).alias("segment"),
        F.when(own, F.length(head)).cast("long").alias("mask_start"),
        F.when(own, F.length(head) + F.length("text")).cast("long").alias("mask_end"),
    )


def dialogues(segments: DataFrame, max_messages: int = MAX_MESSAGES) -> DataFrame:
    """Whole dialogues from ``rotate``: ``conv_id``, ``perspective``, ``part``, ``text`` and ``mask``, an array of character
    spans of the text.

    Messages stand in the order of their turns, then of their segments. A dialogue of more than ``max_messages`` messages
    makes several rows, ``part`` 0, 1, ... of consecutive messages; their texts one after the other are the dialogue, so
    no row grows with the table and no message is left out. Messages are numbered in sorted ranges for that, never in one
    task. No segments give no dialogues.
    """
    rows = segments.select("conv_id", "perspective", "turn", "segment", "mask_start", "mask_end")
    rows = with_ids(rows, ["conv_id", "perspective", "turn", "segment", "mask_start"])
    first = rows.groupBy("conv_id", "perspective").agg(F.min("id").alias("first"))
    first = first.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), "first")
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")))
    part = F.floor((F.col("id") - F.col("first")) / max_messages).cast("long")
    parts = rows.groupBy("conv_id", "perspective", part.alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("id", "segment", "mask_start", "mask_end"))).alias("m")
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("mask"))
    folded = F.aggregate(
        "m",
        start,
        lambda s, x: F.struct(
            (s["at"] + F.length(x["segment"])).cast("long").alias("at"),
            F.when(x["mask_start"].isNull(), s["mask"])
            .otherwise(F.array_append(s["mask"], F.struct((s["at"] + x["mask_start"]).alias("start"), (s["at"] + x["mask_end"]).alias("end"))))
            .alias("mask"),
        ),
    )
    return parts.select(
        "conv_id", "perspective", "part", F.array_join(F.transform("m", lambda x: x["segment"]), "").alias("text"), folded["mask"].alias("mask")
    )


SQL = f"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '{MARK}', '{ESCAPED}') AS text FROM conversations
), p AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM m WHERE speaker <> 'system'),
r AS (
  SELECT conv_id, perspective, turn, text,
    CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
    CASE WHEN speaker <> 'system' AND speaker <> perspective THEN speaker END AS name
  FROM m JOIN p ON m.conv_id IS NOT DISTINCT FROM p.c
), h AS (SELECT *, '{OPEN}' || role || coalesce(' name=' || replace(translate(name, chr(10) || chr(13), '  '), '{MARK}', '{ESCAPED}'), '') || chr(10) AS head FROM r)
SELECT conv_id, perspective, turn, role, name, head || text || '{CLOSE.strip()}' || chr(10) AS segment,
  CASE WHEN role = 'assistant' THEN length(head) END AS mask_start,
  CASE WHEN role = 'assistant' THEN length(head) + length(text) END AS mask_end
FROM h
"""

#: Dialogues of ``dialogues`` with their masks as ``start-end`` pairs, joined by commas.
DIALOGUES_SQL = f"""
WITH s AS (
  SELECT *, row_number() OVER (
    PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, segment NULLS FIRST, mask_start NULLS FIRST
  ) - 1 AS k FROM ({SQL})
), o AS (
  SELECT *, k // {MAX_MESSAGES} AS part,
    sum(length(segment)) OVER (PARTITION BY conv_id, perspective, k // {MAX_MESSAGES} ORDER BY k) - length(segment) AS base
  FROM s
)
SELECT conv_id, perspective, CAST(part AS BIGINT) AS part, string_agg(segment, '' ORDER BY k) AS text,
  coalesce(string_agg(CAST(base + mask_start AS BIGINT) || '-' || CAST(base + mask_end AS BIGINT), ',' ORDER BY k)
    FILTER (WHERE mask_start IS NOT NULL), '') AS mask
FROM o GROUP BY conv_id, perspective, part
"""
