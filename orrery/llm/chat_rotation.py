"""Operator 5: multi-party perspective rotation of dialogues, in DataFrame functions only.

For every participant the dialogue is rendered with that speaker as the assistant and all others as
named users; the mask covers the text of the assistant's turns.  A dialogue comes as one row for each
(conversation, speaker, turn): the rendered segment, its place in the whole rendering, and the span
that is masked in.  Segments in order of ``segment`` joined without a separator are the rendering, so
that no conversation, however long, has to fit into one row or task.

Defined results: a null ``conv_id`` is dropped (it belongs to no dialogue); a null role is the
participant "unknown"; a null text is empty; a null turn stands first; turns that tie are ordered by
role, then text; system turns are shown to all and masked out, and system is no participant; a
conversation of system turns only has no perspective; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turns of one conversation whose places are summed in one task.
SPAN = 1024


def rotate_perspectives(conversations: DataFrame, span: int = SPAN) -> DataFrame:
    """conv_id, speaker, segment, role, name, rendered, start, mask_start, mask_end (masks null outside).

    Scale: places are a prefix sum in two levels.  Spans of turns are summed first; only one row for a
    span meets the others of its conversation; inside spans the sums run side by side.
    """
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id",
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("name"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.floor(F.coalesce("turn", F.lit(-1)) / F.lit(span)).alias("part"),
    )
    speakers = turns.where(F.col("name") != "system").groupBy("conv_id", F.col("name").alias("speaker")).agg(F.lit(1).alias("_one")).drop("_one")
    seen = turns.join(speakers, "conv_id")
    own = F.col("name") == F.col("speaker")
    role = F.when(own, "assistant").when(F.col("name") == "system", "system").otherwise("user")
    head = F.when(own, F.lit("<|assistant|>\n")).when(F.col("name") == "system", F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), F.col("name"), F.lit("|>\n")))
    seen = (
        seen.withColumn("role", role)
        .withColumn("head", F.length(head))
        .withColumn("rendered", F.concat(head, F.col("text"), F.lit("<|end|>\n")))
        .withColumn("size", F.length("rendered").cast("long"))
        .withColumn("n", F.length("text"))
    )
    before = Window.partitionBy("conv_id", "speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        seen.groupBy("conv_id", "speaker", "part")
        .agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("k"))
        .select("conv_id", "speaker", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("_size"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("_k"))
    )
    inside = Window.partitionBy("conv_id", "speaker", "part").orderBy(F.col("turn").asc_nulls_first(), "name", "text")
    start = F.col("_size") + F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = seen.join(parts, ["conv_id", "speaker", "part"]).withColumn("start", start).withColumn("segment", F.col("_k") + F.row_number().over(inside) - 1)
    mine = F.col("role") == "assistant"
    return placed.select(
        "conv_id",
        "speaker",
        "segment",
        "role",
        "name",
        "rendered",
        "start",
        F.when(mine, F.col("start") + F.col("head")).alias("mask_start"),
        F.when(mine, F.col("start") + F.col("head") + F.col("n")).alias("mask_end"),
    )


ORACLE = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS name, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
speakers AS (SELECT DISTINCT conv_id, name AS speaker FROM turns WHERE name <> 'system'),
seen AS (
  SELECT t.conv_id, s.speaker, t.turn, t.name, t.text,
    CASE WHEN t.name = s.speaker THEN 'assistant' WHEN t.name = 'system' THEN 'system' ELSE 'user' END AS role,
    CASE WHEN t.name = s.speaker THEN '<|assistant|>' WHEN t.name = 'system' THEN '<|system|>'
         ELSE '<|user name=' || t.name || '|>' END || chr(10) AS head
  FROM turns t JOIN speakers s ON t.conv_id = s.conv_id),
placed AS (
  SELECT *, head || text || '<|end|>' || chr(10) AS rendered,
    row_number() OVER w - 1 AS segment,
    coalesce(sum(length(head || text || '<|end|>' || chr(10))) OVER
      (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, name, text
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM seen WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, name, text))
SELECT conv_id, speaker, segment, role, name, rendered, start,
  CASE WHEN role = 'assistant' THEN start + length(head) END AS mask_start,
  CASE WHEN role = 'assistant' THEN start + length(head) + length(text) END AS mask_end
FROM placed
"""
