"""Multi-party chat formatting with DataFrame functions only.

For every participant of a conversation, the dialogue is rendered with that
speaker as the assistant and all others as named users, with the character
spans that a loss mask leaves open: the assistant's own turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ranks import number_rows

END = "<|end|>\n"


def _content(text: Column) -> Column:
    """Text that can't be taken for a marker."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", narrator: str = "system", block_turns: int | None = None) -> DataFrame:
    """``conv_col``, ``perspective``, ``block``, ``n_turns``, ``rendered`` and ``mask`` for each participant.

    A dialogue is rendered whole, in block 0. With ``block_turns``, its turns
    are dealt by their place in it to blocks of so many, a row each, so that no
    task holds a dialogue of any length; places come from one distributed sort.

    ``mask`` lists the open spans of ``rendered`` as start:length in
    characters, comma-joined; a span is an own turn with its end marker. Turns
    of the narrator stay as they are and it gets no perspective. A null
    speaker is called ``unknown``; a null text is empty; a null turn number is
    sorted first, as turn 0; equal turn numbers are sorted by speaker and
    text. Rows that repeat are turns each; texts of any length are rendered
    whole; other columns are ignored. An empty table gives an empty result.
    """
    turn = F.coalesce(F.col(turn_col).cast("long"), F.lit(0))
    rows = turns.select(
        F.col(conv_col).alias("conv"), turn.alias("turn"), F.coalesce(F.col(speaker_col).cast("string"), F.lit("unknown")).alias("speaker"),
        F.concat(_content(F.col(text_col)), F.lit(END)).alias("body"), F.lit(0).cast("long").alias("block"),
    )
    if block_turns:
        rows = number_rows(rows, ["conv", "turn", "speaker", "body"], "place")
    cast = rows.where(F.col("speaker") != narrator).select("conv", F.col("speaker").alias("perspective")).distinct()
    if block_turns:
        firsts = rows.groupBy(F.col("conv").alias("begun")).agg(F.min("place").alias("first"))
        cast = cast.join(firsts, cast["conv"].eqNullSafe(firsts["begun"])).drop("begun")
    each = rows.join(cast, rows["conv"].eqNullSafe(cast["conv"])).drop(cast["conv"])
    if block_turns:
        each = each.withColumn("block", F.floor((F.col("place") - F.col("first")) / block_turns).cast("long"))
    own = F.col("speaker") == F.col("perspective")
    head = (
        F.when(own, F.lit("<|assistant|>\n"))
        .when(F.col("speaker") == narrator, F.lit("<|system|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), _content(F.col("speaker")), F.lit("|>\n")))
    )
    of = W.partitionBy("conv", "perspective", "block").orderBy("turn", "speaker", "body").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = each.select("conv", "perspective", "block", own.alias("own"), F.concat(head, "body").alias("piece"), F.char_length("body").alias("length"), F.sum(F.char_length(head) + F.char_length("body")).over(of).alias("end"))
    grouped = placed.groupBy("conv", "perspective", "block").agg(F.sort_array(F.collect_list(F.struct("end", "length", "own", "piece"))).alias("pieces"))  # one dialogue, as it is returned
    spans = F.transform(F.filter("pieces", lambda p: p.own), lambda p: F.concat_ws(":", p.end - p.length, p.length))
    return grouped.select(
        F.col("conv").alias(conv_col), "perspective", "block", F.size("pieces").cast("long").alias("n_turns"),
        F.array_join(F.col("pieces.piece"), "").alias("rendered"), F.array_join(spans, ",").alias("mask"),
    )


ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(turn, 0) AS turn, coalesce(role, 'unknown') AS speaker,
         replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) AS body
  FROM conversations),
b AS (SELECT *, 0::BIGINT AS block FROM t),
c AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
p AS (
  SELECT t.*, c.perspective, speaker = perspective AS own,
         CASE WHEN speaker = perspective THEN '<|assistant|>' || chr(10)
              WHEN speaker = 'system' THEN '<|system|>' || chr(10)
              ELSE '<|user name=' || replace(speaker, '<|', '< |') || '|>' || chr(10) END AS head
  FROM b AS t JOIN c ON t.conv_id IS NOT DISTINCT FROM c.conv_id),
o AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, block
            ORDER BY turn, speaker, body ROWS UNBOUNDED PRECEDING) - length(body) AS begin_at
  FROM p)
SELECT conv_id, perspective, block, count(*) AS n_turns,
       string_agg(head || body, '' ORDER BY turn, speaker, body) AS rendered,
       coalesce(string_agg(CAST(begin_at AS BIGINT) || ':' || length(body), ',' ORDER BY turn, speaker, body) FILTER (WHERE own), '') AS mask
FROM o GROUP BY conv_id, perspective, block
"""
