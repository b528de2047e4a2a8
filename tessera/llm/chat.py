"""Chat formatting by multi-party perspective rotation.

A conversation is rendered once for every participant: that speaker's turns
are the assistant's, everybody else's are a user's with a name, and the roles
in ``Template.fixed`` (instructions) stay what they are.  The loss mask covers
what the assistant says, and the end mark behind it.

A rendering comes in segments of ``Template.segment`` turn numbers, so that no
row outgrows its turns: a conversation of any length is dealt over as many
groups, and its renderings are its segments' texts one after the other.  All
of it is DataFrame expressions.

A null role speaks as ``unknown``; a null text is empty; null turns come first,
in a segment of their own (-1); rows of a null conv_id are one conversation;
equal turns are ordered by role and text, and repeated rows are rendered as
often as they occur.  A conversation of fixed roles only has no participant
and no rows; an empty table gives none.  Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    fixed: tuple[str, ...] = ("system",)
    unknown: str = "unknown"
    segment: int = 64


def rotate(conversations: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, segment, participant, rendered, n_turns, n_masked_turns, mask, n_masked_chars).

    mask: for each turn of the segment the start and end (in characters of
    ``rendered``) of what is learned from, as "start-end" joined by commas.
    """
    turns = conversations.select(
        F.col(conv_col).alias("conv_id"),
        F.coalesce(F.floor(F.col(turn_col) / template.segment), F.lit(-1)).cast("long").alias("segment"),
        F.struct(
            F.coalesce(F.col(turn_col).cast("long"), F.lit(-(1 << 62))).alias("turn"),
            F.coalesce(F.col(role_col), F.lit(template.unknown)).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        ).alias("said"),
    )
    fixed = F.col("said.role").isin(*template.fixed) if template.fixed else F.lit(False)
    # a participant takes part in the whole conversation, whatever the segment
    participants = turns.filter(~fixed).select(F.col("conv_id").alias("of"), F.col("said.role").alias("participant")).distinct()
    segments = turns.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list("said")).alias("turns"))
    each = segments.join(participants, F.col("conv_id").eqNullSafe(F.col("of")))

    def head(turn):
        mine = turn["role"] == F.col("participant")
        stays = turn["role"].isin(*template.fixed) if template.fixed else F.lit(False)
        who = F.when(stays, turn["role"]).when(mine, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), turn["role"]))
        return F.concat(F.lit(template.start), who, F.lit("\n"))

    tail = template.end + "\n"
    piece = F.transform("turns", lambda t: F.struct(head(t).alias("head"), t["text"].alias("text"), (t["role"] == F.col("participant")).alias("mine")))
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"), F.lit(0).cast("long").alias("chars")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["head"]) + F.length(p["text"]) + len(tail)).cast("long").alias("at"),
            F.when(p["mine"], F.concat(a["spans"], F.array(F.concat_ws("-", (a["at"] + F.length(p["head"])).cast("string"), (a["at"] + F.length(p["head"]) + F.length(p["text"]) + len(template.end)).cast("string"))))).otherwise(a["spans"]).alias("spans"),
            (a["chars"] + F.when(p["mine"], F.length(p["text"]) + len(template.end)).otherwise(0)).cast("long").alias("chars"),
        ),
    )
    done = each.withColumn("pieces", piece).withColumn("marked", spans)
    return done.select(
        "conv_id",
        "segment",
        "participant",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["text"], F.lit(tail))), "").alias("rendered"),
        F.size("pieces").cast("long").alias("n_turns"),
        F.size("marked.spans").cast("long").alias("n_masked_turns"),
        F.array_join("marked.spans", ",").alias("mask"),
        F.col("marked.chars").alias("n_masked_chars"),
    )


#: The same for a table ``conversations``, with the default template, in DuckDB.
ROTATE_SQL = r"""
WITH turns AS (
    SELECT conv_id, coalesce(CAST(floor(turn / 64.0) AS BIGINT), -1) AS segment,
           coalesce(CAST(turn AS BIGINT), -4611686018427387904) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
    FROM conversations
), participants AS (
    SELECT DISTINCT conv_id, role AS participant FROM turns WHERE role <> 'system'
), pieces AS (
    SELECT t.conv_id, t.segment, p.participant, row_number() OVER w AS k, t.role = p.participant AS mine, t.text,
           '<|im_start|>' || CASE WHEN t.role = 'system' THEN t.role WHEN t.role = p.participant THEN 'assistant' ELSE 'user name=' || t.role END || chr(10) AS head
    FROM turns t JOIN participants p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
    WINDOW w AS (PARTITION BY t.conv_id, t.segment, p.participant ORDER BY t.turn, t.role, t.text)
), placed AS (
    SELECT *, sum(length(head) + length(text) + 11) OVER (PARTITION BY conv_id, segment, participant ORDER BY k) - length(text) - 11 AS said_at
    FROM pieces
)
SELECT conv_id, segment, participant,
       string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY k) AS rendered,
       count(*) AS n_turns,
       count(*) FILTER (mine) AS n_masked_turns,
       coalesce(string_agg(CAST(CAST(said_at AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(said_at + length(text) + 10 AS BIGINT) AS VARCHAR), ',' ORDER BY k) FILTER (mine), '') AS mask,
       CAST(coalesce(sum(length(text) + 10) FILTER (mine), 0) AS BIGINT) AS n_masked_chars
FROM placed GROUP BY conv_id, segment, participant
"""
