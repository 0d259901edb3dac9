"""Chat formatting by perspective rotation: every participant once as the assistant.

For each participant of a conversation (every speaker but the context roles) the dialogue is
rendered with that speaker's turns as the assistant's, all other participants' as turns of named
users and context turns as system turns; the mask is the character spans of the assistant's
turns, end mark included.

A conversation may be of any length, so it is rendered in pieces of at most WINDOW turn numbers.
Of a turn number with more than WINDOW rows (ties), every part of those rows is a piece of its
own, dealt by a hash. Ties are in order of that hash, role and text. Pieces meet the participants
of their conversation in a join that splits if one conversation holds most pieces.

Defined results: repeated rows count once; a null role is a user named "unknown" and never the
assistant; a null text is empty; a null turn comes first, in pieces of its own; null conv_ids are
one conversation; a conversation without a participant gives no row; control marks inside a text
are broken by a blank; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import sums_before

WINDOW = 256
CONTEXT = ("system",)


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.col("role").cast("string"),
        F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    ).distinct()


def pieces(turns: DataFrame) -> DataFrame:
    """(conv_id, window, tie, turns): the turns of a piece in order."""
    hashed = turns.withColumn("hash", F.xxhash64("role", "text"))
    crowded = (
        turns.groupBy("conv_id", "turn").count().where(F.col("count") > WINDOW).toDF("crowded_conv", "crowded_turn", "ties")
    )
    same = F.col("conv_id").eqNullSafe(F.col("crowded_conv")) & F.col("turn").eqNullSafe(F.col("crowded_turn"))
    parts = F.ceil(F.col("ties") / F.lit(WINDOW))
    # the hash as a share of all hashes, so that parts are in the order of hashes
    part = F.least(F.floor((F.col("hash") / F.lit(2.0**64) + 0.5) * parts), parts - 1)
    placed = hashed.join(crowded, same, "left").select(
        "conv_id",
        F.floor(F.col("turn") / F.lit(WINDOW)).alias("window"),
        F.when(F.col("ties").isNotNull(), F.struct(F.col("turn"), part.cast("long").alias("part"))).alias("tie"),
        F.struct("turn", "hash", "role", "text").alias("row"),
    )
    return placed.groupBy("conv_id", "window", "tie").agg(F.array_sort(F.collect_list("row")).alias("turns"))


def _segment(row: Column, who: Column) -> Column:
    """A turn as it is rendered: head, body, and whether it is the assistant's."""
    own = F.coalesce(row["role"] == who, F.lit(False))
    head = (
        F.when(own, "<|assistant|>\n")
        .when(row["role"].isin(*CONTEXT), F.concat(F.lit("<|"), row["role"], F.lit("|>\n")))
        .otherwise(F.concat(F.lit("<|user name="), F.coalesce(row["role"], F.lit("unknown")), F.lit("|>\n")))
    )
    return F.struct(head.alias("head"), F.concat(row["text"], F.lit("<|end|>\n")).alias("body"), own.alias("own"))


def perspectives(conversations: DataFrame) -> DataFrame:
    """(conv_id, perspective, first_turn, part, n_turns, text, spans) of every piece and participant.

    spans: array of (start, end) in ``text``, code points, end exclusive.
    """
    turns = _turns(conversations)
    who = (
        turns.where(F.col("role").isNotNull() & ~F.col("role").isin(*CONTEXT))
        .select(F.col("conv_id").alias("own_conv"), F.col("role").alias("perspective"))
        .distinct()
    )
    rendered = (
        pieces(turns)
        .join(who, F.col("conv_id").eqNullSafe(F.col("own_conv")))
        .select(
            "conv_id",
            "perspective",
            F.col("turns")[0]["turn"].alias("first_turn"),
            F.coalesce(F.col("tie.part"), F.lit(0)).cast("long").alias("part"),
            F.size("turns").cast("long").alias("n_turns"),
            F.transform("turns", lambda r: _segment(r, F.col("perspective"))).alias("segments"),
        )
    )
    sizes = F.transform("segments", lambda s: (F.length(s["head"]) + F.length(s["body"])).cast("long"))
    placed = rendered.withColumn("starts", sums_before(sizes))
    spans = F.filter(
        F.transform(
            "segments",
            lambda s, i: F.struct(
                s["own"].alias("own"),
                (F.get("starts", i) + F.length(s["head"])).alias("start"),
                (F.get("starts", i) + F.length(s["head"]) + F.length(s["body"])).alias("end"),
            ),
        ),
        lambda s: s["own"],
    )
    return placed.select(
        "conv_id",
        "perspective",
        "first_turn",
        "part",
        "n_turns",
        F.array_join(F.transform("segments", lambda s: F.concat(s["head"], s["body"])), "").alias("text"),
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("spans"),
    )


#: The same over tables in which no turn number has more than WINDOW rows.
SQL = f"""
WITH turns AS (
  SELECT DISTINCT conv_id, turn, role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations
), who AS (
  SELECT DISTINCT conv_id, role AS perspective FROM turns WHERE role IS NOT NULL AND role <> 'system'
), segments AS (
  SELECT t.conv_id, perspective, turn, floor(turn / {WINDOW}.0) AS win, coalesce(role = perspective, false) AS own,
    CASE WHEN role = perspective THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>'
      ELSE '<|user name=' || coalesce(role, 'unknown') || '|>' END || chr(10) AS head,
    text || '<|end|>' || chr(10) AS body
  FROM turns t JOIN who w ON t.conv_id IS NOT DISTINCT FROM w.conv_id
), placed AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, win ORDER BY turn
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM segments
)
SELECT conv_id, perspective, min(turn) AS first_turn, CAST(0 AS BIGINT) AS part, count(*) AS n_turns,
  string_agg(head || body, '' ORDER BY turn) AS text,
  coalesce(string_agg(CASE WHEN own THEN CAST(CAST(start + length(head) AS BIGINT) AS VARCHAR) || ':'
    || CAST(CAST(start + length(head) + length(body) AS BIGINT) AS VARCHAR) END, ',' ORDER BY turn), '') AS spans
FROM placed GROUP BY conv_id, perspective, win
"""
