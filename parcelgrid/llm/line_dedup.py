"""Deletes repeated runs of lines, found by winnowing over line hashes.

A line with words is one unit for every twelve words or part of them, so one long line counts as
a run of its own. A run is ``RUN`` or more successive units (blank lines between them do not
count). Of every window of RUN units the least hash is its fingerprint: two equal windows have
equal fingerprints, wherever they are, so a text region whose fingerprint occurs at one position
only is not repeated and goes no further. Around every fingerprint that occurs at several positions
the match is extended both ways, window by window: all windows that chose it are looked up, and
where the first occurrence of a window (in order of doc_id, text_key, position) is an earlier
one, its lines are deleted. Neighbouring windows overlap, so this deletes maximal runs whole.

So a line goes exactly if it lies in a run of RUN units that occurs earlier, in another document
or in its own. Each deleted line has an equal one that stays.

Popular lines and passages are counted before the shuffle, and each occurrence meets one first
occurrence, never all others.

Defined results: lines are what stands between \\n and are equal if their characters are; lines
without a word stay; a null or empty text stays as it is; repeated rows (same doc_id and text)
count as one document and are treated alike; rows of one doc_id with different texts are told
apart; null doc_ids come first in the order; an empty table gives an empty table; other columns
pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelgrid.sources.tables import materialise

from .rows import BLANKS, SPACE, fresh, let, text_key, text_or_empty

RUN = 5
UNIT_WORDS = 12


def _line_units(lines: Column) -> Column:
    """Per unit (line number from 0, hash)."""

    def units(line: Column, no: Column) -> Column:
        bare = F.btrim(line, F.lit(BLANKS))
        parts = F.ceil(F.size(F.split(bare, f"[{SPACE}]+", -1)) / F.lit(UNIT_WORDS)).cast("int")
        many = let(
            F.xxhash64(line),
            lambda h: F.transform(
                F.sequence(F.lit(1), parts), lambda k: F.struct(no.cast("int").alias("line"), F.xxhash64(h, k).alias("h"))
            ),
        )
        return F.when(bare == "", F.array().cast("array<struct<line:int,h:bigint>>")).otherwise(many)

    return F.flatten(F.transform(lines, units))


def _windows(units: Column) -> Column:
    """Per window: first unit, first and last line, hash, fingerprint, and 1 if the window before chose another unit for it."""

    def window(start: Column) -> Column:
        return let(
            F.slice(units, start + 1, RUN),
            lambda s: let(
                s["h"],
                lambda h: F.struct(
                    start.alias("start"),
                    s[0]["line"].alias("from_line"),
                    s[RUN - 1]["line"].alias("to_line"),
                    F.xxhash64(h).alias("run"),
                    F.array_min(h).alias("print"),
                    (start + RUN - F.array_position(F.reverse(h), F.array_min(h)).cast("int")).alias("at"),
                ),
            ),
        )

    def marked(windows: Column) -> Column:
        return F.transform(
            windows,
            lambda w, i: w.withField("new", F.when(F.get(windows, i - 1)["at"] == w["at"], 0).otherwise(1)).dropFields("at"),
        )

    return let(F.transform(F.sequence(F.lit(0), F.size(units) - RUN), window), marked)


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, units) of the rows that have a window at all."""
    own = docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), text_or_empty().alias("text"))
    lined = own.select("doc_id", "text_key", _line_units(F.split("text", "\n", -1)).alias("units"))
    return lined.where(F.size("units") >= RUN)


def deleted_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, lines): the numbers, from 0, of the lines to delete."""
    held = materialise(units(docs))
    windows = held.select("doc_id", "text_key", F.explode(_windows(F.col("units"))).alias("w")).select(
        "doc_id", "text_key", "w.*"
    )
    # written apart, so that the joins deal out both sides and can split a popular line or passage
    several = materialise(windows.groupBy("print").agg(F.sum("new").alias("n")).where("n > 1").select("print"))
    found = materialise(windows.join(several, "print", "left_semi").drop("print", "new"))
    place = F.struct("doc_id", "text_key", "start")
    runs = found.groupBy("run").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    repeated = materialise(runs.where("first <> last").select("run", "first"))
    later = found.join(repeated, "run").where(place != F.col("first"))
    spans = F.transform(F.collect_set(F.struct("from_line", "to_line")), lambda s: F.sequence(s["from_line"], s["to_line"]))
    return later.groupBy("doc_id", "text_key").agg(F.array_sort(F.array_distinct(F.flatten(spans))).alias("lines"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated runs cut out of ``text``, and an array ``deleted`` of line numbers."""
    a, b, k, n = (fresh(docs, x) for x in ("found_id", "found_key", "own_key", "deleted"))
    gone = materialise(deleted_lines(docs)).toDF(a, b, n).hint("shuffle_hash")
    own = docs.withColumn(k, text_key())
    joined = own.join(gone, own["doc_id"].eqNullSafe(gone[a]) & (own[k] == gone[b]), "left")
    left = let(
        F.split("text", "\n", -1),
        lambda x: F.array_join(
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(n)), lambda i: F.get(x, i)
            ),
            "\n",
        ),
    )
    text = F.when(F.col(n).isNull(), F.col("text")).otherwise(left)
    return joined.select(*[(text.alias(c) if c == "text" else own[c]) for c in docs.columns], n)


#: The same over tables without null or repeated doc_ids and null texts, as what query op5 returns.
SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents
), sized AS (
  SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words FROM lines
), units AS (
  SELECT doc_id, n, line, unnest(range(1, CAST(ceil(words / {UNIT_WORDS}.0) AS BIGINT) + 1)) AS k FROM sized
), placed AS (
  SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n, k) AS pos, sha256(line) || k AS unit FROM units
), windows AS (
  SELECT doc_id, pos, n AS from_line, lead(n, {RUN - 1}) OVER w AS to_line,
    unit || {" || ".join(f"lead(unit, {i}) OVER w" for i in range(1, RUN))} AS run
  FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), later AS (
  SELECT doc_id, from_line, to_line FROM (
    SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS seen FROM windows WHERE run IS NOT NULL) s
  WHERE seen > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(from_line, to_line + 1)) AS n FROM later
)
SELECT l.doc_id, count(g.n) AS n_deleted, coalesce(string_agg(CAST(g.n AS VARCHAR), ',' ORDER BY g.n), '') AS deleted_lines,
  coalesce(string_agg(CASE WHEN g.n IS NULL THEN line END, chr(10) ORDER BY l.n), '') AS text
FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.n = g.n GROUP BY l.doc_id
"""
