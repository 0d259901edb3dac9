"""JSON documents of any size and layout cut into their objects by many tasks.

A file is read in pieces that end at closing braces, so that one line or a million make no
difference and Spark's file splits (blocks) are read by tasks of their own. Where a piece stands in
the document depends on all that goes before it: whether it begins inside a string, and how many
braces and brackets are open. Each block works that out for itself under both beginnings, outside
and inside a string; the blocks' results, one row each, are then composed in file order, which tells
every block which of the two holds and at what depth it begins. (A piece never ends inside an
escape, since a closing brace cannot be escaped.)

With that, each piece is known to end an object or not: a whole document (depth 0) or an element of
an array that is a member of the document (depth 2, and the bracket last opened there is square).
The pieces of one object are joined by its number, so a task holds objects, not files. A file that
ends within a string or an object is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .stages import materialise

#: Rounds in which matched brackets vanish; deeper ones only make a text longer.
NESTED = 6
QUOTE = '"'


def raw_pieces(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, start, id, size, piece): texts up to each closing brace; id ascends within a block (file, start)."""
    read = spark.read.option("lineSep", "}").text(paths)
    return read.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"),
        F.col("_metadata.file_size").alias("size"),
        F.col("value").alias("piece"),
    )


def _brackets(plain: Column, inside: bool) -> Column:
    """The brackets of a piece outside of strings, matched pairs removed: closing ones, then opening ones."""
    text = F.regexp_replace(plain, r'^[^"]*("|$)', "") if inside else plain
    text = F.regexp_replace(text, r'"[^"]*("|$)|[^\[\]{}"]+', "")
    for _ in range(NESTED):
        text = F.regexp_replace(text, r"\[\]|\{\}", "")
    return text


def plain_text(text: Column) -> Column:
    """JSON text without its escapes, so that every quote left opens or closes a string."""
    return F.regexp_replace(text, r"(?s)\\.", "")


def unmatched(plain: Column, inside: bool = False) -> Column:
    """The brackets outside of strings that the text itself does not match: closing ones, then opening ones."""
    return _brackets(plain, inside)


def _count(text: Column, kinds: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{kinds}]+", ""))


def _net(brackets: Column) -> Column:
    return 2 * _count(brackets, r"\[{") - F.length(brackets)


def scanned(raw: DataFrame) -> DataFrame:
    """Each piece with its unmatched brackets, if its block begins outside (out) or inside (in) a string.

    The closing brace after the piece counts with it; whether a file's last piece has one is told by
    the file's size.
    """
    order = Window.partitionBy("file", "start").orderBy("id")
    held = raw.select("*", F.explode(F.array(F.concat(plain_text(F.col("piece")), F.lit("}")))).alias("plain"))
    held = held.select("*", F.explode(F.array(_count(F.col("plain"), QUOTE) % 2)).alias("quotes"))
    before = F.sum("quotes").over(order.rowsBetween(Window.unboundedPreceding, -1))
    held = held.withColumn("odd", F.coalesce(before, F.lit(0)) % 2)
    outside, inside = unmatched(F.col("plain")), unmatched(F.col("plain"), True)
    out, within = (F.when(F.col("odd") == k, outside).otherwise(inside) for k in (0, 1))
    deep = F.col("out").rlike(r"[\[{].*[\]}]") & F.coalesce("within", within).rlike(r"[\[{].*[\]}]")
    checked = F.when(deep, F.raise_error(F.lit("arrays are nested too deep to follow"))).otherwise(F.col("out"))
    # a file begins outside a string, and so does its first block; generators keep each text from being worked out for every use
    told = F.struct(out.alias("out"), F.when(F.col("start") > 0, within).alias("within"))
    held = held.select("*", F.inline(F.array(told)))
    return held.select("file", "start", "id", "size", "piece", "quotes", "odd", checked.alias("out"), "within")


def composed(pieces: DataFrame) -> DataFrame:
    """(file, start, odd0, depth0, closes, last): where each block of a file begins; one row per block.

    ``closes`` tells of the file's last block whether its last piece ended in a brace.
    """
    blocks = pieces.groupBy("file", "start").agg(
        (F.sum("quotes") % 2).alias("parity"), F.sum(_net(F.col("out"))).alias("net_out"), F.sum(_net(F.col("within"))).alias("net_in"),
        F.sum(F.octet_length("piece") + 1).alias("bytes"), F.max("size").alias("size"), F.max("id").alias("last_id"),
    )
    file = Window.partitionBy("file").orderBy("start")
    past = file.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("odd0", F.coalesce(F.sum("parity").over(past), F.lit(0)) % 2)
    blocks = blocks.withColumn("net", F.when(F.col("odd0") == 0, F.col("net_out")).otherwise(F.col("net_in")))
    over = F.sum("bytes").over(Window.partitionBy("file")) - F.col("size")
    is_last = F.lead("start").over(file).isNull()
    return blocks.select(
        "file", "start", "odd0", F.coalesce(F.sum("net").over(past), F.lit(0)).alias("depth0"),
        F.when(is_last, F.col("last_id")).alias("last_id"), over.isin(0, -3).alias("closes"),
    )


def placed(pieces: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each piece with its depth before and after and the ends of objects before it in its block.

    An end at depth 2 is sure, or holds only if the bracket that an earlier block left open there is square.
    """
    order = Window.partitionBy("file", "start").orderBy("id")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = pieces.join(blocks, ["file", "start"])
    held = held.withColumn("brackets", F.when(F.col("odd0") == 0, F.col("out")).otherwise(F.col("within")))
    held = held.withColumn("before", F.col("depth0") + F.coalesce(F.sum(_net(F.col("brackets"))).over(past), F.lit(0)))
    held = held.withColumn("after", F.col("before") + _net(F.col("brackets")))
    lowest = F.col("before") - _count(F.col("brackets"), r"\]}")
    opened = F.regexp_replace("brackets", r"[\]}]+", "")
    kind = F.when((lowest < 2) & (F.col("after") >= 2), F.substr(opened, (2 - lowest).cast("int"), F.lit(1)))
    held = held.withColumn("kind", kind).withColumn("known", F.last("kind", True).over(so_far))
    ends = (F.col("odd0") + F.col("odd") + F.col("quotes")) % 2 == 0
    final = F.coalesce(F.col("id") == F.col("last_id"), F.lit(False))
    bare = final & ~F.col("closes")
    sure = ends & ~bare & ((F.col("after") == 0) | ((F.col("after") == 2) & (F.col("known") == "[")))
    maybe = ends & ~bare & (F.col("after") == 2) & F.col("known").isNull()
    held = held.withColumns({"sure": F.coalesce(sure, F.lit(False)).cast("int"), "maybe": maybe.cast("int"), "bare": bare, "final": final, "open_string": ~ends})
    counts = {f"{c}_before": F.coalesce(F.sum(c).over(past), F.lit(0)) for c in ("sure", "maybe")}
    return held.withColumns(counts).select(
        "file", "start", "id", "piece", "before", "after", "kind", "sure", "maybe", "bare", "final", "open_string", *counts
    )


def objects(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, nr, text, before, after): the texts up to each end of a document or of an element of a member array.

    ``before`` and ``after`` are the depths there: a text that goes from 0 to 0 is a whole document,
    one that ends at 2 an element, after what precedes it in the document.
    """
    pieces = materialise(scanned(raw_pieces(spark, paths)))
    rows = materialise(placed(pieces, composed(pieces)))
    blocks = rows.groupBy("file", "start").agg(
        F.max(F.when(F.col("kind").isNotNull(), F.struct("id", "kind"))).alias("last"), F.sum("sure").alias("sure_all"), F.sum("maybe").alias("maybe_all")
    )
    past = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("square", F.coalesce(F.last("last.kind", True).over(past) == "[", F.lit(False)).cast("int"))
    ends = F.sum(F.col("sure_all") + F.col("square") * F.col("maybe_all")).over(past)
    blocks = blocks.select("file", "start", "square", F.coalesce(ends, F.lit(0)).alias("ends_before"))
    number = F.col("ends_before") + F.col("sure_before") + F.col("square") * F.col("maybe_before")
    own = rows.join(blocks, ["file", "start"]).withColumn("nr", number)
    texts = own.groupBy("file", "nr").agg(
        F.array_sort(F.collect_list(F.struct("start", "id", "piece", "before", "after", "bare", "open_string"))).alias("p"), F.max("final").alias("final")
    )
    end = F.element_at("p", -1)
    text = F.array_join(F.transform("p", lambda x: x["piece"]), "}")
    whole = F.when(end["bare"], text).otherwise(F.concat(text, F.lit("}")))
    blank = F.trim(F.translate(text, "\r\n\t", "   ")) == ""
    sound = F.when(end["bare"], blank & (F.col("p")[0]["before"] == 0)).otherwise(~end["open_string"] & (end["after"] == 0))
    broken = F.col("final") & ~sound
    lost = F.raise_error(F.concat(F.lit("a JSON file ends within an object and could not be read: "), F.col("file"))).cast("string")
    return texts.select(
        "file", "nr", F.when(broken, lost).otherwise(whole).alias("text"), F.col("p")[0]["before"].alias("before"),
        F.when(end["bare"], F.col("p")[0]["before"]).otherwise(end["after"]).alias("after"),
    )
