"""What the operators share: reading tables, row keys, decisions joined back to their rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word rule: blank and the characters 9 to 13.
SPACE = "\\x20\\x09-\\x0D"
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_key() -> Column:
    """Tells apart rows of one doc_id; equal texts have equal keys."""
    return F.xxhash64(text_or_empty())


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores until no column of the table has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, refused: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, text_key) is not in ``refused``; a null id equals a null id.

    Both sides are dealt by key and the refused keys of a partition are held in a hash table, so
    the plan is the same at every size and the texts are neither sorted nor met by a broadcast.
    """
    a, b, k = (fresh(docs, n) for n in ("refused_id", "refused_key", "own_key"))
    gone = refused.select(F.col("doc_id").alias(a), F.col("text_key").alias(b)).distinct().hint("shuffle_hash")
    own = docs.withColumn(k, text_key())
    return own.join(gone, own["doc_id"].eqNullSafe(gone[a]) & (own[k] == gone[b]), "left_anti").drop(k)


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` text bytes, so that a task's memory is bounded."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + (n or 0) > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n or 0
        if start < len(sizes):
            yield batch.slice(start)


def byte_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def _scan(values: Column) -> Column:
    """0 and the sums of the first one, two, ... values."""
    start = F.array(F.lit(0).cast("long"))
    return F.aggregate(values, start, lambda sums, v: F.concat(sums, F.array(F.element_at(sums, -1) + v)))


def sums_before(values: Column, block: int = 256) -> Column:
    """For each value of an array of longs the sum of those before it.

    In blocks and then over the blocks: appending to one growing array would cost the square of
    its length.
    """

    def joined(scans: Column) -> Column:
        return let(
            _scan(F.transform(scans, lambda s: F.element_at(s, -1))),
            lambda starts: F.flatten(
                F.transform(
                    scans, lambda s, j: F.transform(F.slice(s, 1, F.size(s) - 1), lambda x: x + F.get(starts, j))
                )
            ),
        )

    blocks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / F.lit(block)).cast("int"))
    scans = F.transform(blocks, lambda j: let(F.slice(values, j * block + 1, F.lit(block)), _scan))
    return F.when(F.size(values) == 0, F.array().cast("array<bigint>")).otherwise(let(scans, joined))
