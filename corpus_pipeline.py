"""From raw documents to packed training sequences: five stages, each written and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns
of ``documents``; each works on all rows that the stage before kept.

quality_rules drops documents whose posterior quality is low or that fail the base limits;
line_dedup cuts repeated runs of lines out of the texts; simhash_near_dedup keeps one document of
every group of near copies, joined by SimHash (fingerprints of three-word shingles that differ in
two bits or fewer, as op9 finds them) and by what two bits do not reach (five-word shingles, Jaccard
of 0.8 or more, by MinHash); decontamination drops documents that contain a benchmark item;
best_fit_packing returns every piece of every document and its place in a sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelgrid.llm import decontaminate, line_dedup, near_copies as near, packing, quality_rules, simhash
from parcelgrid.llm.queries import tokenizer_path
from parcelgrid.llm.rows import table
from parcelgrid.sources.tables import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_lines(docs).select(docs.columns)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.keep_one(docs, groups=simhash.near_duplicates(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_copies),
    ("decontamination", decontamination),
    ("best_fit_packing", pack),
]

#: SQL can express neither the estimated quality model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
