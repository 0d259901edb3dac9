"""The registered queries: every operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, license_scan, line_dedup, lm_scoring, packing, phrases, pii, quality_rules, simhash, suffix_dedup, token_alignment, warc
from .rows import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def alignment_files() -> token_alignment.Files:
    import public_tokenizers as public

    names = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")
    whole, ranks, pieces = map(public.path, names)
    return token_alignment.Files(whole, ranks, public.PATTERN, pieces)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "votes", "posterior",
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.licenses(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join(F.array_sort("licenses"), ",").alias("licenses"),
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[F.size(k.name).cast("long").alias(f"n_{k.name}") for k in pii.KINDS],
        F.sha2(pii.listed(pii.all_spans(pii.BASE)), 256).alias("base_sha256"),
        pii.listed(pii.all_spans()).alias("spans"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs)
    n_deleted = F.coalesce(F.size("deleted"), F.lit(0)).cast("long")
    lines = F.coalesce(F.array_join("deleted", ","), F.lit(""))
    return out.select("doc_id", n_deleted.alias("n_deleted"), lines.alias("deleted_lines"), "text")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = warc.archive_folder(pages)
    index = warc.write_archives(pages, folder)
    read = warc.read_records(index, folder)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_shingles", "containment").distinct()


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat_format.perspectives(table(spark, sf_dir, "conversations"))
    spans = F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return found.withColumn("spans", F.array_join(spans, ","))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.without_repeats(table(spark, sf_dir, "documents")))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_alignment.counted(table(spark, sf_dir, "documents"), alignment_files())
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_quality": op2_quality,
    "op3_licenses": op3_licenses,
    "op4_pii": op4_pii,
    "op5_line_dedup": op5_line_dedup,
    "op6_warc": op6_warc,
    "op7_decontamination": op7_decontamination,
    "op8_chat_format": op8_chat_format,
    "op9_simhash": op9_simhash,
    "op10_packing": op10_packing,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_phrases": op12_phrases,
    "op13_token_alignment": op13_token_alignment,
}

#: DuckDB SQL by query, where SQL can express it.
ORACLES: dict[str, str] = {
    "op3_licenses": license_scan.SQL,
    "op5_line_dedup": line_dedup.SQL,
    "op6_warc": warc.SQL,
    "op7_decontamination": decontaminate.SQL,
    "op8_chat_format": chat_format.SQL,
    "op11_suffix_dedup": suffix_dedup.SQL,
    "op12_phrases": phrases.SQL,
}
