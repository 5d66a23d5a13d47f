"""The registered queries of the text operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.staging import scratch_folder
from . import sql
from .bpe import bpe_tokens
from .decontamination import decontaminate
from .fingerprints import fingerprint_documents
from .hard_negatives import hard_negatives
from .language_id import identify
from .line_dedup import line_dedup
from .near_dedup import near_duplicates
from .pii import BASE, find_pii, joined
from .quality_classifier import grade_documents, graded
from .quality_rules import quality_rules
from .suffix_dedup import remove_repeats
from .text import table
from .warc import read_archives, write_archives
from .whitening import whiten

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

Query = Callable[[SparkSession, str], DataFrame]


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, threshold=0.85)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))

    def n(kind):
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = joined(F.filter("pii", lambda s: s["kind"].isin(*BASE)))
    return found.select("doc_id", *[n(k) for k in BASE], F.sha2(base, 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tokens(table(spark, sf_dir, "documents"), TOKENIZER, digests=True)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("text")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_folder(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade_documents(table(spark, sf_dir, "documents"), graded(table(spark, sf_dir, "labels")))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def build() -> dict[str, Query]:
    operators = (
        op1_language, op2_decontamination, op3_near_dedup, op4_suffix_dedup, op5_pii, op6_bpe, op7_quality_rules, op8_warc,
        op9_line_dedup, op10_quality_classifier, op11_fingerprints, op12_hard_negatives, op13_whitening)
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in operators}


def oracles() -> dict[str, str]:
    return dict(sql.ORACLES)
