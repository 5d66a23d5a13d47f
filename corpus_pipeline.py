"""A corpus pipeline: clean, drop shared lines, drop near duplicates, drop benchmark leaks, encode.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept; all but the last return the
columns of ``documents``. ``run`` writes every stage's result as Parquet and reads it back as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforge.llm.bpe import bpe_tokens
from panelforge.llm.decontamination import decontaminate
from panelforge.llm.line_dedup import line_dedup
from panelforge.llm.near_dedup import near_duplicates
from panelforge.llm.quality_rules import quality_rules
from panelforge.llm.text import table
from panelforge.sources.staging import staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and so do the documents that the rules reject. Texts in scripts that don't part words are counted by
    characters. A row without id is judged like any other."""
    return _documents(quality_rules(docs, carry=("lang", "source"), count_unspaced=True).where("kept"))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A line of several documents stays in the one with the smallest id. A text may be empty then; its row stays."""
    return _documents(line_dedup(docs, carry=("lang", "source")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays (five words, similarity 0.8). Rows without id stay."""
    kept = near_duplicates(docs).where("kept").select("doc_id").distinct()
    known = docs.where(F.col("doc_id").isNotNull()).join(kept.hint("shuffle_hash"), "doc_id", "left_semi")
    return known.unionByName(docs.where(F.col("doc_id").isNull())).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item's tokens or more go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=COLUMNS[1:]).where(~F.col("contaminated")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, their number, and digests of the ids and of the text decoded from them."""
    return bpe_tokens(docs, TOKENIZER, digests=True, ids=True, carry=("lang", "source"))


STAGES = [
    ("quality rules", clean), ("line dedup", drop_shared_lines), ("near dedup", drop_near_duplicates),
    ("decontamination", drop_leaks), ("bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = staged(docs, name.replace(" ", "-"))
    return docs
