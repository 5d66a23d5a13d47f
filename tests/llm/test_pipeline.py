"""The stages against plain Python, one after another, and their handling of odd rows."""

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
import corpus_pipeline as cp
from test_decontamination import slow_coverage, tokens
from test_near_dedup import all_pairs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in cp.STAGES:
        made = stage(spark, docs, SF).cache()
        out.append((docs, made))
        docs = made
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_names_and_columns(spark, stages):
    assert [n for n, _ in cp.STAGES] == ["quality rules", "line dedup", "near dedup", "decontamination", "bpe"]
    columns = spark.read.parquet(f"{SF}/documents.parquet").dtypes
    assert all(made.dtypes == columns for _, made in stages[:-1])


def test_rules(stages):
    before, after = map(texts, stages[0])
    gone = {i for i in before if brute.rule_counts(before[i])[5]}
    assert gone and not gone & set(after)
    assert all(set(after[i].split("\n")) <= set(before[i].split("\n")) for i in after)
    prose = [i for i, t in before.items() if i not in gone and all(x.rstrip().endswith(".") and len(x.split()) > 3 and "%" not in x and "|" not in x for x in t.split("\n") if x.strip())]
    assert prose and all(after[i] == before[i] for i in prose)


def test_lines(stages):
    before, after = map(texts, stages[1])
    assert after == {i: t for i, (_, _, t) in brute.line_dedup(list(before.items())).items()}


def test_near_duplicates(stages):
    before, after = map(texts, stages[2])
    groups = all_pairs(list(before.items()), 5, 80)
    assert after == {i: t for i, t in before.items() if groups[i][1] == i}


def test_leaks(stages):
    before, after = map(texts, stages[3])
    items = [tokens(t) for (t,) in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()]
    for i, t in before.items():
        words = tokens(t)
        seeds = {tuple(words[k:k + 5]) for k in range(len(words))}
        near = [x for x in items if any(tuple(x[k:k + 5]) in seeds for k in range(len(x) - 4))]
        assert (i not in after) == any(slow_coverage(words, x, 5) >= 0.5 for x in near)


def test_tokens(stages):
    before = texts(stages[4][0])
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = stages[4][1].collect()
    assert {r.doc_id for r in rows} == set(before)
    for r in rows:
        assert list(r.ids) == library.encode(before[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_run_is_the_stages(spark, stages):
    got = {r.doc_id: r.ids_sha256 for r in cp.run(spark, SF).collect()}
    assert got == {r.doc_id: r.ids_sha256 for r in stages[4][1].collect()}


def test_odd_rows(spark):
    good = "This sentence is long enough to stay in the text and it ends as it should. " * 2
    rows = [(1, None, None, None, None), (None, good, "en", None, 3), (2, "", "en", "s", 0), (3, good + "x", None, "s", 1), (3, good + "x", None, "s", 1),
            (4, "word " * 30_000, "en", "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = docs.withColumn("kept", F.lit(1)).withColumn("items", F.lit("x")).withColumn("id", F.lit(1)).withColumn("n_lines", F.lit(2))
    for start in (docs, extra, docs.limit(0)):
        now = start
        for _, stage in cp.STAGES:
            now = stage(spark, now, SF)
        assert now.count() <= len(rows)
