"""The encoder against the tokenizers library."""

import random

import duckdb
import pytest
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

import brute
from panelforge.llm import queries
from panelforge.llm.bpe import WordBpe, bpe_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.01"
LIBRARY, OWN = Tokenizer.from_file(PATH), WordBpe(PATH)


def same(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    got = OWN.encode(text).tolist()
    assert got == want, text
    assert OWN.decode(got) == LIBRARY.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", [
    "", " ", "a", "Hello WORLD's don't I'll we've I'd he'm they're", "12345 1a2b", "naïve café é ΑΣ ΣΑΣ ΟΔΟΣ İI ß ǅ",
    "x<|endoftext|>y <|startoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext", "tab\tnew\nline\r\x0b\x0c\x1c\x1d\x85\xa0 　᠎​.",
    "日本語テスト 한국어 العربية 😀😃 👩‍👩‍👧", "a" * 500, "ab" * 300, "!" * 200, "''s ' 's'", "the" * 100, "१२३ ½ Ⅷ ²", "́á",
])
def test_fixed_texts(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(text)


def test_random_words():
    rng = random.Random(5)
    for _ in range(3000):
        same("".join(rng.choice("theinganrestoéöñ'") for _ in range(rng.randint(1, 30))))


def test_caches_may_turn_over(monkeypatch):
    monkeypatch.setattr("panelforge.llm.bpe.CACHED", 4)
    small = WordBpe(PATH)
    text = "one two three four five six one two three seven one"
    assert small.encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_query_equals_the_library(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    got = {r.doc_id: r for r in queries.op6_bpe(spark, SF).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        ids = LIBRARY.encode(t, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == brute.sha(" ".join(map(str, ids)))
        assert got[i].decoded_sha256 == brute.sha(LIBRARY.decode(ids, skip_special_tokens=False))


def test_edges(spark):
    rows = [(1, None, 5), (2, "", 6), (None, "a b", 7), (3, "x" * 200_000, 8), (3, "x", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = {(r.doc_id, r.n): r for r in bpe_tokens(df.withColumnRenamed("ids", "n"), PATH, carry=("n",)).collect()}
    assert len(out) == 5 and out[1, 5].ids == [] and out[1, 5].decoded == ""
    assert out[3, 8].ids == LIBRARY.encode("x" * 200_000, add_special_tokens=False).ids
    assert bpe_tokens(df.limit(0), PATH).count() == 0
