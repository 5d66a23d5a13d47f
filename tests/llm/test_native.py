"""The native operators: rules, lines and personal data."""

import time

import duckdb
import pytest
from pyspark.sql import functions as F

import brute
from panelforge.llm import queries
from panelforge.llm.line_dedup import line_dedup
from panelforge.llm.pii import before_each, find_pii, mod97
from panelforge.llm.quality_rules import failing, quality_rules

SF = "/root/testdata/sf0.01"
EDGE = [
    (1, None), (2, ""), (3, "Hello World line\nshort\n  hello world LINE \n"), (4, "x"), (5, "hello world line"),
    (6, "one two three four five six\none two three four five six\nÉtude ÉTUDE longue"), (7, "étude étude longue\n\n\n"),
    (8, "a b c d e " * 3000), (9, "\t\x0b \r\n\n"), (10, "Same text twice here.\nSame text twice here."), (11, "line with nbsp here\n" * 2),
]


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by 1").fetchall()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "doc_id long, text string, n_lines string, kept int")


@pytest.mark.parametrize("source", ["edge", "documents"])
def test_line_dedup(spark, documents, source):
    rows = EDGE if source == "edge" else documents
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup(frame(spark, rows)).collect()}
    assert got == brute.line_dedup(rows)


def test_line_dedup_threshold_repeats_and_nulls(spark):
    line = "a line of many documents"
    rows = [(1, line), (1, line), (2, line), (3, line + "\nrest"), (None, line)]
    got = sorted((r.doc_id or 0, r.text) for r in line_dedup(frame(spark, rows), min_docs=3, carry=("kept",)).collect())
    assert got == [(0, line), (1, line), (1, line), (2, ""), (3, "rest")]
    assert line_dedup(frame(spark, rows), min_docs=4).where("n_dropped > 0").count() == 0
    assert line_dedup(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        line_dedup(frame(spark, rows), min_docs=1)


@pytest.mark.parametrize("source", ["edge", "documents"])
def test_rule_counts(spark, documents, source):
    rows = EDGE if source == "edge" else documents
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
           for r in quality_rules(frame(spark, rows)).collect()}
    assert got == {i: brute.rule_counts(t) for i, t in rows}


@pytest.mark.parametrize(("line", "fails"), [
    ("A sentence that ends well.", False), ("an open line of five words", False), ("", False), ("   ", False),
    ("Read more", True), ("*** --- ***", True), ("Home | About | Contact", True), ("%%% $$$ ### a", True),
    ("Copyright 2020, all rights reserved.", True), ("Yes!", False), ("Home » News", True),
    ("menu " + "-" * 60 + "x and so on", False), ("home" + "/a" * 20_000 + " and so on", False), ("home / about- news |team|", True),
    ("Er sagte: „Nein.“", False), ("La lune est belle…", False),
    ("我们今天在公园里看到了很多漂亮的花", False), ("วันนี้เราไปเดินเล่นที่สวนสาธารณะ", False), ("公园", True), ("今日は天気がいいので散歩に行きました", False),
    ("首页 | 新闻 | 关于我们", True), ("Tous droits réservés 2020, une entreprise du groupe.", True), ("Startseite / Impressum", True),
])
def test_line_rules(spark, line, fails):
    assert spark.createDataFrame([(line,)], "x string").select(failing(F.col("x"))).first()[0] is fails


def test_lists_and_scripts_are_parameters(spark):
    chinese = "我们今天在公园里看到了很多漂亮的花\n他们明天要去学校学习新的课程和语言"
    rows = [(1, chinese), (2, "Etusivu / uutiset / muuta\n" + "a line that is long enough to stay here. " * 3), (3, None)]
    plain = {r.doc_id: r for r in quality_rules(frame(spark, rows)).collect()}
    assert plain[1].n_failed_lines == 0 and plain[1].base_failed and not plain[1].kept and plain[2].n_failed_lines == 0
    wide = {r.doc_id: r for r in quality_rules(frame(spark, rows), count_unspaced=True, navigation=("etusivu",), boilerplate=()).collect()}
    assert wide[1].kept and wide[1].text == chinese and wide[2].n_failed_lines == 1 and not wide[3].kept


def test_rules_equal_sql_on_odd_rows(spark):
    from panelforge.llm.sql import RULES
    import pandas as pd
    rows = EDGE + [(20, "公园\n我们今天在公园里看到了很多漂亮的花\nวันนี้เราไปเดินเล่นที่สวน"), (21, "Menü | Suche\nDatenschutzerklärung lesen, bitte.\nconditions d’utilisation of a site in a line.")]
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841, read by its name
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_failed_lines", "kept"]
    want = sorted(duckdb.sql(f"select {', '.join(names)} from ({RULES})").fetchall())
    assert sorted(tuple(r) for r in quality_rules(frame(spark, rows)).select(names).collect()) == want


def test_documents_that_lose_too_much_are_rejected(spark):
    good = "This sentence is long enough to stay in the text and ends as it should do here.\n"
    bad = "Home | About | Contact | Imprint | News | Weather | Sports\n"
    rows = [(1, good + bad), (2, good + bad * 4), (3, None), (4, good + "Read more")]
    out = {r.doc_id: r for r in quality_rules(frame(spark, rows), carry=("n_lines",)).collect()}
    assert [out[i].kept for i in (1, 2, 3, 4)] == [True, False, False, True]
    assert out[4].text == good.rstrip("\n") and out[4].n_lines == "clash"
    assert quality_rules(frame(spark, [])).count() == 0


PII = [
    (1, "mail a.b@c.de_x@y.org and x@y, @z.de a@b..c a@-.-"), (2, "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3"),
    (3, "4111 1111 1111 1111 and 4111-1111-1111-1112, 41111111111111110 12  4111111111111111 5 4111111111111111"),
    (4, "call +49 (30) 1234-5678. +1 2 +123456789012345678 ++49 30 123 456 789"), (5, None), (6, ""),
    (7, "é😀 a@b.cd 😀 1.1.1.1 é"), (8, "9" * 5000 + " " + "a" * 30000 + "@"), (9, "4 " * 4000), (10, "a@b.c" * 300),
    (11, "iban DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, XX00 1234 5678 9012"),
    (12, "her social security number 123-45-6789; part 123-45-6789-1"), (13, "serial 123-45-6789 " + "x" * 60),
]


@pytest.mark.parametrize("source", ["edge", "documents"])
def test_base_pii(spark, documents, source):
    rows = PII if source == "edge" else documents
    for r in find_pii(frame(spark, rows)).collect():
        want = brute.base_pii(dict(rows)[r.doc_id])
        got = {k: [(s.start, s.end) for s in r.pii if s.kind == k] for k in want}
        assert got == want, r.doc_id
        assert all((dict(rows)[r.doc_id] or "")[s.start:s.end] == s.value for s in r.pii)


def test_added_kinds_and_scores(spark):
    out = {r.doc_id: [(s.kind, s.value) for s in r.pii] for r in find_pii(frame(spark, PII)).collect()}
    assert out[11] == [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432")]
    assert out[12] == [("ssn", "123-45-6789")] and out[13] == []
    near, far = (r.pii[0].score for r in find_pii(frame(spark, [(1, "card: 4111111111111111"), (2, "x 4111111111111111")])).orderBy("doc_id").collect())
    assert near > far
    assert spark.range(1).select(mod97(F.lit("DE89370400440532013000"))).first()[0] == 1
    assert find_pii(frame(spark, [])).count() == 0


def test_context_words_stand_alone(spark):
    rows = [(1, "the hotel antisocial club serial 123-45-6789"), (2, "insecurity in room 123-45-6789"), (3, "SSN: 123-45-6789"),
            (4, "123-45-6789 (social security)"), (5, 'api_key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'),
            (6, "digest 04dbebab91ab85687d33eeaaf9ac699e1188f962"), (7, "token " + "ab1" * 12), (8, "secret " + "a1B2c3D4e5" * 9),
            (9, "iban DE89370400440532013000 but DE8937040044053201300 not")]
    out = {r.doc_id: [(s.kind, s.value) for s in r.pii] for r in find_pii(frame(spark, rows)).collect()}
    assert [out[i] for i in (1, 2, 6, 7, 8)] == [[]] * 5 and out[3] == out[4] == [("ssn", "123-45-6789")]
    assert out[5] == [("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962")] and out[9] == [("iban", "DE89370400440532013000")]


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 1023, 1024, 1025, 5000])
def test_sums_before_each_place(spark, n):
    sizes = [i * 7 % 13 for i in range(n)]
    got = spark.createDataFrame([(sizes,)], "x array<int>").select(before_each(F.col("x"))).first()[0]
    assert got == [sum(sizes[:i]) for i in range(n)]


def test_many_matches_take_time_in_proportion(spark):
    def seconds(n):
        df = frame(spark, [(1, " ".join(f"user{i}@mail{i}.org" for i in range(n)))])
        start = time.perf_counter()
        found = find_pii(df, carry=("text",)).selectExpr(
            "size(pii) as n", "pii[size(pii) - 1].end as end", "char_length(text) as whole").first()
        assert found.n == n and found.end == found.whole
        return time.perf_counter() - start

    seconds(100)
    assert seconds(32_000) < 12 * max(seconds(4_000), 0.5)


def test_pii_query_digest(spark, documents):
    for r in queries.op5_pii(spark, SF).collect():
        want = brute.base_pii(dict(documents)[r.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for k, v in want.items() for a, b in v)
        assert r.base_sha256 == brute.sha(text) and (r.spans == text or r.spans.startswith(text))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(v) for v in want.values()]


@pytest.mark.parametrize("name", ["op5_pii", "op7_quality_rules", "op9_line_dedup"])
def test_no_python_on_the_main_path(spark, name):
    plan = queries.build()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
