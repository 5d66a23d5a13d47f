"""Archives: what is written comes back, and damage is seen."""

import gzip
import os

import pytest
from pyspark.sql.utils import AnalysisException

import brute
from panelforge.llm import warc

ROWS = [
    (1, "http://a/é\r\nx", "x" * 100), (2, None, "x" * 100), (3, "u", "x" * 99), (4, "u", "x" * 99), (5, "u", None), (6, "u", ""),
    (7, "u", "é😀" * 40_000), (8, "u", "é😀" * 40_000), (9, "u", "a\r\n\r\nWARC/1.1\r\n\r\n" * 3000), (10, "u", "0\r\n\r\n"),
    (None, "u", "x" * 100), (2, "v", "x" * 100), (11, "u", "y" * 16_300), (12, "u", "z" * 65_536),
]


def written(spark, rows, tmp_path, **options):
    path = str(tmp_path / "archives")
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], "page_id long, url string, html string, digest string, number int")
    warc.write_archives(df, path, **options)
    return path


@pytest.mark.parametrize("options", [{}, {"segment_bytes": 1000, "records_per_file": 7}])
def test_round_trip(spark, tmp_path, options):
    got = warc.read_archives(spark, written(spark, ROWS, tmp_path, **options)).collect()
    assert len(got) == len(ROWS) and all(r.complete for r in got)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    for i, _, html in ROWS:
        data = (html or "").encode()
        for r in by[i]:
            assert r.payload_bytes == len(data) and r.payload_digest == brute.sha(data)
            assert r.payload == (None if r.record_type == "revisit" else data)
    assert {i: [(r.record_type, r.refers_to) for r in v] for i, v in by.items() if v[0].record_type == "revisit"} == {
        2: [("revisit", 1)] * 2, 8: [("revisit", 7)]}


def test_no_rows(spark, tmp_path):
    path = written(spark, [], tmp_path)
    assert not [f for f in os.listdir(path) if f.endswith(".gz")] or warc.read_archives(spark, path).count() == 0


def test_missing_folder(spark, tmp_path):
    with pytest.raises(AnalysisException):
        warc.read_archives(spark, str(tmp_path / "none")).count()


def test_damage_is_seen(spark, tmp_path):
    parts = warc.records(1, "u", b"p" * 5000, brute.sha(b"p" * 5000), None, 1000)
    wrong = warc.records(2, "u", b"q", brute.sha(b"other"), None)
    whole = warc.records(3, "u", b"r" * 5000, brute.sha(b"r" * 5000), None, 1000)
    data = b"".join(r + warc.END for r in [*parts[:2], *parts[3:], *wrong, *reversed(whole)])
    os.makedirs(tmp_path / "a")
    with gzip.open(tmp_path / "a" / "x.gz", "wb") as f:
        f.write(data)
    got = {r.page_id: r for r in warc.read_archives(spark, str(tmp_path / "a")).collect()}
    assert {i: r.complete for i, r in got.items()} == {1: False, 2: False, 3: True}
    assert got[1].payload is None and got[3].payload == b"r" * 5000


def test_broken_framing_raises():
    with pytest.raises(ValueError):
        list(warc.parse(b"garbage"))
    with pytest.raises(ValueError):
        list(warc.parse(warc.record("response", {}, b"abc") + b"x"))


@pytest.mark.parametrize("body", [b"", b"5\r\nabc", b"zz\r\n\r\n", b"3\r\nabc\r\n"])
def test_bad_chunks(body):
    assert warc.unchunked(body) is None
