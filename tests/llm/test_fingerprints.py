"""Locally consistent parsing: against a plain parser, independence of offsets, neighbours across tasks."""

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import brute
from panelforge.llm import fingerprints as fp, queries
from panelforge.llm.text import mixed

SF = "/root/testdata/sf0.01"


def toss(own, left):
    if own == left:
        return 16
    place = ((own ^ left) & -(own ^ left)).bit_length() - 1
    return 2 * place + (own >> place & 1)


def one(x):
    return int(mixed(np.array([x % 2**64], dtype=np.uint64))[0])


def parsed(text: str) -> set[int]:
    """Signatures of one text, level by level with plain loops."""
    names, spans, level, out = list(text.encode()), None, 0, set()
    spans = [1] * len(names)
    while names:
        runs = []
        for name, span in zip(names, spans):
            if runs and runs[-1][0] == name:
                runs[-1][1] += 1
                runs[-1][2] += span
            else:
                runs.append([name, 1, span])
        n = len(runs)
        label = [toss(r[0], runs[i - 1][0] if i else 0) & 127 for i, r in enumerate(runs)]
        for _ in range(3 if level else 2):
            label = [toss(x, label[i - 1] if i else 0) for i, x in enumerate(label)]
        tops = [0 < i < n - 1 and label[i] > label[i - 1] and label[i] >= label[i + 1] for i in range(n)]
        starts = [i for i in range(n) if i == 0 or tops[i] and not tops[i - 1] and 1 < i < n - 1]
        names, spans = [], []
        for a, b in zip(starts, [*starts[1:], n]):
            total = 0
            for k in range(a, b):
                name, times, _ = runs[k]
                value = int(fp._BYTE[(k - a & 63) << 8 | name]) if level == 0 else one(name + int(fp._PLACE[k - a & 63]))
                total += one(value + times * int(fp._RUN)) if times > 1 else value
            names.append(one(total + b - a))
            spans.append(sum(r[2] for r in runs[a:b]))
        out |= {x >> 32 for x, span in zip(names, spans) if span >= fp.LEAST_SPAN or len(names) == 1}
        level += 1
        if len(names) == 1:
            return out
    return {0}


ODD = ["", "a", "aa", "ab", "a" * 5000, "ab" * 700, "abc" * 500, "Grüße 日本語 🎉", "\0\0x\0", "line\n" * 300,
       "".join(map(chr, np.random.default_rng(0).integers(32, 1000, 3000)))]


def test_signatures_equal_a_plain_parser():
    together = fp.signatures(ODD)
    assert [set(s.tolist()) for s in together] == [parsed(t) for t in ODD]
    assert all((np.diff(s.astype(np.int64)) > 0).all() for s in together)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \né", max_size=60), max_size=6))
def test_signatures_of_small_alphabets(texts):
    assert [set(s.tolist()) for s in fp.signatures(texts)] == [parsed(t) for t in texts]


def test_phrases_do_not_depend_on_offsets():
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("etaoin shrdlu"), 6000))
    plain, shifted = (set(fp.signatures([t])[0].tolist()) for t in (text, "seven!!" + text))
    assert len(plain & shifted) > 0.95 * len(plain)


def test_names_stay_short_and_cuts_leave_pairs():
    rng = np.random.default_rng(2)
    names = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    starts = fp.landmarks(names, np.array([0, 5, 6, 9000]))
    assert {0, 5, 6, 9000} <= set(starts.tolist())
    size = np.diff(np.append(starts, len(names)))
    assert size.max() < fp._PLACES and set(starts[size == 1].tolist()) <= {5}


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    texts = [t or "" for _, t in rows]
    prints = fp.fingerprints(texts)
    out = []
    for i, (key, _) in enumerate(rows):
        j = (i + 1) % len(rows)
        n = len(texts[i]) // 4
        changed = texts[i][:len(texts[i]) - n] + texts[j][:n]
        e = fp.fingerprints([changed])[0]
        out.append((key, len(texts[i]), brute.sha(changed), prints[i], e, fp.likeness(prints[i], e), fp.likeness(prints[i], prints[j])))
    return out


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def test_query_over_the_whole_table(spark):
    rows = duckdb.connect().execute(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    found = as_rows(queries.op11_fingerprints(spark, SF))
    assert found == expected(rows)
    assert np.mean([r[5] > r[6] for r in found]) > 0.98
    marks = {}
    for (_, text), r in zip(sorted(rows), found):
        assert marks.setdefault(text or "", r[3]) == r[3]


@pytest.mark.parametrize("rows", [[], [(3, "only one")], [(3, None)], [(None, "x" * 40), (1, ""), (2, "abc"), (9, None)],
                                  [(i, f"text {i % 3} " * (i % 5)) for i in range(40)]])
def test_odd_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fingerprint": F.lit(1), "h": F.lit(2)}).repartition(5)
    assert as_rows(fp.fingerprint_documents(df)) == expected(rows)


def test_repeated_ids_and_rows(spark):
    rows = [(1, "same text of some length")] * 30 + [(1, "another text, as long"), (2, "z")] * 2
    found = fp.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(r.doc_id for r in found) == sorted(r[0] for r in rows)
    assert sum(r.near_next == 1.0 for r in found if r.n_chars == 24) == 29


def test_likeness():
    a, b = "0000000100000002", "0000000200000003"
    assert fp.likeness(a, a) == 1 and fp.likeness(a, b) == 1 / 3 and fp.likeness(a, "00000009") == 0
    assert fp.edited("abcdefgh", "XYZ") == "abcdefXY" and fp.edited("abcdefgh", "X") == "abcdefX" and fp.edited("abc", "X") == "abc"
