"""Language network and ordinal classifier: gradients, held-out accuracy, odd rows."""

import unicodedata

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import language_id as li, quality_classifier as qc, queries

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def test_gradients_by_differences():
    net = li.Net.random(["a", "b", "c"], 3, 1)
    for p in ("x", "u"):
        setattr(net, p, [v.astype(np.float64) for v in getattr(net, p)])
    net.v, net.c = net.v.astype(np.float64), net.c.astype(np.float64)
    rng = np.random.default_rng(0)
    data, target = rng.integers(97, 100, (5, 4)).astype(np.uint8), np.array([0, 1, 2, 1])

    def loss():
        joint = np.concatenate([net.states(data, 0, []), net.states(data, 1, [])], axis=2).astype(np.float64)
        logits = joint @ net.v + net.c
        p = np.exp(logits) / np.exp(logits).sum(axis=2, keepdims=True)
        return -np.log(p[:, np.arange(4), target]).mean()

    for parameter, gradient in zip(net.parameters(), net.gradients(data, target)):
        for place in [tuple(rng.integers(0, s) for s in parameter.shape) for _ in range(6)] + [tuple(min(98, s - 1) for s in parameter.shape)]:
            kept = parameter[place]
            parameter[place] = kept + 1e-3
            up = loss()
            parameter[place] = kept - 1e-3
            down = loss()
            parameter[place] = kept
            assert gradient[place] == pytest.approx((up - down) / 2e-3, abs=2e-4)


def test_fast_labels_equal_the_trained_form():
    net = li.Net.random(["a", "b"], 4, 2)
    data = np.random.default_rng(1).integers(0, 256, (20, 7)).astype(np.uint8)
    logits = np.concatenate([net.states(data, 0, []), net.states(data, 1, [])], axis=2) @ net.v + net.c
    want = np.exp(logits) / np.exp(logits).sum(axis=2, keepdims=True)
    assert np.allclose(net.labels(data), want, atol=1e-5)


def test_pooling_ignores_filling_and_order():
    net = li.Net.random(["a", "b"], 4, 2)
    texts = [b"x", b"y" * 128, b"z" * 129, b"w" * 1000]
    together = li.pooled(net, texts, lanes=3)
    assert np.allclose(together, [li.pooled(net, [t])[0] for t in texts]) and np.allclose(together.sum(axis=1), 1, atol=1e-5)


def test_letters_by_category():
    assert all(li.has_letter(t) for t in ("a", "1é", "中", "_ß", "ªx"))
    assert not any(li.has_letter(t) for t in ("", "½ ②", "Ⅷ ①", "² 12_", "!?…", "🎉"))


def test_language_query_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in queries.op1_language(spark, SF).collect()}
    truth = dict(duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").fetchall())
    assert set(rows) == set(truth)
    held = [i for i in truth if rows[i].held_out]
    import zlib
    assert held == [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([rows[i].lang_pred == truth[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows.values())


def plain_probabilities(net, data):
    """Mean label probabilities of a text, one byte after the other, by loops."""
    def squash(x):
        return x / (1 + np.abs(x))

    def gate(x):
        return 0.5 + 0.5 * squash(x)

    total, n = np.zeros(len(net.langs)), len(net.u[0])
    for a in range(0, len(data), li.SEGMENT):
        part = data[a:a + li.SEGMENT]
        padded, states = part + b" " * (li.SEGMENT - len(part)), [{}, {}]
        for d, places in enumerate((range(li.SEGMENT), range(li.SEGMENT - 1, -1, -1))):
            h = np.zeros(n)
            for t in places:
                x, u = net.x[d][padded[t]].astype(float), h @ net.u[d].astype(float)
                r, z = gate(x[:n] + u[:n]), gate(x[n:2 * n] + u[n:2 * n])
                h = z * h + (1 - z) * squash(x[2 * n:] + r * u[2 * n:])
                states[d][t] = h
        for t in range(len(part)):
            score = np.concatenate([states[0][t], states[1][t]]) @ net.v + net.c
            p = np.exp(score - score.max())
            total += p / p.sum()
    return total / len(data)


def test_language_query_equals_a_plain_network(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    net = li.train(docs, "doc_id", "text", "lang", held_out, li.PER_LANGUAGE, li.SNIPPET)
    texts = dict(duckdb.sql(f"select doc_id, text from '{SMALL}/documents.parquet' where strlen(text) < 1500").fetchall())
    got = {r.doc_id: r for r in queries.op1_language(spark, SMALL).collect()}
    assert len(texts) > 50
    for i, text in texts.items():
        if not any(unicodedata.category(c).startswith("L") for c in text):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        p = plain_probabilities(net, text.lower().encode("utf-8", "replace"))
        assert got[i].score == pytest.approx(p.max(), abs=2e-3) and p[net.langs.index(got[i].lang_pred)] > p.max() - 2e-3


def test_language_odd_rows(spark):
    rows = [(i, "the and of with that " * 5, "en") for i in range(40)] + [(100 + i, "der und die das nicht " * 5, "de") for i in range(40)]
    rows += [(200, None, "en"), (201, "", None), (202, "123 %%% 456", "de"), (None, "the and of that " * 4, None), (203, "é" * 300_000, None), (203, "the of and", "")]
    df = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, lang string, held_out boolean")
    out = [(r.doc_id, r.lang_pred, r.score, r.held_out) for r in li.identify(df).collect()]
    by = {o[0]: o for o in out}
    assert len(out) == len(rows) and all(by[i][1:3] == ("und", 0.0) for i in (200, 201, 202)) and by[None][3] is True
    assert by[1][1] == "en" and by[101][1] == "de" and by[None][1] == "en"
    never = F.lit(False)
    assert li.train(df, "doc_id", "text", "lang", never, 9, 99, max_langs=1).langs == ["de"]
    unlabelled = li.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}
    assert li.identify(df.limit(0)).count() == 0


def test_ordinal_thresholds_and_held_out_accuracy():
    rows = duckdb.sql("""select d.text, case when toxic = 1 then 0 when quality = 0 then 1 else 2 end
        from '/root/testdata/sf0.1/documents.parquet' d join '/root/testdata/sf0.1/labels.parquet' l on d.doc_id = l.doc_id order by d.doc_id""").fetchall()
    table, grades = qc.Buckets(qc.BUCKETS), np.array([g for _, g in rows])
    features = [table.of(t) for t, _ in rows]
    cut = len(rows) * 3 // 4
    model = qc.fit(features[:cut], grades[:cut], 3)
    tails = np.array([model.tails(f) for f in features[cut:]])
    assert (np.diff(model.thresholds) > 0).all() and (tails[:, 0] >= tails[:, 1]).all()
    good, chosen = grades[cut:] == 2, tails[:, 1] >= 0.5
    assert chosen[good].mean() > 0.85 and chosen[~good].mean() < 0.35


def plain_buckets(text, n):
    """The features of a text, each written out and hashed by itself."""
    import xxhash
    marks, words = ".,;:!?\"'()[]{}%$#&*|<>-_/\\", text.split()
    names = {"empty"} if not words else set()
    forms = {}
    for w in words:
        low = w.strip(marks).lower()
        names |= {"w " + low, "p " + low[:4]}
        form = ""
        for c in w:
            kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
            form += "" if form.endswith(kind) else kind
        forms.setdefault(form[:8], []).append(w)
    for form, held in forms.items():
        names.add(f"s {form} {round(4 * (len(held) / len(words)) ** 0.5)}")
    if words:
        lines = [x.strip() for x in text.split("\n") if x.strip()]
        names.add(f"share {10 * len(set(words)) // len(words)}")
        names.add(f"symbols {int(20 * (sum(any(c in '#*$%&|<>' for c in w) for w in words) / len(words)) ** 0.5)}")
        names.add(f"open {10 * sum(not x.endswith(('.', '!', '?')) for x in lines) // len(lines)}")
        names.add(f"line {int(4 * np.log2(1 + len(words) / len(lines)))}")
    return {xxhash.xxh3_64_intdigest(x.encode()) % n for x in names}


def test_classifier_query_equals_a_plain_scorer(spark):
    """Each document's score by cumulative links, one feature after the other, with the weights the query fits."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = qc.train(docs, qc.graded(spark.read.parquet(f"{SF}/labels.parquet")))
    texts = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    rows = queries.op10_quality_classifier(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts) and 0 < model.cut < 1 and model.thresholds[0] < model.thresholds[1]
    for r in rows:
        score = sum(float(model.weights[b]) for b in plain_buckets(texts[r.doc_id] or "", len(model.weights)))
        tails = [1 / (1 + np.exp(t - score)) for t in model.thresholds]
        assert (r.expected_grade, r.tail) == pytest.approx((sum(tails), tails[1]), abs=1e-4)
        assert r.selected == (r.tail >= model.cut)


def test_cut_parts_best():
    rng = np.random.default_rng(3)
    for n in (2, 5, 40):
        tails, wanted = rng.integers(0, 8, n) / 8, rng.random(n) < 0.5
        wanted[:2] = True, False

        def share(cut):
            return (tails[wanted] >= cut).mean() - (tails[~wanted] >= cut).mean()

        assert share(qc.best_cut(tails, wanted)) == pytest.approx(max(share(x) for x in (*tails, 2.0)) if max(share(x) for x in tails) >= 0 else max(share(x) for x in tails))
    assert qc.best_cut(np.array([0.2, 0.3]), np.array([True, True])) == 0.5


def test_few_ratings_still_teach():
    table = qc.Buckets(1 << 12)
    rows = [table.of(t) for t in ["a fine text about rivers"] * 5 + ["vile words of hate"] * 4]
    model = qc.fit(rows, np.array([2] * 5 + [0] * 4), 3, 1 << 12)
    assert model.tails(rows[0])[1] > model.tails(rows[-1])[1] + 0.2


def test_classifier_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.1), (2, "again", 0.2), (None, "text here", 0.3), (3, "x" * 300_000, 0.4)], "doc_id long, text string, tail double")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (2, 0, 0), (2, 1, 1), (None, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    assert {(r.doc_id, r.grade) for r in qc.graded(labels).collect()} == {(1, 2), (2, 0), (9, 2)}
    assert qc.grade_documents(docs, qc.graded(labels), carry=("text",)).count() == 5
    assert {r.tail for r in qc.grade_documents(docs, qc.graded(labels.limit(0))).collect()} == {float(qc.sigmoid(-1.0))}
    assert qc.grade_documents(docs.limit(0), qc.graded(labels)).count() == 0


def test_repeated_ids_train_once(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(qc, "fit", lambda rows, grades, levels, buckets, *_: taken.append(len(rows)) or qc.Ordinal(np.zeros(buckets, np.float32), np.arange(2.0)))
    docs = spark.createDataFrame([(1, f"text number {i}") for i in range(50)] + [(2, "another")], "doc_id long, text string")
    qc.train(docs, spark.createDataFrame([(1, 0), (2, 2)], "doc_id long, grade int"), max_docs=2)
    assert taken == [2]
