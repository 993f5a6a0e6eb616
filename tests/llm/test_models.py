"""Quality classifier and language identification."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid, quality
from tessera.llm.queries import QUERIES

from .helpers import DOCS, edge_docs, edge_table, empty_table

SF01 = "/root/testdata/sf0.01"


def _held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_gam_learns_steps_and_interactions():
    r = np.random.default_rng(1)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    gam = quality.fit(x[:3000], y[:3000])
    assert ((gam.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9 and (1, 0) in gam.pairs
    y = (x[:, 2] > 0.3).astype(float)
    assert ((quality.fit(x[:3000], y[:3000]).score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.98
    # A score is the logistic of table entries that are added.
    row = x[:1]
    z = gam.bias + sum(t[np.searchsorted(e, row[0, f], side="right")] for f, (e, t) in enumerate(zip(gam.edges, gam.tables, strict=True)))
    bins = [np.searchsorted(e, row[0, f], side="right") for f, e in enumerate(gam.pair_edges)]
    z += sum(t[bins[a], bins[b]] for (a, b), t in zip(gam.pairs, gam.pair_tables, strict=True))
    assert gam.score(row)[0] == pytest.approx(1 / (1 + np.exp(-z)))


def test_gam_degenerate():
    assert quality.Gam().score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert quality.fit(np.zeros((0, 3)), np.zeros(0)).score(np.ones((1, 3)))[0] == 0.5
    assert quality.fit(np.ones((5, 3)), np.ones(5)).score(np.ones((1, 3)))[0] > 0.5


def test_features_do_not_depend_on_neighbours():
    texts = [r[1] for r in edge_docs()]
    together = quality.text_features(pa.array(texts, pa.string()))
    assert np.isfinite(together).all()
    for t, x in zip(texts, together, strict=True):
        assert np.array_equal(quality.text_features(pa.array([t], pa.string()))[0], x)


def test_quality_held_out_accuracy(spark):
    rows = QUERIES["op2_quality_gam"](spark, SF01).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    assert all(r.held_out == _held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert len(rows) == spark.read.parquet(f"{SF01}/documents.parquet").count()
    judged = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]
    print("quality", len(judged), np.mean(judged))
    assert np.mean(judged) > 0.9


def test_quality_learns_nothing_from_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    flipped = spark.createDataFrame([(r.doc_id, 1 - r.quality if _held_out(r.doc_id) else r.quality) for r in labels.collect()], "doc_id bigint, quality int")
    a, b = (sorted(map(tuple, quality.score_quality(docs, x).collect())) for x in (labels, flipped))
    assert a == b


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 0, 1), (4, 1, None), (5, 1, 0), (5, 1, 0), (6, None, 1), (None, 1, 1), (99, 1, 1)], "doc_id bigint, quality int, size int")
    out = quality.score_quality(edge_table(spark), labels).collect()
    assert Counter(r.id for r in out) == Counter(r[0] for r in edge_docs())
    kept = quality.keep_quality(edge_table(spark), labels)
    assert kept.columns == edge_table(spark).columns
    want = Counter(r.id for r in out if r.predicted)
    assert Counter(r.doc_id for r in kept.collect()) == want
    none = labels.limit(0)
    assert {r.score for r in quality.score_quality(edge_table(spark), none).collect()} == {0.5}
    assert quality.score_quality(empty_table(spark), labels).count() == 0 == quality.keep_quality(empty_table(spark), none).count()


def test_language_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    rows = QUERIES["op4_language_id"](spark, SF01).collect()
    assert len(rows) == len(docs) and all(r.held_out == _held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    right = [r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out]
    print("lang", len(right), np.mean(right))
    assert np.mean(right) > 0.9


def grams(text):
    """Counts of a text's n-grams by bucket."""
    out = np.zeros(langid.BUCKETS)
    for _, own, n, _ in langid.counted([text], langid.BUCKETS):
        out[own] += n
    return out


def test_naive_bayes_equals_plain_counts(spark):
    rows = [(i, t, lang, "s", 0) for i, (t, lang) in enumerate([("aab b", "x"), ("bba!", "y"), ("abc", "x"), ("ccc a", "y"), ("bb", "x"), ("cab", "y")])]
    model = langid.train(spark.createDataFrame(rows, DOCS))
    known = [r for r in rows if not _held_out(r[0])]
    assert model.langs == ["x", "y"]
    for k, lang in enumerate(model.langs):
        count = np.ones(langid.BUCKETS)
        for r in known:
            if r[2] == lang:
                count += grams(r[1])
        assert np.allclose(model.logp[:, k], np.log(count / count.sum()), atol=1e-5)
        assert model.prior[k] == pytest.approx(np.log(sum(r[2] == lang for r in known) / len(known)))
    texts = ["aab", "ccb"]
    for t, name, score in zip(texts, *model.predict(texts), strict=True):
        z = model.prior + grams(t) @ model.logp
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert name == model.langs[p.argmax()] and score == pytest.approx(p.max(), abs=1e-5)


def test_languages_are_counted_some_at_a_time(spark, monkeypatch):
    rows = [(i, f"{lang} word{i % 5} {lang * 3}", lang, "s", 0) for i in range(60) for lang in ("x", "y", "z", "w", "é")]
    docs = spark.createDataFrame(rows, DOCS).coalesce(2)
    whole = langid.train(docs)
    monkeypatch.setattr(langid, "TOGETHER", 2)
    parts = langid.train(docs)
    assert parts.langs == whole.langs == sorted("xyzwé")
    assert np.array_equal(parts.logp, whole.logp) and np.array_equal(parts.prior, whole.prior)


@pytest.mark.parametrize("size", [langid.SLICE, 1, 2, 3, 7])
def test_ngrams_equal_plain_ones(monkeypatch, size):
    """Each run of one to three characters counts once, letters in lower case and all else as a space, in its own bucket; slices change nothing."""
    bucket = lambda g: int(np.flatnonzero(grams(g) - grams(g[:-1]) - grams(g[1:]) + grams(g[1:-1]))[0])
    texts = ["Aab b!", "", None, "Ünï  ÇÖDÉ 中文 \U0001f600x", "a", "zz9 zz"]
    low = ["".join(c if c.isalpha() else " " for c in (t or "").lower()) for t in texts]
    want = [Counter(bucket(s[a : a + n]) for n in (1, 2, 3) for a in range(len(s) - n + 1)) for s in low]
    monkeypatch.setattr(langid, "SLICE", size)
    got, lettered = [Counter() for _ in texts], [False] * len(texts)
    for k, own, n, letter in langid.counted(texts, langid.BUCKETS):
        got[k].update(dict(zip(own.tolist(), n.tolist(), strict=True)))
        lettered[k] |= letter
    assert got == want and lettered == [any(c.isalpha() for c in s) for s in low]
    assert len({bucket(g) for g in ("ab", "ba", "a", "aa", "aaa", "a b", " ab")}) == 7


def test_languages_of_rows_without_ids(spark):
    """Rows with null ids are drawn apart, as are those that repeat an id."""
    rows = [(None, f"das ist der text nummer {i} und mehr", "de", "s", 0) for i in range(9000)] + [(7, f"this is the text number {i} and more", "en", "s", 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, DOCS)
    out = langid.identify(docs, per_lang=500).groupBy("id", "lang_pred").count().collect()
    assert {(r.id, r.lang_pred): r["count"] for r in out} == {(None, "de"): 9000, (7, "en"): 3000}


def test_memory_of_a_long_text():
    import tracemalloc

    text = "Ein langer Text, ohne Ende. " * 100_000
    tracemalloc.start()
    for _ in langid.counted([text], langid.BUCKETS):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * len(text)


def test_language_ties_and_too_many(spark, monkeypatch):
    rows = [(i, "same words", lang, "s", 0) for i in range(40) for lang in ("y", "x")]
    out = langid.identify(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.lang_pred for r in out} == {"x"} and all(r.score == pytest.approx(0.5) for r in out)
    monkeypatch.setattr(langid, "MOST_BYTES", 4 * langid.BUCKETS)
    with pytest.raises(ValueError):
        langid.train(spark.createDataFrame(rows, DOCS))


def test_language_edges(spark):
    out = langid.identify(edge_table(spark)).collect()
    assert Counter(r.id for r in out) == Counter(r[0] for r in edge_docs())
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in out if r.id in (1, 2, 3))
    assert all(r.lang_pred != "und" for r in out if r.id in (4, 5, 6, 8))
    unlabelled = edge_table(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}
    assert langid.identify(empty_table(spark)).count() == 0
