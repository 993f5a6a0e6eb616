"""Benchmark decontamination against exact edit distances of all items and texts."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontam

from .helpers import DOCS, edge_docs, edge_table, empty_table, prose

ITEMS = "item_id bigint, text string, id bigint, doc_id bigint"


def least_edits(item, text):
    """Fewest edits from a list of words to any run of another's."""
    prev = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        cur = [i]
        for j, v in enumerate(text, 1):
            cur.append(min(prev[j - 1] + (w != v), prev[j] + 1, cur[j - 1] + 1))
        prev = cur
    return min(prev)


def edited(r, words, n):
    out = list(words)
    for _ in range(n):
        at, kind = r.randrange(len(out)), r.randrange(3)
        out[at : at + (kind != 1)] = [] if kind == 0 else [f"edit{r.randrange(10**6)}"]
    return out


def _fixture():
    r = random.Random(11)
    items = [prose(1000 + i, n) for i, n in enumerate([1, 2, 3, 4, 5, 9, 10, 12, 18, 25, 40, 60, 90])]
    docs = []
    for k in range(120):
        w = prose(k, r.randrange(5, 120))
        item = r.choice(items)
        share = r.choice([0, 0.05, 0.1, 0.15, 0.2, 0.5])
        at = r.randrange(len(w) + 1)
        docs.append(w if k % 4 == 0 else w[:at] + edited(r, item, int(len(item) * share)) + w[at:])
    return items, docs


def test_equals_brute_force(spark):
    items, docs = _fixture()
    want = {(d, i): e for d, t in enumerate(docs) for i, item in enumerate(items) if (e := least_edits(item, t)) <= decontam.edits(len(item))}
    bench = spark.createDataFrame([(i, " ".join(t).upper(), 1, 2) for i, t in enumerate(items)], ITEMS)
    df = spark.createDataFrame([(i, ", ".join(t) + ".", "en", "a", 0) for i, t in enumerate(docs)], DOCS)
    for block in (decontam.BLOCK_ITEMS, 4):
        got = {(r.doc_id, r.item_id): r.distance for r in decontam.contaminated(df, bench, block=block).collect()}
        assert got == want
    kept = {r.doc_id for r in decontam.drop_contaminated(df, bench).collect()}
    assert kept == set(range(len(docs))) - {d for d, _ in got}


def test_windows_lie_where_the_passage_is(spark):
    item, before = prose(1, 40), prose(2, 33)
    df = spark.createDataFrame([(7, " ".join(before + item + prose(3, 20)), "en", "a", 0)], DOCS)
    (r,) = decontam.contaminated(df, spark.createDataFrame([(3, " ".join(item), 0, 0)], ITEMS)).collect()
    assert (r.doc_id, r.item_id, r.n_words) == (7, 3, 40) and abs(r.first_word - 33) <= decontam.edits(40)


def test_embedding_turns_edits_into_few_differences():
    words = np.array([prose(i, 60) for i in range(200)])
    near = np.array([[*w[:30], "x", *w[30:59]] for w in words.tolist()])
    code = lambda x: np.vectorize(lambda s: abs(hash(s)) + 1, otypes=[np.uint64])(x)
    same = [(decontam.embed(code(words), k) == decontam.embed(code(near), k)).mean() for k in range(decontam.WALKS)]
    far = (decontam.embed(code(words), 0) == decontam.embed(code(words[::-1]), 0)).mean()
    assert min(same) > 0.6 and far < 0.15


@pytest.mark.parametrize("n", [10, 15, 25, 40, 60, 100, 200, 400, 1000, 2000])
def test_keys_reach_their_target_recall(n, monkeypatch):
    """Keys alone find their share of passages with the most edits, at any place of a text; with grams all are found."""
    times = 120 if n <= 60 else 40 if n <= 400 else 20
    for keys_alone in (True, False):
        r = random.Random(n)
        if keys_alone:
            monkeypatch.setattr(decontam, "_missed", lambda *a: [])
        else:
            monkeypatch.undo()
        found = 0
        for k in range(times if keys_alone else times // 4):
            item = prose(k, n)
            index = decontam.build([k], [" ".join(item)])
            found += len(decontam.search(index, pa.array([" ".join(prose(k + 999, r.randrange(max(40, n))) + edited(r, item, decontam.edits(n)) + prose(k + 99, 40))]))[0])
        assert found >= decontam.TARGET_RECALL * times if keys_alone else found == times // 4
    positions, samples = decontam.scheme_for(n, 0.95)
    assert 1 <= positions <= decontam.POSITIONS and 1 <= samples <= decontam.SAMPLES


def test_results_do_not_depend_on_the_layout(spark):
    items, docs = _fixture()
    index = decontam.build(list(range(len(items))), [" ".join(t) for t in items])
    texts = [" ".join(t) for t in docs]
    alone = []
    for i, t in enumerate(texts):
        alone += [(i, *map(int, hit[1:])) for hit in zip(*decontam.search(index, pa.array([t])), strict=True)]
    assert [tuple(map(int, hit)) for hit in zip(*decontam.search(index, pa.array(texts)), strict=True)] == alone
    bench = spark.createDataFrame([(i, " ".join(t), 1, 2) for i, t in enumerate(items)], ITEMS)
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], DOCS)
    for table in (df.repartition(7), df.orderBy(F.xxhash64("doc_id")).coalesce(1)):
        assert sorted(map(tuple, decontam.contaminated(table, bench).collect())) == sorted(alone)


@pytest.mark.parametrize("items", [[], [(1, None, 0, 0), (2, "", 0, 0), (3, "-- !", 0, 0), (None, "one two three four five six", 0, 0)]])
def test_empty_items(spark, items):
    bench = spark.createDataFrame(items, ITEMS)
    assert decontam.contaminated(edge_table(spark), bench).count() == 0
    assert decontam.drop_contaminated(edge_table(spark), bench).count() == len(edge_docs())


def test_edges(spark):
    text = "no id here but some words"
    bench = spark.createDataFrame([(5, text, 0, 0), (5, text, 0, 0), (6, "w3 x3 w4 x4 w5 x5 w6 x6", 0, 0)], ITEMS)
    got = decontam.contaminated(edge_table(spark), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(None, 5), (6, 6), (7, 6)}
    kept = decontam.drop_contaminated(edge_table(spark), bench)
    assert kept.columns == edge_table(spark).columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 8, 8]
    assert decontam.contaminated(empty_table(spark), bench).count() == 0 == decontam.drop_contaminated(empty_table(spark), bench).count()


def test_long_items_and_copies_of_one_take_bounded_memory(monkeypatch):
    """Windows dealt out a few at a time find what they find all at once."""
    r = random.Random(21)
    items = [prose(3000, 400), prose(3001, 60), prose(3002, 60)]
    texts = pa.array([" ".join(prose(4000 + i, 30) + edited(r, items[i % 3], 9) + prose(5000 + i, 30)) for i in range(12)] + [" ".join(items[1] * 40), "", None])
    index = decontam.build([7, 8, 9], [" ".join(i) for i in items])
    usual = [x.tolist() for x in decontam.search(index, texts)]
    assert set(zip(usual[0], usual[1], strict=True)) == {(i, 7 + i % 3) for i in range(12)} | {(12, 8)}
    monkeypatch.setattr(decontam, "MATCH_WORDS", 500)
    assert [x.tolist() for x in decontam.search(index, texts)] == usual
    assert decontam._ranges(np.array([5, 2, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]


@pytest.mark.parametrize(("n", "times"), [(12, 60), (100, 24), (400, 8), (1000, 4), (2000, 2)])
def test_recall_does_not_fall_with_length(n, times):
    """Passages at any place of longer texts are all found, with the fewest edits, up to the most that are allowed."""
    r = random.Random(n)
    items, texts, most = [prose(70_000 + n * 10 + i, n) for i in range(3)], [], []
    for k in range(times):
        share = (0, 0.05, 0.1, 0.2)[k % 4] if times > 2 else (0.1, 0.2)[k]
        texts.append(prose(80_000 + k, r.randrange(3 * n)) + edited(r, items[k % 3], int(n * share)) + prose(90_000 + k, r.randrange(n)))
        most.append(int(n * share))
    index = decontam.build([0, 1, 2], [" ".join(i) for i in items])
    text, item, at, _, dist = decontam.search(index, pa.array([" ".join(t) for t in texts]))
    assert list(zip(text.tolist(), item.tolist(), strict=True)) == [(k, k % 3) for k in range(times)]
    assert all(d <= m for d, m in zip(dist.tolist(), most, strict=True))
    if n <= 400:
        assert dist.tolist() == [least_edits(items[k % 3], t) for k, t in enumerate(texts)]


def test_items_that_share_grams_are_counted_in_parts(monkeypatch):
    r = random.Random(5)
    common = prose(1, 40)
    items = [common[: 10 + i] + prose(100 + i, 20 - i) for i in range(12)] * 2
    texts = [prose(200 + i, 20) + edited(r, items[i], 6) + prose(300 + i, 9) for i in range(12)]
    want = {(t, i): d for t, text in enumerate(texts) for i, item in enumerate(items) if (d := least_edits(item, text)) <= 6}
    index = decontam.build(list(range(24)), [" ".join(i) for i in items])
    for words in (decontam.MATCH_WORDS, 40):
        monkeypatch.setattr(decontam, "MATCH_WORDS", words)
        text, item, _, _, dist = decontam.search(index, pa.array([" ".join(t) for t in texts]))
        assert {(t, i): d for t, i, d in zip(text.tolist(), item.tolist(), dist.tolist(), strict=True)} == want


def test_items_without_an_id_contaminate(spark):
    bench = spark.createDataFrame([(None, "no id here but some words", 0, 0), (-(2**63), "w3 x3 w4 x4 w5 x5 w6 x6", 0, 0)], ITEMS)
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(edge_table(spark), bench).collect()}
    assert got == {(None, None), (6, -(2**63)), (7, -(2**63))}
    kept = decontam.drop_contaminated(edge_table(spark), bench).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 2, 3, 4, 5, 8, 8] and not any(r.text == "no id here but some words" for r in kept)
