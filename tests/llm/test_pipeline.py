"""Each stage of the pipeline against a plain version, on its own input."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from corpus_pipeline import decontaminate_stage, neardup_stage, token_stage
from tessera.llm import decontam, quality

from .helpers import CLASH, DOCS, SF, prose
from .test_binary import _want_tokens
from .test_decontam import ITEMS
from .test_models import _held_out
from .test_native import _check_mix
from .test_neardup import plain


def least_edits(item, text):
    prev, ramp = np.zeros(len(text) + 1, np.int64), np.arange(len(text) + 1)
    for w in item:
        cur = prev + 1
        cur[1:] = np.minimum(cur[1:], prev[:-1] + (text != w))
        prev = np.minimum.accumulate(cur - ramp) + ramp
    return prev.min()


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    root, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        out.append(docs)
    return [spark.read.parquet(f"{SF}/documents.parquet"), *out]


def _rows(df):
    return [tuple(r) for r in df.collect()]


def test_names_and_columns(outputs):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality", "neardup", "decontaminate", "mixing", "tokens"]
    assert all(df.columns == outputs[0].columns for df in outputs[:-1])


def test_quality_stage(spark, outputs):
    docs = {r[0]: r for r in _rows(outputs[0])}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    known = sorted(k for k in labels if not _held_out(k) and k in docs)
    features = lambda ids: quality.text_features(pa.array([docs[i][1] for i in ids]))
    model = quality.fit(features(known), np.array([labels[k] for k in known], float))
    want = {k for k, s in zip(docs, model.score(features(list(docs))), strict=True) if s >= 0.5}
    assert Counter(_rows(outputs[1])) == Counter(docs[k] for k in want)


def test_neardup_stage(outputs):
    before = _rows(outputs[1])
    assert {r[0] for r in _rows(outputs[2])} == {k for k, _, _, kept in plain(before) if kept} and len(outputs[2].columns) == len(outputs[1].columns)


def test_decontaminate_stage(spark, outputs):
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    words = lambda t: (lambda h, first: h)(*decontam.text_words(pa.array([t])))
    items = [w for t in bench if len(w := words(t))]
    before, after = _rows(outputs[2]), {r[0] for r in _rows(outputs[3])}
    bad = {r[0] for r in before if any(least_edits(i, words(r[1])) <= decontam.edits(len(i)) for i in items)}
    assert bad and after == {r[0] for r in before} - bad


def test_mixing_stage(outputs):
    before, after = _rows(outputs[3]), Counter(_rows(outputs[4]))
    assert set(after) <= set(before) and max(after.values()) <= 2
    from tessera.llm import mixing

    counts = mixing.mix_counts(outputs[3]).collect()
    assert {r.id: r.copies for r in counts if r.copies} == {r[0]: n for r, n in after.items()}
    _check_mix(before, counts)


def test_token_stage(outputs):
    rows = sorted((r[0], r[1]) for r in _rows(outputs[4]))
    want = _want_tokens(rows)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in outputs[5].collect()) == sorted(want)


def test_run_equals_the_stages(spark, outputs):
    cols = ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select(*cols).collect())) == sorted(map(tuple, outputs[5].select(*cols).collect()))


def test_edge_rows_pass_every_stage(spark, tmp_path):
    """Nulls in any column, empty and very long texts, copies, repeated rows and clashing names."""
    long = prose(1, 3000)
    rows = [(i, " ".join(prose(10 + i, 80)) + ".", "en", "ab"[i % 2], i) for i in range(40)]
    rows += [(100, " ".join(long), None, None, None), (101, " ".join([*long, "end"]), "en", "a", 0), (102, None, "en", "a", 0), (103, "", "en", None, 0), (None, rows[0][1], "en", "a", 0), (None, rows[3][1] + " x", "en", "b", 0), rows[5], rows[5], (None, None, None, None, None)]
    rows += [(104, " ".join([*prose(900, 9), *prose(17, 40)[:30], *prose(901, 9)]), "en", "a", 0)]
    docs = spark.createDataFrame([(*r, 7, "k", 9, "r", 3, b"s", 1, 5, "l") for r in rows], CLASH)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, None) for i in range(40)] + [(None, 1, 0), (5, None, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, " ".join(prose(17, 40)[:30]), 0, 0), (1, None, 0, 0), (2, "", 0, 0)], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and set(map(str, out.collect())) <= set(map(str, docs.collect()))
    kept = neardup_stage(spark, docs, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in kept) == Counter([*range(40), 100, 102, 103, 104, None])
    assert {r.doc_id for r in kept} - {r.doc_id for r in decontaminate_stage(spark, docs, str(tmp_path)).collect()} == {7, 104}
    assert len(token_stage(spark, docs, str(tmp_path)).collect()) == len(rows)
    assert corpus_pipeline.run(spark, str(tmp_path)).columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", DOCS), ("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", ITEMS)):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
