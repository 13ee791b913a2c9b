import random

import numpy as np
import pytest

from arkivel.llm import toxicity

from .test_operators import components, shingles


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(800)]
    rows = []
    for i in range(900):
        w = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), "zzgr" + rng.choice(words) if i % 4 else "zzhate")
        rows.append((i, " ".join(w), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_held_out_accuracy(labelled):
    docs, labels = labelled.drop("toxic"), labelled.select("doc_id", "toxic")
    model = toxicity.fit(docs, labels, usable="doc_id % 5 <> 0")
    got = toxicity.scored(docs, model).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.doc_id % 5 == 0]
    assert held[held.toxic == 1].predicted.mean() > 0.9 and held[held.toxic == 0].predicted.mean() < 0.02
    assert ((got.score >= 0) & (got.score <= 1)).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    assert toxicity.accepted(docs, model).count() == (got.predicted == 0).sum()


def test_hard_rows(spark, docs, none, rows):
    one_kind = spark.createDataFrame([(1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, one_kind)
    got = toxicity.scored(docs, model).toPandas()
    assert len(got) == len(rows) and (got.predicted == 0).all()
    assert toxicity.scored(none, model).count() == 0 and toxicity.accepted(docs, model).columns == docs.columns
    assert toxicity.accepted(docs, toxicity.fit(none, one_kind)).count() == len(rows)


def test_gradient_reaches_the_windows_that_won():
    rng = np.random.default_rng(0)
    texts = [rng.integers(1, 500, (n, 3)).astype(np.int32) for n in (1, 2, 30, 0, 7)] * 8
    y = np.array([0, 1, 0, 0, 1] * 8, np.float32)
    for i in np.flatnonzero(y):
        texts[i][0] = 7
    model = toxicity.train(texts, y, epochs=8)
    first, buckets = toxicity._packed(texts, np.arange(len(texts)))
    assert (((model.scores(first, buckets) >= 0.5) == (y == 1)).mean()) > 0.9


def test_pipeline_on_hard_rows(spark, docs, rows, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    at = f"file://{tmp_path}"
    table = docs.select("doc_id", "text", "lang", "source", "n_chars")
    table.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    got = table
    for name, stage in pipeline.STAGES[:-1]:
        before, source = got.count(), got
        got = stage(spark, got, at).cache()
        assert got.columns == table.columns, name
        if name in ("toxicity", "line_dedup"):
            assert got.count() == before, name
        if name == "near_dedup":
            ids = [r.doc_id for r in got.collect() if r.doc_id is not None]
            want = components({r.doc_id: shingles(r.text) for r in source.collect() if r.doc_id is not None}, 80)
            assert sorted(ids) == sorted(set(want.values()))
    last = pipeline.run(spark, at).toPandas()
    assert last.groupby("sequence_id").length.sum().max() <= 2048
