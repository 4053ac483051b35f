"""Pairwise quality ranking: held-out accuracy and defined results for odd rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from granary.llm import quality
from granary.llm.quality import FEATURES, THRESHOLD, Ranker, code_values, fit, keep_good, measures, quality_scores, score, train, value_codes

FOLDER = "/root/testdata/sf0.1"


def test_measures_are_finite():
    for text in (None, b"", b" \n\t", b"a", "é ü".encode(), b"\xff\xfe", b"a " * 100_000, b"x" * 300_000, b"$$$ ||| ###"):
        row = measures(text)
        assert len(row) == len(FEATURES) and np.isfinite(row).all()


def test_ranks_and_threshold_by_quantile():
    rng = np.random.default_rng(0)
    labels = (rng.random(2000) < 0.8).astype(int)
    rows = rng.normal(size=(2000, 3))
    rows[:, 1] = np.where(labels == 1, rng.normal(size=2000), rng.normal(size=2000) * 0.3 + 3)
    model = fit(rows, labels)
    got = model.score(rows)
    assert (got[labels == 1].mean() > 0.6) and (got[labels == 0].mean() < THRESHOLD)
    # the quantile that divides the labels is where the threshold lies
    assert abs((got < THRESHOLD).mean() - (labels == 0).mean()) < 0.02


def test_one_label_or_none():
    rows = np.zeros((3, len(FEATURES)))
    assert (fit(rows, np.ones(3, int)).score(rows) > THRESHOLD).all()
    assert (fit(rows, np.zeros(3, int)).score(rows) < THRESHOLD).all()
    assert isinstance(fit(rows[:0], np.zeros(0, int)), Ranker)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_scores(docs, labels)
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert rows and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.predicted for r in good) >= 0.97 * len(good)
    assert sum(r.predicted for r in bad) <= 0.06 * len(bad)
    assert all((r.score >= THRESHOLD) == bool(r.predicted) and 0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(quality_scores(docs, labels).collect()) == sorted(quality_scores(docs, other).collect())


def test_edge_rows(frame):
    rows = [(1, None), (2, ""), (None, "a few words"), (3, "w " * 300_000), (3, "w " * 300_000)]
    docs = frame([(*r, "k", 1.0) for r in rows], "doc_id long, text string, label string, score double")
    labels = frame([(1, None), (None, 1), (3, 0), (3, 1), (2, 1), (9, 1)], "doc_id long, quality int")
    model = train(docs, labels, F.lit(True))
    got = score(docs, model).collect()
    assert len(got) == 5 and sum(r.doc_id == 3 for r in got) == 2
    kept = keep_good(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}
    empty = train(docs.limit(0), labels.limit(0), F.lit(True))
    assert score(docs.limit(0), empty).count() == 0 and keep_good(docs, empty).count() == 5


def test_learns_from_every_label(frame):
    """5,000 alike good documents of small hash would fill a sample; the others are learned from all the same."""
    rows = [(i, "plain words of a good text " * 3, 1) for i in range(5000)]
    rows += [(5000 + i, "some words that nobody wants " * 3 + "$$$ ### " * (i % 3 + 1), 0) for i in range(6000)]
    docs, labels = frame([r[:2] for r in rows], "doc_id long, text string").repartition(3), frame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    model = train(docs, labels, F.lit(True), rounds=3)
    whole = fit(np.array([measures(t.encode()) for _, t, _ in rows], float), np.array([q for *_, q in rows]), rounds=3)
    assert np.array_equal(model.cuts, whole.cuts) and np.allclose(model.weights, whole.weights)
    assert abs(model.middle - whole.middle) < 2e-3 and abs(model.scale - whole.scale) < 2e-3
    assert sum(r.predicted for r in score(docs, model).where("doc_id < 5000").collect()) == 5000


def test_gradient_is_that_of_all_pairs():
    rng = np.random.default_rng(5)
    rows, labels = rng.normal(size=(60, 2)), np.arange(60) % 3 // 2
    model = fit(rows, labels, rounds=1, decay=0.0)
    cells = model.cells(rows)
    step = np.zeros(model.weights.size)
    for i in cells[labels == 1]:
        for j in cells[labels == 0]:
            np.add.at(step, i, 0.5)
            np.add.at(step, j, -0.5)
    step /= 20 * 40
    assert np.allclose(model.weights.ravel(), 0.3 * step / np.sqrt(step**2 + 1e-6))


def test_values_keep_their_order_as_codes():
    x = np.array([-1e300, -2.5, -1.0, -1e-9, 0.0, 1e-9, 0.3, 1.0, 1.5, 7e8])
    codes = value_codes(x)
    assert (np.diff(codes) > 0).all() and np.allclose(code_values(codes), x, rtol=2**-10) and value_codes(np.array([-0.0]))[0] == 0


def test_texts_are_not_shuffled(spark, frame, monkeypatch):
    """Features are made below every exchange, also where the labels are too many to be broadcast."""
    docs = frame([(i, "plain words " * (i % 5)) for i in range(40)], "doc_id long, text string")
    labels = frame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    plans, write, limit = [], quality.cut_lineage, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(quality, "cut_lineage", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        train(docs, labels, F.lit(True), rounds=1)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    below = []
    for plan in plans:
        lines = plan.splitlines()
        for k, line in enumerate(lines):
            if "MapInArrow" in line:
                for x in lines[k + 1 :]:
                    if len(x) - len(x.lstrip(" :+-")) <= line.index("MapInArrow"):
                        break
                    below.append(x)
    assert any("Exchange" in p for p in plans) and below and not any("Exchange" in x for x in below)
