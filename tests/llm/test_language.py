"""Language model: held-out accuracy, penalties, calibration, odd rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from granary.llm.language import codes, counts, languages, predict, proximal, softmax, temperature, train


def test_codes_and_counts():
    assert "".join(map(chr, codes("Ab1c, É!").tolist())) == " ab c é "
    assert len(codes("12 !?\n")) == 0 and len(counts(None)[0]) == 0 and len(counts("")[0]) == 0
    at, x = counts("aaaa")
    assert len(at) <= 6 and (x >= 1).all()


def test_proximal_is_sparse_and_shrunk():
    z, n = np.array([0.05, -0.05, 0.2, -0.4]), np.ones(4)
    w = proximal(z, n, 0.5, 1.0, 0.1, 0.5)
    assert w[0] == w[1] == 0 and w[2] < 0 < w[3]
    assert (np.abs(proximal(z, n, 0.5, 1.0, 0.1, 50.0)) <= np.abs(w)).all()


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(4000, 3)) * 2
    truth = np.array([rng.choice(3, p=p) for p in softmax(logits)])
    assert abs(temperature(logits * 3, truth) - 3) < 0.3


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = languages(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_weights_are_mostly_zero_and_held_out_labels_unread(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    a = train(docs, ~held)
    b = train(docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))), ~held)
    assert a.langs == b.langs and np.allclose(a.weights, b.weights, atol=1e-9)
    assert 0 < (a.weights != 0).mean() < 0.2


def test_edge_rows(frame):
    rows = [(i, w * 5, lang) for i in range(40) for w, lang in (("the house and ", "en"), ("das Haus und ", "de"))]
    rows = [(n, t, lang) for n, (_, t, lang) in enumerate(rows)]
    odd = [(None, "the house", "en"), (90, None, "en"), (91, "", "de"), (92, "12 34 !", "de"), (93, "das Haus", None), (94, "the house " * 50_000, "en"), (94, "the house", "en")]
    docs = frame([(*r, "z") for r in rows + odd], "doc_id long, text string, lang string, held_out string")
    model = train(docs, F.lit(True))
    got = [(r.doc_id, r.lang_pred) for r in predict(docs, model).collect() if r.doc_id is None or r.doc_id >= 90]
    assert sorted(map(str, got)) == sorted(map(str, [(None, "en"), (90, "und"), (91, "und"), (92, "und"), (93, "de"), (94, "en"), (94, "en")]))
    none = train(docs.limit(0), F.lit(True))
    assert none.langs == [] and predict(docs.limit(0), none).count() == 0
    assert {r.lang_pred for r in predict(docs, none).collect()} == {"und"}
