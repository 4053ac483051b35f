"""Maximum-entropy scores: base score by brute force, probabilities that sum to one, gain on held-out texts."""

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.llm import lm
from granary.llm.lm import CLASSES, HEAD, START, SYMBOLS, Model, contexts_of, gradient, language_scores, scores, tail_class


def tokens_of(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def brute(rows, learn):
    counts = Counter(t for i, text in rows if learn(i) for t in tokens_of(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, text in rows:
        t = tokens_of(text)
        out.append((str(i), not learn(i), len(t), sum(counts[x] > 0 for x in t), n, sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)))
    return sorted(out)


def close(got, want):
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all(abs(a[5] - b[5]) <= 1e-6 * max(1, abs(b[5])) for a, b in zip(got, want))


def result(df):
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in df.collect())


def in_training(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 != 0


def test_contexts_of_several_texts():
    got = contexts_of(np.array([5, 6, 7, 8, 9]), np.array([3, 1, 1]))
    want = [(START, START), (START, 5), (5, 6), (START, START), (START, START)]
    assert [(c // SYMBOLS, c % SYMBOLS) for c in got.tolist()] == want


def random_model(seed=0):
    rng = np.random.default_rng(seed)
    model = Model(100, 50, {}, {}, {}, np.ones(CLASSES - HEAD // lm.CLASS_SIZE), rng.normal(size=CLASSES + HEAD))
    model.weights = rng.normal(size=model.weights.shape).astype(np.float32)
    return model


def test_chances_of_a_context_sum_to_one():
    logs = random_model().logs(np.arange(0, SYMBOLS * SYMBOLS, 97))
    assert logs.shape[1] == SYMBOLS - 1
    assert np.allclose(np.exp(logs).sum(1), 1)


def test_gradient_against_differences():
    model, rng = random_model(1), np.random.default_rng(2)
    model.weights *= 0
    contexts, symbols, n = rng.integers(0, 200, 60), rng.integers(0, SYMBOLS - 1, 60), rng.integers(1, 9, 60)
    rows, up, curve, _ = gradient(model, contexts, symbols, n)
    model.weights = model.weights.astype(np.float64)
    for _ in range(12):
        k, j = rng.integers(len(rows)), rng.integers(CLASSES + HEAD)
        total = []
        for d in (-1e-4, 1e-4):
            model.weights[rows[k], j] += d
            total.append(gradient(model, contexts, symbols, n)[3])
            model.weights[rows[k], j] -= d
        assert abs((total[1] - total[0]) / 2e-4 - up[k, j]) < 1e-3 * max(1, abs(up[k, j])) and (curve >= 0).all()


def test_base_score_and_odd_rows(frame, monkeypatch):
    monkeypatch.setattr(lm, "LOOKUP", 150)  # most words reach the texts by the join
    rng = random.Random(6)
    words = [f"{'AbÉ'[k % 3]}w{k}" for k in range(400)]
    rows = [(i, rng.choice([" ", "\n", "\x0b "]).join(words[min(399, int(rng.expovariate(0.02)))] for _ in range(rng.randrange(60)))) for i in range(150)]
    rows += [(None, "aw0 new"), (900, None), (901, ""), (902, "aw0 " * 50_000), (903, "x" * 100_000), (904, "aw0"), (904, "aw0"), (905, "\x1c \x85 nbsp x")]
    docs = frame([(*r, "q", 1) for r in rows], "doc_id long, text string, token string, row int").repartition(4)
    got = scores(docs)
    close(result(got), brute(rows, in_training))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got.collect())


def test_empty_tables(frame):
    assert scores(frame([], "doc_id long, text string")).collect() == []
    row = language_scores(frame([(1, "a")], "doc_id long, text string"), F.lit(False)).collect()[0]
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (True, 2, 0, 0)


def test_held_out_texts_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = scores(docs).collect()
    close(sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows), brute([(r.doc_id, r.text) for r in docs.collect()], in_training))
    held = [r for r in rows if r.held_out]
    n = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / n > sum(r.base_score for r in held) / n + 0.05


def test_word_order_matters(spark):
    """The model prefers texts to the same words in another order; the base cannot tell them apart."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang <> 'en' or doc_id < 300")
    mixed = docs.where("doc_id % 10 = 3").select((F.col("doc_id") + 1_000_000).alias("doc_id"), F.concat_ws(" ", F.sort_array(F.split("text", r"\s+"))).alias("text"))
    both = docs.select("doc_id", "text").union(mixed)
    got = {r.doc_id: r for r in language_scores(both, F.col("doc_id") < 1_000_000).collect()}
    pairs = [(got[i - 1_000_000], got[i]) for i in got if i >= 1_000_000]
    assert sum(a.score / a.n_tokens for a, _ in pairs) > sum(b.score / b.n_tokens for _, b in pairs)


@pytest.mark.parametrize("ending", [b"", b"a", b"ab", b"\xc3\xa9"])
def test_every_ending_has_a_class(ending):
    assert 0 <= tail_class({b"ab": 1}, ending) < lm.TAIL


def small_model(frame, lookup, monkeypatch):
    monkeypatch.setattr(lm, "LOOKUP", lookup)
    rng = random.Random(3)
    texts = frame([(" ".join(f"{rng.choice('abc')}{k}{'xyz'[k % 3]}q" for k in (min(899, int(rng.expovariate(0.005))) for _ in range(40))),) for _ in range(200)], "text string")
    texts = texts.select(F.col("text").cast("binary").alias("text"))
    return lm.train(texts, lm._token_counts(texts), 2)


def test_chances_of_all_leaves_sum_to_one(frame, monkeypatch):
    """With weights of words fitted to events, whatever the history."""
    model = small_model(frame, 300, monkeypatch)
    n, rng = model.leaves.count, np.random.default_rng(4)
    assert n > 300 and (model.tree.up == -1).sum() == 1
    seen = rng.integers(0, n, (3, 4000))
    for last, before in ((n, n), (5, n), (n - 1, 7), (140, 200)):
        seen[1][:500], seen[2][:500] = last, before
        events = [np.concatenate([a, b]).astype(np.int32) for a, b in zip(seen, (np.arange(n), np.full(n, last), np.full(n, before)))]
        got = lm.share_scores(model.tree, *events, np.arange(4000 + n) < 4000)[4000:]
        assert abs((10**got).sum() - 1) < 1e-4
        plain = lm.share_scores(model.tree, *events, np.zeros(4000 + n, bool))[4000:]
        assert abs((10**plain).sum() - 1) < 1e-4 and np.abs(got - plain).max() > 0.1


def test_leaves_follow_the_vocabulary(frame, monkeypatch):
    few, many = (small_model(frame, lookup, monkeypatch).leaves for lookup in (1200, 150))
    assert many.size.sum() > 3 * few.size.sum()  # words without a leaf of their own get more leaves by hash
    assert len(many.own) + lm.TOGETHER * many.size.sum() >= 900


@pytest.mark.parametrize("lookup", [1 << 17, 200])
def test_words_of_one_ending_are_told_apart_by_the_words_before(frame, monkeypatch, lookup):
    """Each of 600 equally frequent words of one ending has one successor."""
    monkeypatch.setattr(lm, "LOOKUP", lookup)
    monkeypatch.setattr(lm, "EVENTS", 4000)  # several shares
    rng, rows = random.Random(8), []
    for i in range(500):
        k, words = rng.randrange(600), []
        for _ in range(40):
            words.append(f"w{k}zz")
            k = (k * 7 + 3) % 600
        rows.append((i, " ".join(words)))
    docs = frame(rows, "doc_id long, text string").repartition(3)
    held = [r for r in scores(docs).collect() if r.held_out]
    n = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / n > sum(r.base_score for r in held) / n + 0.9


def test_a_frequent_word_is_dealt_to_several_shares(frame, monkeypatch):
    monkeypatch.setattr(lm, "EVENTS", 500)
    docs = frame([(i, "the the the the end") for i in range(400)], "doc_id long, text string").repartition(2)
    close(result(scores(docs)), brute([(i, "the the the the end") for i in range(400)], in_training))


def test_columns_survive_squeezing():
    columns = [np.arange(7, dtype=np.int32) - 3, np.arange(7, dtype=np.uint16) * 999, np.linspace(0, 1, 7)]
    got = lm.stretch(lm.squeeze(*columns), "i4", "u2", "f8")
    assert all((a == b).all() for a, b in zip(columns, got))


def test_tasks_stay_small(frame, monkeypatch):
    """Shares are alike in size though a few words are very frequent, and a batch of texts is cut to words in pieces."""
    monkeypatch.setattr(lm, "EVENTS", 4000)
    rng, most = random.Random(9), []
    texts = [" ".join(f"w{min(999, int(rng.expovariate(0.02)))}" for _ in range(60)) for _ in range(1500)]
    docs = frame([(i, i, False, bytearray(t.encode())) for i, t in enumerate(texts)], "row long, id long, held_out boolean, text binary")
    model = lm.train(docs.select("text"), lm._token_counts(docs.select("text")), 1)
    shares = 1 + model.tokens // lm.EVENTS
    context = docs.sparkSession.sparkContext
    sizes = Counter()
    for r in lm._deal(docs.coalesce(1), context.broadcast(model), shares, lm.EVENTS).where("share >= 0").collect():
        sizes[r.share] += len(lm.stretch(r.data, *lm.EVENT)[0])
    assert sum(sizes.values()) == model.tokens and len(sizes) == shares and max(sizes.values()) < 1.4 * lm.EVENTS

    cut = lm.texts_of
    monkeypatch.setattr(lm, "texts_of", lambda cols: (most.append(len(cols["text"])), cut(cols))[1])
    deal = type("Rows", (), {"schema": docs.schema, "mapInArrow": lambda self, run, schema: run})()
    list(lm._deal(deal, type("Shared", (), {"value": model}), shares, lm.EVENTS)(iter(docs.coalesce(1).toArrow().combine_chunks().to_batches())))
    assert sum(most) == 1500 and max(most) <= 250


def test_equal_events_count_each(frame, monkeypatch):
    """Events that occur several times have the scores they would have one by one, and weigh as many."""
    model = small_model(frame, 300, monkeypatch)
    rng = np.random.default_rng(1)
    events = [rng.integers(0, 12, 3000).astype(np.int32) for _ in range(3)]
    learn = np.arange(3000) % 4 > 0
    got = lm.share_scores(model.tree, *events, learn)
    asked = []
    choices = lm.Tree.choices
    monkeypatch.setattr(lm.Tree, "choices", lambda tree, word, *rest: (asked.append(len(word)), choices(tree, word, *rest))[1])
    order = rng.permutation(3000)
    again = lm.share_scores(model.tree, *(x[order] for x in events), learn[order])
    assert np.allclose(again, got[order], atol=1e-5)
    assert sum(asked) == len(np.unique(np.stack(events), axis=1).T)


def test_texts_are_cut_like_bytes():
    """Bytes that are no UTF-8, other spaces, NULLs, slices of a batch."""
    texts = [None, b"", b" ", b"\n a\x0bB \xff\xfeZ\x00q ", b"x\x1c y\x85 \xc2\xa0z", "É AÉ ſ İ".encode(), b"a", b"\xc3", b" " * 5, b"AA aa\t\r\n\x0c"]
    for a, n in ((0, 10), (3, 4), (1, 2), (0, 1)):
        got = lm.texts_of({"text": pa.array(texts, pa.binary()).slice(a, n)})
        tokens = [got.tokens[c].as_py() for c in got.code.tolist()]
        assert tokens == [t for x in texts[a : a + n] for t in [*(x or b"").lower().split(), b""]]
        assert got.lens.tolist() == [len((x or b"").split()) + 1 for x in texts[a : a + n]]


def test_classes_of_many_tokens():
    rng = random.Random(1)
    tokens = [bytes(rng.randrange(256) for _ in range(rng.randrange(1, 5))) for _ in range(2000)] + [b"a", b"\x00", b"\x00a"]
    tail_of = {b"ab": 3, b"a": 5, tokens[0][-2:]: 7, b"\x00a": 9}
    got = lm.tail_classes(tail_of)(pa.array([b"zz", *tokens], pa.binary()).slice(1))
    assert got.tolist() == [tail_class(tail_of, t[-2:]) for t in tokens]


def test_what_is_dealt_and_summed_takes_few_bytes(frame, monkeypatch):
    monkeypatch.setattr(lm, "EVENTS", 20_000)
    rng = random.Random(5)
    texts = [" ".join(f"w{min(4999, int(rng.expovariate(0.002)))}" for _ in range(100)) for _ in range(2000)]
    docs = frame([(i, i, False, bytearray(t.encode())) for i, t in enumerate(texts)], "row long, id long, held_out boolean, text binary").coalesce(1)
    model = lm.train(docs.select("text"), lm._token_counts(docs.select("text")), 1)
    context, shares = docs.sparkSession.sparkContext, 1 + model.tokens // lm.EVENTS
    tree, model.tree = context.broadcast(model.tree), None
    dealt = lm._deal(docs, context.broadcast(model), shares, lm.EVENTS).repartition(shares, "share").sortWithinPartitions("share", "batch")
    events = [r.data for r in dealt.where("share >= 0").collect()]
    assert sum(map(len, events)) < 5.0 * model.tokens
    sums = [r.data for r in lm._fit_shares(dealt, tree, 1).where("share >= 0").collect()]
    assert sum(map(len, sums)) < 5 * sum(int.from_bytes(b[:8], "little") for b in sums)


def test_training_leaves_no_shuffle_files(spark, frame):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {str(f) for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(files.getAllFiles()) if "shuffle_" in str(f)}
    before, key = shuffled(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    asked = spark.conf.get(key)
    scores(frame([(i, f"a{i % 50} b{i % 7} c") for i in range(2000)], "doc_id long, text string").repartition(3))  # trains; its result is not run
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before and spark.conf.get(key) == asked
