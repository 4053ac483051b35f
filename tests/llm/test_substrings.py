"""Substring dedup against brute force."""

import hashlib
import random
import re
from collections import defaultdict

from granary.llm import substrings
from granary.llm.substrings import ANCHOR, COVER, PERIOD, WINDOW, substring_dedup


def test_cover_brings_any_two_places_to_an_anchor():
    for a in range(PERIOD):
        for b in range(PERIOD):
            assert any((a + s) % PERIOD in COVER and (b + s) % PERIOD in COVER for s in range(PERIOD))
    assert ANCHOR + PERIOD - 1 == WINDOW


def brute(rows):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in docs:
        if i is not None:
            for s in range(len(w) - WINDOW + 1):
                g = tuple(w[s : s + WINDOW])
                least[g] = min(least.get(g, i), i)
    out = []
    for i, w in docs:
        gone = set()
        if i is not None:
            for s in range(len(w) - WINDOW + 1):
                if least[tuple(w[s : s + WINDOW])] < i:
                    gone.update(range(s, s + WINDOW))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def make_rows(rng, n):
    passages = [[f"p{j}w{k}é" for k in range(rng.randrange(5, 70))] for j in range(8)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(0, 6)):
            if rng.random() < 0.5:
                p = rng.choice(passages)
                a = rng.randrange(len(p))
                words += p[a : a + rng.randrange(1, 60)]
            else:
                words += [f"u{rng.randrange(30)}" for _ in range(rng.randrange(20))]
        rows.append((i * 3 - 50, rng.choice([" ", "\n", "\t "]).join(words)))
    return rows


def test_against_brute_force(spark, frame, monkeypatch):
    rng = random.Random(11)
    monkeypatch.setattr(substrings, "BUCKET_ENTRIES", 200)  # several buckets
    rows = make_rows(rng, 250)
    rows += [(9000 + i, rows[3][1] + " tail" * (i % 3)) for i in range(60)]  # a large group of copies
    long = " ".join(f"x{k % 977}" for k in range(60_000))
    rows += [(5, None), (6, ""), (7, " \n"), (None, rows[3][1]), (rows[8][0], rows[8][1]), (rows[9][0], rows[10][1]), (70_000, long), (70_001, long + " z"), (70_002, "a " * 30_000)]
    rng.shuffle(rows)
    docs = frame([(*r, "x", b"y") for r in rows], "doc_id long, text string, mark string, pos binary").repartition(5)
    assert result(substring_dedup(docs)) == brute(rows)


def test_small_batches_settle_the_same(spark, frame):
    rows = make_rows(random.Random(2), 120)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("3", "1000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert result(substring_dedup(frame(rows, "doc_id long, text string"))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_empty_table_and_integer_ids(frame):
    assert substring_dedup(frame([], "doc_id int, text string")).collect() == []
    assert substring_dedup(frame([(1, "a")], "doc_id int, text string")).schema["doc_id"].dataType.simpleString() == "int"
