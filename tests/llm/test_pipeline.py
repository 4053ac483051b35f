"""The pipeline's stages, each against brute force on its own input."""

import re

import pytest

import corpus_pipeline
from granary.llm import quality
from granary.llm.decontaminate import normal_words
from granary.llm.secrets import find_secrets

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage was given and returned, written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{folder}/{k}")
        given, docs = docs, spark.read.parquet(f"{folder}/{k}")
        out[name] = given, docs
    return out


def test_order_and_columns(stages, spark):
    columns = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "secret scans", "best-fit packing"]
    for _, out in list(stages.values())[:-1]:
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in columns]


def test_quality(stages, spark):
    given, out = stages["quality classifier"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r.doc_id for r in out.collect()}
    asked = [r.doc_id for r in given.collect() if r.doc_id in labels]
    good, bad = [i for i in asked if labels[i]], [i for i in asked if not labels[i]]
    assert sum(i in kept for i in good) >= 0.97 * len(good) and sum(i in kept for i in bad) <= 0.1 * len(bad)
    assert quality.THRESHOLD == 0.3


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def test_near_duplicates(stages):
    given, out = stages["MinHash near-dedup"]
    sets = sorted((r.doc_id, shingles(r.text or "")) for r in given.collect())
    group = {i: i for i, _ in sets}
    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if s and t and min(len(s), len(t)) * 100 >= 80 * max(len(s), len(t)) and 100 * len(s & t) >= 80 * len(s | t):
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, g in group.items() if i == g)


def test_benchmark(stages, spark):
    given, out = stages["benchmark decontamination"]
    items = [" " + " ".join(normal_words(r.text)) + " " for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    exact = {r.doc_id for r in given.collect() if any(t in " " + " ".join(normal_words(r.text)) + " " for t in items)}
    kept = {r.doc_id for r in out.collect()}
    assert exact and not exact & kept and len(kept) >= given.count() - len(exact) - 5


def test_secrets(stages):
    given, out = stages["secret scans"]
    before, after = {r.doc_id: r for r in given.collect()}, {r.doc_id: r for r in out.collect()}
    assert before.keys() == after.keys()
    changed = [i for i in before if before[i].text != after[i].text]
    assert changed and set(changed) == {i for i, r in before.items() if find_secrets(r.text or "")[1]}
    assert all(not find_secrets(r.text or "")[0] and r.n_chars == len(r.text) for r in after.values())
    assert not any(re.search(r"token = \"[0-9a-f]{40}", r.text) for r in after.values())


def test_packing(stages):
    given, out = stages["best-fit packing"]
    counts = {r.doc_id: len((r.text or "").encode().split()) + 1 for r in given.collect()}
    got = {}
    for r in out.collect():
        for i, n in zip(r.doc_ids, r.lengths):
            got[i] = got.get(i, 0) + n
    assert got == counts


def test_run_gives_the_same(stages, spark):
    assert sorted(map(str, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(str, stages["best-fit packing"][1].collect()))


def test_odd_rows_pass_through_every_stage(spark, frame, tmp_path):
    import os

    for name in ("labels", "benchmark"):
        os.symlink(f"{FOLDER}/{name}.parquet", tmp_path / f"{name}.parquet")
    text = " ".join(f"word{k} and the other one" for k in range(40))
    rows = [(None, text, "en", None, None, "x"), (1, None, None, "s", 0, None), (2, "", "en", "s", 0, "y"), (3, text, "en", "s", 1, "z"), (3, text, "en", "s", 1, "z"), (4, text + " " + text, "en", None, 2, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string"
    for docs in (frame(rows, schema), frame([], schema)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            assert out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= 0
