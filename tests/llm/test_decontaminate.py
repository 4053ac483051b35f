"""Decontamination: recall of edited passages, exact edit distance, rows left alone."""

import random

import numpy as np

from granary.llm import decontaminate
from granary.llm.decontaminate import LIMIT, _embed, contaminated, drop_contaminated, edit_distance, make_block, matches, normal_words, window_size


def slow_distance(a, b):
    """Least edits from all of a to any stretch of b."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_edit_distance_against_brute_force():
    rng = random.Random(0)
    for _ in range(300):
        a = np.array([rng.randrange(4) for _ in range(rng.randrange(1, 12))])
        b = np.array([rng.randrange(4) for _ in range(rng.randrange(1, 30))])
        d, s, e = edit_distance(a, b)
        assert d == slow_distance(a.tolist(), b.tolist()) == levenshtein(a.tolist(), b[s:e].tolist())


def test_words():
    assert normal_words('The "Cat" ### sat-down, Élan! … a_b 5%') == ["the", "cat", "sat-down", "élan", "a_b", "5"]
    assert normal_words(None) == [] and normal_words("") == []
    assert all(window_size(n) <= n < window_size(n) * 1.3 + 2 for n in range(8, 300))


def test_walk_keeps_close_texts_close():
    """One edit changes few steps; unrelated texts agree by chance only."""
    rng = np.random.default_rng(1)
    walk = rng.integers(0, 1 << 63, (120, 500), dtype=np.uint64)
    steps = np.repeat(np.linspace(0, 0.6, 60)[:, None], 1, 1)
    text = rng.integers(1, 498, (50, 40))
    near = np.concatenate([text[:, :20], text[:, 21:], np.zeros((50, 1), int)], 1)
    far = rng.integers(1, 498, (50, 40))
    same = lambda x, y: (_embed(x, walk, steps) == _embed(y, walk, steps)).mean()
    assert same(text, text) == 1 and same(text, near) > 0.6 and same(text, far) < 0.1


def edit(rng, words, n):
    words = list(words)
    for _ in range(n):
        k, what = rng.randrange(len(words)), rng.randrange(3)
        words[k : k + 1] = [] if what == 0 else ["zz%d" % rng.randrange(99)] if what == 1 else ["zz", words[k]]
    return words


def corpus(seed):
    rng = random.Random(seed)
    common = [f"c{k}" for k in range(30)]
    word = lambda: rng.choice(common) if rng.random() < 0.5 else f"r{rng.randrange(5000)}"
    items = [(i, [word() for _ in range(rng.randrange(8, 60))]) for i in range(120)]
    items.append((500, [word() for _ in range(700)]))
    texts = [[word() for _ in range(rng.randrange(0, 300))] for _ in range(200)]
    planted = []
    for i, words in items:
        for share in (0, 0.5, 1):
            host = rng.choice(texts)
            k = rng.randrange(len(host) + 1)
            texts.append(host[:k] + edit(rng, words, int(share * LIMIT * min(len(words), 256))) + host[k:])
            planted.append((len(texts) - 1, i))
    return items, texts, planted


def test_recall_and_precision_against_brute_force():
    items, texts, planted = corpus(3)
    block = make_block(items)
    got = {(d, i) for d, i, *_ in matches(block, texts)}
    assert sum(p in got for p in planted) >= 0.97 * len(planted)
    truth = {(d, i) for i, words in items if i < 500 for d, t in enumerate(texts) if edit_distance(np.array([block.vocab[w] for w in words]), np.array([block.vocab.get(w, 0) for w in t] or [0]))[0] <= int(LIMIT * len(words))}
    found = {p for p in got if p[1] < 500}
    assert found <= truth and len(found) >= 0.97 * len(truth)


def test_long_items_among_short_ones_are_found():
    """The wanted share holds for each length, not on the mean of a block of mostly short items."""
    rng = random.Random(8)
    word = lambda: f"r{rng.randrange(5000)}"
    items = [(i, [word() for _ in range(12 if i < 400 else 200)]) for i in range(440)]
    block = make_block(items)
    for n in (12, 200):
        own = [x for x in items if len(x[1]) == n] * (1 if n == 12 else 5)
        texts = [[word() for _ in range(30)] + edit(rng, words, int(LIMIT * n)) + [word() for _ in range(30)] for _, words in own]
        got = {(d, i) for d, i, *_ in matches(block, texts)}
        truth = {(d, i) for d, (i, words) in enumerate(own) if slow_distance(words, texts[d]) <= int(LIMIT * n)}
        assert len(truth) == len(own) and len(truth & got) >= 0.97 * len(truth), n


def test_short_items_against_brute_force(frame):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(4)}"
    items = [(i, [word() for _ in range(1 + i % 9)]) for i in range(60)]
    texts = [[word() for _ in range(rng.randrange(0, 14))] for _ in range(200)]
    bench = frame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    docs = frame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.distance, r.start_word, r.end_word) for r in contaminated(docs, bench).collect() if r.item_id % 9 < 7}
    want = {(d, i): slow_distance(w, t) for i, w in items if len(w) < 8 for d, t in enumerate(texts)}
    want = {k: n for k, n in want.items() if n <= int(LIMIT * len(items[k[1]][1]))}
    assert {k: n for k, (n, _, _) in got.items()} == want and {n for n in want.values()} == {0, 1}
    assert all(levenshtein(items[i][1], texts[d][s:e]) == n for (d, i), (n, s, e) in got.items())
    assert {r.doc_id for r in drop_contaminated(docs, bench.where("length(text) > 14 and item_id % 9 < 7")).collect()} == set(range(200)) - {d for d, i in want if len(" ".join(items[i][1])) > 14}


def test_long_items_are_taken_whole():
    rng = random.Random(12)
    word = lambda: f"r{rng.randrange(5000)}"
    item = [word() for _ in range(700)]
    own = [word() for _ in range(50)]
    texts = [own + item[:260] + own, own + item[300:560] + own, own + edit(rng, item, 130) + own, own + item + own, item[20:]]
    got = matches(make_block([(4, item)]), texts)
    assert [d for d, *_ in got] == [2, 3, 4]
    assert [slow_distance(item, texts[d]) for d, *_ in got] == [n for _, _, n, _, _ in got]
    assert got[1] == (3, 4, 0, 50, 750)


def test_query_and_blocks(spark, frame):
    items, texts, planted = corpus(5)
    bench = frame([(i, " ".join(w).upper() + ".", "q") for i, w in items] + [(7, None, "q"), (None, "a b c d e f g h i", "q"), (900, "too short", "q")], "item_id long, text string, doc_id string")
    docs = frame([(d, "  ".join(t), "z") for d, t in enumerate(texts)] + [(None, " ".join(items[0][1]), "z"), (9000, None, "z"), (9001, "", "z"), (9002, " ".join(items[1][1] * 400), "z")], "doc_id long, text string, item_id string").repartition(3)
    one, several = (sorted((r.doc_id if r.doc_id is not None else -1, r.item_id) for r in contaminated(docs, bench, block_words=n).collect()) for n in (1 << 18, 700))
    for got in (one, several):
        assert sum(p in got for p in planted) >= 0.97 * len(planted) and (-1, 0) in got and (9002, 1) in got
        assert not any(d in (9000, 9001) for d, _ in got)
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {r.doc_id for r in docs.collect()} - {d if d >= 0 else None for d, _ in one}


def test_empty_tables(frame):
    docs, bench = frame([(1, "a b c d e f g h i j")], "doc_id long, text string"), frame([], "item_id long, text string")
    assert contaminated(docs, bench).collect() == [] and drop_contaminated(docs, bench).count() == 1
    some = frame([(1, "a b c d e f g h i j")], "item_id long, text string")
    assert contaminated(docs.limit(0), some).collect() == [] and drop_contaminated(docs.limit(0), some).count() == 0
    assert [tuple(r) for r in contaminated(docs, some).collect()] == [(1, 1, 0, 0, 10)]


def test_exact_passages_of_the_given_tables(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    items = [(r.item_id, " ".join(normal_words(r.text))) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items if f" {t} " in f" {' '.join(normal_words(r.text))} "}
    assert want and want <= got
    assert decontaminate.MIN_WORDS == 8
