"""Spelling variants against brute force: composed pairs, partitions of all sizes, whole results."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from granary.llm import spelling
from granary.llm.spelling import Acceptors, near_pairs, spelling_variants, variants

SCHEMA = "doc_id long, text string, word string, n int, l string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def shared(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def brute(counts):
    out = {}
    for w in counts:
        others = [v for v in counts if near(w, v)]
        form = min(others, key=lambda v: (-counts[v], v)) if others else None
        form = form if form and counts[form] >= 5 * counts[w] else None
        out[w] = (form, counts[w], len(others), counts[form] if form else None)
    rows = []
    for w, (form, *rest) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form or "", root, *(x or 0 for x in rest)))
    return sorted(rows)


def observed(rows):
    total = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            total[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def result(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def test_composed_pairs_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        size = rng.randrange(6)
        short, long = (sorted({"".join(rng.choice("abc") for _ in range(k)) for _ in range(rng.randrange(40))}) for k in (size, size + 1))
        places = rng.randrange(1, size + 3)
        want = {tuple(sorted(p)) for p in itertools.chain(itertools.combinations(short, 2), itertools.product(short, long)) if near(*p) and shared(*p) < places}
        assert sorted(tuple(sorted(p)) for p in near_pairs(short, long, places)) == sorted(want)


def test_acceptors_are_minimal():
    made = Acceptors()
    made.add(sorted(a + b + c for a in "abc" for b in "xyz" for c in "uv"))
    assert len(made.arcs) == 4  # one state for each place, and the final one
    made.add(["axu", "axv"])
    assert len(made.arcs) == 6  # the last state is shared


def make_rows(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdeé×ßÀ") for _ in range(rng.randrange(5, 11))) for _ in range(30)]
    words = []
    for stem in stems:
        for k in range(12):
            w = list(stem)
            for _ in range(rng.choice([0, 1, 1, 2])):
                i = rng.randrange(len(w))
                w[i : i + rng.randrange(2)] = rng.choice(["", "a", "é", "xy"])
            words += ["".join(w)] * rng.choice([1, 4, 5, 6, 30, 31, 160, 900])
    rng.shuffle(words)
    words = [w.upper() if rng.random() < 0.1 and w.isascii() else w for w in words]
    return [(i if i else None, rng.choice([" ", ", ", "\n", "1", "ÿ1"]).join(words[k : k + 50])) for i, k in enumerate(range(0, len(words), 50))]


def test_against_brute_force(frame):
    rows = make_rows(3)
    rows += [(3, None), (4, ""), (5, "  12 "), rows[1], rows[1], (9, "Longest " * 50_000 + "longer " * 3 + "x" * 70_000)]
    docs = frame([(*r, "w", 1, "l") for r in rows], SCHEMA)
    got, want = result(spelling_variants(docs)), brute(observed(rows))
    assert got == want and sum(r[1] != "" for r in want) > 20


@pytest.mark.parametrize("limit", [7, 60])
def test_crowded_partitions_are_cut(frame, monkeypatch, limit):
    monkeypatch.setattr(spelling, "LEAST_LIMIT", 0)
    rng = random.Random(limit)
    # one prefix and one suffix hold most words
    words = {"aaaaaa" + "".join(rng.choice("abc") for _ in range(rng.randrange(2, 6))) for _ in range(250)}
    words |= {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 5))) + "bbbbbb" for _ in range(100)} | {"z" * 300, "z" * 301, "z" * 150 + "y" + "z" * 150}
    counts = {w: rng.choice([5, 25, 125, 700]) for w in words}
    cells = spelling._partitions(frame(list(counts.items()), "word string, n long"), limit)
    assert cells.groupBy("l", "lo", "hi", "key").count().where(f"count > {limit} and lo < hi").isEmpty()
    assert result(variants(frame(list(counts.items()), "word string, n long"), limit=limit)) == brute(counts)


def test_long_chains_of_forms(frame):
    counts = {"a" * (6 + k): 5 ** (k + 1) for k in range(14)}
    got = {r.word: r.root for r in variants(frame(list(counts.items()), "word string, n long")).collect()}
    assert set(got.values()) == {"a" * 19}


def test_empty_table(frame):
    assert spelling_variants(frame([], SCHEMA)).collect() == []
    assert spelling_variants(frame([(1, None, "w", 1, "l")], SCHEMA)).collect() == []
