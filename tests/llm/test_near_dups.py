"""LSH forest near duplicates and components against brute force."""

import random
import re

import numpy as np
import pytest

from granary.llm import near_dups
from granary.llm.common import WordCodes
from granary.llm.components import components
from granary.llm.near_dups import near_duplicates, screen_bits, shingle_codes, signatures


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()


def roots_of(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows, size):
    sets = [(i, shingles(t, size)) for i, t in rows]
    links = [(a, b) for k, (a, s) in enumerate(sets) for b, t in sets[:k] if a is not None and b is not None and s and t and 100 * len(s & t) >= 80 * len(s | t)]
    roots = roots_of({i for i, _ in rows if i is not None}, links)
    return sorted((str(i), len(s), str(roots.get(i)), i is None or roots[i] == i) for i, s in sets)


def result(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in df.collect())


def edited(rng, words, share):
    return [f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def make_rows(seed):
    rng = random.Random(seed)
    rows, n = [], 0
    for _ in range(25):  # groups of copies at all distances from the limit
        base = [f"w{rng.randrange(60)}" for _ in range(rng.choice([3, 8, 30, 120]))]
        share = rng.choice([0, 0.01, 0.03, 0.05, 0.08])
        for _ in range(rng.randrange(1, 14)):
            rows.append((n := n + rng.randrange(1, 4), rng.choice([" ", "\n"]).join(edited(rng, base, share))))
    base = [f"g{rng.randrange(10**6)}" for _ in range(80)]  # one large group
    for _ in range(220):
        rows.append((n := n + 1, " ".join(edited(rng, base, 0.03)).upper()))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size, small, crowded, block", [(2, 64, 4096, 1000), (5, 3, 4096, 20), (2, 3, 60, 7)])
def test_against_brute_force(frame, monkeypatch, size, small, crowded, block):
    monkeypatch.setattr(near_dups, "BLOCK", block)
    monkeypatch.setattr(near_dups, "SMALL", small)
    monkeypatch.setattr(near_dups, "CROWDED", crowded)
    rows = make_rows(size)
    long = " ".join(f"x{k}" for k in range(40_000))
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, None), (None, rows[0][1]), (9004, "one"), (9005, "ONE"), (9006, "one two"), rows[3], rows[3], (9010, long), (9011, long + " y")]
    docs = frame([(*r, 1, "z") for r in rows], "doc_id long, text string, node int, code string")
    got, want = result(near_duplicates(docs, size=size)), brute(rows, size)
    assert got == want


def test_empty_table(frame):
    assert near_duplicates(frame([], "doc_id long, text string")).collect() == []
    assert near_duplicates(frame([(1, None)], "doc_id long, text string")).collect()[0].kept


@pytest.mark.parametrize("per_task", [400_000, 90])
def test_components_against_brute_force(frame, monkeypatch, per_task):
    monkeypatch.setattr("granary.llm.components.LINKS", per_task)
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1200)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)] + [(5000, 5000)]
    rng.shuffle(links)
    got = {r.node: r.root for r in components(frame(links, "u long, v long")).collect()}
    want = roots_of({x for e in links for x in e}, links)
    assert got == {n: r for n, r in want.items() if n != 5000}
    assert components(frame([], "u long, v long")).collect() == []


def test_signatures_estimate_similarity_and_screen_lets_links_pass():
    rng, codes = random.Random(9), WordCodes()
    missed = 0
    for _ in range(300):
        base = [b"%d" % rng.randrange(10**6) for _ in range(80)]
        other = [w if rng.random() > 0.05 else b"q%d" % rng.randrange(10**6) for w in base]
        a, b = shingle_codes(base, codes, 2), shingle_codes(other, codes, 2)
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        sig = signatures([a, b])
        assert abs((sig[0] == sig[1]).mean() - j) < 0.2
        bits = np.packbits((sig >> np.uint64(40) & np.uint64(1)).astype(np.uint8), axis=1).view(np.uint64)
        missed += j >= 0.8 and np.bitwise_count(bits[0] ^ bits[1]).sum() > screen_bits(0.8)
    assert missed == 0
