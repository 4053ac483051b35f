"""Prefix trie against brute force, with shards, pieces and queues small enough to be passed between."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from granary.llm import prefix_trie as module
from granary.llm.prefix_trie import SpillingQueue, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, n string"


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h, base = zlib.crc32(str(c).encode()) % 6, c - c % 100
        seq = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (m[0], len(p), str(members[p[:-1]][0] if p else None), len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items()
    )


def result(df):
    return sorted((r.conv_id, r.depth, str(r.parent_conv_id), r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def make_rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(0, 900), 160) + [0, 100, 500, 700, 1 << 40]:
        if c in {r[0] for r in rows}:
            continue
        for turn in range(rng.choice([1, 2, 4, 7, 12])):
            rows.append((c, turn, rng.choice(["user", "assistant"]) if turn > 2 else "user", rng.choice(["hi", "höllo", "x" * 40]) if rng.random() < 0.9 else f"t{rng.randrange(9)}", 1, "n"))
    rows += [(300, None, None, None, 1, "n"), (300, None, "user", "hi", 1, "n"), (300, 2, "user", None, 1, "n"), (None, 1, "user", "hi", 1, "n"), rows[5], rows[5], (rows[7][0], rows[7][1], "b", "tie", 1, "n")]
    # a conversation copied many times, and two long ones that part late
    rows += [(c, t, "user", f"copied {t}", 1, "n") for c in range(2000, 2100) for t in range(9)]
    rows += [(c, t, "user", "again" if t < 60 else f"{c}", 1, "n") for c in (3000, 3100) for t in range(70)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("members, block, held", [(1000, 4096, 200_000), (5, 4, 3), (1, 7, 10)])
def test_against_brute_force(frame, members, block, held):
    rows = make_rows(members)
    assert result(prefix_trie(frame(rows, SCHEMA), members, block, held)) == brute(rows)


def test_members_grow_with_the_input(frame, monkeypatch):
    monkeypatch.setattr(module, "TOP", 20)
    rows = make_rows(9)
    assert result(prefix_trie(frame(rows, SCHEMA), 1, 16)) == brute(rows)


def test_turnless_empty_and_very_long(frame):
    # 101 and 102 have no base, and no turns left where h is at least their number of turns
    rows = [(c, t, "user", "y" * 300_000 if c == 130 else "a", 1, "n") for c in range(101, 140) for t in range(2)]
    want = brute(rows)
    assert result(prefix_trie(frame(rows, SCHEMA))) == want and any(r[1] == 0 and r[7] != hashlib.sha256().hexdigest() for r in want)
    assert prefix_trie(frame([], SCHEMA)).collect() == []
    assert prefix_trie(frame([(None, 1, "user", "a", 1, "n")], SCHEMA)).collect() == []


def test_long_conversation_crosses_stretches(frame):
    rows = [(c, t, "user", f"t{t}" if t < 2500 else f"{c} {t}", 1, "n") for c in (200, 207) for t in range(3000)]
    got = result(prefix_trie(frame(rows, SCHEMA), 1, 512))
    shared = [r for r in got if r[3] == 2]
    assert len(got) == 1 + 2500 + 2 * 500 and len(shared) == 2501
    root = next(r for r in got if r[1] == 0)
    assert root[4:7] == (1, 2, sum(len(f"t{t}") for t in range(2500)))


def test_queue_spills_and_merges():
    rng, queue = random.Random(2), SpillingQueue(held=7, most_runs=2)
    messages = [(rng.randrange(30), rng.randrange(5), 0, 1, 2, rng.randrange(100)) for _ in range(2000)]
    for m in messages:
        queue.push(m)
    for key in sorted({m[:3] for m in messages}):
        assert queue.take(key) == tuple(sum(m[i] for m in messages if m[:3] == key) for i in (3, 4, 5))
    assert queue.take((99, 0, 0)) == (0, 0, 0)
