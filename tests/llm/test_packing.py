"""Best-fit packing: exact cover of all tokens, capacities, cost against a single length."""

import random
from collections import defaultdict

from granary.llm.packing import OVERHEAD, SIZES, best_fit, pack, packed, token_counts


def cost(bins, overhead=OVERHEAD):
    return sum(size + overhead for size, _ in bins)


def test_bins_hold_their_pieces_and_are_cut_down():
    rng = random.Random(1)
    for _ in range(60):
        sizes = tuple(sorted(rng.sample(range(5, 200), rng.randrange(1, 5))))
        lengths = sorted((rng.randrange(1, sizes[-1] + 1) for _ in range(rng.randrange(0, 120))), reverse=True)
        bins = best_fit(lengths, sizes, 7)
        assert sorted(i for _, p in bins for i in p) == list(range(len(lengths)))
        for size, p in bins:
            used = sum(lengths[i] for i in p)
            assert used <= size and size == min(s for s in sizes if s >= used)


def test_best_fit_takes_the_tightest_room():
    assert best_fit([6, 5, 4, 3], (10,), 0) == [(10, [0, 2]), (10, [1, 3])]


def test_several_sizes_cost_less_than_any_single_one():
    rng = random.Random(2)
    lengths = sorted((min(4096, int(rng.lognormvariate(5.5, 1.3)) + 1) for _ in range(4000)), reverse=True)
    many = cost(best_fit(lengths, SIZES, OVERHEAD))
    assert many <= cost(best_fit(lengths, (max(SIZES),), OVERHEAD))
    assert many <= 1.03 * (sum(lengths) + OVERHEAD * sum(lengths) / max(SIZES))


def check_cover(rows, counts, sizes):
    spans = defaultdict(list)
    for r in rows:
        assert r.n_tokens == sum(r.lengths) <= r.capacity and r.capacity in sizes and all(n > 0 for n in r.lengths)
        for i, s, n in zip(r.doc_ids, r.starts, r.lengths):
            spans[i].append((s, n))
    want = defaultdict(list)
    for i, n in counts:
        want[i] += [(s, min(max(sizes), n - s)) for s in range(0, n, max(sizes))]
    assert {k: sorted(v) for k, v in spans.items()} == {k: sorted(v) for k, v in want.items()}
    assert len({r.bin_id for r in rows}) == len(rows)


def test_all_tokens_of_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = [(r.doc_id, len((r.text or "").encode().split()) + 1) for r in docs.collect()]
    rows = packed(docs).collect()
    check_cover(rows, counts, SIZES)
    assert sum(r.n_tokens for r in rows) / sum(r.capacity for r in rows) > 0.97


def test_shards_and_edge_rows(frame):
    rows = [(i, "w " * (i * 37 % 300)) for i in range(200)] + [(None, "a b"), (500, None), (501, ""), (502, "x " * 100_000), (502, "x " * 100_000), (3, "same id")]
    docs = frame([(*r, "z", 1) for r in rows], "doc_id long, text string, n string, id int")
    counts = [(i, len((t or "").split()) + 1) for i, t in rows]
    got = pack(token_counts(docs), sizes=(64, 256), shard_tokens=5000).collect()
    check_cover(got, counts, (64, 256))
    assert len({r.bin_id.split("-")[0] for r in got}) > 5
    # the same whatever the partitions
    again = pack(token_counts(docs.repartition(7)), sizes=(64, 256), shard_tokens=5000).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert packed(docs.limit(0)).collect() == []
