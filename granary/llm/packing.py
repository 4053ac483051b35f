"""Best-fit packing of documents into sequences of several permitted lengths.

A document is its words and one end mark. It is cut into pieces of at most the longest permitted length, and
pieces are packed, longest first, each into the open sequence with the least room that fits it. If none fits, a
sequence is opened: of the permitted lengths that hold the piece, the one whose cost per token is least when it
is filled as well as the pieces still to come allow. At the end each sequence is cut down to the shortest
permitted length that holds its contents. A sequence costs its length and a fixed ``overhead``.

Only ids and lengths travel. Pieces are dealt to shards by hash, about ``shard_tokens`` tokens each, and each
shard is packed in one task; the number of shards grows with the tokens, and the pieces of a long document go to
several shards.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import map_batches, utf8, words
from granary.session import cut_lineage

SIZES = (512, 1024, 2048, 4096)
OVERHEAD = 32
SHARD_TOKENS = 4_000_000


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n): words and the end mark of every row; a NULL or empty text has the end mark only."""

    def make():
        def run(cols):
            return {"id": cols["id"], "n": [len(words(t)) + 1 for t in cols["text"].to_pylist()]}

        return run

    picked = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text"))
    return map_batches(picked, "id long, n long", make)


def best_fit(lengths: list[int], sizes: tuple[int, ...], overhead: int) -> list[tuple[int, list[int]]]:
    """(size, indices of the pieces) of each sequence; the lengths are in falling order and at most the largest size."""
    sizes = tuple(sorted(sizes))
    distinct = sorted(set(lengths))
    left = dict.fromkeys(distinct, 0)
    for n in lengths:
        left[n] += 1

    def filled(first: int, size: int) -> int:
        """Tokens in a sequence of a size that begins with a piece and takes the longest remaining ones that fit."""
        room, last = size - first, first
        while room > 0:
            k = bisect_right(distinct, min(room, last)) - 1
            if k < 0:
                break
            last = distinct[k]
            take = min(left[last], room // last)
            room -= take * last
            last -= 1
        return size - room

    open_rooms: list[tuple[int, int]] = []  # (room, sequence) in order
    bins: list[list] = []
    for i, n in enumerate(lengths):
        left[n] -= 1
        at = bisect_left(open_rooms, (n, -1))
        if at < len(open_rooms):
            room, b = open_rooms.pop(at)
        else:
            room = min((s for s in sizes if s >= n), key=lambda s: ((s + overhead) / filled(n, s), -s))
            b = len(bins)
            bins.append([room, []])
        bins[b][1].append(i)
        if room > n:
            insort(open_rooms, (room - n, b))
    out = []
    for _, pieces in bins:
        used = sum(lengths[i] for i in pieces)
        out.append((next(s for s in sizes if s >= used), pieces))
    return out


def pack(counts: DataFrame, sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD, shard_tokens: int = SHARD_TOKENS, seed: int = 5) -> DataFrame:
    """One row per sequence from (id, n): bin_id, capacity, n_tokens, and arrays doc_ids, starts, lengths.

    Every token of every row is in exactly one sequence. Repeated rows are packed each. Rows with n NULL or below
    1 have no tokens and are left out. Equal lengths are taken by id, then place; a NULL id comes first.
    """
    counts = cut_lineage(counts.where(F.col("n") > 0))
    total = counts.agg(F.sum("n")).first()[0] or 0
    shards, most = max(1, -(-total // shard_tokens)), max(sizes)
    pieces = counts.select("id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {most}"))).alias("piece"))
    pieces = pieces.select("id", (F.col("piece") * most).alias("start"), F.least(F.lit(most), F.col("n") - F.col("piece") * most).cast("int").alias("length"))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "start", F.lit(seed)), F.lit(shards)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("id", "ascending"), ("start", "ascending")])
        ids, starts, lengths = (table[c].to_pylist() for c in ("id", "start", "length"))
        shard, bins = table["shard"][0].as_py(), best_fit(lengths, sizes, overhead)
        pick = lambda values, t: pa.array([[values[i] for i in p] for _, p in bins], pa.list_(t))
        return pa.table(
            {
                "bin_id": pa.array([f"{shard}-{k}" for k in range(len(bins))]),
                "capacity": pa.array([s for s, _ in bins], pa.int32()),
                "n_tokens": pa.array([sum(lengths[i] for i in p) for _, p in bins], pa.int32()),
                "doc_ids": pick(ids, pa.int64()),
                "starts": pick(starts, pa.int64()),
                "lengths": pick(lengths, pa.int32()),
            }
        )

    schema = "bin_id string, capacity int, n_tokens int, doc_ids array<long>, starts array<long>, lengths array<int>"
    return pieces.groupBy("shard").applyInArrow(run, schema)


def packed(docs: DataFrame) -> DataFrame:
    """Sequences (see ``pack``) of the tokens of whole texts; NULL and empty texts have none, repeated rows count again."""
    return pack(token_counts(docs))
