"""Prefix trie of conversations: subtree totals by time-forward processing.

A node is a distinct sequence of first turns, named by its depth and a 128-bit hash of the sequence (two XORs of
hashes of (place, role, text), so it is a running aggregate and no conversation meets in one task). Texts are read
once, to be hashed; only names and numbers travel on.

Totals go from the leaves to the root. In a shard the nodes are sorted by reverse level order, by Spark's external
sort; each node takes what its children have sent from a priority queue that spills, adds its own, and sends the
total on to its parent, which comes later in that order. The totals of shard roots are then passed across shards:

* Nodes with more than ``members`` conversations form the top of the trie. ``members`` grows with the input, so
  there are at most ``TOP`` of them, whatever the input. What lies below a top node falls into subtrees of at most
  ``members`` conversations, each a shard. A hot first turn is just a top node with many shards.
* A shard is cut again every ``block`` levels, so one endless conversation is dealt out as well. The roots of these
  pieces form a tree of their own, in which totals are passed on by the same process; then the pieces that hold
  their parents are settled again with what arrived.
* What top nodes receive is summed by node first, a partly aggregated sum, so a parent may have any number of
  children.

The queue's runs are scratch files of the running task, unlinked as they are made and never read by another task.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.windows import number_rows
from granary.session import cut_lineage

TOP = 100_000
MOST_HEAD = 6
KEY = ["depth", "p1", "p2"]
CHUNK = 8192


class SpillingQueue:
    """Messages (key of three numbers, children, leaves, saved), taken in ascending order of their keys.

    At most ``held`` messages stay in memory; more are written as sorted runs, and many runs are merged into one.
    """

    PACK = struct.Struct("<6q")

    def __init__(self, held: int = 200_000, most_runs: int = 64):
        self.held, self.most_runs = held, most_runs
        self._heap: list[tuple] = []
        self._runs: list[Iterator[tuple]] = []
        self._heads: list[tuple] = []  # (first message of a run, its index)

    def push(self, message: tuple) -> None:
        heapq.heappush(self._heap, message)
        if len(self._heap) > self.held:
            self._spill(iter(sorted(self._heap)))
            self._heap = []
            if len(self._heads) > self.most_runs:
                rest = heapq.merge(*[self._with(head, self._runs[i]) for head, i in self._heads])
                self._heads, self._runs, runs = [], [], rest
                self._spill(runs)

    @staticmethod
    def _with(head: tuple, rest: Iterator[tuple]) -> Iterator[tuple]:
        yield head
        yield from rest

    def _spill(self, messages: Iterator[tuple]) -> None:
        file = tempfile.TemporaryFile()
        for m in messages:
            file.write(self.PACK.pack(*m))
        file.seek(0)
        self._runs.append(self._read(file))
        self._next_of(len(self._runs) - 1)

    def _read(self, file) -> Iterator[tuple]:
        with file:
            while data := file.read(self.PACK.size * 4096):
                yield from self.PACK.iter_unpack(data)

    def _next_of(self, run: int) -> None:
        head = next(self._runs[run], None)
        if head is not None:
            heapq.heappush(self._heads, (head, run))

    def take(self, key: tuple) -> tuple[int, int, int]:
        """Sums of the messages of this key, the least that is left (zeros if there is none)."""
        children = leaves = saved = 0
        while True:
            if self._heads and (not self._heap or self._heads[0][0] < self._heap[0]):
                if self._heads[0][0][:3] != key:
                    break
                message, run = heapq.heappop(self._heads)
                self._next_of(run)
            elif self._heap and self._heap[0][:3] == key:
                message = heapq.heappop(self._heap)
            else:
                break
            children, leaves, saved = children + message[3], leaves + message[4], saved + message[5]
        return children, leaves, saved


def _forward(rows: DataFrame, held: int = 200_000) -> DataFrame:
    """Totals (depth, p1, p2, children, leaves, saved) of each node, its shard's subtree included.

    ``rows`` has (shard, depth, p1, p2, q1, q2, top, message, children, leaves, saved): a node's own numbers, the
    name (depth - 1, q1, q2) of its parent, and whether it is the top of its shard; or a message to a node from
    outside the shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, got = SpillingQueue(held), [0, 0, 0]
        for batch in batches:
            out = []
            for depth, p1, p2, q1, q2, top, message, *own in zip(*(c.to_pylist() for c in batch.columns)):
                if message:  # sorted just before its node
                    got = [a + b for a, b in zip(got, own)]
                    continue
                sent = queue.take((-depth, p1, p2))
                children, leaves, saved = (a + b + c for a, b, c in zip(own, got, sent))
                got = [0, 0, 0]
                out.append((depth, p1, p2, children, leaves, saved))
                if not top:
                    queue.push((1 - depth, q1, q2, 1, leaves, saved))
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=[*KEY, "children", "leaves", "saved"])

    # reverse level order; the parts of a task's shards are told apart by the nodes' names
    dealt = rows.repartition("s0", "s1", "s2").sortWithinPartitions(F.desc("depth"), "p1", "p2", F.desc("message"))
    columns = [*KEY, "q1", "q2", "top", "message", "children", "leaves", "saved"]
    return dealt.select(*columns).mapInArrow(run, ", ".join(f"{c} long" for c in [*KEY, "children", "leaves", "saved"]))


def _turns(table: DataFrame) -> DataFrame:
    """(conv_id, pos, a, b, chars): numbered turns, hashes of (role, text), code points of the text."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = table.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNotNull().alias("seen"), "turn", role.alias("role"), F.md5(text).alias("digest"),
        *(F.xxhash64(F.lit(k), role, text).alias(c) for k, c in ((1, "a"), (2, "b"))), F.length(text).alias("chars"),
    )
    return number_rows(rows, ["conv_id"], ["seen", "turn", "role", "digest"], "pos").select("conv_id", "pos", "a", "b", "chars")


def _steps(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations (conv_id, n), and their steps (conv_id, depth, p1, p2, q1, q2, chars, last)."""
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_HEAD
    convs = sizes.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    bases = sizes.where(F.col("conv_id") % 100 == 0).select(F.col("conv_id").alias("of"), F.col("own").alias("base_n"))
    head = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = convs.join(bases, F.col("base") == F.col("of"), "left").select("conv_id", "h", "base", head.alias("head"), (head + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))
    convs = cut_lineage(convs)
    shared = turns.where((F.col("conv_id") % 100 == 0) & (F.col("pos") < MOST_HEAD)).withColumnRenamed("conv_id", "of")
    first = convs.join(shared, (F.col("base") == F.col("of")) & (F.col("pos") <= F.col("head"))).select("conv_id", F.col("pos").alias("depth"), "n", "a", "b", "chars")
    own = turns.join(convs, "conv_id").where(F.col("pos") > F.col("h")).select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("depth"), "n", "a", "b", "chars")
    rows = first.union(own).select("conv_id", "depth", "n", F.xxhash64(F.lit(3), "a", "depth").alias("e1"), F.xxhash64(F.lit(4), "b", "depth").alias("e2"), "chars")
    # running XOR: inside stretches of a conversation, then what the earlier stretches give
    rows = rows.withColumn("stretch", F.floor((F.col("depth") - 1) / 1024))
    inside = Window.partitionBy("conv_id", "stretch").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.where(F.col("n") > 1024).groupBy("conv_id", "stretch").agg(F.bit_xor("e1").alias("x1"), F.bit_xor("e2").alias("x2"))
    before = sums.select("conv_id", "stretch", *(F.bit_xor(x).over(earlier).alias(x) for x in ("x1", "x2")))
    rows = rows.withColumns({p: F.bit_xor(e).over(inside) for p, e in (("p1", "e1"), ("p2", "e2"))}).join(before, ["conv_id", "stretch"], "left")
    for p, x, e, q in (("p1", "x1", "e1", "q1"), ("p2", "x2", "e2", "q2")):
        rows = rows.withColumn(p, F.col(p).bitwiseXOR(F.coalesce(x, F.lit(0)))).withColumn(q, F.col(p).bitwiseXOR(F.col(e)))
    return convs, cut_lineage(rows.select("conv_id", "depth", "p1", "p2", "q1", "q2", "chars", (F.col("depth") == F.col("n")).cast("long").alias("last")))


def _end_digests(ends: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256): digest of the ascending ids of each node.

    Ids are sorted across tasks and packed into chunks there; a node's chunks then pass through one digest, which
    has to see them in order, a batch at a time.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            new = np.append(True, np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0))
            starts = np.flatnonzero(new)
            cuts = [s for a, b in zip(starts, np.append(starts[1:], len(new))) for s in range(a, b, CHUNK)]
            parts = [zlib.compress(np.diff(cols[3][a:b], prepend=0).tobytes(), 1) for a, b in zip(cuts, [*cuts[1:], len(new)])]
            yield pa.record_batch([*(pa.array(c[cuts]) for c in cols), pa.array(parts)], names=[*KEY, "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, sha, out = None, None, []
        for batch in batches:
            for *key, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if key != name:
                    if name is not None:
                        out.append((*name, sha.hexdigest()))
                    name, sha, mark = key, hashlib.sha256(), b""
                values = np.cumsum(np.frombuffer(zlib.decompress(ids), np.int64))
                sha.update(mark + b",".join(b"%d" % i for i in values.tolist()))
                mark = b","
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (*[pa.int64()] * 3, pa.string()))] if out else [pa.array([], t) for t in (*[pa.int64()] * 3, pa.string())], names=[*KEY, "ends_sha256"])
            out = []
        if name is not None:
            yield pa.record_batch([pa.array([v], t) for v, t in zip((*name, sha.hexdigest()), (*[pa.int64()] * 3, pa.string()))], names=[*KEY, "ends_sha256"])

    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*KEY, "conv_id"]
    chunks = ends.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(pack, "depth long, p1 long, p2 long, first long, ids binary")
    return chunks.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digest, "depth long, p1 long, p2 long, ends_sha256 string")


def _named(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*(F.col(old).alias(new) for old, new in names.items()))


def prefix_trie(conversations: DataFrame, members: int = 1000, block: int = 4096, held: int = 200_000) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    Gives conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    Turns are ordered by number, NULL first, then by role and MD5 of the text; repeated rows are turns of their own.
    A NULL role or text is empty; rows without a conversation id belong to none and are left out; other columns are
    not read. No conversation, no node. ``members`` bounds the conversations of a shard and grows with the input
    where the top of the trie would have more than ``TOP`` nodes; ``block`` bounds a shard's levels, ``held`` the
    messages in memory.
    """
    turns = cut_lineage(_turns(conversations))
    convs, steps = _steps(turns)
    nodes = steps.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.min("chars").cast("long").alias("chars"), F.sum("last").alias("ends")
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("n") == 0).cast("long")), zero).alias("ends")).where(F.col("n") > 0)
    root = root.select(*(zero.alias(c) for c in KEY), "conv_id", "n", none.alias("q1"), none.alias("q2"), zero.alias("chars"), "ends")
    nodes = cut_lineage(nodes.union(root))
    members = max(members, steps.count() // TOP)

    big = F.col("depth").eqNullSafe(0) | (F.col("n") > members)
    top = nodes.where(big)  # at most TOP and the root, see above
    top_names = F.broadcast(_named(top, {"depth": "top_depth", "p1": "t1", "p2": "t2", "conv_id": "top_conv"}))
    # the top ends at a depth that all members of a node below it share
    here = [F.col("depth") == F.col("top_depth"), F.col("p1") == F.col("t1"), F.col("p2") == F.col("t2")]
    tops = steps.join(top_names, here, "left_semi").groupBy("conv_id").agg(F.max("depth").alias("d")).withColumnRenamed("conv_id", "under")
    low = nodes.where(~big).join(tops, F.col("conv_id") == F.col("under"), "left").withColumn("first", F.coalesce("d", zero) + 1).drop("under", "d")
    piece = F.floor((F.col("depth") - 1) / block)
    start = lambda k: F.greatest(F.col("first"), k * block + 1)
    low = low.withColumn("at", start(piece))
    places = _named(steps, {"conv_id": "of", "depth": "s0", "p1": "s1", "p2": "s2"})
    low = cut_lineage(low.join(places, (F.col("conv_id") == F.col("of")) & (F.col("at") == F.col("s0"))).drop("of", "at"))

    saved, leaf = (F.col("n") - 1) * F.col("chars"), (F.col("ends") == F.col("n")).cast("long")
    shard, own = ["s0", "s1", "s2"], ["children", "leaves", "saved"]
    columns = [*shard, *KEY, "q1", "q2", "top", "message", *own]
    is_top = ((F.col("depth") == F.col("s0")) & (F.col("p1") == F.col("s1")) & (F.col("p2") == F.col("s2"))).cast("long")
    shard_rows = low.select(*shard, *KEY, "q1", "q2", is_top.alias("top"), zero.alias("message"), zero.alias("children"), leaf.alias("leaves"), saved.alias("saved"))
    inside = cut_lineage(_forward(shard_rows, held))

    def messages(totals: DataFrame, hung: DataFrame) -> DataFrame:
        """Totals of shard roots, summed by the parent that receives them."""
        sent = totals.join(hung, KEY).select((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"), F.lit(1).cast("long").alias("children"), "leaves", "saved")
        return sent.groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in own))

    def received(sent: DataFrame, shards: DataFrame) -> DataFrame:
        return sent.join(shards, KEY).select(*shard, *KEY, none.alias("q1"), none.alias("q2"), zero.alias("top"), F.lit(1).cast("long").alias("message"), *own)

    # pieces below the first of their subtree: a tree of pieces, each subtree a shard
    roots = low.where(is_top == 1)
    hung = roots.where(F.col("depth") > F.col("first"))
    before, base = (_named(steps, {"conv_id": f"{c}_of", "depth": f"{c}0", "p1": f"{c}1", "p2": f"{c}2"}) for c in ("b", "f"))
    tree = hung.join(before, (F.col("conv_id") == F.col("b_of")) & (start(piece - 1) == F.col("b0"))).join(base, (F.col("conv_id") == F.col("f_of")) & (F.col("first") == F.col("f0")))
    tree = tree.join(inside, KEY).select(
        F.col("f0").alias("s0"), F.col("f1").alias("s1"), F.col("f2").alias("s2"), piece.cast("long").alias("depth"), "p1", "p2", F.col("b1").alias("q1"), F.col("b2").alias("q2"),
        zero.alias("message"), zero.alias("children"), "leaves", "saved", F.col("depth").alias("level"),
    )
    # the number of a piece stands in for its depth, so parents come one level later; those next to the base are roots
    tree = cut_lineage(tree.withColumn("top", (F.col("depth") == F.floor((F.col("s0") - 1) / block) + 1).cast("long")))
    passed = _forward(tree.select(*columns), held).join(_named(tree, {"depth": "k", "p1": "k1", "p2": "k2", "level": "level"}), (F.col("depth") == F.col("k")) & (F.col("p1") == F.col("k1")) & (F.col("p2") == F.col("k2")))
    passed = passed.select(F.col("level").alias("depth"), "p1", "p2", "leaves", "saved")
    arrived = cut_lineage(messages(passed, hung.select(*KEY, "q1", "q2")))
    again = received(arrived, low.select(*KEY, *shard))
    touched = again.select(*shard).distinct()
    redone = _forward(shard_rows.join(touched, shard, "left_semi").select(*columns).union(again.select(*columns)), held)
    still = inside.join(low.join(touched, shard, "left_anti").select(*KEY), KEY)
    below = cut_lineage(still.select(*KEY, *own).union(redone))

    # the top of the trie: one shard of at most TOP nodes
    to_top = messages(below, roots.where(F.col("depth") == F.col("first")).select(*KEY, "q1", "q2"))
    one = {c: zero.alias(c) for c in shard}
    top_rows = top.select(*one.values(), *KEY, "q1", "q2", (F.col("depth") == 0).cast("long").alias("top"), zero.alias("message"), zero.alias("children"), leaf.alias("leaves"), saved.alias("saved"))
    sent = to_top.select(*one.values(), *KEY, none.alias("q1"), none.alias("q2"), zero.alias("top"), F.lit(1).cast("long").alias("message"), *own)
    totals = below.union(_forward(top_rows.union(sent), held))

    last = steps.where("last = 1").select(*KEY, "conv_id").union(convs.where("n = 0").select(*(zero.alias(c) for c in KEY), "conv_id"))
    up = [F.col("depth") == F.col("top_depth") + 1, F.col("q1") == F.col("t1"), F.col("q2") == F.col("t2")]
    under_top = nodes.where(big).select(*KEY, "q1", "q2").union(roots.where(F.col("depth") == F.col("first")).select(*KEY, "q1", "q2"))
    deeper = low.where((is_top == 0) | (F.col("depth") > F.col("first"))).select(*KEY, "q1", "q2")
    named = _named(nodes, {"depth": "up_depth", "p1": "u1", "p2": "u2", "conv_id": "parent_conv_id"})
    parents = under_top.join(top_names, up).select(*KEY, F.col("top_conv").alias("parent_conv_id")).union(
        deeper.join(named, (F.col("depth") == F.col("up_depth") + 1) & (F.col("q1") == F.col("u1")) & (F.col("q2") == F.col("u2"))).select(*KEY, "parent_conv_id")
    )
    out = nodes.select(*KEY, "conv_id", "n").join(totals, KEY).join(_end_digests(last), KEY, "left").join(parents, KEY, "left")
    nothing = hashlib.sha256().hexdigest()
    return out.select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256")
    )


# crc32 in SQL: a table of 256 steps made by rule, then one step a byte
ORACLE = """
with steps as (
    select list(v order by b) as t from (
        select b, list_reduce(list_prepend(b, range(8)), lambda c, i: xor(c >> 1, (c & 1) * 3988292384)) as v from range(256) as r(b))
), turns as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
), own as (
    select conv_id, list({'h': md5(length(role) || ':' || role || text), 'c': length(text)} order by turn nulls first, role, md5(text)) as s from turns group by conv_id
), heads as (
    select conv_id, s, xor(4294967295, list_reduce(
        list_prepend(4294967295::bigint, list_transform(range(0, length(conv_id::varchar)), lambda i: ascii(substr(conv_id::varchar, i + 1, 1))::bigint)),
        lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]))) % 6 as h
    from own, steps
), convs as (
    select c.conv_id, list_concat(coalesce(b.s[:c.h], []), c.s[c.h + 1:]) as s from heads c left join own b on b.conv_id = c.conv_id - c.conv_id % 100
), nodes as (
    select s[:d] as p, d, min(conv_id) as conv_id, count(*) as n, (count(*) - 1) * coalesce(s[:d][-1].c, 0) as saved, string_agg(conv_id::varchar, ',' order by conv_id) filter (len(s) = d) as ends
    from (select conv_id, s, unnest(range(0, len(s) + 1)) as d from convs) group by s[:d], d
), kids as (
    select p[:d - 1] as p, count(*) as k from nodes where d > 0 group by 1
), marked as (
    select nodes.*, coalesce(k, 0) as k from nodes left join kids using (p)
), sums as (
    select p[:e] as p, sum(saved) as saved, count(*) filter (k = 0) as leaves from (select p, saved, k, unnest(range(0, d + 1)) as e from marked) group by 1
)
select m.conv_id, m.d as depth, up.conv_id as parent_conv_id, m.n as n_convs, m.k as n_children, leaves as n_leaves, sums.saved::bigint as saved_tokens, sha256(coalesce(m.ends, '')) as ends_sha256
from marked m join sums using (p) left join marked up on m.d > 0 and up.p = m.p[:m.d - 1]
"""
