"""Connected components of a table of links by repeated contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.session import cut_lineage


def _labels(edges: DataFrame, turn: int) -> DataFrame:
    """(node, label): the node of least rank among a node and its neighbours; ranks are ids or, every other turn, hashes."""
    rank = (lambda c: F.col(c)) if turn % 2 == 0 else (lambda c: F.xxhash64(c, F.lit(turn)))
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min(F.struct(rank("v").alias("k"), "v")).alias("m"))
    return least.select(F.col("u").alias("node"), F.when(F.col("m.k") < rank("u"), F.col("m.v")).otherwise(F.col("u")).alias("label"))


LINKS = 400_000  # links of a task
HELD = 2 * LINKS  # nodes that a task holds before it hands its forest on: those of its links


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as stars round the least nodes: the same parts with one link a node."""
    above: dict[int, int] = {}

    def top(x):
        while (y := above.setdefault(x, x)) != x:
            above[x] = above.setdefault(y, y)
            x = y
        return x

    def stars():
        pairs = [(x, r) for x in above if (r := top(x)) != x]
        return pa.record_batch([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = top(u), top(v)
            if a != b:
                above[max(a, b)] = min(a, b)
        if len(above) > HELD:
            yield stars()
            above.clear()
    yield stars()


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (u, v) with another one: the root is the least node that can be reached.

    Each turn first contracts the links of a task, ``LINKS`` of them, to a forest: one link a node. Then nodes are
    merged into the neighbour of least rank, and only the links between what is left go on, so later turns are small:
    a hub takes its neighbours in at once, and a chain loses a constant share of its nodes to the hashed ranks, so
    the number of turns is logarithmic. When what is left fits one task, its forest is the end. Labels and links are
    written tables; the least neighbour is partly aggregated, so a hub is no hot task.
    """
    edges, levels = cut_lineage(_pairs(links)), []
    while n := edges.count():
        tasks = -(-n // LINKS)
        forest = cut_lineage(edges.coalesce(tasks).mapInArrow(_forest, "u long, v long"))
        if tasks == 1:  # stars round their roots
            roots = forest.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
            levels.append(forest.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots))
            break
        labels = cut_lineage(_labels(forest, len(levels)))
        levels.append(labels)
        ends = {c: labels.select(F.col("node").alias(f"{c}_node"), F.col("label").alias(f"{c}_label")) for c in ("u", "v")}
        moved = forest.join(ends["u"], F.col("u") == F.col("u_node")).join(ends["v"], F.col("v") == F.col("v_node"))
        edges = cut_lineage(_pairs(moved.select(F.col("u_label").alias("u"), F.col("v_label").alias("v"))))
    if not levels:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = levels[-1]
    for labels in levels[-2::-1]:
        later = found.select(F.col("node").alias("at"), F.col("label").alias("next"))
        found = labels.join(later, F.col("label") == F.col("at"), "left").select("node", F.coalesce("next", "label").alias("label"))
    found = cut_lineage(found)
    least = found.groupBy("label").agg(F.min("node").alias("root"))
    return found.join(least, "label").select("node", "root")
