"""Near duplicates by an LSH forest over MinHash signatures.

A document is its set of distinct word shingles. Equal sets are one class, and only the document of the smallest
id of a class goes on. Each of ``TREES`` trees orders the classes by a label of ``DEPTH`` MinHash values; classes
that agree on the first ``START`` values of a tree form a region. Candidates are neighbours in a tree's order with a
long common prefix, screened by the distance of 192-bit sketches (one bit of every MinHash value):

1. The rows of each tree are sorted by label (range partitions, so a hot region is cut into several tasks). In its
   region each class finds its most similar partner: among all of a small region, among the neighbours of longest
   common prefix in a large one. A crowded region is split at a greater depth. Classes that the screen connects are
   tied to clusters.
2. The best pairs are confirmed on the full sets, and linked classes form components.
3. What is still apart in a cluster is settled on the full sets: the classes outside the cluster's largest component
   are compared with all the others, block by block inside tasks, and of each task only a forest that connects the
   same components comes out. So a group of copies, already joined, is not compared within itself, and no pairs are
   listed.

Two sets of similarity J share a region with chance 1 - (1 - J^5)^24: above 0.9999 at 0.8. Nothing is capped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import WordCodes, map_batches, mix, utf8, window_codes
from granary.llm.components import components
from granary.session import cut_lineage

TREES, START, DEPTH = 24, 5, 8
SKETCH = TREES * DEPTH  # bits
SMALL = 64
CROWDED = 4096
NEIGHBOURS = 8
BLOCK = 1000
NONE = np.iinfo(np.int64).min  # no class


def shingle_codes(words: list[bytes], codes: WordCodes, size: int) -> np.ndarray:
    """Sorted codes of the distinct shingles of a text in lower case; the whole sequence if it is shorter."""
    if not words:
        return np.empty(0, np.uint64)
    c = codes.of(words)
    return np.unique(window_codes(c, min(size, len(c))))


def _factors() -> np.ndarray:
    return np.random.default_rng(20240607).integers(1, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (rows: sets, none empty), ``SKETCH`` each."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets)])[:-1]
    out = np.empty((len(sets), SKETCH), np.uint64)
    for k, f in enumerate(_factors()):
        x = flat * f
        x ^= x >> np.uint64(31)
        out[:, k] = np.minimum.reduceat(x * np.uint64(0xD6E8FEB86659FD93), starts)
    return out


def class_rows(docs: DataFrame, size: int) -> DataFrame:
    """(id, n, code, trees, bits): shingle count, hash of the set, (key, label) of each tree, sketch."""

    def make():
        codes = WordCodes()

        def run(cols):
            ids = cols["id"].to_pylist()
            sets = [shingle_codes((t or b"").lower().split(), codes, size) for t in cols["text"].to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            out = {"id": ids, "n": [len(s) for s in sets], "code": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], "keys": [None] * len(ids), "bits": [None] * len(ids)}
            for at in range(0, len(full), 256):
                part = full[at : at + 256]
                sig = signatures([sets[i] for i in part])
                bits = np.packbits((sig >> np.uint64(40) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
                label = sig.reshape(len(part), TREES, DEPTH)
                key = np.broadcast_to(mix(np.arange(1, TREES + 1, dtype=np.uint64)), (len(part), TREES))
                levels = []
                for d in range(DEPTH):
                    key = mix((key + label[:, :, d]) * np.uint64(0x9FB21C651E98DF25))
                    if d >= START - 1:
                        levels.append(key.view(np.int64))
                keys = np.stack(levels, 2)  # region of each tree at each depth
                for j, i in enumerate(part):
                    out["keys"][i] = keys[j].ravel()
                    out["bits"][i] = bits[j]
            return out

        return run

    return map_batches(docs, "id long, n long, code binary, keys array<long>, bits array<long>", make)


def _apart(bits_a: np.ndarray, bits_b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits_a ^ bits_b).sum(-1)


def screen_bits(limit: float) -> int:
    """Differing bits that a pair at the limit exceeds with a chance of about 1e-6 (one bit differs with (1 - J) / 2)."""
    p = (1 - limit) / 2
    return int(np.ceil(SKETCH * p + 4.8 * np.sqrt(SKETCH * p * (1 - p)))) + 1


def _partners(rows: DataFrame, limit: float) -> DataFrame:
    """(node, partner, apart, tie): for each tree, a class's best partner and one that ties it to its cluster.

    Rows come sorted by label. The pairs of a region that pass the screen connect its rows to parts; ``tie`` is the
    smallest class of the part, so that trees which agree on a group give the same pairs.
    """
    most = screen_bits(limit)
    levels = DEPTH - START + 1

    def run(batches):
        def near(bits, n, node, i, j):
            d = _apart(bits[i], bits[j])
            size = np.minimum(n[i], n[j]) >= limit * np.maximum(n[i], n[j]) * (1 - 1e-9)
            return np.where(size & (node[i] != node[j]), d, most + 1)

        def settle(cols, s, e, depth, best, least, tie):
            """Fill in the best partners and ties of the rows s to e, which share a region at a depth."""
            node, n, bits, k = cols["node"][s:e], cols["n"][s:e], cols["bits"][s:e], e - s
            for step in range(1, (k - 1 if k <= SMALL else NEIGHBOURS) + 1):
                i = np.arange(k - step)
                d = near(bits, n, node, i, i + step)
                for x, y in ((i, i + step), (i + step, i)):
                    better = d < least[s + x]
                    least[s + x[better]], best[s + x[better]] = d[better], node[y[better]]
            if k > CROWDED and depth < levels - 1:
                key = cols[f"k{depth + 1}"][s:e]
                cuts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), k)
                for a, b in zip(cuts, cuts[1:]):
                    if b - a > 1:
                        settle(cols, s + a, s + b, depth + 1, best, least, tie)
                return
            apart, queue, part, parts = np.arange(k), [], np.zeros(k, np.int64), -1
            while len(apart) or queue:
                if not queue:  # the first row not yet reached begins a new part
                    parts += 1
                    queue.append(int(apart[0]))
                    part[apart[0]] = parts
                    apart = apart[1:]
                x = queue.pop()
                hit = near(bits, n, node, np.full(len(apart), x), apart) <= most
                part[apart[hit]] = parts
                queue.extend(apart[hit].tolist())
                apart = apart[~hit]
            first = np.full(parts + 1, np.iinfo(np.int64).max)
            np.minimum.at(first, part, node)
            tie[s:e] = np.where(first[part] == node, NONE, first[part])

        def done(cols):
            k = len(cols["k0"])
            best, least, tie = np.full(k, NONE), np.full(k, most + 1), np.full(k, NONE)
            cuts = np.append(np.flatnonzero(np.append(True, cols["k0"][1:] != cols["k0"][:-1])), k)
            for s, e in zip(cuts, cuts[1:]):
                if e - s > 1:
                    settle(cols, s, e, 0, best, least, tie)
            keep = (best != NONE) | (tie != NONE)
            known = least <= most
            arrays = [pa.array(cols["node"][keep]), pa.array(best[keep], mask=~known[keep]), pa.array(least[keep].astype(np.int32)), pa.array(tie[keep], mask=tie[keep] == NONE)]
            return pa.record_batch(arrays, names=["node", "partner", "apart", "tie"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            got = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(batch.schema.names)}
            cols = {**{f"k{d}": got[f"k{d}"] for d in range(levels)}, "node": got["node"], "n": got["n"], "bits": np.stack([got[f"b{w}"].view(np.uint64) for w in range(3)], 1)}
            if held is not None:
                cols = {c: np.concatenate([held[c], cols[c]]) for c in cols}
            # the last region may go on in the next batch; a long one is worked on in pieces
            last = int(np.searchsorted(cols["k0"], cols["k0"][-1], "left"))
            if len(cols["k0"]) - last > 20_000:
                last = len(cols["k0"])
            held = {c: x[last:] for c, x in cols.items()}
            if last:
                yield done({c: x[:last] for c, x in cols.items()})
        if held is not None and len(held["k0"]):
            yield done(held)

    return rows.mapInArrow(run, "node long, partner long, apart int, tie long")


def _sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, codes): the full set of each of the given nodes."""

    def make():
        codes = WordCodes()

        def run(cols):
            return {"node": cols["id"], "codes": [shingle_codes((t or b"").lower().split(), codes, size).tobytes() for t in cols["text"].to_pylist()]}

        return run

    picked = docs.join(nodes.withColumnRenamed("node", "id"), "id", "left_semi")
    return map_batches(picked, "node long, codes binary", make)


def _confirm(pairs: DataFrame, sets: DataFrame, limit: float) -> DataFrame:
    """The pairs (u, v) whose full sets have 100 * intersection >= 100 * limit * union."""
    percent = round(limit * 100)
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("codes").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("codes").alias("b")), "v")

    def make():
        def run(cols):
            good = []
            for a, b in zip(cols["a"].to_pylist(), cols["b"].to_pylist()):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                shared = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            good = np.array(good, bool)
            return {c: cols[c].to_numpy()[good] for c in ("u", "v")}

        return run

    return map_batches(both.select("u", "v", "a", "b"), "u long, v long", make).distinct()


def _star(ties: DataFrame) -> DataFrame:
    """The same parts as the ties (node, tie) with about one pair a node.

    A node keeps its least tie, and its other ties (one a tree at most) are tied to that one. Ties are the smallest
    classes of parts, so the pairs among them are few however many nodes a part has.
    """
    own = ties.groupBy("node").agg(F.collect_set("tie").alias("all")).select("node", "all", F.array_min("all").alias("least"))
    rest = own.where(F.size("all") > 1).select(F.explode("all").alias("u"), F.col("least").alias("v")).where(F.col("u") != F.col("v"))
    return own.select(F.col("node").alias("u"), F.col("least").alias("v")).union(rest.distinct())


def _clusters(first: DataFrame, ties: DataFrame) -> DataFrame:
    """(node, cluster) by best pairs and ties. Ties repeat what most best pairs say, so they are contracted first."""
    near = cut_lineage(components(first))
    ends = {c: near.select(F.col("node").alias(f"{c}_node"), F.col("root").alias(f"{c}_root")) for c in ("u", "v")}
    for c, roots in ends.items():
        ties = ties.join(roots, F.col(c) == F.col(f"{c}_node"), "left").withColumn(f"{c}_root", F.coalesce(f"{c}_root", c)).drop(f"{c}_node")
    ties = cut_lineage(ties)
    far = components(ties.select(F.col("u_root").alias("u"), F.col("v_root").alias("v")))
    nodes = near.union(ties.select("u", "u_root")).union(ties.select("v", "v_root")).distinct()
    joined = nodes.join(far.select(F.col("node").alias("near"), F.col("root").alias("far")), F.col("root") == F.col("near"), "left")
    return joined.select("node", F.coalesce("far", "root").alias("cluster"))


def _left_apart(clusters: DataFrame, roots: DataFrame, sets: DataFrame, limit: float) -> DataFrame:
    """Links (u, v) between the components that a cluster is still in: of each task a forest that connects the same ones."""
    percent = round(limit * 100)
    labels = roots.withColumnRenamed("node", "labelled")
    nodes = clusters.join(labels, F.col("node") == F.col("labelled"), "left").select("cluster", "node", F.coalesce("root", "node").alias("root"))
    by_root = nodes.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("c"))
    split = by_root.groupBy("cluster").agg(F.count(F.lit(1)).alias("roots"), F.sum("c").alias("size"), F.max("c").alias("top"), F.max_by("root", F.struct("c", "root")).alias("main"))
    split = split.where(F.col("roots") > 1).select(F.col("cluster").alias("of"), "main", "size", (F.col("size") - F.col("top")).alias("outside"))
    here = nodes.join(split, F.col("cluster") == F.col("of")).drop("of")
    here = here.join(sets.withColumnRenamed("node", "set_of"), F.col("node") == F.col("set_of")).drop("set_of")
    here = here.withColumns({"blocks": F.ceil(F.col("size") / BLOCK).cast("int"), "outs": F.ceil(F.col("outside") / BLOCK).cast("int")})
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    # each block of classes meets each block of those outside the largest component
    members = here.select("cluster", own("blocks").alias("b"), F.explode(F.sequence(F.lit(0), F.col("outs") - 1)).alias("o"), "node", "root", "codes")
    outside = here.where(F.col("root") != F.col("main"))
    outside = outside.select("cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), own("outs").alias("o"), "node", "root", "codes").toDF("cluster_", "b_", "o_", "node_", "root_", "codes_")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        u, v, above = [], [], {}

        def top(x):
            while (y := above.get(x, x)) != x:
                above[x] = above.get(y, y)
                x = y
            return x

        if left.num_rows and right.num_rows:
            root = left["root"].to_numpy()
            parts = [np.frombuffer(c, np.uint64) for c in left["codes"].to_pylist()]
            order = np.argsort(root, kind="stable")
            root, parts = root[order], [parts[i] for i in order]
            size, flat = np.array([len(p) for p in parts]), np.concatenate(parts)
            order = np.argsort(flat)
            flat = flat[order]
            owner = np.repeat(np.arange(len(parts)), size)[order]
            for r, c in zip(right["root_"].to_pylist(), right["codes_"].to_pylist()):
                codes = np.frombuffer(c, np.uint64)
                low, high = np.searchsorted(flat, codes, "left"), np.searchsorted(flat, codes, "right")
                many = high - low
                at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
                shared = np.bincount(owner[at], minlength=len(parts))
                linked = (100 * shared >= percent * (size + len(codes) - shared)) & (root != r)
                for other in np.unique(root[linked]).tolist():
                    a, b = top(r), top(other)
                    if a != b:  # a task hands on a forest of its components, no more links than components
                        above[max(a, b)] = min(a, b)
                        u.append(min(r, other))
                        v.append(max(r, other))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    pairs = members.groupBy("cluster", "b", "o").cogroup(outside.groupBy("cluster_", "b_", "o_"))
    return pairs.applyInArrow(meet, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, limit: float = 0.8) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Texts with A-Z in lower case are cut to words; a document's set is its distinct ``size``-word shingles, the
    whole sequence if it has fewer words. Documents of Jaccard similarity ``limit`` or more are linked;
    ``component_id`` is the smallest id that can be reached, ``kept`` whether it is the document's own. Without
    words or text a document is linked with nothing. Ids are integers. A row without id is linked with nothing:
    its component is NULL, and it is kept. Rows of the same id are one document with several texts.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text"))
    rows = cut_lineage(class_rows(picked, size))
    real = rows.where(F.col("id").isNotNull() & F.col("code").isNotNull())
    classes = real.groupBy("code").agg(F.min("id").alias("rep"))
    # one row of each class goes into the trees
    tops = real.join(classes.select(F.col("code").alias("c"), "rep"), (F.col("id") == F.col("rep")) & (F.col("code") == F.col("c")), "left_semi").dropDuplicates(["id", "code"])
    levels = DEPTH - START + 1
    trees = tops.select(
        F.col("id").alias("node"), "n", *(F.col("bits")[w].alias(f"b{w}") for w in range(3)), F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.slice("keys", t * levels + 1, levels))).alias("k")
    ).select(*(F.col("k")[d].alias(f"k{d}") for d in range(levels)), "node", "n", "b0", "b1", "b2")
    order = [f"k{d}" for d in range(levels)]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cut_lineage(_partners(trees.repartitionByRange(parts, *order).sortWithinPartitions(*order), limit))
    ties = _star(found.where(F.col("tie").isNotNull()).select("node", "tie"))
    best = found.where(F.col("partner").isNotNull()).groupBy("node").agg(F.min_by("partner", F.struct("apart", "partner")).alias("partner"))
    first = best.select(F.least("node", "partner").alias("u"), F.greatest("node", "partner").alias("v")).distinct()
    clusters = cut_lineage(_clusters(first, ties))
    sets = cut_lineage(_sets(picked, clusters.select("node"), size))
    links = cut_lineage(_confirm(first, sets, limit))
    roots = components(links)
    more = cut_lineage(_left_apart(clusters, roots, sets, limit))
    roots = components(links.union(more)) if not more.isEmpty() else roots
    # rows of one id but different sets are one document, so their classes are one too
    found = _with_roots(real, classes, roots)
    marked = rows.join(found, F.col("id") == F.col("member"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    kind = docs.schema[id_col].dataType
    return marked.select(
        F.col("id").cast(kind).alias(id_col),
        F.col("n").alias("n_shingles"),
        component.cast(kind).alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, limit: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each group: that of the smallest id.

    Of rows with the same id one stays (the smallest text); rows without id all stay.
    """
    found = near_duplicates(docs, id_col, text_col, size, limit)
    gone = found.where(~F.col("kept")).select(F.col(id_col).alias("_gone")).distinct()
    named = docs.where(F.col(id_col).isNotNull()).join(gone, F.col(id_col) == F.col("_gone"), "left_anti")
    turn = F.row_number().over(Window.partitionBy(id_col).orderBy(F.col(text_col).asc_nulls_last()))
    one = named.withColumn("_turn", turn).where(F.col("_turn") == 1).drop("_turn")
    return one.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))


def _with_roots(real: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(member, component) of every document in a class: the root of its class's representative."""
    labels = classes.join(roots, F.col("rep") == F.col("node"), "left").select("code", F.coalesce("root", "rep").alias("component"))
    return real.select(F.col("id").alias("member"), "code").join(labels, "code").groupBy("member").agg(F.min("component").alias("component"))


ORACLE = """
with recursive w as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
    from documents
), sets as (
    select distinct doc_id, case when len(w) = 1 then w[1] else w[i] || ' ' || w[i + 1] end as s
    from (select doc_id, w, unnest(range(1, greatest(len(w), 2))) as i from w where len(w) > 0)
), n as (
    select doc_id, count(*) as n from sets group by doc_id
), both_ as (
    select a.doc_id as u, b.doc_id as v, count(*) as c from sets a join sets b on a.s = b.s and a.doc_id <> b.doc_id group by all
), links as (
    select u, v from both_ join n as nu on nu.doc_id = u join n as nv on nv.doc_id = v
    where 100 * c >= 80 * (nu.n + nv.n - c)
), reach as (
    select doc_id, doc_id as r from documents
    union
    select reach.doc_id, v from reach join links on u = r
)
select doc_id, coalesce(any_value(n), 0)::bigint as n_shingles, min(r) as component_id, min(r) = doc_id as kept
from reach left join n using (doc_id) group by doc_id
"""
