"""Exact substring dedup with difference-cover anchors.

A run of ``WINDOW`` (13) words that also starts in a document of a smaller id is removed. Positions of a text are
taken modulo the period 7, and only windows of 7 words at the positions {0, 1, 3} of a period are hashed: these
are a difference cover, so for any two places there is a shift below 7 that brings both to a cover position, and
two equal runs of 7 + 7 - 1 = 13 words share an anchor at that shift. Three sevenths of the windows find every match.

1. Anchors go to buckets of their hash; an anchor found in two documents is shared.
2. Only documents with shared anchors are read again. Matches are extended: each run of 13 words that holds a
   shared anchor is hashed whole (96 bits) and goes to a bucket of its hash, where the smallest id of each run
   is found. Runs of larger ids are marked.
3. Marks go back to the documents by id, and the words they cover are cut.

What travels is packed: one row per batch of documents and bucket, with arrays of hashes, ids and positions.
Within a batch equal hashes are settled before the exchange, so an anchor or run that stands in a third of all
documents costs one entry per batch, not one per document; the number of buckets grows with the words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import WordCodes, map_batches, mix, utf8, window_codes
from granary.session import cut_lineage

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
BUCKET_ENTRIES = 500_000
ANCHOR_BYTES = 6  # of an anchor's hash, besides its bucket; two anchors taken for equal cost work, not exactness

_PACKED = "bucket long, hash binary, rest binary, id binary, mark binary, pos binary"


def _flat(cols: dict, words: WordCodes):
    """Codes of a batch's words in a row, with index of the document and position in it."""
    tokens = [(t or b"").split() for t in cols["text"].to_pylist()]
    lens = np.array([len(t) for t in tokens], np.int64)
    codes = words.of([w for t in tokens for w in t])
    doc = np.repeat(np.arange(len(lens)), lens)
    pos = np.arange(len(codes)) - np.repeat(np.cumsum(lens) - lens, lens)
    return codes, doc, pos, lens


def _delta(x: np.ndarray) -> bytes:
    return np.diff(x, prepend=x.dtype.type(0)).tobytes()


def _pack(bits: int, hashes, rest, ids, marks, pos, width: int = 8) -> list[tuple]:
    """Rows of ``_PACKED``, one per bucket with entries, entries in order of place; ``width`` low bytes of a hash."""
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    rows = []
    for part in np.split(order, cuts) if len(order) else []:
        rows.append((int(bucket[part[0]]), hashes[part].view(np.uint8).reshape(-1, 8)[:, :width].tobytes(), rest[part].tobytes(), _delta(ids[part]), _delta(marks[part]), _delta(pos[part].astype(np.uint32))))
    return rows


def _targets(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.view(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _by_target(bits: int, ids, marks, pos) -> list[tuple]:
    """(target, id, mark, pos) of places on their way back, packed by a hash of their document."""
    target = _targets(ids, bits)
    order = np.argsort(target, kind="stable")
    cuts = np.flatnonzero(np.diff(target[order])) + 1
    return [(int(target[p[0]]), _delta(ids[p]), _delta(marks[p]), _delta(pos[p].astype(np.uint32))) for p in (np.split(order, cuts) if len(order) else [])]


def _own(bits: int, ids, marks, pos) -> list[tuple]:
    """Rows for places already settled; their negative bucket passes through."""
    return [(-1 - t, b"", b"", *rest) for t, *rest in _by_target(bits, ids, marks, pos)]


def _as_columns(rows: list[tuple]) -> dict | None:
    if not rows:
        return None
    return dict(zip(("bucket", "hash", "rest", "id", "mark", "pos"), map(list, zip(*rows))))


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys in sorted arrays."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    change = np.zeros(len(keys[0]), bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, marks and positions of packed rows."""
    ids, marks = (np.concatenate([np.cumsum(np.frombuffer(x, np.int64)) for x in table[c].to_pylist()]) for c in ("id", "mark"))
    return ids, marks, np.concatenate([np.cumsum(np.frombuffer(x, np.uint32), dtype=np.uint32) for x in table["pos"].to_pylist()])


def _settle(packed: DataFrame, rule, bits: int, width: int = 8) -> DataFrame:
    """(id, mark, at): for each document the packed places that ``rule`` picks in the buckets, or settled before."""

    def pick(table: pa.Table) -> pa.Table:
        ids, marks, pos = _unpack(table)
        if table["bucket"][0].as_py() >= 0:
            join = lambda c, t: np.concatenate([np.zeros(0, t), *(np.frombuffer(x, t) for x in table[c].to_pylist())])
            hashes = np.zeros((len(ids), 8), np.uint8)
            hashes[:, :width] = join("hash", np.uint8).reshape(-1, width)
            picked = rule(hashes.view(np.uint64).ravel(), join("rest", np.uint32), ids, marks)
            ids, marks, pos = ids[picked], marks[picked], pos[picked]
        rows = _by_target(bits, ids, marks, pos)
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("target", pa.int64()), ("id", pa.binary()), ("mark", pa.binary()), ("pos", pa.binary())))})

    def gather(table: pa.Table) -> pa.Table:
        ids, marks, pos = _unpack(table)
        order = np.lexsort((marks, ids))
        starts = _starts(ids[order], marks[order])
        parts = np.split(order, starts[1:]) if len(order) else []
        first = order[starts]
        return pa.table({"id": ids[first], "mark": marks[first], "at": pa.array([pos[p].tobytes() for p in parts], pa.binary())})

    back = packed.groupBy("bucket").applyInArrow(pick, "target long, id binary, mark binary, pos binary")
    return back.groupBy("target").applyInArrow(gather, "id long, mark long, at binary")


def _shared(hashes, rest, ids, marks) -> np.ndarray:
    """Entries whose hash stands in two documents."""
    order = np.lexsort((marks, ids, hashes))
    h, i, m = hashes[order], ids[order], marks[order]
    starts = _starts(h)
    size = np.diff(np.append(starts, len(h)))
    docs = np.add.reduceat((np.isin(np.arange(len(h)), _starts(h, i, m))).astype(np.int64), starts)
    return order[np.repeat(docs > 1, size)]


def _later(hashes, rest, ids, marks) -> np.ndarray:
    """Entries whose run also stands in a document of a smaller id."""
    order = np.lexsort((ids, rest, hashes))
    h, r, i = hashes[order], rest[order], ids[order]
    starts = _starts(h, r)
    least = np.repeat(i[starts], np.diff(np.append(starts, len(h))))
    return order[i > least]


def _anchor_rows(docs: DataFrame, bits: int) -> DataFrame:
    def make():
        words, cover = WordCodes(), np.isin(np.arange(PERIOD), COVER)

        def run(cols):
            codes, doc, pos, lens = _flat(cols, words)
            hashes = window_codes(codes, ANCHOR)
            n = len(hashes)
            take = np.flatnonzero(cover[pos[:n] % PERIOD] & (pos[:n] + ANCHOR <= lens[doc[:n]]) & (lens[doc[:n]] >= WINDOW)) if n else np.empty(0, np.int64)
            hashes, doc, pos = hashes[take], doc[take], pos[take]
            ids, marks = cols["id"].to_numpy()[doc], cols["mark"].to_numpy()[doc]
            order = np.argsort(hashes, kind="stable")
            starts = _starts(hashes[order])
            size = np.diff(np.append(starts, len(order)))
            last = order[starts + size - 1] if len(starts) else starts
            several = np.repeat(doc[order[starts]] != doc[last], size) if len(starts) else np.zeros(0, bool)
            first = np.zeros(len(order), bool)
            first[starts] = True
            send = np.sort(order[~several | first])
            here = order[several]
            return _as_columns(_pack(bits, hashes[send], np.zeros((len(send), 0), np.uint32), ids[send], marks[send], pos[send], ANCHOR_BYTES) + _own(bits, ids[here], marks[here], pos[here]))

        return run

    return map_batches(docs, _PACKED, make)


def _run_rows(docs: DataFrame, bits: int) -> DataFrame:
    """Runs of 13 words that hold a shared anchor; ``at`` has the packed positions of a document's anchors."""

    def make():
        words, unzip = WordCodes(), zstandard.ZstdDecompressor()

        def run(cols):
            codes, doc, pos, lens = _flat({"text": pa.array([unzip.decompress(t) for t in cols["text"].to_pylist()], pa.binary())}, words)
            if not len(codes):
                return None
            begin = np.cumsum(lens) - lens
            near = np.zeros(len(codes) + 1, np.int32)
            for i, at in enumerate(cols["at"].to_pylist()):
                p = np.frombuffer(at, np.uint32).astype(np.int64)
                np.add.at(near, begin[i] + np.maximum(p - (PERIOD - 1), 0), 1)
                np.add.at(near, np.minimum(begin[i] + p + 1, len(codes)), -1)
            hashes, rest = window_codes(codes, WINDOW), (window_codes(codes, WINDOW, seed=1) >> np.uint64(32)).astype(np.uint32)
            n = len(hashes)
            take = np.flatnonzero((np.cumsum(near)[:n] > 0) & (pos[:n] + WINDOW <= lens[doc[:n]]))
            hashes, rest, doc, pos = hashes[take], rest[take], doc[take], pos[take]
            ids, marks = cols["id"].to_numpy()[doc], cols["mark"].to_numpy()[doc]
            order = np.lexsort((ids, rest, hashes))
            starts = _starts(hashes[order], rest[order])
            size = np.diff(np.append(starts, len(order)))
            later = ids[order] > np.repeat(ids[order[starts]], size) if len(starts) else np.zeros(0, bool)
            send, here = np.sort(order[~later]), order[later]
            return _as_columns(_pack(bits, hashes[send], rest[send], ids[send], marks[send], pos[send]) + _own(bits, ids[here], marks[here], pos[here]))

        return run

    return map_batches(docs, _PACKED, make)


def _cut(docs: DataFrame) -> DataFrame:
    """Words left of documents with marked runs: (id, mark, n_removed, kept_sha256, kept)."""

    def make():
        unzip = zstandard.ZstdDecompressor()

        def run(cols):
            removed, kept = [], []
            for text, at in zip(cols["text"].to_pylist(), cols["at"].to_pylist()):
                words = unzip.decompress(text).split()
                gone = np.zeros(len(words) + 1, np.int32)
                p = np.frombuffer(at, np.uint32).astype(np.int64)
                np.add.at(gone, p, 1)
                np.add.at(gone, p + WINDOW, -1)
                gone = np.cumsum(gone)[:-1] > 0
                removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]))
            return {"id": cols["id"], "mark": cols["mark"], "n_removed": removed, "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept], "kept": kept}

        return run

    return map_batches(docs, "id long, mark long, n_removed long, kept_sha256 string, kept binary", make)


def _zipped(docs: DataFrame) -> DataFrame:
    """The same rows, texts compressed for the way."""

    def make():
        zipper = zstandard.ZstdCompressor()

        def run(cols):
            return {"id": cols["id"], "mark": cols["mark"], "text": [zipper.compress(t) for t in cols["text"].to_pylist()]}

        return run

    return map_batches(docs, "id long, mark long, text binary", make)


def _bits(words: int, share: float) -> int:
    return max(0, int(np.ceil(np.log2(max(1.0, words * share / BUCKET_ENTRIES)))))


def removed_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All rows as (id, mark, n_words, all_sha256), and the cut ones as (id, mark, n_removed, kept_sha256, kept).

    ``mark`` is a hash of the text; with the id it leads back to a row.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.xxhash64(utf8(text_col)), F.lit(0)).alias("mark"), utf8(text_col).alias("text"))

    def make():
        def run(cols):
            words = [(t or b"").split() for t in cols["text"].to_pylist()]
            return {"id": cols["id"], "mark": cols["mark"], "n_words": [len(w) for w in words], "all_sha256": [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]}

        return run

    base = cut_lineage(map_batches(picked, "id long, mark long, n_words long, all_sha256 string", make))
    words = base.agg(F.sum("n_words")).first()[0] or 0
    real = picked.where(F.col("id").isNotNull() & F.col("text").isNotNull())
    # an exact copy of a document of a smaller id is removed whole; its runs need not travel
    same = base.where((F.col("n_words") >= WINDOW) & F.col("id").isNotNull())
    first = same.groupBy("all_sha256").agg(F.min("id").alias("first"))
    copies = same.join(first, "all_sha256").where(F.col("id") > F.col("first")).select("id", "mark", "n_words").distinct()
    bits = _bits(words, len(COVER) / PERIOD)
    shared = _settle(_anchor_rows(real, bits), _shared, bits, ANCHOR_BYTES).join(copies.select("id", "mark"), ["id", "mark"], "left_anti")
    touched = cut_lineage(_zipped(real).join(shared, ["id", "mark"]))
    bits = _bits(words, 1 / 8)
    cut = _cut(touched.drop("at").join(_settle(_run_rows(touched, bits), _later, bits), ["id", "mark"]))
    whole = copies.select("id", "mark", F.col("n_words").alias("n_removed"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), F.lit(b"").alias("kept"))
    cut = cut.union(whole)
    return base, cut


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256.

    Ids are integers. A row without id is left whole and counts for no other row; NULL and empty texts have no
    words. Rows of the same id are versions of one document: none is smaller than another, each is cut by its
    own words. Other columns are not read.
    """
    base, cut = removed_runs(docs, id_col, text_col)
    cut = cut.groupBy(F.col("id").alias("cut_id"), F.col("mark").alias("cut_mark")).agg(F.first("n_removed").alias("removed"), F.first("kept_sha256").alias("kept"))
    out = base.join(cut, (F.col("id") == F.col("cut_id")) & (F.col("mark") == F.col("cut_mark")), "left")
    return out.select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col),
        "n_words",
        F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept", "all_sha256").alias("kept_sha256"),
    )


ORACLE = f"""
with w as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents
), win as (
    select doc_id, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') as g
    from (select doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) as i from w where len(w) >= {WINDOW})
), later as (
    select doc_id, i from (select doc_id, i, min(doc_id) over (partition by g) as least from win) where least < doc_id
), gone as (
    select doc_id, p from (select doc_id, unnest(range(i, i + {WINDOW})) as p from later) group by all
), holes as (
    select doc_id, list(p) as ps from gone group by doc_id
)
select w.doc_id, len(w)::bigint as n_words, coalesce(len(ps), 0)::bigint as n_removed,
       sha256(array_to_string(case when ps is null then w
              else list_transform(list_filter(range(1, len(w) + 1), lambda i: not list_contains(ps, i)), lambda i: w[i]) end, ' ')) as kept_sha256
from w left join holes using (doc_id)
"""
