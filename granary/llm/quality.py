"""Document quality by pairwise ranking (Bradley-Terry).

Each document is a row of bounded features of its whole text, cut at quantiles of the training rows into
one-hot cells, so that the score is a sum of one learned step function per feature. The score is learned from
preference pairs: a document of label 1 is preferred to one of label 0, and the chance of that is the logistic of
the difference of their scores. The score is then set on the 0-1 scale by the quantile of training scores that
divides the labels: a document at that quantile gets ``THRESHOLD``.

All labelled documents are learned from, and every document of one label is paired with every one of the other: what a
document adds to the gradient depends on the other label only by how many documents it has at each score. So a round
is one job that counts training rows by label, cell and score (to 1/8), and only such counts, whose number is bounded, reach
the driver. Quantiles are of all rows, too, from counts of values to 11 binary digits. All texts are scored whole.
A text is measured where it is read, before the labels are joined, so that only its features are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import crc_mod, map_batches, utf8
from granary.session import cut_lineage

THRESHOLD = 0.3
FEATURES = (
    "log_words log_chars mean_word long_words symbol_share symbol_words upper_share upper_words digit_share digit_words mark_share bang_share pipe_share "
    "line_words short_lines dup_lines dup_line_words repeat_words distinct_words top_word stop_share non_ascii letter_share end_marks entropy"
).split()
SYMBOLS = b"#*$%&|<>"
STEPS, BINS = 8, 512  # score bins of a unit, and all of them


def measures(text: bytes | None) -> list[float]:
    """The features of one text, all finite; zeros for a text without words."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = int(counts[:128].sum() + counts[192:].sum())
    space = int(counts[9:14].sum() + counts[32])
    solid = max(1, chars - space)
    upper, digits = int(counts[65:91].sum()), int(counts[48:58].sum())
    letters = upper + int(counts[97:123].sum()) + int(counts[192:].sum())
    symbols = int(sum(counts[c] for c in SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    seen, dup, dup_words = set(), 0, 0
    for x in lines:
        if x in seen:
            dup += 1
            dup_words += len(x.split())
        seen.add(x)
    by_word: dict[bytes, int] = {}
    for w in words:
        by_word[w] = by_word.get(w, 0) + 1
    pairs: dict[tuple, int] = {}
    for p in zip(words, words[1:], words[2:]):
        pairs[p] = pairs.get(p, 0) + 1
    repeated = sum(c for c in pairs.values() if c > 1)
    share = np.array(list(by_word.values())) / n
    sample_words = by_word.items()
    weigh = lambda test: sum(c for w, c in sample_words if test(w)) / n
    return [
        np.log1p(n),
        np.log1p(chars),
        solid / n,
        weigh(lambda w: len(w) > 12),
        symbols / solid,
        weigh(lambda w: w[-1:] in (b"#", b"*", b"$", b"%", b"&") or w == b"|"),
        upper / max(1, letters),
        weigh(lambda w: len(w) > 1 and w.isupper()),
        digits / solid,
        weigh(lambda w: any(48 <= c < 58 for c in w)),
        int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()) / solid,
        int(counts[33]) / solid,
        int(counts[124]) / n,
        np.log1p(n / max(1, len(lines))),
        sum(len(x.split()) < 5 for x in lines) / max(1, len(lines)),
        dup / max(1, len(lines)),
        dup_words / n,
        repeated / max(1, n - 2),
        len(by_word) / n,
        float(share.max()),
        weigh(lambda w: len(w) < 4),
        int(counts[192:].sum()) / solid,
        letters / solid,
        int(counts[46] + counts[33] + counts[63]) / n,
        float(-(share * np.log(share)).sum()) / np.log(n + 1.0),
    ]


@dataclass
class Ranker:
    """Cuts per feature, weight per (feature, cell), and the line from a score to the 0-1 scale."""

    cuts: np.ndarray
    weights: np.ndarray
    middle: float
    scale: float
    constant: float | None = None

    def cells(self, rows: np.ndarray) -> np.ndarray:
        """Index of each feature's cell."""
        f, k = self.weights.shape
        inside = np.stack([np.searchsorted(self.cuts[j], rows[:, j], "left") for j in range(f)], 1) if f else np.zeros((len(rows), 0), int)
        return inside + np.arange(f) * k

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return self.weights.ravel()[self.cells(rows)].sum(1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(rows), self.constant)
        at = np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip((self.raw(rows) - self.middle) / self.scale + at, -40, 40)))


def value_codes(x: np.ndarray) -> np.ndarray:
    """Values to 11 binary digits, as numbers of the same order."""
    bits = (np.ascontiguousarray(x, np.float64) + 0.0).view(np.int64) >> 41  # a sign, 11 digits of the power, 11 others
    return np.where(bits < 0, ~(bits & (1 << 22) - 1), bits)


def code_values(codes: np.ndarray) -> np.ndarray:
    """The largest value in size of each code."""
    bits = np.where(codes < 0, (~codes & (1 << 22) - 1) | -1 << 22, codes)
    return ((bits << 41) | (1 << 41) - 1).view(np.float64)


def quantiles(values: np.ndarray, n: np.ndarray, shares) -> np.ndarray:
    """Quantiles of values in ascending order that occur ``n`` times: the first value with the share up to it."""
    up = np.cumsum(n)
    return values[np.minimum(np.searchsorted(up, np.asarray(shares) * up[-1] - 1e-9, "left"), len(values) - 1)]


def _cuts(label: np.ndarray, feature: np.ndarray, code: np.ndarray, n: np.ndarray, features: int, cells: int) -> np.ndarray:
    """Cuts of each feature; half of them by quantiles of each label, so that a rare label has cells of its own."""
    grid, out = np.linspace(0, 1, cells // 2 + 1)[1:-1], np.empty((features, 0))
    for k in (1, 0):
        own = []
        for f in range(features):
            at = np.flatnonzero((label == k) & (feature == f))
            at = at[np.argsort(code[at])]
            own.append(quantiles(code_values(code[at]), n[at], grid))
        out = np.concatenate([out, own], axis=1)
    return np.sort(out, axis=1)


def score_bins(model: Ranker, cells: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Rows by label, cell and bin of their score."""
    bins = np.clip(np.rint(model.weights.ravel()[cells].sum(1) * STEPS) + BINS // 2, 0, BINS - 1).astype(np.int64)
    keys = ((label[:, None] * model.weights.size + cells) * BINS + bins[:, None]).ravel()
    return np.bincount(keys, minlength=2 * model.weights.size * BINS)


def _climb(model: Ranker, count, rounds: int, rate: float, decay: float) -> None:
    """Adagrad on the logistic loss of all pairs; ``count`` gives the rows by label, cell and score bin under the weights."""
    flat, power = model.weights.reshape(-1), np.full(model.weights.size, 1e-6)
    at = (np.arange(BINS) - BINS // 2) / STEPS
    lost = 1 / (1 + np.exp(np.clip(at[:, None] - at, -40, 40)))  # of a document at one bin, paired with one of label 0 at another
    for _ in range(rounds):
        bad, good = count(model).reshape(2, flat.size, BINS).astype(float)
        b, g = (x[: model.weights.shape[1]].sum(0) for x in (bad, good))  # each row is in one cell of the first feature
        step = good @ (lost @ b) / (g.sum() * b.sum()) - bad @ (g @ lost) / (g.sum() * b.sum()) - decay * flat
        power += step**2
        flat += rate * step / np.sqrt(power)


def _settle(model: Ranker, label: np.ndarray, score: np.ndarray, n: np.ndarray) -> Ranker:
    """The line to the 0-1 scale, from the counts of training scores."""
    order = np.argsort(score)
    label, score, n = label[order], score[order], n[order]
    model.middle = float(quantiles(score, n, n[label == 0].sum() / n.sum()))  # the quantile that divides the labels
    upper, lower = (quantiles(score[label == k], n[label == k], 0.5) for k in (1, 0))
    model.scale = max(float(upper - lower) / 8, 1e-6)
    return model


def one_sided(n_good: int, n_bad: int) -> Ranker:
    """With one label only there are no pairs: every score is then that label's (0.5 without any label)."""
    return Ranker(np.zeros((0, 0)), np.zeros((0, 0)), 0.0, 1.0, 0.5 if not n_good + n_bad else 0.99 if n_good else 0.01)


CELLS, ROUNDS, RATE, DECAY = 12, 40, 0.3, 1e-3


def fit(rows: np.ndarray, labels: np.ndarray, cells: int = CELLS, rounds: int = ROUNDS, rate: float = RATE, decay: float = DECAY) -> Ranker:
    """Learn scores from all preference pairs of rows in memory; ``train`` does the same for tables."""
    good, bad = int((labels == 1).sum()), int((labels == 0).sum())
    if not good or not bad:
        return one_sided(good, bad)
    label, f = labels.astype(np.int64), rows.shape[1]
    cuts = _cuts(np.repeat(label, f), np.tile(np.arange(f), len(rows)), value_codes(rows).ravel(), np.ones(rows.size, int), f, cells)
    model = Ranker(cuts, np.zeros((f, cuts.shape[1] + 1)), 0.0, 1.0)
    at = model.cells(rows)
    _climb(model, lambda m: score_bins(m, at, label), rounds, rate, decay)
    return _settle(model, label, model.raw(rows), np.ones(len(rows), int))


def measured(docs: DataFrame, id_col: str, text_col: str, held_out=None) -> DataFrame:
    """(id, held_out, row) of all rows of ``docs``, made where they are read: features travel, texts do not."""
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(True))
    picked = docs.select(F.col(id_col).alias("id"), held.alias("held_out"), utf8(text_col).alias("text"))

    def make():
        def run(cols):
            return {"id": cols["id"], "held_out": cols["held_out"], "row": [measures(t) for t in cols["text"].to_pylist()]}

        return run

    return map_batches(picked, f"id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, row array<double>", make)


def train(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cells: int = CELLS, rounds: int = ROUNDS) -> Ranker:
    """Fit on all labelled documents among the label rows that ``learn`` (a condition) takes.

    NULL ids and labels are left out; an id labelled twice counts by its smallest label. With one label only every
    score is that label's.
    """
    return learned(measured(docs, id_col, text_col), labels, learn, id_col, label_col, cells, rounds)


def learned(features: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", label_col: str = "quality", cells: int = CELLS, rounds: int = ROUNDS) -> Ranker:
    """``train`` on rows of ``measured``. Those with a label are written once; a round reads two bytes a feature."""
    clean = labels.where(learn).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    clean = clean.where(F.col("id").isNotNull() & F.col("label").isin(0, 1)).groupBy("id").agg(F.min("label").alias("label"))
    rows = cut_lineage(features.select("id", "row").join(clean, "id").select("label", "row"))
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(n) < 2:
        return one_sided(n.get(1, 0), n.get(0, 0))
    f = len(FEATURES)

    def matrix(cols):
        return cols["row"].flatten().to_numpy().reshape(-1, f), cols["label"].to_numpy().astype(np.int64)

    def make_counts():
        def run(cols):
            x, label = matrix(cols)
            keys = np.stack([np.repeat(label, f), np.tile(np.arange(f), len(x)), value_codes(x).ravel()], 1)
            keys, times = np.unique(keys, axis=0, return_counts=True)
            return {"label": keys[:, 0], "feature": keys[:, 1], "code": keys[:, 2], "n": times}

        return run

    by_value = map_batches(rows, "label long, feature long, code long, n long", make_counts).groupBy("label", "feature", "code").agg(F.sum("n").alias("n")).toArrow()
    cuts = _cuts(*(by_value[c].to_numpy() for c in ("label", "feature", "code", "n")), f, cells)
    model = Ranker(cuts, np.zeros((f, cuts.shape[1] + 1)), 0.0, 1.0)
    width, wide = cuts.shape[1] + 1, np.arange(f) * (cuts.shape[1] + 1)

    def make_cells():
        def run(cols):
            x, label = matrix(cols)
            return {"label": label, "cells": [c.tobytes() for c in (model.cells(x) - wide).astype(np.uint16)]}

        return run

    packed = cut_lineage(map_batches(rows, "label long, cells binary", make_cells).hint("rebalance"))

    def each(batches):
        for batch in batches:
            if batch.num_rows:
                own = np.frombuffer(b"".join(batch.column("cells").to_pylist()), np.uint16).reshape(-1, f)
                yield own + wide, batch.column("label").to_numpy()

    def count(now: Ranker) -> np.ndarray:
        def run(batches):
            total = 0
            for own, label in each(batches):
                total = total + score_bins(now, own, label)
            if not np.isscalar(total):
                key = np.flatnonzero(total)
                yield pa.record_batch([pa.array(key), pa.array(total[key])], names=["key", "n"])

        got = packed.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(2 * f * width * BINS, np.int64)
        out[got["key"].to_numpy()] = got["n"].to_numpy()
        return out

    _climb(model, count, rounds, RATE, DECAY)

    def scores(batches):
        for own, label in each(batches):
            keys, times = np.unique(np.stack([label, np.rint(model.weights.ravel()[own].sum(1) * 1024).astype(np.int64)], 1), axis=0, return_counts=True)
            yield pa.record_batch([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(times)], names=["label", "score", "n"])

    got = packed.mapInArrow(scores, "label long, score long, n long").groupBy("label", "score").agg(F.sum("n").alias("n")).toArrow()
    return _settle(model, got["label"].to_numpy(), got["score"].to_numpy() / 1024, got["n"].to_numpy())


def score(docs: DataFrame, model: Ranker, id_col: str = "doc_id", text_col: str = "text", held_out=None) -> DataFrame:
    """One row per document: id, held_out, score (0 to 1), predicted (1 from ``THRESHOLD`` up).

    NULL and empty texts have the features of a text without words. Repeated rows give repeated results.
    """
    return scored(measured(docs, id_col, text_col, held_out), model, id_col)


def scored(features: DataFrame, model: Ranker, id_col: str = "doc_id") -> DataFrame:
    """``score`` of rows of ``measured``."""

    def make():
        def run(cols):
            got = model.score(cols["row"].flatten().to_numpy().reshape(-1, len(FEATURES)))
            return {"id": cols["id"], "held_out": cols["held_out"], "score": got, "predicted": (got >= THRESHOLD).astype(np.int32)}

        return run

    kind = features.schema["id"].dataType.simpleString()
    return map_batches(features, f"id {kind}, held_out boolean, score double, predicted int", make).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Ranker, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text the model does not reject. Decided row by row, with no join."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                got = model.score(np.array([measures(t.encode("utf-8", "replace") if isinstance(t, str) else t) for t in texts], float))
                yield batch.filter(pa.array(got >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents, learned from labels whose crc32 of the id modulo 5 is not 0."""
    features = cut_lineage(measured(docs, "doc_id", "text", crc_mod("doc_id", 5) == 0))
    return scored(features, learned(features, labels, crc_mod("doc_id", 5) != 0))
