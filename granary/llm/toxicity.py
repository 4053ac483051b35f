"""Toxicity of texts: logistic regression on hashed word n-grams and skip-grams, trained by FTRL-proximal.

Words are cut at white space, put in lower case (A-Z) and freed of ASCII marks at both ends. A text's features are
the distinct words, word pairs and pairs with one word skipped, hashed to ``DIM`` coordinates; each is
there or not, so one insult counts as much in a long text as in a short one. Every coordinate has a learning rate of
its own, and the L1 bound leaves most weights at exactly zero, so the model that reaches the executors is a short
list of (coordinate, weight).

Training runs in shards on the executors; after each round the states of the shards that touched a coordinate are
averaged. Bounds, as parameters: ``per_label`` labelled texts of each label are learned from (those with the
smallest hash of their id), coordinates of fewer than ``min_docs`` of them get no weight; a state has ``DIM``
coordinates. All texts are scored whole.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import WordCodes, bounded_sample, crc_mod, map_batches, mix, utf8, window_codes
from granary.session import cut_lineage

BITS = 20
DIM = 1 << BITS
THRESHOLD = 0.3
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def features(text: bytes | None, codes: WordCodes) -> np.ndarray:
    """Sorted distinct coordinates of a text."""
    tokens = [w for w in (t.strip(MARKS) for t in text.lower().split()) if w] if text else []
    if not tokens:
        return np.empty(0, np.int64)
    c = codes.of(tokens)
    skips = mix(c[:-2] * np.uint64(0x9E3779B97F4A7C15) + mix(c[2:])) if len(c) > 2 else np.empty(0, np.uint64)
    grams = [window_codes(c, n, n) for n in (1, 2)]
    return np.unique((np.concatenate([*grams, skips]) >> np.uint64(64 - BITS)).astype(np.int64))


@dataclass
class State:
    """FTRL-proximal sums of every coordinate; the last one is the bias, which has no penalty."""

    z: np.ndarray = field(default_factory=lambda: np.zeros(DIM + 1))
    n: np.ndarray = field(default_factory=lambda: np.zeros(DIM + 1))
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.1

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, free = self.z[at], at == DIM
        shrunk = np.where(free, z, np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0))
        return -shrunk / ((self.beta + np.sqrt(self.n[at])) / self.alpha + np.where(free, 0.0, self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        """One step on one text; ``at`` holds distinct coordinates, the bias among them."""
        w = self.weights(at)
        g = sigmoid(w.sum()) - label
        grown = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] = grown


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """The coordinates with a weight, their weights, and the bias."""

    at: np.ndarray
    weight: np.ndarray
    bias: float

    def scorer(self):
        """Scores of lists of texts; the short list of weights is spread out once."""
        table, codes = np.zeros(DIM, np.float32), WordCodes()
        table[self.at] = self.weight

        def score(texts: list[bytes | None]) -> np.ndarray:
            return sigmoid(np.array([table[features(t, codes)].sum(dtype=float) for t in texts]) + self.bias)

        return score


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, label_col: str, per_label: int, shards: int, seed: int) -> DataFrame:
    """The sample as one row per shard, so no task of a later round gets a part of one.

    Only the sample's ids (at most 2 x ``per_label``) are broadcast.
    """
    clean = labels.where(learn).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    clean = clean.where(F.col("id").isNotNull() & F.col("label").isin(0, 1)).groupBy("id").agg(F.max("label").alias("label"))
    sample = bounded_sample(clean, "label", "id", per_label, seed).select("id", "label")
    picked = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")).join(F.broadcast(sample), "id")
    picked = picked.select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(shards)).cast("int").alias("shard"), F.col("id").cast("string").alias("id"), "label", "text")

    def pack(batches):
        codes, rows = WordCodes(), {}
        for batch in batches:
            for shard, *row, text in zip(*(c.to_pylist() for c in batch.columns)):
                rows.setdefault(shard, []).append((*row, features(text, codes).astype(np.int32)))
        for shard, of in rows.items():
            ends = np.cumsum([len(at) for *_, at in of])
            columns = [[shard], [[i for i, *_ in of]], [[label for _, label, _ in of]], [ends], [np.concatenate([at for *_, at in of]).tobytes()]]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=["shard", "ids", "labels", "ends", "at"])

    kinds = (pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary())
    dealt = picked.repartition(shards, "shard").sortWithinPartitions("shard", "id", "text")
    return cut_lineage(dealt.mapInArrow(pack, "shard int, ids array<string>, labels array<int>, ends array<long>, at binary"))


def _shards(batches):
    """(ids, labels, coordinates by text) of each packed shard."""
    for batch in batches:
        for ids, labels, ends, at in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4))):
            yield ids, labels, np.split(np.frombuffer(at, np.int32).astype(np.int64), ends[:-1])


def train(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    per_label: int = 2000,
    min_docs: int = 3,
    shards: int = 4,
    rounds: int = 6,
    seed: int = 13,
) -> Model:
    """Fit on at most ``per_label`` labelled texts of each label among the label rows that ``learn`` takes.

    NULL ids and labels are left out; an id labelled twice counts as toxic if one label says so. Without toxic
    examples every score is 0.01, with nothing else 0.99.
    """
    rows = training_rows(docs, labels, learn, id_col, text_col, label_col, per_label, shards, seed)
    known = {r.label for r in rows.select(F.explode("labels").alias("label")).distinct().collect()}
    if known != {0, 1}:
        return Model(np.empty(0, np.int64), np.empty(0), float(np.log(99) if known == {1} else -np.log(99)))

    def count(batches):
        for _, _, texts in _shards(batches):
            at, n = np.unique(np.concatenate(texts), return_counts=True)
            yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], names=["at", "n"])

    often = rows.mapInArrow(count, "at int, n int").groupBy("at").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("at").toArrow()
    common, state = np.zeros(DIM, bool), State()
    common[often["at"].to_numpy()] = True
    for step in range(rounds):
        sent = docs.sparkSession.sparkContext.broadcast((common, state.z, state.n))

        def learn_shard(batches, sent=sent, step=step):
            common, *before = sent.value
            for ids, labels, texts in _shards(batches):
                own = State(*(a.copy() for a in before))
                for i in sorted(range(len(ids)), key=lambda i: zlib.crc32(f"{step}:{ids[i]}".encode())):
                    own.learn(np.append(texts[i][common[texts[i]]], DIM), labels[i])
                at = np.flatnonzero(own.n != before[1])
                yield pa.record_batch([pa.array(at), pa.array(own.z[at]), pa.array(own.n[at])], names=["at", "z", "n"])

        made = rows.mapInArrow(learn_shard, "at long, z double, n double")
        total = made.groupBy("at").agg(F.avg("z").alias("z"), F.avg("n").alias("n")).toArrow()
        sent.unpersist()
        at = total["at"].to_numpy()
        state.z[at], state.n[at] = total["z"].to_numpy(), total["n"].to_numpy()
    weights = state.weights(np.arange(DIM + 1))
    kept = np.flatnonzero(weights[:DIM])
    return Model(kept, weights[kept].astype(np.float32), float(weights[DIM]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """One row per document: id, held_out, score (0 to 1), predicted (1 from ``THRESHOLD`` up).

    NULL and empty texts, and texts of marks alone, have the score of the bias. Repeated rows give repeated results;
    a NULL id counts as held out; other columns are not read.
    """
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(True))
    picked = docs.select(F.col(id_col).alias("id"), held.alias("held_out"), utf8(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most DIM pairs, mostly a few thousand

    def make():
        scorer = shared.value.scorer()

        def run(cols):
            got = scorer(cols["text"].to_pylist())
            return {"id": cols["id"], "held_out": cols["held_out"], "score": got, "predicted": (got >= THRESHOLD).astype(np.int32)}

        return run

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(picked, f"id {kind}, held_out boolean, score double, predicted int", make).withColumnRenamed("id", id_col)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents, learned from labels whose crc32 of the id modulo 4 is not 2."""
    held = crc_mod("doc_id", 4) == 2
    return score(docs, train(docs, labels, ~held), held_out=held)
