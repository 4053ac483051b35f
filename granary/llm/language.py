"""Language of texts: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of 1 to 3 characters of the lower-case text, each run of non-letters being one space;
their counts are damped (1 + log), weighted by inverse document frequency and scaled to length 1. The model is
trained by follow-the-regularised-leader with elastic-net penalties (the L1 part leaves most weights at zero),
in shards on the executors whose states are averaged after each round. A temperature, fitted on training rows
that the weights were not learned from, calibrates the score.

Bounds, as parameters: ``per_lang`` texts of each language are learned from (those with the smallest hash of
their id), of the ``max_langs`` most frequent languages; weights are ``DIM`` x languages. All texts are predicted
whole.
"""

from __future__ import annotations

import functools
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import bounded_sample, crc_mod, map_batches

BITS = 15
DIM = 1 << BITS
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter, for all of Unicode."""
    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])


def codes(text: str) -> np.ndarray:
    """Code points of the text in lower case between spaces, runs of non-letters as one space; empty without a letter."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[raw]
    if not letter.any():
        return np.empty(0, np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first character after a letter stands for the run
    out = np.where(letter, raw, 32)[keep].astype(np.uint64)
    return np.concatenate([[np.uint64(32)], out] if out[0] != 32 else [out])


def grams(code: np.ndarray) -> np.ndarray:
    """Hashed 1- to 3-grams of a text's codes."""
    parts, h = [], code * np.uint64(0x9E3779B97F4A7C15)
    parts.append(h)
    for n in (2, 3):
        h = (h[:-1] ^ (h[:-1] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + code[n - 1 :] * np.uint64(0x94D049BB133111EB)
        parts.append(h)
    return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and their damped counts."""
    code = codes(text) if text else np.empty(0, np.uint64)
    if not len(code):
        return np.empty(0, np.int64), np.empty(0)
    n = np.bincount(grams(code), minlength=DIM)
    at = np.flatnonzero(n)
    return at, 1 + np.log(n[at])


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # DIM x languages, mostly zero
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, features: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(features), len(self.langs)))
        for i, (at, x) in enumerate(features):
            v = x * self.idf[at]
            norm = np.sqrt(v @ v)
            out[i] = self.bias + (v / norm @ self.weights[at] if norm else 0)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        feats = [counts(t) for t in texts]
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        p = softmax(self.logits(feats) / self.temperature)
        known = np.array([len(at) > 0 for at, _ in feats], bool)
        best = p.argmax(1)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, p[np.arange(len(p)), best], 0.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def proximal(z: np.ndarray, n: np.ndarray, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights of the follow-the-regularised-leader state: zero inside the L1 bound, shrunk by L2 outside."""
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


def sample(docs: DataFrame, learn, id_col: str, text_col: str, lang_col: str, per_lang: int, max_langs: int, seed: int) -> DataFrame:
    """Rows to learn from: (id, lang, counts), the same wherever the rows lie."""
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    # the texts stay behind: only ids are ranked
    ids = bounded_sample(rows.select("lang", "id"), "lang", "id", per_lang, seed, max_langs).select("id").distinct()
    picked = rows.join(F.broadcast(ids), "id")

    def make():
        def run(cols):
            feats = [counts(t) for t in cols["text"].to_pylist()]
            return {"id": cols["id"], "lang": cols["lang"], "at": [a for a, _ in feats], "x": [x for _, x in feats]}

        return run

    return map_batches(picked.select("id", "lang", "text"), "id string, lang string, at array<long>, x array<double>", make)


def train(
    docs: DataFrame,
    learn,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_lang: int = 1500,
    max_langs: int = 200,
    shards: int = 8,
    rounds: int = 3,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.05,
    l2: float = 0.5,
    seed: int = 11,
) -> Model:
    """Fit weights on nine tenths of the sample, the temperature on the rest.

    The sample's features, at most ``per_lang`` x ``max_langs`` sparse rows, are kept as a table in the shared
    folder; each round reads it in ``shards``, and only states of size DIM x languages are added up.
    """
    from granary.session import cut_lineage

    rows = sample(docs, learn, id_col, text_col, lang_col, per_lang, max_langs, seed)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(shards * 10)).cast("int"))
    rows = cut_lineage(rows)
    # the last shard of ten is for the temperature
    fit, rest = rows.where(F.col("shard") < 9 * shards), rows.where(F.col("shard") >= 9 * shards)
    langs = sorted(r.lang for r in rows.where(F.size("at") > 0).select("lang").distinct().collect())
    if not langs:
        return Model([], np.zeros(DIM), np.zeros((DIM, 0)), np.zeros(0))
    n_docs = fit.count()
    seen = fit.select(F.explode("at").alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("n")).toArrow()
    idf = np.full(DIM, np.log(1.0 + n_docs) + 1)
    idf[seen["at"].to_numpy()] = np.log((1.0 + n_docs) / (1.0 + seen["n"].to_numpy())) + 1
    k = len(langs)
    z, n = np.zeros((DIM + 1, k)), np.zeros((DIM + 1, k))
    spark = docs.sparkSession
    index = {lang: i for i, lang in enumerate(langs)}
    for step in range(rounds):
        state = spark.sparkContext.broadcast((idf, z, n))

        def learn_shard(batches, state=state, step=step):
            idf, z, n = (np.array(a) for a in state.value)
            used = np.zeros(len(z), bool)
            todo = [b for b in batches if b.num_rows]
            for batch in todo:
                cols = dict(zip(batch.schema.names, batch.columns))
                order = np.argsort([hash_order(i, step) for i in cols["id"].to_pylist()])
                ats, xs, ys = cols["at"].to_pylist(), cols["x"].to_pylist(), cols["lang"].to_pylist()
                for i in order:
                    at, x = np.array(ats[i], np.int64), np.array(xs[i], float)
                    if not len(at) or ys[i] not in index:
                        continue
                    v = x * idf[at]
                    v = np.append(v / np.sqrt(v @ v), 1.0)
                    at = np.append(at, len(z) - 1)  # the last row is the bias
                    w = proximal(z[at], n[at], alpha, beta, l1, l2)
                    g = softmax(v @ w)
                    g[index[ys[i]]] -= 1
                    g = v[:, None] * g[None, :]
                    grown = n[at] + g * g
                    z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
                    n[at] = grown
                    used[at] = True
            at = np.flatnonzero(used)
            if len(at):
                yield pa.record_batch([pa.array(at), pa.array(list(z[at]), pa.list_(pa.float64())), pa.array(list(n[at]), pa.list_(pa.float64()))], names=["at", "z", "n"])

        spread = fit.repartition(shards, "shard").sortWithinPartitions("id").select("id", "lang", "at", "x")
        made = spread.mapInArrow(learn_shard, "at long, z array<double>, n array<double>")
        total = made.groupBy("at").agg(
            F.count(F.lit(1)).alias("c"),
            *(F.sum(F.col("z")[i]).alias(f"z{i}") for i in range(k)),
            *(F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(k)),
        ).toArrow()
        state.unpersist()
        at, c = total["at"].to_numpy(), total["c"].to_numpy()[:, None].astype(float)
        for i in range(k):
            z[at, i], n[at, i] = total[f"z{i}"].to_numpy() / c[:, 0], total[f"n{i}"].to_numpy() / c[:, 0]
    w = proximal(z, n, alpha, beta, l1, l2)
    model = Model(langs, idf, w[:-1], w[-1])
    held = rest.toArrow().sort_by("id")
    truth = np.array([index.get(x, 0) for x in held["lang"].to_pylist()], int)
    if len(truth):
        logits = model.logits([(np.array(a, np.int64), np.array(x, float)) for a, x in zip(held["at"].to_pylist(), held["x"].to_pylist())])
        model.temperature = temperature(logits, truth)
    return model


def hash_order(key: str, step: int) -> int:
    import zlib

    return zlib.crc32(f"{step}:{key}".encode())


def temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section on its logarithm."""

    def loss(t):
        p = softmax(logits / np.exp(t))[np.arange(len(truth)), truth]
        return -np.log(np.maximum(p, 1e-12)).mean()

    low, high, r = -4.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held_out=None) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score.

    NULL text and text without a letter give ``und`` with score 0, as does a model without languages. Repeated
    rows give repeated results; other columns are not read.
    """
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(True))
    picked = docs.select(F.col(id_col).alias("id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM x languages numbers

    def make():
        def run(cols):
            lang, score = shared.value.predict(cols["text"].to_pylist())
            return {"id": cols["id"], "held_out": cols["held_out"], "lang_pred": lang, "score": score}

        return run

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(picked, f"id {kind}, held_out boolean, lang_pred string, score double", make).withColumnRenamed("id", id_col)


def languages(docs: DataFrame) -> DataFrame:
    """Languages of all documents, learned from those whose crc32 of the id modulo 4 is not 2."""
    held = crc_mod("doc_id", 4) == 2
    return predict(docs, train(docs, ~held), held_out=held)
