"""Language model scores: a hashed maximum-entropy model with a class-factored softmax, nested down to the words.

All words stand at the leaves of one tree. Its top is made of symbols: the ``HEAD`` most frequent tokens, and tail classes of
the other words by their last two bytes. Below a tail class its words are nested in classes of two, down to a leaf for each
frequent word and leaves for the others by their hash, whose number follows the vocabulary; the words of such a leaf share
its chance by their smoothed counts, with one event for unseen words. The chance of a word is the product of the
choices on its path, so the chances of a history sum to one.

The choices start from a small dense model: a softmax over classes of ``CLASS_SIZE`` head words and tail classes, then over
the head words of a class, with the symbols of the last two words as features (bigram, skip and trigram, hashed to ``ROWS``
rows); below the symbols they start from the counts. To each choice come the weights of the words themselves: the word before
(bigram), the one before that (skip) and both (trigram), hashed together with the place in the tree.

Everything the model learns from is counted over all training texts. The dense model is fitted by gradient ascent with a
curvature scale on triples of symbols, whose number is bounded; its gradients are added up on the driver. The weights of
words have no bound: every token of every text is dealt to a share by the word before it (a frequent one by the text's row,
too), and a task fits and applies the weights of a share, so the shares are as many as the tokens ask for, and no weight
leaves its task. A skip feature is that of its share. Bigrams and trigrams of neighbouring words before, whose events are
worked on together, are hashed into a table of their own.

What is broadcast: ``LOOKUP`` frequent tokens of at most 64 bytes with their counts, and the tree, a few bytes for each frequent token
and each ``TOGETHER`` others. Counts of all other tokens reach the documents by a join on the token; frequent tokens, which
would be hot keys, are not in it.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import crc_mod, map_batches, mix, utf8
from granary.session import cut_lineage, finished_shuffles_removed

HEAD, CLASS_SIZE, TAIL = 128, 16, 24
HEAD_CLASSES = HEAD // CLASS_SIZE
CLASSES = HEAD_CLASSES + TAIL
SYMBOLS = HEAD + TAIL + 1  # and the start
START = SYMBOLS - 1
ROWS = 1 << 13
LOOKUP = 1 << 17
ROUNDS = 12
PRIOR = 2.0
MOST_STEP = 0.4
TOGETHER = 4  # other words of a leaf, about
EVENTS = 1 << 18  # tokens of a share, about
BLOCK = 1 << 15  # of which are worked on at once
HELD = 1 << 18  # whose choices are kept meanwhile
GROUP = 1 << 15  # different events, about, whose bigrams and trigrams have a table of their own
TEXTS, PIECE = 2000, 250  # texts that are dealt together, and cut to words at once
WORD_ROUNDS, WORD_PRIOR, WORD_STEP = 2, 2.0, 1.0
END = b""  # the end of a text; no word is empty


@dataclass
class Model:
    tokens: int  # N, in training texts
    distinct: int  # V
    counts: dict[bytes, int]  # of frequent tokens
    head: dict[bytes, int]
    tail_of: dict[bytes, int]  # class of frequent endings
    tail_z: np.ndarray  # smoothed size of each tail class, with an event for unseen words in each leaf by hash
    bias: np.ndarray  # log share of each class, then of each head word in its class
    weights: np.ndarray = field(default_factory=lambda: np.zeros((ROWS, CLASSES + HEAD), np.float32))
    leaves: Leaves | None = None
    tree: Tree | None = None

    def symbol(self, token: bytes) -> int:
        return self.head[token] if token in self.head else HEAD + tail_class(self.tail_of, token[-2:])

    @property
    def base_z(self) -> float:
        return self.tokens + 0.1 * (self.distinct + 1)

    def logs(self, contexts: np.ndarray) -> np.ndarray:
        """Natural log of the chance of each symbol (head words and tail classes) after each context."""
        x = self.bias + self.weights[feature_rows(contexts)].sum(1, dtype=np.float64)
        c = log_softmax(x[:, :CLASSES])
        w = log_softmax(x[:, CLASSES:].reshape(len(x), HEAD_CLASSES, CLASS_SIZE))
        return np.concatenate([(c[:, :HEAD_CLASSES, None] + w).reshape(len(x), HEAD), c[:, HEAD_CLASSES:]], 1)


def tail_class(tail_of: dict[bytes, int], ending: bytes) -> int:
    """The class of a frequent ending, or one of the last four by the ending's bytes."""
    got = tail_of.get(ending)
    return TAIL - 4 + sum(ending) % 4 if got is None else got


def tail_classes(tail_of: dict[bytes, int]):
    """``tail_class`` for an array of tokens."""
    table = np.append(np.arange(1 << 8).repeat(1 << 8) + np.tile(np.arange(1 << 8), 1 << 8), np.arange(1 << 8)) % 4 + TAIL - 4  # endings of two bytes, then of one
    for ending, k in tail_of.items():
        table[int.from_bytes(ending, "big") + (len(ending) < 2) * (1 << 16)] = k

    def of(tokens: pa.Array) -> np.ndarray:
        data = np.frombuffer(tokens.buffers()[2] or b"", np.uint8)
        if not len(data):  # no words
            return np.full(len(tokens), TAIL - 4)
        cuts = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset :][: len(tokens) + 1].astype(np.int64)
        last, before = data[np.maximum(cuts[1:] - 1, 0)].astype(np.int64), data[np.maximum(cuts[1:] - 2, 0)].astype(np.int64)
        return table[np.where(np.diff(cuts) > 1, before << 8, 1 << 16) + last]

    return of


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def feature_rows(contexts: np.ndarray) -> np.ndarray:
    """Hashed rows of the three features of contexts (code: symbol before last x SYMBOLS + last symbol)."""
    c = contexts.astype(np.uint64)
    last, before = c % np.uint64(SYMBOLS), c // np.uint64(SYMBOLS)
    keys = np.stack([last + np.uint64(1 << 20), before + np.uint64(2 << 20), c + np.uint64(3 << 20)], 1)
    return (mix(keys) >> np.uint64(64 - 13)).astype(np.int64)


def contexts_of(symbols: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Context codes of symbols in a row, ``lens`` of each text."""
    before, last = histories(symbols, lens, START)
    return before * SYMBOLS + last


def histories(symbols: np.ndarray, lens: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbol before last and the last symbol at each place."""
    first = np.cumsum(lens) - lens
    last, before = np.roll(symbols, 1), np.roll(symbols, 2)
    last[first] = start
    before[first] = start
    second = first + 1
    second = second[second < len(symbols)]
    before[second] = start  # after the first word; at a text of one symbol this is the next text's start anyway
    return before, last


@dataclass
class Texts:
    tokens: pa.Array  # distinct ones of all texts, the end last
    code: np.ndarray  # place in ``tokens`` of each token of the texts in a row
    lens: np.ndarray  # tokens of each text

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lens)), self.lens)


def texts_of(cols: dict) -> Texts:
    """Tokens of texts (bytes); the kernels look at single bytes, so they need no valid UTF-8."""
    text = pc.fill_null(cols["text"], b"").cast(pa.binary())
    cut = pc.ascii_split_whitespace(pc.ascii_lower(text.view(pa.string())))
    of = np.repeat(np.arange(len(text)), cut.value_lengths().to_numpy())
    flat = cut.flatten()
    filled = pc.greater(pc.binary_length(flat), 0)  # space at the ends leaves empty parts
    words = flat.filter(filled).dictionary_encode()
    of = of[filled.to_numpy(zero_copy_only=False)]
    code = np.full(len(of) + len(text), len(words.dictionary), np.int32)
    code[np.arange(len(of)) + of] = words.indices.to_numpy()
    return Texts(pa.concat_arrays([words.dictionary.view(pa.binary()), pa.array([END])]), code, np.bincount(of, minlength=len(text)) + 1)


def _token_counts(docs: DataFrame) -> DataFrame:
    def make():
        def run(cols):
            texts = texts_of(cols)
            return {"token": texts.tokens, "c": np.bincount(texts.code, minlength=len(texts.tokens))}

        return run

    return map_batches(docs, "token binary, c long", make).groupBy("token").agg(F.sum("c").alias("c"))


def symbol_coder(model: Model):
    """Symbols of an array of tokens, for one task."""
    head, classes = pa.array(list(model.head), pa.binary()), tail_classes(model.tail_of)
    symbols = np.append(np.array(list(model.head.values())), 0)

    def code(tokens: pa.Array) -> np.ndarray:
        at = pc.index_in(tokens, value_set=head).fill_null(len(head)).to_numpy()
        return np.where(at < len(head), symbols[at], HEAD + classes(tokens))

    return code


def _triples(docs: DataFrame, model) -> DataFrame:
    """(context, symbol, n) over all training texts."""

    def make():
        code = symbol_coder(model.value)

        def run(cols):
            texts = texts_of(cols)
            symbols = code(texts.tokens)[texts.code]
            counts = np.bincount(contexts_of(symbols, texts.lens) * SYMBOLS + symbols)  # at most SYMBOLS^3
            keys = np.flatnonzero(counts)
            return {"context": keys // SYMBOLS, "symbol": keys % SYMBOLS, "n": counts[keys]}

        return run

    return map_batches(docs, "context long, symbol long, n long", make).groupBy("context", "symbol").agg(F.sum("n").alias("n"))


def gradient(model: Model, contexts: np.ndarray, symbols: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Rows of weights, gradient and curvature of the log likelihood there, and the log likelihood."""
    own, which = np.unique(contexts, return_inverse=True)
    g, h, total = [], [], 0.0
    rows = feature_rows(own)
    for a in range(0, len(own), 2048):
        part = np.flatnonzero((which >= a) & (which < a + 2048))
        i, s, m = which[part] - a, symbols[part], n[part].astype(float)
        k = min(2048, len(own) - a)
        logs = model.logs(own[a : a + k])
        total += float((logs[i, s] * m).sum())
        seen = np.zeros((k, SYMBOLS - 1))
        np.add.at(seen, (i, s), m)
        words = seen[:, :HEAD].reshape(k, HEAD_CLASSES, CLASS_SIZE)
        classes = np.concatenate([words.sum(2), seen[:, HEAD:]], 1)
        x = model.bias + model.weights[rows[a : a + k]].sum(1, dtype=np.float64)
        pc = np.exp(log_softmax(x[:, :CLASSES]))
        pw = np.exp(log_softmax(x[:, CLASSES:].reshape(k, HEAD_CLASSES, CLASS_SIZE)))
        size, inner = classes.sum(1, keepdims=True), words.sum(2, keepdims=True)
        g.append(np.concatenate([classes - size * pc, (words - inner * pw).reshape(k, HEAD)], 1))
        h.append(np.concatenate([size * pc * (1 - pc), (inner * pw * (1 - pw)).reshape(k, HEAD)], 1))
    g, h = np.concatenate(g), np.concatenate(h)
    used, at = np.unique(rows, return_inverse=True)
    up, curve = np.zeros((len(used), g.shape[1])), np.zeros((len(used), g.shape[1]))
    for f in range(3):
        np.add.at(up, at.reshape(rows.shape)[:, f], g)
        np.add.at(curve, at.reshape(rows.shape)[:, f], h)
    return used, up, curve, total


def _fit_weights(model: Model, triples: DataFrame, rounds: int) -> Model:
    spark = triples.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(replace(model, counts={}, head={}, tail_of={}, leaves=None))  # gradients need no words

        def run(batches, shared=shared):
            rows = [b for b in batches if b.num_rows]  # at most SYMBOLS^3 rows in all tasks
            if rows:
                t = pa.Table.from_batches(rows)
                used, up, curve, _ = gradient(shared.value, *(t[c].to_numpy() for c in ("context", "symbol", "n")))
                yield pa.record_batch([pa.array(used), pa.array([x.astype(np.float32).tobytes() for x in up]), pa.array([x.astype(np.float32).tobytes() for x in curve])], names=["row", "up", "curve"])

        got = triples.mapInArrow(run, "row long, up binary, curve binary").toArrow()
        shared.destroy()
        if got.num_rows:
            g, h = np.zeros(model.weights.shape), np.zeros(model.weights.shape)
            for part in got.to_batches(1024):
                row = part.column("row").to_numpy()
                for c, total in (("up", g), ("curve", h)):
                    np.add.at(total, row, np.frombuffer(b"".join(part.column(c).to_pylist()), np.float32).reshape(len(row), -1))
            # three features share each gap between what is seen and expected; bounded steps keep rare rows stable
            step = (g - PRIOR * model.weights) / (3 * (h + PRIOR))
            model.weights = (model.weights + np.clip(step, -MOST_STEP, MOST_STEP)).astype(np.float32)
    return model


def train(docs: DataFrame, counts: DataFrame, rounds: int = ROUNDS) -> Model:
    """Fit the model on training texts (id, text as bytes) and the counts of all their tokens."""
    totals = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    n, v = totals[0] or 0, totals[1]
    top = counts.where(F.length("token") <= 64).orderBy(F.desc("c"), "token").limit(LOOKUP).toArrow()
    frequent = dict(zip(top["token"].to_pylist(), top["c"].to_pylist()))
    head = [t for t in frequent if t != END][: HEAD - 1]
    head = sorted(head + [END], key=lambda t: (-frequent.get(t, 0), t))
    # endings of all words: at most 65,793 different ones
    names = docs.sparkSession.createDataFrame([(bytearray(t),) for t in head], "token binary")
    rest = counts.join(F.broadcast(names), "token", "left_anti").where(F.length("token") > 0)
    ends = rest.groupBy(F.expr("substring(token, greatest(length(token) - 1, 1), 2)").alias("ending")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).toArrow().to_pylist()
    ends.sort(key=lambda r: (-r["c"], r["ending"]))
    tail_of = {bytes(r["ending"]): i for i, r in enumerate(ends[: TAIL - 4])}
    tail_n, tail_v = np.zeros(TAIL), np.zeros(TAIL, np.int64)
    for r in ends:
        t = tail_class(tail_of, bytes(r["ending"]))
        tail_n[t] += r["c"]
        tail_v[t] += r["v"]
    for t in frequent.keys() - set(head):
        tail_v[tail_class(tail_of, t[-2:])] -= 1  # leaves tail_v the words without a leaf of their own
    words = np.full(HEAD, 0.1)
    words[: len(head)] += [frequent.get(t, 0) for t in head]
    by_class = words.reshape(HEAD_CLASSES, CLASS_SIZE).sum(1)
    classes = np.concatenate([by_class, tail_n + 0.1])
    bias = np.concatenate([np.log(classes / classes.sum()), np.log(words / np.repeat(by_class, CLASS_SIZE))])
    model = Model(n, v, frequent, {t: i for i, t in enumerate(head)}, tail_of, np.zeros(TAIL), bias)
    model.leaves = Leaves.of(model, tail_v)
    masses = model.leaves.masses(counts, model)
    np.add.at(model.tail_z, model.leaves.symbol[HEAD:-1] - HEAD, masses[HEAD:])
    if n:
        shared = docs.sparkSession.sparkContext.broadcast(replace(model, counts={}, leaves=None))
        triples = cut_lineage(_triples(docs, shared).repartition(8, "context"))
        shared.destroy()
        _fit_weights(model, triples, rounds)
    model.tree = Tree.of(model, masses, np.concatenate([words, tail_n + 0.1]))
    return model


@dataclass
class Leaves:
    """The leaf of every word: head words, other frequent words, then leaves by hash for each tail class.

    Number ``count`` stands for the start of a text.
    """

    own: dict[bytes, int]
    first: np.ndarray  # leaf by hash, of each tail class
    size: np.ndarray  # how many, a power of two
    symbol: np.ndarray  # of each leaf, and of the start
    times: np.ndarray  # how often the word of each leaf of one word occurs in training texts
    log_z: np.ndarray | None = None  # log10 of the smoothed size of leaves that words share, else 0

    @property
    def count(self) -> int:
        return len(self.symbol) - 1

    @classmethod
    def of(cls, model: Model, others: np.ndarray) -> Leaves:
        """``others``: words of each tail class that are not among the frequent ones."""
        tail = [t for t in model.counts if t not in model.head]
        own = model.head | {t: HEAD + i for i, t in enumerate(tail)}
        size = 1 << np.ceil(np.log2(np.maximum(1, others / TOGETHER))).astype(np.int64)
        symbol = np.concatenate([np.arange(HEAD), np.array([model.symbol(t) for t in tail], int), np.repeat(np.arange(TAIL) + HEAD, size), [START]])
        times = np.zeros(HEAD + len(tail), np.int64)
        times[list(own.values())] = [model.counts.get(t, 0) for t in own]
        return cls(own, HEAD + len(tail) + np.cumsum(size) - size, size, symbol.astype(np.int16), times)

    def coder(self, tail_of: dict[bytes, int]):
        """Leaves of an array of tokens, for one task."""
        classes, mask = tail_classes(tail_of), (self.size - 1).astype(np.uint64)

        def code(tokens: pa.Array) -> np.ndarray:
            out = np.fromiter((self.own.get(t, -1) for t in tokens.to_pylist()), np.int32, len(tokens))
            rest = np.flatnonzero(out < 0)
            words = tokens.take(pa.array(rest))
            k = classes(words)
            codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), np.uint64, len(rest))
            out[rest] = self.first[k] + (codes & mask[k]).astype(np.int64)
            return out

        return code

    def masses(self, counts: DataFrame, model: Model) -> np.ndarray:
        """Smoothed size of each leaf; a leaf by hash has one event for unseen words."""
        shared = counts.sparkSession.sparkContext.broadcast((self, model.tail_of))

        def make():
            leaves, tail_of = shared.value
            leaf_of = leaves.coder(tail_of)

            def run(cols):
                leaf = leaf_of(cols["token"])
                rest = leaf >= leaves.first[0]
                return {"leaf": leaf[rest], "mass": cols["c"].to_numpy()[rest] + 0.1}

            return run

        got = map_batches(counts, "leaf long, mass double", make).groupBy("leaf").agg(F.sum("mass").alias("mass")).toArrow()
        shared.destroy()
        out = np.full(self.count, 0.1)
        out[: len(self.times)] += self.times
        out[got["leaf"].to_numpy()] += got["mass"].to_numpy()
        self.log_z = np.where(np.arange(self.count) < self.first[0], 0.0, np.log10(out)).astype(np.float32)
        return out


def nest(items: np.ndarray, masses: np.ndarray, node: int, leaves: int, up: np.ndarray, side: np.ndarray, bias: np.ndarray) -> tuple[int, int]:
    """Join items two by two, the smallest first, under nodes numbered from ``node``; gives the root item and the next node."""
    order = np.argsort(masses, kind="stable")
    waiting, size = items[order].tolist(), masses[order].tolist()
    made, made_size, i, j = [], [], 0, 0
    for n in range(node, node + len(waiting) - 1):
        pair = []
        for _ in range(2):
            if j >= len(made) or (i < len(waiting) and size[i] <= made_size[j]):
                pair.append((waiting[i], size[i]))
                i += 1
            else:
                pair.append((made[j], made_size[j]))
                j += 1
        (a, x), (b, y) = pair
        up[a] = up[b] = n
        side[b] = 1
        bias[n] = np.log(y / x)
        made.append(leaves + n)
        made_size.append(x + y)
    return (made[-1] if made else waiting[0]), node + len(waiting) - 1


@dataclass
class Tree:
    """Choices of two on the way from each leaf up to the root. The first nodes choose among symbols."""

    leaves: int
    up: np.ndarray  # node above each leaf, then above each node; -1 at the root
    side: np.ndarray  # 1 where the node's second part is taken
    bias: np.ndarray  # log odds of the second part by counts
    logits: np.ndarray  # of the nodes among symbols, by context, by the dense model
    symbol: np.ndarray

    NODES = SYMBOLS - 2  # among symbols

    @classmethod
    def of(cls, model: Model, masses: np.ndarray, symbol_masses: np.ndarray) -> Tree:
        leaves, n = model.leaves, model.leaves.count
        up, side, bias = np.full(2 * n - 1, -1, np.int32), np.zeros(2 * n - 1, np.uint8), np.zeros(n - 1, np.float32)
        tops, node = list(range(HEAD)), cls.NODES
        for k in range(HEAD, HEAD + TAIL):
            items = np.flatnonzero(leaves.symbol[:-1] == k)
            top, node = nest(items, masses[items], node, n, up, side, bias)
            tops.append(top)
        nest(np.array(tops), symbol_masses, 0, n, up, side, bias)
        parts = np.zeros((2, SYMBOLS - 1, cls.NODES))  # symbols in each part of a node
        for s, item in enumerate(tops):
            while up[item] >= 0:
                parts[side[item], s, up[item]] = 1
                item = n + up[item]
        logits = np.empty((SYMBOLS * SYMBOLS, cls.NODES), np.float32)
        for a in range(0, len(logits), 1024):
            chances = np.exp(model.logs(np.arange(a, min(a + 1024, len(logits)))))
            logits[a : a + 1024] = np.log(chances @ parts[1]) - np.log(chances @ parts[0])
        return cls(n, up, side, bias, logits, leaves.symbol)

    def paths(self, word: np.ndarray) -> tuple[np.ndarray, ...]:
        """Choices on the way up from each leaf in a row: where they begin, how many, their nodes and the sides taken."""
        levels, which, item = [], np.arange(len(word)), word.astype(np.int64)
        many = np.zeros(len(word), np.int64)
        while len(which):
            node = self.up[item]
            levels.append((which, node, self.side[item]))
            many[which] += 1
            item = self.leaves + node.astype(np.int64)
            go = np.flatnonzero(self.up[item] >= 0)
            which, item = which[go], item[go]
        begin = np.cumsum(many) - many
        nodes, sides = np.empty(many.sum(), np.int32), np.empty(many.sum(), np.uint8)
        for k, (which, node, side) in enumerate(levels):
            nodes[begin[which] + k], sides[begin[which] + k] = node, side
        return begin, many, nodes, sides

    def choices(self, word: np.ndarray, last: np.ndarray, before: np.ndarray, bits: tuple[int, int, int], paths: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """For every choice on the paths of events, one event after the other, log odds to start from, side taken and three rows of weights; how many an event has.

        ``word`` is a place in ``paths``. The rows are those of bigram, skip and trigram, each in a table of 2 to the power of its ``bits``.
        """
        begin, many, nodes, sides = paths
        lens = many[word]
        at = np.arange(lens.sum()) + np.repeat(begin[word] - (np.cumsum(lens) - lens), lens)
        node = nodes[at]
        start = self.bias[node]
        high = np.flatnonzero(node < self.NODES)
        context = np.repeat((self.symbol[before].astype(np.int64) * SYMBOLS + self.symbol[last]) * self.NODES, lens)
        start[high] = self.logits.reshape(-1)[context[high] + node[high]]
        u, t = last.astype(np.uint64), before.astype(np.uint64)
        keys = [(mix(k) >> np.uint64(32)).astype(np.uint32) for k in (u + np.uint64(1 << 60), t + np.uint64(2 << 60), (t << np.uint64(32)) + u)]
        place = node.astype(np.uint32) * np.uint32(0x9E3779B1)
        rows = [((np.repeat(k, lens) ^ place) * np.uint32(0x85EBCA6B) >> np.uint32(32 - b)).astype(np.int32) for k, b in zip(keys, bits)]
        return lens, start, sides[at], *rows


def share_scores(tree: Tree, word: np.ndarray, last: np.ndarray, before: np.ndarray, learn: np.ndarray, rounds: int = WORD_ROUNDS) -> np.ndarray:
    """log10 of the chance of each event's leaf, with weights fitted to the events to learn from. Equal events are worked on once."""
    pair = np.unique(last.astype(np.int64) << 32 | before, return_inverse=True)[1]
    _, first, same = np.unique(pair << 32 | word, return_index=True, return_inverse=True)
    word, last, before = word[first], last[first], before[first]
    times = np.bincount(same, learn, len(first)).astype(np.float32)
    # events are in order of the last word here; words that follow each other have a table of bigrams and trigrams together, small enough to stay at hand
    group = np.searchsorted(last, last) // GROUP
    skip_bits = table_bits(4 * times.sum())
    leaves, word = np.unique(word, return_inverse=True)
    paths = tree.paths(leaves)
    held, room, groups = {}, HELD, []
    for own in np.split(np.arange(len(word)), np.flatnonzero(np.diff(group)) + 1):
        bits = table_bits(8 * times[own].sum())
        blocks = [part[a : a + BLOCK] for part in (own[times[own] > 0], own[times[own] == 0]) for a in range(0, len(part), BLOCK)]
        groups.append((blocks, (bits, skip_bits, bits), np.zeros(1 << bits, np.float32)))

    def choices(block, bits):
        nonlocal room
        got = held.get(block[0]) or tree.choices(word[block], last[block], before[block], bits, paths)
        if block[0] not in held and room >= len(block):  # the rest of a large share is worked out again each time
            held[block[0]] = got
            room -= len(block)
        return got

    skips = np.zeros(1 << skip_bits, np.float32)
    for k in range(rounds if learn.any() else 0):
        skip_change = np.zeros(len(skips), np.complex64)  # gradient and curvature side by side
        for blocks, bits, weights in groups:
            change = np.zeros(len(weights), np.complex64)
            for block in blocks:
                if times[block[0]] == 0:
                    continue
                lens, x, side, bigram, skip, trigram = choices(block, bits)
                if k:  # else all weights are 0
                    x = x + weights[bigram] + skips[skip] + weights[trigram]
                n = np.repeat(times[block], lens)
                p = 1 / (1 + np.exp(-np.clip(x, -40, 40)))
                both = np.empty(len(p), np.complex64)
                both.real, both.imag = n * (side - p), n * (p * (1 - p))
                for total, r in ((change, bigram), (skip_change, skip), (change, trigram)):
                    np.add.at(total, r.astype(np.intp), both)
            take_step(weights, change)  # no other group has these
        take_step(skips, skip_change)
        del skip_change
    out = np.zeros(len(word))
    for blocks, bits, weights in groups:
        for block in blocks:
            lens, start, side, bigram, skip, trigram = choices(block, bits)
            x = (2 * side.astype(np.float32) - 1) * (start + weights[bigram] + skips[skip] + weights[trigram])
            lost = np.maximum(-x, np.float32(0)) + np.log(1 + np.exp(-np.abs(x)))
            out[block] = np.add.reduceat(lost, np.cumsum(lens) - lens, dtype=np.float64) / -np.log(10)
    return out[same]


def table_bits(rows: float) -> int:
    return int(np.clip(np.ceil(np.log2(rows + 1)), 10, 28))


def take_step(weights: np.ndarray, change: np.ndarray) -> None:
    """Three features share each gap between what is seen and expected."""
    for a in range(0, len(weights), BLOCK):
        own, sums = weights[a : a + BLOCK], change[a : a + BLOCK]
        own += np.clip((sums.real - WORD_PRIOR * own) / (3 * (sums.imag + WORD_PRIOR)), -WORD_STEP, WORD_STEP)


def squeeze(*columns: np.ndarray) -> bytes:
    """Columns of one length as compressed bytes, the bytes of like weight together."""
    raw = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns)
    return len(columns[0]).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def stretch(blob: bytes, *types) -> list[np.ndarray]:
    """The columns of ``squeeze``."""
    n, widths = int.from_bytes(blob[:8], "little"), [np.dtype(t).itemsize for t in types]
    raw = np.frombuffer(pa.decompress(blob[8:], n * sum(widths), "zstd", asbytes=True), np.uint8)
    ends = np.cumsum(widths) * n
    return [np.ascontiguousarray(raw[e - n * w : e].reshape(w, n).T).view(t).reshape(n) for e, w, t in zip(ends, widths, types)]


TABLE = "share int, batch long, data binary"
EVENT = ("i4", "i4", "i4", "u2")  # leaves of the word, the last and the one before; text in its batch, and the mark of a training text
SUM = ("u2", "f4")  # text in its batch, log10 of its chances
LEARN = 1 << 15


def steps(x: np.ndarray) -> np.ndarray:
    """Differences in the type of ``x``, which fill fewer bytes if it ascends; ``np.cumsum`` in that type takes them back."""
    return np.diff(x, prepend=x.dtype.type(0))


def squeeze_events(word: np.ndarray, last: np.ndarray, before: np.ndarray, mark: np.ndarray) -> bytes:
    """Events in order of the last word, then as they came (by text)."""
    order = np.argsort(last, kind="stable")
    return squeeze(word[order], steps(last[order]), before[order], steps(mark[order]))


def stretch_events(blob: bytes) -> list[np.ndarray]:
    word, last, before, mark = stretch(blob, *EVENT)
    return [word, np.cumsum(last, dtype=last.dtype), before, np.cumsum(mark, dtype=mark.dtype)]


def _deal(docs: DataFrame, model, shares: int, size: int) -> DataFrame:
    """For each batch of texts a row of what the counts settle (share below 0) and a row of events for each share."""
    kind = docs.schema["id"].dataType.simpleString()
    fields = _row_fields(kind)

    def run(batches):
        m = model.value
        leaves, base_z = m.leaves, np.log10(m.base_z)
        leaf_of = leaves.coder(m.tail_of)
        # a word so frequent that it would fill a share is dealt to several
        often = np.ones(leaves.count + 1, np.int64)
        often[: len(leaves.times)] += 4 * leaves.times // size
        often[leaves.count] = often[leaves.own[END]]
        unit = np.cumsum(often) - often  # words, and parts of frequent ones, are dealt in turn, so that shares are alike in size
        share_of, several = (unit % shares).astype(np.int32), often > 1
        for batch in (b.slice(a, TEXTS) for b in batches for a in range(0, b.num_rows, TEXTS)):
            keys = batch.column("row").to_numpy()
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            sink, word, lens = pa.BufferOutputStream(), [], []
            with pa.ipc.new_stream(sink, fields, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                for a in range(0, len(keys), PIECE):
                    piece = batch.slice(a, PIECE)
                    texts = texts_of(dict(zip(piece.schema.names, piece.columns)))
                    lens.append(texts.lens)
                    own = leaf_of(texts.tokens)
                    word.append(own[texts.code])
                    writer.write_batch(_settled(piece, texts, own, leaves, base_z, fields))
            del texts
            word, lens = np.concatenate(word), np.concatenate(lens)
            first = int(keys[0])
            before, last = histories(word, lens, leaves.count)
            text = np.repeat(np.arange(len(lens), dtype=np.uint16), lens)
            part, marks = share_of[last], mix(keys.astype(np.uint64))
            for a in range(0, len(word), BLOCK):
                spread = a + np.flatnonzero(several[last[a : a + BLOCK]])
                at = last[spread]
                part[spread] = (unit[at] + (marks[text[spread]] % often[at].astype(np.uint64)).astype(np.int64)) % shares
            mark = text + np.where(held, 0, LEARN).astype(np.uint16)[text]
            order = np.argsort(part.astype(np.uint16) if shares <= 1 << 16 else part, kind="stable")
            part = part[order]
            at = np.flatnonzero(np.diff(part, prepend=-1))
            found = part[at]
            events = [c[order] for c in (word, last, before, mark)]
            blobs = [squeeze_events(*(c[a:b] for c in events)) for a, b in zip(at, [*at[1:], len(order)])]
            share = [-1 - first // TEXTS % shares, *found.tolist()]
            yield from _table(share, [first] * len(share), [sink.getvalue().to_pybytes(), *blobs])

    return docs.mapInArrow(run, TABLE)


def _settled(texts_rows: pa.RecordBatch, texts: Texts, leaf: np.ndarray, leaves: Leaves, base_z: float, fields: pa.Schema) -> pa.RecordBatch:
    """Rows of texts: sums over the tokens whose counts are known here, on a text's first row, and its other tokens."""
    text, n = texts.text, len(texts.lens)
    settled = leaf < len(leaves.times)
    settled[settled] = leaves.times[leaf[settled]] > 0
    weigh = np.zeros(len(leaf))
    weigh[settled] = np.log10(leaves.times[leaf[settled]] + 0.1)
    known = settled[texts.code]
    base = np.bincount(text, weigh[texts.code], n) - texts.lens * base_z
    n_known = np.bincount(text[known], minlength=n)
    pair, tf = np.unique(text[~known] << 32 | texts.code[~known], return_counts=True)
    of, code = pair >> 32, pair & 0xFFFFFFFF
    # what the words of a leaf share; 0.1 without any
    shared = np.bincount(of, tf * np.where(leaf[code] < len(leaves.times), -1.0, leaves.log_z[leaf[code]]), n)
    none = np.setdiff1d(np.arange(n), of)
    keys = texts_rows.column("row").to_numpy()
    token = pa.concat_arrays([texts.tokens.take(pa.array(code)), pa.array([b" %d" % keys[i] for i in none.tolist()], pa.binary())])
    of, tf = np.append(of, none), np.append(tf, np.zeros(len(none), tf.dtype))
    order = np.argsort(of, kind="stable")
    of, tf = of[order], tf[order]
    first = np.append(True, of[1:] != of[:-1])
    once = lambda x: np.where(first, x[of], x.dtype.type(0))
    got = texts_rows.select(["id", "held_out"]).take(pa.array(of, mask=~first))
    columns = {"row": keys[of], "id": got.column("id"), "held_out": got.column("held_out"), "n_tokens": once(texts.lens), "n_known": once(n_known), "base": once(base), "score": once(-shared), "token": token.take(pa.array(order)), "tf": tf}
    return pa.record_batch([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip((columns[f.name] for f in fields), fields)], schema=fields)


def _table(*columns):
    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary()))], names=["share", "batch", "data"])


def _row_fields(kind: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(_row_schema(kind)))


def _row_schema(kind: str) -> str:
    return f"row long, id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, token binary, tf long"


def _fit_shares(dealt: DataFrame, tree, rounds: int) -> DataFrame:
    """Sums of log10 chances by text for the events of each batch and share; other rows are handed on."""

    def run(batches):
        def finish():
            if rows:
                got = [stretch_events(data) for _, data in rows]
                word, last, before, mark = (np.concatenate(c) for c in zip(*got))
                logs = share_scores(tree.value, word, last, before, mark >= LEARN, rounds)
                ends = np.cumsum([len(g[0]) for g in got])
                out = []
                for (batch, _), end, g in zip(rows, ends, got):
                    at = g[3] % LEARN
                    text = np.flatnonzero(np.bincount(at))
                    out.append(squeeze(steps(text.astype(np.uint16)), np.bincount(at, logs[end - len(at) : end])[text].astype(np.float32)))
                yield from _table([share] * len(rows), [b for b, _ in rows], out)

        share, rows = None, []
        for batch in batches:
            for s, key, data in zip(*(c.to_pylist() for c in batch.columns)):
                if s < 0:
                    yield from _table([s], [key], [data])
                    continue
                if s != share:
                    yield from finish()
                    share, rows = s, []
                rows.append((key, data))
        yield from finish()

    return dealt.mapInArrow(run, TABLE)


def _gather(parts: DataFrame, kind: str) -> DataFrame:
    """The settled rows of each batch, the sums of all shares added to the score of a text's first row."""
    fields = _row_fields(kind)

    def run(batches):
        key, rows, sums = None, None, None
        for batch in batches:
            for s, b, data in zip(*(c.to_pylist() for c in batch.columns)):
                if s < 0:  # the first row of a batch
                    if rows is not None:
                        yield _added(rows, sums, fields)
                    rows = pa.ipc.open_stream(data).read_all()
                    key, sums = b, np.zeros(TEXTS)
                else:
                    text, x = stretch(data, *SUM)
                    assert b == key
                    sums[np.cumsum(text, dtype=text.dtype)] += x
        if rows is not None:
            yield _added(rows, sums, fields)

    return parts.mapInArrow(run, _row_schema(kind))


def _added(rows: pa.Table, sums: np.ndarray, fields: pa.Schema) -> pa.RecordBatch:
    columns = dict(zip(rows.schema.names, rows.combine_chunks().to_batches()[0].columns))
    score = columns["score"].to_numpy().copy()
    first = np.flatnonzero(columns["held_out"].is_valid().to_numpy(zero_copy_only=False))
    score[first] += sums[: len(first)]
    columns["score"] = pa.array(score)
    return pa.record_batch([columns[f.name] for f in fields], schema=fields)


def _score_rows(docs: DataFrame, model: Model) -> DataFrame:
    """Sums over the tokens of each text that the broadcast tables settle, and its other tokens.

    One of a text's rows has the sums; a text whose tokens are all settled has a row with a token that is no word.
    """
    context = docs.sparkSession.sparkContext
    tree, model.tree = context.broadcast(model.tree), None
    shares = 1 + model.tokens // EVENTS
    dealt = _deal(docs, context.broadcast(replace(model, counts={}, head={}, weights=np.empty((0, 0)))), shares, EVENTS).repartition(shares, "share").sortWithinPartitions("share", "batch")
    parts = _fit_shares(dealt, tree, WORD_ROUNDS).repartition("batch").sortWithinPartitions("batch", "share")
    return _gather(parts, docs.schema["id"].dataType.simpleString())


def language_scores(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per document row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``learn`` is the condition of training rows; where it is NULL, the row is held out. NULL text counts as empty: it has the end token
    only. Repeated rows are counted and scored each. Without training texts every word is unseen. Scores are log10.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    held = ~F.coalesce(learn, F.lit(False))
    picked = docs.select(F.col(id_col).alias("id"), held.alias("held_out"), utf8(text_col).alias("text"))
    training = picked.where(~F.col("held_out"))
    with finished_shuffles_removed(docs.sparkSession):  # nothing of the training is read again but what it returns and the counts
        counts = cut_lineage(_token_counts(training.select("text")))
        model = train(training.select("text"), counts, rounds)
    rows = _score_rows(picked.withColumn("row", F.monotonically_increasing_id()), model)
    unknown = counts.withColumnRenamed("token", "word")
    joined = rows.join(unknown, F.col("token") == F.col("word"), "left")
    c = F.coalesce("c", F.lit(0))
    add = F.col("tf") * F.log10(c + 0.1)
    out = joined.groupBy("row").agg(
        F.max("id").alias("id"),
        F.max("held_out").alias("held_out"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(c > 0, F.col("tf")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + add).alias("base_score"),
        F.sum(F.col("score") + add).alias("score"),
    )
    return out.select(F.col("id").cast(kind).alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def scores(docs: DataFrame) -> DataFrame:
    """Scores of all documents, learned from those whose crc32 of the id modulo 10 is not 0."""
    return language_scores(docs, crc_mod("doc_id", 10) != 0)
