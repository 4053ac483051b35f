"""Benchmark passages in documents: CGK embedding, bit-sampling LSH, exact edit check.

Texts are words in lower case without punctuation at their ends. A document holds an item if some stretch of its
words is within ``limit`` (a fifth of the item's words) edits of the item, an edit being a word put in, left out or
changed.

* Windows of item size at every word of every document are the other side of the search. Lengths of items are
  taken down to a few window sizes, and an item is represented by its first words of that number. A window can
  only match an item if it shares enough of its word pairs (a changed or left out word breaks two, one put in
  breaks one and shifts one past the end); places without so many pairs of any item are passed over. This count loses nothing. Pairs that many items
  have are left out of it where an item has enough others.
* The CGK random walk embeds a window: at each of 3 x size steps it writes the current word and moves on or not, by
  a random function of step and word. Walks that meet after an edit stay together, so edit distance becomes
  Hamming distance. Each table has its own walk and samples ``BITS`` steps of it as a key; keys equal to an item's
  make a candidate.
* Each window size has its own number of tables, taken from simulated edits at the limit so that ``recall`` is
  reached on other simulated edits too. Where ``MAX_TABLES`` do not reach it, which is so for long windows, all
  places that share enough word pairs are candidates, so that nothing is lost there.
* Candidates are confirmed by the exact edit distance of the whole item to its best stretch near the window. An item
  over ``PIECE`` words is searched by pieces, of which one at least is within the limit if the item is.
* Items of less than ``MIN_WORDS`` words are cut into one run of words more than they may have edits; one run stands
  unchanged in any match, so places with an equal run are all there are.

The benchmark is taken in blocks of at most ``block_words`` words, whose tables are broadcast; documents are read
once per block and never shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import map_batches, mix

BITS = 4
LIMIT = 0.2
RECALL = 0.98
MIN_WORDS = 8
MAX_TABLES = 64
TRIALS = 192
COMMON = 8
PIECE = 256
BLOCK_WORDS = 1 << 18
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def normal_words(text: str | None) -> list[str]:
    """Words in lower case without punctuation at their ends; a word of punctuation alone is none."""
    if not text:
        return []
    words = [w.strip(PUNCTUATION) for w in text.lower().split()]
    if not text.isascii():
        words = [w if w.isascii() else EDGE.sub("", w) for w in words]
    return [w for w in words if w]


def window_size(n: int) -> int:
    """The largest window size, of a few in steps of about an eighth, that is at most n."""
    size = MIN_WORDS
    while (more := size + max(1, size // 8)) <= n:
        size = more
    return size


def edit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edits from an item to a stretch of a text, and where the first such stretch to end starts and ends."""
    n = len(item)

    def ends(a, b):
        row, at = np.zeros(len(b) + 1, np.int64), np.arange(len(b) + 1)
        for i in range(n):
            new = np.empty(len(b) + 1, np.int64)
            new[0] = i + 1
            new[1:] = np.minimum(row[:-1] + (b != a[i]), row[1:] + 1)
            row = np.minimum.accumulate(new - at) + at
        return row

    row = ends(item, text)
    end = int(row.argmin())
    # the same backwards from that end gives the shortest stretch
    length = int(np.flatnonzero(ends(item[::-1], text[:end][::-1]) == row[end])[0])
    return int(row[end]), end - length, end


@dataclass
class Block:
    """Tables of a block of items."""

    vocab: dict[str, int]
    items: list[np.ndarray]  # word codes of each piece of an item
    owner: np.ndarray  # index of the item of each piece
    pairs: np.ndarray  # sorted codes of word pairs of the items
    first: np.ndarray  # where the pieces of a pair begin in ``of_pair``
    of_pair: np.ndarray  # the pieces that have a pair
    size: np.ndarray  # window size of each piece
    need: np.ndarray  # word pairs of a piece that a window must have
    walk: np.ndarray  # (step, word) -> one bit for each table
    steps: dict[int, np.ndarray]  # size -> (table, BITS) sampled steps, as shares of a walk
    keys: dict[int, tuple[np.ndarray, np.ndarray]]  # size -> sorted keys, piece of each; sizes without tables are not in
    whole: np.ndarray  # index of the text of each piece
    offset: np.ndarray  # where a piece begins in it
    texts: list[np.ndarray]  # word codes of each item
    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # words of a run of short items -> sorted keys, piece, place in it
    limit: float

    def allowed(self, n: int) -> int:
        return int(self.limit * n + 1e-9)


def _embed(windows: np.ndarray, walk: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Key of each window (rows; padded by -1) in each table."""
    rows, size = windows.shape
    tables = len(steps)
    padded = np.concatenate([windows, np.full((rows, 1), -1, windows.dtype)], 1)
    chosen = np.sort((steps * 3 * size).astype(np.int64), axis=1)
    at, table = np.arange(rows)[None, :], np.arange(tables, dtype=np.uint64)[:, None]
    point = np.zeros((tables, rows), np.int64)
    key = np.repeat(table * np.uint64(1_000_003) + np.uint64(size), rows, 1)
    for j in range(int(chosen.max()) + 1 if chosen.size else 0):
        word = padded[at, point]
        for t in np.flatnonzero((chosen == j).any(1)):
            for _ in range(int((chosen[t] == j).sum())):
                key[t] = mix(key[t] * np.uint64(0x9FB21C651E98DF25) + (word[t] + 2).astype(np.uint64))
        point += (walk[j, word] >> table & np.uint64(1)).astype(np.int64) & (point < size)
    return key


def _edited(rng, piece: np.ndarray, size: int, edits: int) -> list[int]:
    """The window of a piece after edits in it; words put in are 0, as are words past the end."""
    words = piece.tolist()
    for _ in range(edits):
        k, what = rng.integers(min(size, len(words))), rng.integers(3)
        words = words[:k] + ([] if what == 0 else [0] if what == 1 else [0, words[k]]) + words[k + 1 :]
    return (words + [0] * size)[:size]


def _tables_for(pieces: list[np.ndarray], size: int, walk: np.ndarray, steps: np.ndarray, limit: float, recall: float, seed: int) -> int | None:
    """Tables needed so that pieces of a window size, edited up to the limit, are found with the wanted share.

    The share must be reached on the edits that the number is taken from and on others. None: it is not reached.
    """
    rng = np.random.default_rng(seed)
    picked = [pieces[i] for i in np.resize(rng.permutation(len(pieces)), TRIALS)]
    plain = np.stack([x[:size] for x in picked])
    near = np.array([_edited(rng, x, size, int(limit * len(x) + 1e-9)) for x in picked], np.int64)
    same = _embed(plain, walk, steps) == _embed(near, walk, steps)
    first = np.where(same.any(0), same.argmax(0) + 1, len(steps) + 1)  # tables until a trial is found
    for tables in range(4, len(steps) + 1):
        found = first <= tables
        if found[: TRIALS // 3].mean() >= recall and found[TRIALS // 3 :].mean() >= recall:
            return tables
    return None


def make_block(items: list[tuple[int, list[str]]], limit: float = LIMIT, recall: float = RECALL, seed: int = 3) -> Block:
    vocab: dict[str, int] = {}
    coded = [(i, np.array([vocab.setdefault(w, len(vocab) + 1) for w in words], np.int64)) for i, words in items]
    coded.sort(key=lambda x: len(x[1]) < MIN_WORDS)  # short items last
    pieces, owner, whole, offset = [], [], [], []
    for k, (i, words) in enumerate(coded):
        count = -(-len(words) // PIECE)
        at = 0
        for part in np.array_split(words, count):
            pieces.append(part)
            owner.append(i)
            whole.append(k)
            offset.append(at)
            at += len(part)
    runs = _short_runs(pieces, limit)
    everything = pieces, np.array(owner), np.array(whole), np.array(offset), [words for _, words in coded]
    pieces = [p for p in pieces if len(p) >= MIN_WORDS]
    base = len(vocab) + 2
    if not pieces:
        none = np.zeros(0, np.int64)
        return Block(vocab, *everything[:2], none, np.zeros(1, np.int64), none, none, none, np.zeros((0, base), np.uint64), {}, {}, *everything[2:], runs, limit)
    size = np.array([window_size(len(p)) for p in pieces])
    own = [p[: n - 1] * base + p[1:n] for p, n in zip(pieces, size)]
    code, at, count = np.unique(np.concatenate([np.unique(c) for c in own]), return_inverse=True, return_counts=True)
    edits = np.array([int(limit * len(p) + 1e-9) for p in pieces])
    need, links = np.empty(len(pieces), np.int64), []
    for i, c in enumerate(own):
        k = np.searchsorted(code, c)
        rare = k[count[k] <= COMMON]
        if len(rare) - 2 * edits[i] < 3:
            rare = k
        need[i] = max(1, len(rare) - 2 * edits[i])
        links.append(np.unique(rare))
    pair, piece = np.concatenate(links), np.repeat(np.arange(len(pieces)), [len(x) for x in links])
    order = np.argsort(pair, kind="stable")
    used, first = np.unique(pair[order], return_index=True)
    pairs, first, of_pair = code[used], np.append(first, len(pair)), piece[order]
    sizes = set(size.tolist())
    rng = np.random.default_rng(seed)
    walk = rng.integers(0, 1 << 63, (3 * max(sizes), base), dtype=np.uint64) ^ (rng.integers(0, 2, (3 * max(sizes), base), dtype=np.uint64) << np.uint64(63))
    sampled = rng.random((MAX_TABLES, BITS)) * 0.6  # later steps mostly lie past the end of the words
    keys, steps = {}, {}
    for n in sorted(sizes):
        same = np.flatnonzero(size == n)
        tables = _tables_for([pieces[k] for k in same], n, walk, sampled, limit, recall, seed)
        if tables is None:
            continue
        steps[n] = sampled[:tables]
        key = _embed(np.stack([pieces[k][:n] for k in same]), walk, steps[n]).ravel()
        order = np.argsort(key, kind="stable")
        keys[n] = key[order], np.tile(same, tables)[order]
    return Block(vocab, *everything[:2], pairs, first, of_pair, size, need, walk, steps, keys, *everything[2:], runs, limit)


def _run_keys(codes: np.ndarray, words: int) -> np.ndarray:
    """Hash of the run of so many words at each place."""
    key = np.full(max(0, len(codes) - words + 1), words, np.uint64)
    for j in range(words):
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + (codes[j : j + len(key)] + 2).astype(np.uint64))
    return key


def _short_runs(pieces: list[np.ndarray], limit: float) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    rows: dict[int, list] = {}
    for p, words in enumerate(pieces):
        if len(words) < MIN_WORDS:
            for part in np.array_split(np.arange(len(words)), min(len(words), int(limit * len(words) + 1e-9) + 1)):
                rows.setdefault(len(part), []).append((int(_run_keys(words[part], len(part))[0]), p, int(part[0])))
    out = {}
    for n, got in rows.items():
        got.sort()
        key, piece, place = zip(*got)
        out[n] = np.array(key, np.uint64), np.array(piece), np.array(place)
    return out


def _short_matches(block: Block, codes: np.ndarray, doc: np.ndarray, ends: np.ndarray, lens: np.ndarray) -> dict[tuple[int, int], list[int]]:
    """The first best place of each short item in each text that is within its limit."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for words, (keys, piece, place) in block.runs.items():
        got = _run_keys(codes, words)
        at = np.flatnonzero(doc[: len(got)] == doc[words - 1 : words - 1 + len(got)])
        low = np.searchsorted(keys, got[at], "left")
        count = np.searchsorted(keys, got[at], "right") - low
        at, low, count = at[count > 0], low[count > 0], count[count > 0]
        total = np.cumsum(count)
        cuts = np.searchsorted(total, np.arange(0, (int(total[-1]) if len(total) else 0) + 100_000, 100_000))
        for x, z in zip(cuts, cuts[1:]):
            c = count[x:z]
            row = np.repeat(low[x:z], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            start = np.repeat(at[x:z], c) - place[row]
            own, text = piece[row], doc[np.repeat(at[x:z], c)]
            size = np.array([len(block.items[p]) for p in np.unique(own)])[np.unique(own, return_inverse=True)[1]] if len(own) else own
            for n in np.unique(size).tolist():
                k = np.flatnonzero(size == n)
                allowed = block.allowed(n)
                cells = (start[k] - allowed)[:, None] + np.arange(n + 2 * allowed)
                inside = (cells >= (ends - lens)[text[k]][:, None]) & (cells < ends[text[k]][:, None])
                window = np.where(inside, codes[np.clip(cells, 0, len(codes) - 1)], -1)
                items, item = np.unique(own[k], return_inverse=True)
                edits = _least_edits(np.stack([block.items[p] for p in items])[item], window)
                for i in np.flatnonzero(edits <= allowed).tolist():
                    pair, new = (int(text[k[i]]), int(own[k[i]])), (int(edits[i]), int(start[k[i]]))
                    best[pair] = min(best.get(pair, new), new)
    return {pair: [start] for pair, (_, start) in best.items()}


def _least_edits(items: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Least edits from each row of items to a stretch of the same row of windows."""
    row = [np.zeros(len(items), np.int64)] * (windows.shape[1] + 1)
    for i in range(items.shape[1]):
        new = [np.full(len(items), i + 1)]
        for j in range(windows.shape[1]):
            new.append(np.minimum(np.minimum(row[j] + (items[:, i] != windows[:, j]), row[j + 1] + 1), new[j] + 1))
        row = new
    return np.min(row, axis=0)


def _long_matches(block: Block, codes: np.ndarray, doc: np.ndarray, ends: np.ndarray, lens: np.ndarray) -> dict[tuple[int, int], list[int]]:
    """Places of candidates for each piece and text, by windows of the pieces."""
    found: dict[tuple[int, int], list[int]] = {}
    if not len(block.pairs):
        return found
    base = len(block.vocab) + 2
    pair = codes[:-1] * base + codes[1:]
    at = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0) & (doc[:-1] == doc[1:]))
    place = np.minimum(np.searchsorted(block.pairs, pair[at]), len(block.pairs) - 1)
    hit = block.pairs[place] == pair[at]
    at, place = at[hit], place[hit]
    # each place with each piece that has its pair, by piece and place
    count = block.first[place + 1] - block.first[place]
    pos = np.repeat(at, count)
    piece = block.of_pair[np.arange(len(pos)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(block.first[place], count)]
    order = np.argsort(piece, kind="stable")
    piece, pos = piece[order], pos[order]
    far = np.arange(len(pos)) + block.need[piece] - 1
    ok = np.flatnonzero(far < len(pos))
    ok = ok[(piece[far[ok]] == piece[ok]) & (pos[far[ok]] - pos[ok] <= block.size[piece[ok]] - 2) & (doc[pos[far[ok]]] == doc[pos[ok]])]
    # windows with enough pairs of a piece between two places
    least = np.maximum(pos[far[ok]] - block.size[piece[ok]] + 2, (ends - lens)[doc[pos[ok]]])
    sizes, many = block.size[piece[ok]], pos[ok] - least + 1
    spots = np.repeat(least, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    windows_of = np.repeat(sizes, many)
    for size in np.unique(sizes).tolist():
        if size not in block.keys:
            for k in np.flatnonzero(sizes == size).tolist():
                found.setdefault((int(doc[pos[ok[k]]]), int(piece[ok[k]])), []).extend((int(least[k]), int(pos[ok[k]])))
            continue
        starts = np.unique(spots[windows_of == size])
        keys, owner = block.keys[size]
        for a in range(0, len(starts), 20_000):
            s = starts[a : a + 20_000]
            cells = s[:, None] + np.arange(size)
            windows = np.where(cells < ends[doc[s]][:, None], codes[np.minimum(cells, len(codes) - 1)], -1)
            got = _embed(windows, block.walk, block.steps[size]).ravel()
            low, high = np.searchsorted(keys, got, "left"), np.searchsorted(keys, got, "right")
            for k in np.flatnonzero(high > low):
                start = int(s[k % len(s)])
                for p in set(owner[low[k] : high[k]].tolist()):
                    found.setdefault((int(doc[start]), p), []).append(start)
    return found


def matches(block: Block, texts: list[list[str]]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, edits, start, end) of the items found in texts, the best stretch of each in words."""
    get = block.vocab.get
    lens = np.array([len(t) for t in texts], np.int64)
    codes = np.array([get(w, 0) for t in texts for w in t] or [0], np.int64)
    doc = np.repeat(np.arange(len(texts)), lens)
    if not len(doc):
        return []
    ends = np.cumsum(lens)
    found = _long_matches(block, codes, doc, ends, lens) | _short_matches(block, codes, doc, ends, lens)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    wide: dict[tuple[int, int], list[list[int]]] = {}

    def confirm(d, piece, item, a, z):
        edits, start, stop = edit_distance(item, codes[a:z])
        if edits <= block.allowed(len(item)):
            key, begin = (d, int(block.owner[piece])), int(ends[d] - lens[d])
            new = (edits, a + start - begin, a + stop - begin)
            best[key] = min(best.get(key, new), new)

    for (d, piece), spots in found.items():
        item = block.items[piece]
        allowed = block.allowed(len(item))
        begin, end = int(ends[d] - lens[d]), int(ends[d])
        spots = sorted(set(spots))
        # stretches around the windows, taken together where they touch
        reach, runs = len(item) + 2 * allowed, []
        for s in spots:
            a, z = max(begin, s - 2 * allowed), min(end, s + reach)
            if runs and a <= runs[-1][1]:
                runs[-1][1] = z
            else:
                runs.append([a, z])
        whole = block.texts[block.whole[piece]]
        for a, z in runs:
            if len(whole) == len(item):
                confirm(d, piece, item, a, z)
            elif edit_distance(item, codes[a:z])[0] <= allowed:
                # the stretch that the whole item may take up around the piece
                before, more = int(block.offset[piece]), 2 * block.allowed(len(whole))
                around = [max(begin, a - before - more), min(end, z + len(whole) - before + more), piece]
                wide.setdefault((d, int(block.whole[piece])), []).append(around)
    for (d, k), around in wide.items():
        runs = []
        for a, z, piece in sorted(around):
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], z)
            else:
                runs.append([a, z, piece])
        for a, z, piece in runs:
            confirm(d, piece, block.texts[k], a, z)
    return [(d, item, *rest) for (d, item), rest in sorted(best.items())]


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", limit: float = LIMIT, recall: float = RECALL, min_words: int = 1, block_words: int = BLOCK_WORDS):
    """Blocks of the items in order of their ids, read one after the other.

    Items without a word are left out, and those of less than ``min_words`` words where the caller wants that. NULL
    texts, NULL ids and repeated rows are left out too.
    """
    rows = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).distinct()
    part, size = [], 0
    for row in rows.orderBy("id", "text").toLocalIterator():
        words = normal_words(row.text)
        if len(words) < max(1, min_words):
            continue
        if part and size + len(words) > block_words:
            yield make_block(part, limit, recall)
            part, size = [], 0
        part.append((row.id, words))
        size += len(words)
    if part:
        yield make_block(part, limit, recall)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, item_id, distance, start_word, end_word): the benchmark items that documents hold.

    One row per document row and item, with the fewest edits and where that stretch is (in words, end exclusive).
    NULL and empty texts hold nothing; rows without id are reported with NULL. Repeated rows give repeated results.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, item_id long, distance int, start_word int, end_word int"
    out = docs.sparkSession.createDataFrame([], schema)
    for k, block in enumerate(blocks(benchmark, **options)):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def make(shared=shared):
            def run(cols):
                ids, got = cols["id"], []
                for a in range(0, len(ids), 500):
                    got += [(a + d, *rest) for d, *rest in matches(shared.value, [normal_words(t) for t in cols["text"][a : a + 500].to_pylist()])]
                if not got:
                    return None
                d, item, edits, start, end = map(list, zip(*got))
                return {"id": ids.take(pa.array(d)), "item_id": item, "distance": edits, "start_word": start, "end_word": end}

            return run

        found = map_batches(picked, schema, make)
        out = found if k == 0 else out.union(found)
    return out.withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no benchmark item. Decided row by row, with no join."""
    out = docs
    for block in blocks(benchmark, **options):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col))
                keep = np.ones(batch.num_rows, bool)
                for a in range(0, batch.num_rows, 500):
                    for d, *_ in matches(shared.value, [normal_words(t) for t in texts[a : a + 500].to_pylist()]):
                        keep[a + d] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
