"""Spelling variants of a corpus' words: pairs at one edit, by composing automata.

Two words are near if they differ by one inserted, deleted or replaced code point. The pairs are the accepted
strings of A o E o A: the minimised acceptor A of the vocabulary, a transducer E that copies its input but for
exactly one edit, and A again. The vocabulary grows with the corpus, so this machine is never built whole. Its
accepting paths are dealt out by the state in which they enter the part of the word where the edit is made:

* A pair's edit is at place q, the length of its common prefix; up to q the words agree, and after the edit they
  agree again. For words of length l (and l + 1, where one is inserted) the places 0..l are cut in windows; all pairs
  whose edit lies in the window lo..hi agree on the first ``lo`` and the last ``l - 1 - hi`` code points.
* So (l, lo, hi, that prefix, that suffix) names a partition; its words have one initial state and one final state,
  and what is between them is composed in one task. Every pair has one place, so it comes out of one partition only.
* There are two windows to start with. A partition of more than ``limit`` words is cut in two smaller windows, again
  and again. A window of one place leaves at most two code points open, of 90 that words consist of: 8,190 words at
  most, below any limit allowed. Nothing is capped.

Pairs are not listed: a partition gives one row per word, its count of near words and the best of them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import utf8
from granary.session import cut_lineage

LETTERS = "[A-Za-zÀ-ÿ]"
LEAST_LIMIT = 90 + 90 * 90
MIN_CHARS, MIN_COUNT, TIMES, EVERY = 6, 5, 5, 199


def observed(text: bytes, doc_id: bytes, find, every: int) -> tuple[list[str], list[tuple[str, str, int]]]:
    """Runs of a text (A-Z in lower case), and (run, word, n) for those that lose a code point.

    A run whose crc32 of ``<doc_id>:<run>`` is divisible by ``every`` is read without one code point.
    """
    runs = find(text.lower().decode("utf-8", "replace"))
    start, odd = zlib.crc32(doc_id + b":"), []
    for run in set(runs):
        h = zlib.crc32(run.encode(), start)
        if h % every == 0:
            at = h % len(run)
            odd.append((run, run[:at] + run[at + 1 :], runs.count(run)))
    return runs, odd


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, every: int = EVERY) -> DataFrame:
    """(word, n): words of at least ``min_chars`` code points that occur ``min_count`` times or more.

    Counts are summed inside a task before they are exchanged. NULL and empty texts have no words; a NULL id counts
    as the empty text; repeated rows count again.
    """
    held = 400_000  # distinct words a task holds before it hands its counts on

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, total = re.compile(f"{LETTERS}{{{min_chars},}}").findall, Counter()

        def counted():
            kept = [(w, n) for w, n in total.items() if n and len(w) >= min_chars]
            return pa.record_batch([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                runs, odd = observed(text, doc_id or b"", find, every)
                total.update(runs)
                for run_, word, n in odd:
                    total[run_] -= n
                    total[word] += n
                if len(total) > held:
                    yield counted()
                    total.clear()
        yield counted()

    picked = docs.select(utf8(id_col).alias("id"), utf8(text_col).alias("text"))
    return picked.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Acceptors:
    """Minimised acceptors of sets of equally long strings; equal states of all of them are one. State 0 is final."""

    def __init__(self):
        self.arcs: list[dict[str, int]] = [{}]
        self._ids: dict[tuple, int] = {}

    def _state(self, arcs: list[tuple[str, int]]) -> int:
        key = tuple(arcs)
        if key not in self._ids:
            self._ids[key] = len(self.arcs)
            self.arcs.append(dict(key))
        return self._ids[key]

    def add(self, words: list[str]) -> int | None:
        """Initial state of the acceptor of sorted, distinct words of one length; None without words."""
        if not words:
            return None
        size, open_, before = len(words[0]), [[] for _ in range(len(words[0]) + 1)], words[0]

        def close(down_to):
            for d in range(size, down_to, -1):
                open_[d - 1].append((before[d - 1], self._state(open_[d]) if d < size else 0))
                open_[d] = []

        for word in words[1:]:
            shared = next(i for i, (a, b) in enumerate(zip(before, word)) if a != b)
            close(shared + 1)
            # the arc at the place of difference is closed as well
            open_[shared].append((before[shared], self._state(open_[shared + 1]) if shared + 1 < size else 0))
            open_[shared + 1] = []
            before = word
        close(0)
        return self._state(open_[0]) if size else 0

    def common(self, p: int, q: int, but: str | None = None) -> list[str]:
        """Strings that both states accept, without those that begin with ``but``."""
        out, todo = [], [(p, q, "")]
        while todo:
            p, q, read = todo.pop()
            if not p and not q:
                out.append(read)
                continue
            a, b = self.arcs[p], self.arcs[q]
            if len(b) < len(a):
                a, b = b, a
            todo.extend((self.arcs[p][c], self.arcs[q][c], read + c) for c in a if c in b and (read or c != but))
        return out


def near_pairs(short: list[str], long: list[str], places: int) -> Iterator[tuple[str, str]]:
    """Pairs at one edit whose place is below ``places``: two of ``short``, or one of ``short`` and one of ``long``.

    ``short`` are sorted distinct strings of one length, ``long`` of that length plus one. The composed machine is
    walked in states (p, q), both having read the same input with no edit made so far; what follows an edit depends
    on the states alone, and is found once for each.
    """
    made = Acceptors()
    start, edits = (made.add(short), made.add(long)), {}
    todo = [(*start, "")] if short else []
    while todo:
        p, q, read = todo.pop()
        if (p, q) not in edits:
            arcs = sorted(made.arcs[p].items())
            found = [(a + end, b + end) for i, (a, s) in enumerate(arcs) for b, t in arcs[:i] for end in made.common(s, t)]
            if q is not None:
                found += [(end, b + end) for b, t in made.arcs[q].items() for end in made.common(p, t, b)]
            edits[p, q] = found
        for u, v in edits[p, q]:
            yield read + u, read + v
        if len(read) + 1 < places:
            after = made.arcs[q] if q is not None else {}
            todo.extend((s, after.get(c), read + c) for c, s in made.arcs[p].items())


def _window(rows: DataFrame) -> DataFrame:
    """Name the partition of rows (l, lo, hi, word, n)."""
    same_end = F.greatest(F.col("l") - 1 - F.col("hi"), F.lit(0))
    size = F.length("word")
    return rows.withColumn("key", F.concat(F.substring("word", F.lit(1), F.col("lo")), F.lit(" "), F.substring("word", size - same_end + 1, same_end)))


def _partitions(words: DataFrame, limit: int) -> DataFrame:
    """Rows (l, lo, hi, key, word, n), no partition (l, lo, hi, key) with more than ``limit`` of them."""
    size, shortest = F.length("word"), words.agg(F.min(F.length("word"))).first()[0] or 0
    # a word is the shorter (or an equally long) one of its pairs, or the longer one
    classes = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("l")).where(F.col("l") >= shortest)
    half = F.floor((F.col("l") + 1) / 2).cast("int")
    windows = F.array(F.struct(F.lit(0).alias("lo"), (half - 1).alias("hi")), F.struct(half.alias("lo"), F.col("l").alias("hi")))
    rows = _window(classes.select("word", "n", "l", F.explode(windows).alias("w")).select("l", "w.lo", "w.hi", "word", "n"))
    name, done = ["l", "lo", "hi", "key"], []
    while True:
        rows = cut_lineage(rows)
        large = rows.groupBy(*name).agg(F.count(F.lit(1)).alias("c")).where((F.col("c") > limit) & (F.col("lo") < F.col("hi"))).select(*name)
        if large.isEmpty():
            return done[0].unionByName(rows) if done else rows
        large = cut_lineage(large)
        fit = rows.join(large, name, "left_anti")
        done = [done[0].unionByName(fit) if done else fit]
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.array(F.struct("lo", middle.alias("hi")), F.struct((middle + 1).alias("lo"), "hi"))
        rows = _window(rows.join(large, name).select("l", "word", "n", F.explode(halves).alias("w")).select("l", "w.lo", "w.hi", "word", "n"))


def _composed(rows: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form) of each word with near words, once for each partition that has some."""

    def settle(l: int, lo: int, hi: int, words: list[str], n: list[int]) -> list[tuple[str, int, int, str]]:
        counts = dict(zip(words, n))
        short, long = ([w for w in counts if len(w) == size] for size in (l, l + 1))
        if not short or len(counts) < 2:
            return []
        head, tail = short[0][:lo], short[0][l - max(l - 1 - hi, 0) :]
        inner = [sorted(w[lo : len(w) - len(tail)] for w in part) for part in (short, long)]
        number, best = defaultdict(int), {}
        for u, v in near_pairs(*inner, hi - lo + 1):
            u, v = head + u + tail, head + v + tail
            for a, b in ((u, v), (v, u)):
                number[a] += 1
                other = (-counts[b], b)
                if a not in best or other < best[a]:
                    best[a] = other
        return [(w, c, -best[w][0], best[w][1]) for w, c in number.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(out):
            return pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "form_n", "form"])

        name, words, n, out = None, [], [], []
        for batch in batches:
            for *key, word, count in zip(*(c.to_pylist() for c in batch.columns)):
                if key != name:
                    if len(words) > 1:
                        out += settle(*name[:3], words, n)
                    if len(out) > 20_000:
                        yield batch_of(out)
                        out = []
                    name, words, n = key, [], []
                words.append(word)
                n.append(count)
        if len(words) > 1:
            out += settle(*name[:3], words, n)
        yield batch_of(out)

    name = ["l", "lo", "hi", "key"]
    dealt = rows.select(*name, "word", "n").repartition(*name).sortWithinPartitions(*name)
    return dealt.mapInArrow(run, "word string, n_near long, form_n long, form string")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: forms followed to the last, in doubling steps.

    A form is several times as frequent as its word, so chains end, after a number of steps that is the logarithm
    of the largest count at most.
    """
    steps = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = steps.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = cut_lineage(steps.join(onward, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        steps = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return steps


def variants(words: DataFrame, times: int = TIMES, limit: int = 20_000) -> DataFrame:
    """One row per word of (word, n): word, n, n_near, form, form_n, root.

    ``n_near`` counts the words at one edit. ``form`` is the near word of the largest count (ties: the smallest in
    code-point order), if that count is at least ``times`` the word's own, else NULL, as is ``form_n``. ``root``
    follows the forms to the last one, and is the word itself without a form. Words are distinct and not NULL.
    """
    if limit < LEAST_LIMIT:
        raise ValueError(f"limit must be at least {LEAST_LIMIT}")
    if times < 2:
        raise ValueError("times must be at least 2")
    words = cut_lineage(words.select("word", "n"))
    found = _composed(_partitions(words, limit)).groupBy("word").agg(F.sum("n_near").alias("near"), F.min(F.struct((-F.col("form_n")).alias("m"), "form")).alias("best"))
    strong = -F.col("best.m") >= F.lit(times) * F.col("n")
    out = words.join(found, "word", "left").select(
        "word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.form")).alias("form"), F.when(strong, -F.col("best.m")).alias("form_n")
    )
    out = cut_lineage(out)
    roots = _roots(out.where(F.col("form").isNotNull())).withColumnRenamed("word", "of")
    return out.join(roots, F.col("word") == F.col("of"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Variants among the words of all documents: word, form, root, n, n_near, form_n."""
    return variants(vocabulary(docs, id_col, text_col))


# crc32 in SQL: a table of 256 steps made by rule, then one step a byte
ORACLE = f"""
with recursive steps as (
    select list(v order by b) as t from (
        select b, list_reduce(list_prepend(b, range(8)), lambda c, i: xor(c >> 1, (c & 1) * 3988292384)) as v from range(256) as r(b))
), runs as (
    select coalesce(doc_id::varchar, '') || ':' as head,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) as run
    from documents
), counted as (
    select head, run, count(*) as n from runs where length(run) >= {MIN_CHARS} group by all
), hashed as (
    select run, n, xor(4294967295, list_reduce(
        list_prepend(4294967295::bigint, list_transform(range(0, strlen(head || run)), lambda i: ('0x' || substr(hex(head || run), 2 * i + 1, 2))::bigint)),
        lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]))) as h
    from counted, steps
), read as (
    select case when h % {EVERY} = 0 then run[:h % length(run)] || run[h % length(run) + 2:] else run end as word, n from hashed
), words as (
    select word, sum(n)::bigint as n from read where length(word) >= {MIN_CHARS} group by word having sum(n) >= {MIN_COUNT}
), cuts as (
    select word, n, i, word[:i - 1] as a, word[i + 1:] as b from (select word, n, unnest(range(1, length(word) + 1)) as i from words)
), pairs as (
    select u.word, v.word as near, v.n from cuts u join cuts v on u.i = v.i and u.a = v.a and u.b = v.b and u.word <> v.word
    union select u.word, v.word, v.n from words u join cuts v on u.word = v.a || v.b
    union select v.word, u.word, u.n from words u join cuts v on u.word = v.a || v.b
), best as (
    select word, count(*)::bigint as n_near, max(n) as top_n, arg_min(near, struct_pack(m := -n, near := near)) as top from pairs group by word
), forms as (
    select words.word, words.n, coalesce(n_near, 0) as n_near, case when top_n >= {TIMES} * n then top end as form, case when top_n >= {TIMES} * n then top_n::bigint end as form_n
    from words left join best using (word)
), chain as (
    select word, word as root, 0 as k from forms
    union all
    select chain.word, form, k + 1 from chain join forms on chain.root = forms.word where form is not null
)
select forms.word, form, root, n, n_near, form_n from forms join (select word, arg_max(root, k) as root from chain group by word) using (word)
"""
