"""Quality rules with cross-document line frequency.

Lines are normalised (A-Z in lower case, words joined by one space) and hashed together with their host. The
distinct documents of each (host, line) are counted; a line in more than ``max_docs`` documents of its host is
removed from them, and a document that keeps too small a share of its words is rejected as depleted.

A document gives one row per distinct line. Repeated rows are made one by (line, document), keys that spread a hot
line over all tasks, and the count is partly aggregated before its exchange. Only the lines above the limit meet
the lines of the documents again, in a join whose hot keys Spark splits.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import map_batches, utf8

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_DOCS = 100
MIN_KEPT_SHARE = 0.5
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"


def measures(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    text = text or b""
    words = text.split()
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = int(counts.sum() - counts[128:192].sum()) - sum(int(counts[c]) for c in SPACES)
    seen, dup = set(), 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        first: dict[tuple, int] = {}
        marked = np.zeros(len(words) + 3, bool)
        for i, w in enumerate(windows):
            j = first.setdefault(w, i)
            if j != i:
                marked[i : i + 3] = True
                marked[j : j + 3] = True
        repeated = int(marked.sum())
    return len(words), chars, sum(int(counts[c]) for c in SYMBOLS), dup, repeated


def _lines(docs: DataFrame) -> DataFrame:
    """One row per document and distinct normalised line: row id, hash of (host, line), words in all its copies."""

    def make():
        def run(cols):
            keys, docs, codes, sizes = [], [], [], []
            for key, doc, host, text in zip(*(cols[c].to_pylist() for c in ("key", "doc", "host", "text"))):
                found: dict[bytes, int] = {}
                for line in (text or b"").split(b"\n"):
                    words = line.lower().split()
                    if words:
                        norm = b" ".join(words)
                        found[norm] = found.get(norm, 0) + len(words)
                mark = b"0" if host is None else b"1" + host + b"\n"
                for norm, size in found.items():
                    keys.append(key)
                    docs.append(doc)
                    codes.append(xxhash.xxh3_128_digest(mark + norm))
                    sizes.append(size)
            return {"key": keys, "doc": docs, "line": codes, "size": sizes}

        return run

    return map_batches(docs, "key string, doc long, line binary, size int", make)


def line_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    max_docs: int = MAX_DOCS,
    min_kept_share: float = MIN_KEPT_SHARE,
) -> DataFrame:
    """One row per document: measures, ``base_failed``, ``n_removed_words``, ``depleted`` and ``kept``.

    Rows of one id are one document: repeated rows count once for a line of their host, and each gets its own result.
    Rows without an id are documents of their own unless text and host are equal. NULL or empty text has no words and
    fails the base rules. A NULL host is a host of its own. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    # the key leads lines back to their rows, also where ids are missing or repeated with other texts
    key = F.concat_ws(":", F.col(id_col).cast("string"), F.hex(F.crc32(utf8(text_col))), F.hex(F.crc32(utf8(host_col))), F.when(F.col(id_col).isNull(), F.sha2(utf8(text_col), 256)))
    # what counts as a document: its id, or the row itself where it has none
    doc = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), key))
    picked = docs.select(F.col(id_col).alias("id"), key.alias("key"), doc.alias("doc"), utf8(host_col).alias("host"), utf8(text_col).alias("text"))

    def make():
        def run(cols):
            got = np.array([measures(t) for t in cols["text"].to_pylist()], np.int64).reshape(-1, 5)
            return {"id": cols["id"], "key": cols["key"], **dict(zip(names, got.T))}

        return run

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    measured = map_batches(picked.select("id", "key", "text"), f"id {kind}, key string, " + ", ".join(f"{n} long" for n in names), make)
    lines = _lines(picked.select("key", "doc", "host", "text"))
    # copies of a row give its lines again: a document counts once for a line of its host
    common = lines.select("line", "doc").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_docs).select("line")
    removed = lines.join(common, "line").groupBy("key", "line").agg(F.max("size").alias("size"))
    removed = removed.groupBy("key").agg(F.sum("size").alias("removed"))
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    out = (
        measured.join(removed.withColumnRenamed("key", "removed_key"), F.col("key") == F.col("removed_key"), "left")
        .withColumn("n_removed_words", F.coalesce("removed", F.lit(0)).cast("long"))
        .withColumn("base_failed", base_failed)
        .withColumn("depleted", F.col("n_words") - F.col("n_removed_words") < min_kept_share * F.col("n_words"))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
    )
    return out.select(F.col("id").alias(id_col), *names, "base_failed", "n_removed_words", "depleted", "kept")


ORACLE = f"""
with docs as (
    select doc_id, coalesce(source, chr(0)) as host, coalesce(text, '') as text from documents
), word as (
    select doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w from docs
), win as (
    select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
    from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from word where len(w) >= 3)
), again as (
    select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from win) where n > 1
), marked as (
    select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from again) group by doc_id
), line as (
    select doc_id, host, unnest(string_split(text, chr(10))) as line from docs
), dup as (
    select doc_id, count(*) - count(distinct line) as n from line
    where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by doc_id
), norm as (
    select doc_id, host, len(w) as size, array_to_string(w, ' ') as line
    from (select doc_id, host, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from line)
    where len(w) > 0
), common as (
    select host, line from norm group by host, line having count(distinct doc_id) > {MAX_DOCS}
), gone as (
    select doc_id, sum(size) as n from norm join common using (host, line) group by doc_id
), all_ as (
    select d.doc_id, len(w)::bigint as n_words,
           length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint as word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
           coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(marked.n, 0)::bigint as n_repeat_words,
           coalesce(gone.n, 0)::bigint as n_removed_words
    from docs d join word using (doc_id) left join dup using (doc_id) left join marked using (doc_id)
    left join gone using (doc_id)
)
select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed,
       n_words - n_removed_words < {MIN_KEPT_SHARE} * n_words as depleted,
       not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
       and not (n_words - n_removed_words < {MIN_KEPT_SHARE} * n_words) as kept
from all_
"""
