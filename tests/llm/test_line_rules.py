"""Line frequency rules against brute force."""

import random
import re
from collections import Counter, defaultdict

from granary.llm.line_rules import line_rules, measures


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = [], 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.append(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {p for i, w in enumerate(windows) if n[w] > 1 for p in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_measures_against_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice(["a", "b ", "é", "\n", "\x0b", " ", "\x85", "\x1c", "#", "|", "a b a ", "ü<"]) for _ in range(rng.randrange(60)))
        assert measures(text.encode()) == brute_measures(text), text
    assert measures(None) == (0, 0, 0, 0, 0)


def brute(rows, max_docs):
    docs = defaultdict(set)
    lines = []
    for i, text, host in rows:
        own = Counter()
        for line in (text or "").split("\n"):
            w = re.findall(r"[^\x20\x09-\x0D]+", line)
            if w:
                own[" ".join(w).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))] += len(w)
        lines.append(own)
        for norm in own:
            docs[host, norm].add((text, host) if i is None else i)
    out = []
    for (i, text, host), own in zip(rows, lines):
        n, *_, repeat = brute_measures(text)
        removed = sum(size for norm, size in own.items() if len(docs[host, norm]) > max_docs)
        failed = n < 50 or 100 * repeat > 50 * n
        out.append((str(i), n, removed, failed, not failed and n - removed >= 0.5 * n))
    return sorted(out)


def test_removal_and_rejection(frame):
    rng = random.Random(5)
    common = [" ".join(f"Common{j}x{k}" for k in range(12)) for j in range(8)]
    rows = []
    for i in range(120):
        own = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(10)) for _ in range(rng.randrange(3, 12))]
        picked = [c if rng.random() < 0.5 else c.upper() + "  " for c in common if rng.random() < 0.6]
        lines = own + picked + picked[: rng.randrange(2)]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), rng.choice(["hot", "hot", "hot", "other", None])))
    rows += [(500, None, "hot"), (501, "", None), (None, rows[0][1], "hot"), (0, rows[0][1], "hot"), (7, "other text", "hot")]
    docs = frame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, key string, line int")
    got = line_rules(docs, max_docs=10).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed_words, r.base_failed, r.kept) for r in got) == brute(rows, 10)
    assert any(r.depleted and not r.base_failed for r in got) and any(r.kept and r.n_removed_words for r in got)


def test_repeated_rows_are_one_document(frame):
    text = "\n".join(" ".join(f"w{k}x{j}" for j in range(13)) for k in range(5))
    rows = [(7, text, "h")] * 150 + [(8, text, "h"), (None, text, "h"), (None, text, "h")]
    got = line_rules(frame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 153 and all(r.kept and r.n_removed_words == 0 for r in got)
    got = line_rules(frame(rows, "doc_id long, text string, source string"), max_docs=2).collect()
    assert all(r.depleted and r.n_removed_words == 65 for r in got)


def test_empty_table(frame):
    assert line_rules(frame([], "doc_id long, text string, source string")).collect() == []


def test_very_long_text(frame):
    rows = [(1, "some words here\n" * 60_000, "a"), (2, "word " * 200_000, None)]
    got = {r.doc_id: r for r in line_rules(frame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1].n_dup_lines == 59_999 and got[1].n_repeat_words == 180_000 and not got[1].kept
    assert got[2].n_words == 200_000 and got[2].base_failed
