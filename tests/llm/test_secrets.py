"""Recursive secret scan against hand-made layers and a plain scan."""

import base64
import bz2
import gzip
import lzma
import random
import re
import urllib.parse
import zlib

from granary.llm.secrets import find_secrets, joined, redact, secret_digest, secret_spans

KEY = "AKIA" + "ABCDEFGH12345678"


def spans_of(text):
    return find_secrets(text)[1]


def test_plain_kinds_and_lengths():
    text = f"é password: 'hunter2hunter2' token=short {KEY} AKIASHORT " + "ab" * 16 + " " + "ab" * 15
    base, spans, _, _ = find_secrets(text)
    assert base == spans
    assert [(text[s:e], k) for s, e, k in base] == [("password: 'hunter2hunter2", "assign"), (KEY, "access"), ("ab" * 16, "hex")]


def test_short_match_uses_up_its_text():
    # the first match takes all letters of its value, so no second one starts inside
    assert joined(find_secrets("token=secret=abcdefgh12")[0]) == "assign:0:23"
    assert find_secrets("api-key=abcdefgh")[0] == []
    assert len(find_secrets("API_KEY = abcdefgh, ApiKey:'abcdefgh'")[0]) == 2


def test_ascii_case_only():
    assert find_secrets("toKen=abcdefghij")[0] == []


def test_url_layers_map_to_the_source():
    plain = "password=hunter2hunter2"
    once = "".join(f"%{b:02X}" for b in plain.encode())
    twice = urllib.parse.quote(once)
    for coded in (once, twice):
        text = f"ü see {coded} end"
        (s, e, kind), = spans_of(text)
        assert (kind, text[s:e]) == ("assign", coded)


def test_unicode_escapes_and_references():
    for coded in ("".join(f"\\u{ord(c):04x}" for c in KEY), "".join(f"&#{ord(c)};" for c in KEY), "".join(f"&#x{ord(c):X};" for c in KEY)):
        text = f"x {coded} y"
        assert [(text[s:e], k) for s, e, k in spans_of(text)] == [(coded, "access")]


def test_base64_and_compressed_nesting():
    inner = f"note {KEY} end".encode()
    for packed in (inner, zlib.compress(inner), gzip.compress(zlib.compress(inner)), base64.b64encode(inner), base64.b64encode(gzip.compress(base64.b64encode(inner)))):
        coded = base64.b64encode(packed).decode()
        text = f"α path/{coded} ω" if packed is not inner else f"α {coded} ω"
        found = spans_of(text)
        assert any(k == "access" and text.find(coded) <= s < e <= text.find(coded) + len(coded) for s, e, k in found), packed
    text = "α " + base64.b64encode(inner).decode()
    (s, e, _), = spans_of(text)
    assert KEY.encode() in base64.b64decode(text[s - (s - 2) % 4 : e + (-(e - 2)) % 4])  # only the letters that hold the key


def test_ends_on_cycles_and_noise():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("%25aA0=+/\\u&#x; é") for _ in range(rng.randrange(300)))
        base, spans, _, cut = find_secrets(text)
        assert set(base) <= set(spans) and not cut
        assert all(0 <= s < e <= len(text) for s, e, _ in spans)
    assert find_secrets("%25" * 2000)[1] == []


def wrap(coded, width, end="\n"):
    return end.join(coded[i : i + width] for i in range(0, len(coded), width))


def test_base64_over_line_ends():
    for before in range(40, 80):
        inner = b"n" * before + b" password=hunter2hunter2 " + b"z" * 90
        for width, end in ((64, "\n"), (76, "\r\n"), (76, "\\n"), (30, "\n  ")):
            coded = wrap(base64.b64encode(inner).decode(), width, end)
            text = f"ü Content: {coded}\nwords after"
            a, z = (text.index(coded) + x for x in (before * 4 // 3, len(coded) - 100))
            assert any(a - 2 <= s and e <= z + 20 and e - s >= 30 for s, e, k in spans_of(text) if k == "assign"), (before, width)


def test_wrapped_compressed_base64():
    inner = random.Random(2).randbytes(300).hex()[:299] + f"! {KEY} end"
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress):
        coded = wrap(base64.b64encode(pack(inner.encode())).decode(), 64)
        assert any(k == "access" for *_, k in spans_of(f"-----BEGIN DATA-----\n{coded}\n-----END DATA-----"))


def test_compressed_bytes_in_percent_codes_and_escapes():
    inner = f"{random.Random(3).randbytes(40).hex(' ')} {KEY} é".encode()
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress):
        data = pack(inner)
        for coded in (urllib.parse.quote(data), urllib.parse.quote_plus(data), "".join(f"%{b:02x}" for b in data), "".join(f"\\x{b:02x}" for b in data), repr(data)[2:-1], "".join(f"\\u{b:04x}" for b in data)):
            text = f"ü v={coded}&x=1"
            assert [k for s, e, k in spans_of(text) if s >= 4 and e <= 5 + len(coded)] == ["access"], (pack, coded[:40])


def test_all_members_of_a_stream():
    import zstandard

    parts = [b"first words " * 9, f"second {KEY} ".encode(), b"password=hunter2hunter2"]
    for pack in (gzip.compress, bz2.compress, lzma.compress, zstandard.ZstdCompressor().compress):
        coded = base64.b64encode(b"".join(map(pack, parts))).decode()
        assert {k for *_, k in spans_of(f"x {coded} y")} == {"assign", "access"}, pack


def test_layers_that_are_no_clean_text():
    for inner in (b"\0\x01" + KEY.encode() + b"\0", b"\xff\xfe password=hunter2hunter2", b"\x80" * 20 + b"token=abcdefgh" + b"\x07", b"\x08\x12" + gzip.compress(KEY.encode())):
        (_, _, kind), = set(spans_of(f"x {base64.b64encode(inner).decode()} y"))
        assert kind in ("access", "assign")
    noise = random.Random(4).randbytes(3000)
    assert find_secrets(base64.b64encode(noise).decode())[1:] == ([], 0, 0)


def brute(text):
    found = [(m.start(), m.end(), "assign") for m in re.finditer(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 8]
    found += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found, key=lambda x: (x[0], ["assign", "access", "hex"].index(x[2])))


def test_query_on_tables_against_a_plain_scan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r for r in secret_digest(docs).collect()}
    import hashlib

    for doc_id, text in docs.select("doc_id", "text").collect():
        want = joined(brute(text or ""))
        assert rows[doc_id].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(rows[doc_id].spans.split(","))


def test_edge_rows(spark, frame):
    long = "word " * 200_000 + f"token={KEY}"
    rows = [(1, None, "a"), (1, "", "b"), (None, f"x {KEY}", None), (2, long, "c"), (2, long, "c")]
    docs = frame(rows, "doc_id long, text string, spans string")
    got = secret_spans(docs).collect()
    assert sorted(r.n_access for r in got) == [0, 0, 1, 1, 1]
    assert secret_spans(docs.limit(0)).count() == 0
    assert secret_digest(frame([], "doc_id long, text string")).count() == 0
    out = redact(docs)
    assert out.columns == docs.columns
    texts = [r.text for r in out.collect()]
    assert texts.count("x [secret]") == 1 and None in texts and sum((t or "").endswith("word [secret]") for t in texts) == 2
