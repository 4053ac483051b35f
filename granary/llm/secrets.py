"""Secrets in texts, also inside encoded layers.

A worklist starts with the text itself. Each layer on it is scanned for secrets, then unwrapped in every way
that applies: percent codes, Unicode escapes and character references (decoded in place, so that a secret that
is partly encoded is seen whole), base64 runs, also over line ends, and compressed bytes inside any of them. What
comes out is a new layer; a layer whose text was seen before at the same place is not taken up again, so the work
ends at a fixpoint also for data that decode to themselves. Every character of a layer knows the span of the
original text it came from, and a secret found in a layer is reported by that span.

Decoded bytes that are no UTF-8 stay in a layer as lone surrogates, a byte each, so a layer is never damaged.
Decoded base64 that is no clean text is a layer if it has a run of ``SHORTEST`` letters, as every secret has.

Bound: compressed bytes are unwrapped up to ``MAX_LAYER_BYTES`` in a layer and ``MAX_TEXT_BYTES`` in a document
(a safety limit against decompression bombs; ``cut_layers`` counts what was cut). Nothing else is limited.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import map_batches

MAX_LAYER_BYTES = 16 << 20
MAX_TEXT_BYTES = 64 << 20

# kinds in the order of their listing; fixed patterns
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex")
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")

PERCENT = re.compile(r"%([0-9A-Fa-f]{2})")
PERCENT_HIGH = re.compile(r"%[89A-Fa-f][0-9A-Fa-f]")
FORM = re.compile(r"%([0-9A-Fa-f]{2})|\+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\[uU]([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
SIMPLE = {"n": 10, "r": 13, "t": 9, "b": 8, "f": 12, "v": 11, "a": 7, "0": 0, "\\": 92, "/": 47, "'": 39, '"': 34}
BYTE_ESCAPE = re.compile(ESCAPE.pattern + r"|\\([nrtbfva0\\/'\"])")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
# lines of base64, the line end plain or escaped; a run starts where no letter is before it
LINE_END = re.compile(r"[ \t]*+(?:\r?\n|\r|(?:\\r)?\\n)[ \t>]*+")
WRAPPED = re.compile(
    r"(?:(?<![A-Za-z0-9+/_\-\\])|(?<=\\n)|(?<=\\)(?!n))"
    r"(?:L++(?:END L{16,}+)++(?:END L++)?|L{16,}+END L++)={0,2}".replace("END ", f"(?:{LINE_END.pattern})").replace("L", "[A-Za-z0-9+/_-]")
)
MAGIC = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
SHORTEST = 14  # token=abcdefgh
LETTERS = re.compile(rb"[\x20-\x7e]{%d}" % SHORTEST)
_HEX_TABLE = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of secrets that stand plainly in a text, in code points."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if b"x" * 32 in text.encode("utf-8", "replace").translate(_HEX_TABLE):
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


class Layer:
    """A text with, for each of its characters, the span of the original text it came from (None: itself)."""

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None):
        self.text, self.starts, self.ends = text, starts, ends

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        return min(self.starts[start:end]), max(self.ends[start:end])


def _from_pieces(parent: Layer, pieces: list[tuple[bytes, int, int]]) -> Layer:
    """Layer of decoded bytes; each piece (bytes, start, end) came from that span of the parent."""
    raw, starts, ends = bytearray(), [], []
    for data, start, end in pieces:
        a, b = parent.span(start, end)
        raw += data
        starts += [a] * len(data)
        ends += [b] * len(data)
    text, s, e, i = bytes(raw).decode("utf-8", "surrogateescape"), [], [], 0
    if len(text) == len(raw):
        return Layer(text, starts, ends)
    for ch in text:
        n = _width(ch)
        s.append(min(starts[i : i + n]))
        e.append(max(ends[i : i + n]))
        i += n
    return Layer(text, s, e)


def _width(ch: str) -> int:
    """Bytes of a character; a lone surrogate stands for one byte."""
    return 1 if ch < "\x80" or "\udc80" <= ch <= "\udcff" else len(ch.encode("utf-8"))


def _replaced(parent: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The parent with each match decoded in place; None if nothing changes."""
    pieces, at, text = [], 0, parent.text
    for m in pattern.finditer(text):
        data = decode(m)
        if data is None:
            continue
        pieces += [(text[i].encode("utf-8", "surrogateescape"), i, i + 1) for i in range(at, m.start())]
        pieces.append((data, m.start(), m.end()))
        at = m.end()
    if not pieces:
        return None
    pieces += [(text[i].encode("utf-8", "surrogateescape"), i, i + 1) for i in range(at, len(text))]
    return _from_pieces(parent, pieces)


def _code_point(m: re.Match) -> bytes | None:
    digits = next(g for g in m.groups() if g is not None)
    code = int(digits, 10 if m[5] is not None else 16)
    return chr(code).encode() if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else None


class _Zstd:
    """Decompressor of one frame with the interface of bz2's; small slices bound what a call gives."""

    def __init__(self):
        import zstandard

        self.frame, self.input, self.unused_data = zstandard.ZstdDecompressor(max_window_size=1 << 27).decompressobj(), b"", b""
        self.at, self.eof, self.needs_input = 0, False, True

    def decompress(self, data: bytes, room: int) -> bytes:
        self.input = self.input[self.at :] + data if data else self.input
        self.at = 0 if data else self.at
        out = []
        while room > 0 and self.at < len(self.input) and not self.frame.eof:
            got = self.frame.decompress(self.input[self.at : self.at + 64])
            self.at += 64
            out.append(got)
            room -= len(got)
        self.eof, self.needs_input = self.frame.eof, self.at >= len(self.input)
        if self.eof:
            self.unused_data = self.frame.unused_data + self.input[self.at :]
        return b"".join(out)


class _Zlib:
    """Decompressor of gzip and zlib with the interface of bz2's."""

    def __init__(self):
        self.stream, self.input, self.eof, self.needs_input = zlib.decompressobj(47), b"", False, True

    def decompress(self, data: bytes, room: int) -> bytes:
        out = self.stream.decompress(self.stream.unconsumed_tail + data, room)
        self.eof, self.needs_input = self.stream.eof, not self.stream.unconsumed_tail and len(out) < room
        return out

    @property
    def unused_data(self) -> bytes:
        return self.stream.unused_data


def _opened(data: bytes):
    """A decompressor for data that begin as a known format, else None."""
    if data[:2] == b"\x1f\x8b" or (data[:1] == b"\x78" and len(data) > 2 and (data[0] * 256 + data[1]) % 31 == 0):
        return _Zlib()
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(memlimit=256 << 20)
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return _Zstd()
    return None


def _inflate(data: bytes, room: int) -> tuple[bytes, bool, int] | None:
    """Decompressed bytes of all members in a row, whether the limit cut them, and the bytes read; None if this is no known format.

    What comes before damaged bytes is kept, but of zlib, whose two first bytes occur in any data.
    """
    out, size, rest, cut = [], 0, data, False
    while (d := _opened(rest)) is not None:
        if room <= size:
            cut = True
            break
        read = len(data) - len(rest)
        try:
            given = rest
            while not d.eof:
                part = d.decompress(given, room - size)
                given = b""
                out.append(part)
                size += len(part)
                if size >= room and not d.eof:
                    cut = True
                    break
                if not part and d.needs_input:
                    break  # the data end early
        except Exception:  # bytes that only look compressed, or damaged ones
            if not size or rest[:1] == b"x":
                return (b"".join(out), cut, read) if read else None
            break
        if cut or not d.eof:
            rest = b""
            break
        rest = d.unused_data.lstrip(b"\0")
    return (b"".join(out), cut, len(data) - len(rest)) if out or cut else None


def _is_text(data: bytes) -> bool:
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return bool(text) and not any(c < " " and c not in "\t\n\r\f\v" for c in text)


def _promising(head: bytes) -> bool:
    """Whether decoded bytes begin as text or as a known compressed format."""
    magic = head[:2] == b"\x1f\x8b" or head[:3] == b"BZh" or head[:6] == b"\xfd7zXZ\x00" or head[:4] == b"\x28\xb5\x2f\xfd"
    return magic or head[:1] == b"\x78" or not any(c < 32 and c not in (9, 10, 11, 12, 13) for c in head)


def _base64_runs(text: str) -> list[tuple[int, int]]:
    """Runs of base64 letters; also from and between ``/``, ``-`` and ``_``, which may be separators."""
    runs = []
    for m in BASE64.finditer(text):
        a, z = m.span()
        runs.append((a, z))
        cuts = [a, *(a + x.end() for x in re.finditer("[/_-]", m[0])), z + 1]
        for i in range(len(cuts) - 1):
            for end in {cuts[i + 1] - 1, z}:
                if end - cuts[i] >= 16 and end - cuts[i] < z - a:
                    head = text[cuts[i] : cuts[i] + 16].replace("-", "+").replace("_", "/")
                    if "=" in head or _promising(base64.b64decode(head)):
                        runs.append((cuts[i], end))
    return runs


def _wrapped_runs(text: str) -> list[list[tuple[int, int]]]:
    """Base64 over line ends, the spans of its lines: a whole block, and parts of it with lines of one length.

    A part is lines of one length, the shorter line after them, and with or without the line before, which may
    begin in the middle. Each line is in a few parts.
    """
    runs = []
    for m in WRAPPED.finditer(text):
        gaps = [x.span() for x in LINE_END.finditer(text, *m.span())]
        if not gaps:
            continue
        lines = list(zip([m.start(), *(z for _, z in gaps)], [*(a for a, _ in gaps), m.start() + len(m[0].rstrip("="))]))
        size = [z - a for a, z in lines]
        found, i = {(0, len(lines))}, 0
        while i < len(lines):
            j = i + 1
            while j < len(lines) and size[j] == size[i]:
                j += 1
            end = j + (j < len(lines) and size[j] < size[i])
            found |= {(i, end), (max(0, i - 1), end)}
            i = j
        runs += [lines[i:j] for i, j in sorted(found) if j - i > 1]
    return runs


def _packed_layers(parent: Layer, raw: bytes, places, budget: list[int]) -> list[Layer]:
    """Layers of compressed bytes in raw; ``places`` gives the span of the parent of a stretch of raw."""
    found, at = [], 0
    for m in MAGIC.finditer(raw):
        if m.start() < at:  # inside a stream that was unwrapped
            continue
        out = _inflate(raw[m.start() :], max(0, min(MAX_LAYER_BYTES, budget[0])))
        if out is None:
            continue
        data, cut, read = out
        budget[0] -= len(data)
        budget[1] += cut
        if data:
            at = m.start() + read
            start, end = parent.span(*places(m.start(), at))
            text = data.decode("utf-8", "surrogateescape")
            found.append(Layer(text, [start] * len(text), [end] * len(text)))
    return found


def _own_packed(layer: Layer, budget: list[int]) -> list[Layer]:
    """Layers of the compressed bytes that stand in a decoded layer."""
    raw = layer.text.encode("utf-8", "surrogateescape")
    if not MAGIC.search(raw):
        return []
    place = lambda a, z: (n := len(raw[:a].decode("utf-8", "surrogateescape")), max(n + 1, len(raw[:z].decode("utf-8", "surrogateescape"))))
    return _packed_layers(layer, raw, place, budget)


def _coded_packed(parent: Layer, pattern: re.Pattern, byte, budget: list[int]) -> list[Layer]:
    """Layers of compressed bytes of which each is written as a character or as a match of the pattern.

    The in-place layer has the characters of escapes, not bytes, and not the short escapes or form-coded blanks.
    """
    text, raw, starts, ends, at = parent.text, bytearray(), [], [], 0

    def put(code, a, z):
        raw.append(code if code < 256 else 10)
        starts.append(a)
        ends.append(z)

    for m in pattern.finditer(text):
        for i in range(at, m.start()):
            put(ord(text[i]) - 0xDC00 if "\udc80" <= text[i] <= "\udcff" else ord(text[i]), i, i + 1)
        put(byte(m), *m.span())
        at = m.end()
    for i in range(at, len(text)):
        put(ord(text[i]) - 0xDC00 if "\udc80" <= text[i] <= "\udcff" else ord(text[i]), i, i + 1)
    return _packed_layers(parent, bytes(raw), lambda a, z: (starts[a], ends[z - 1]), budget)


def _escaped_byte(m: re.Match) -> int:
    if m[6] is not None:
        return SIMPLE[m[6]]
    return int(next(g for g in m.groups() if g is not None), 10 if m[5] is not None else 16)


def _base64_layers(parent: Layer, budget: list[int]) -> list[Layer]:
    found = []
    for lines in [[run] for run in _base64_runs(parent.text)] + _wrapped_runs(parent.text):
        run = "".join(parent.text[a:z] for a, z in lines).rstrip("=").replace("-", "+").replace("_", "/")
        run = run[: len(run) - (len(run) % 4 == 1)]
        data = base64.b64decode(run + "=" * (-len(run) % 4))
        readable, packed = _is_text(data) or LETTERS.search(data), MAGIC.search(data)
        if not readable and not packed:
            continue
        at = [i for a, z in lines for i in range(a, z)]
        place = lambda a, z: (at[a * 8 // 6], at[min(len(run) - 1, (z * 8 - 1) // 6)] + 1)  # noqa: E731, B023
        if readable:
            found.append(_from_pieces(parent, [(data[i : i + 1], *place(i, i + 1)) for i in range(len(data))]))
        else:
            found += _packed_layers(parent, data, place, budget)
    return found


def find_secrets(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]], int, int]:
    """Base spans, all spans (both (start, end, kind) in order), layers unwrapped, layers cut by the limit."""
    order = lambda spans: sorted(set(spans), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
    text = re.sub("[\ud800-\udfff]", "\ufffd", text)
    base = order(scan(text))
    spans, seen, work, budget, layers = set(base), set(), [Layer(text)], [MAX_TEXT_BYTES, 0], 0
    while work:
        layer = work.pop()
        children = []
        if "%" in layer.text and PERCENT.search(layer.text):
            children.append(_replaced(layer, PERCENT, lambda m: bytes.fromhex(m[1])))
            if "+" in layer.text and PERCENT_HIGH.search(layer.text):
                children += _coded_packed(layer, FORM, lambda m: int(m[1], 16) if m[1] else 32, budget)
        if ("\\" in layer.text or "&#" in layer.text) and ESCAPE.search(layer.text):
            children.append(_replaced(layer, ESCAPE, _code_point))
            children += _coded_packed(layer, BYTE_ESCAPE, _escaped_byte, budget)
        if layer.starts is not None:
            children += _own_packed(layer, budget)
        children += _base64_layers(layer, budget)
        for child in children:
            if child is None or not child.text:
                continue
            key = (hashlib.blake2b(child.text.encode("utf-8", "surrogateescape"), digest_size=16).digest(), child.starts[0], child.ends[-1])
            if key in seen or child.text == layer.text:
                continue
            seen.add(key)
            layers += 1
            spans.update((*child.span(s, e), kind) for s, e, kind in scan(child.text))
            work.append(child)
    return base, order(spans), layers, budget[1]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in spans)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, counts of plain secrets by kind, their spans and the spans of all.

    ``base_spans`` and ``spans`` are arrays of (kind, start, end) in code points, end exclusive, by start, then
    kind, then end. NULL text counts as empty: no spans. Repeated rows give repeated results; other columns of
    ``docs`` are not read. Each row is worked on alone: no exchange.
    """
    out = (
        "id {t}, n_assign long, n_access long, n_hex long, base_spans array<struct<kind:string,start:int,end:int>>, "
        "spans array<struct<kind:string,start:int,end:int>>, n_layers int, cut_layers int"
    )

    def make():
        def run(cols):
            rows = [find_secrets(t or "") for t in cols["text"].to_pylist()]
            as_structs = lambda spans: [{"kind": k, "start": s, "end": e} for s, e, k in spans]
            count = lambda kind: [sum(k == kind for *_, k in r[0]) for r in rows]
            return {
                "id": cols["id"],
                "n_assign": count("assign"),
                "n_access": count("access"),
                "n_hex": count("hex"),
                "base_spans": [as_structs(r[0]) for r in rows],
                "spans": [as_structs(r[1]) for r in rows],
                "n_layers": [r[2] for r in rows],
                "cut_layers": [r[3] for r in rows],
            }

        return run

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(picked, out.format(t=kind), make).withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """The same rows and columns, each secret span of the text (also an encoded one) replaced by ``mark``.

    Overlapping spans are replaced together; NULL text stays NULL. Decided row by row, with no exchange and no
    join, so ids may be missing or repeated.
    """

    def make():
        def run(cols):
            out = []
            for text in cols[text_col].to_pylist():
                spans = find_secrets(text)[1] if text else []
                if spans:
                    parts, at = [], 0
                    for s, e, _ in spans:
                        if s >= at:
                            parts += [text[at:s], mark]
                        at = max(at, e)
                    text = "".join(parts) + text[at:]
                out.append(text)
            return {**cols, text_col: out}

        return run

    from pyspark.sql.types import StructField, StructType

    schema = StructType([StructField(f.name, f.dataType, True) for f in docs.schema])
    return _map_same(docs, schema, make)


def _map_same(df: DataFrame, schema, make) -> DataFrame:
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = to_arrow_schema(schema)

    def run(batches):
        fn = make()
        for batch in batches:
            out = fn(dict(zip(batch.schema.names, batch.columns)))
            yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip((out[f.name] for f in fields), fields)], schema=fields)

    return df.mapInArrow(run, schema)


def secret_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: counts, digest of the base spans, and all spans as text."""
    text = lambda col: F.array_join(F.transform(col, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return secret_spans(docs).select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(text(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        "n_layers",
    )
