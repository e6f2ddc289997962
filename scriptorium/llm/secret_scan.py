"""Secret scans through nested encodings.

A text is the first layer of a worklist. Every layer is scanned for the same kinds of secrets, and unwrapped: URL and
Unicode escapes all over the layer, each base64 run (at its four alignments, also joined over line breaks), and
compressed streams (gzip, zlib, bzip2, xz; deflate alone only if it is all of a layer) anywhere in decoded bytes. Bytes that are no text stay in a layer as lone surrogates, which match
nothing, so what surrounds a secret never hides it. New layers join the worklist
until nothing new appears; a layer with the text and the source of one seen before is not taken again, which ends
cycles. Each character of a layer knows the span of the original text it came from, so findings are reported in
original code points.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import small_batches

#: The kinds, their patterns and least lengths (of group 2, or of the match).
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of hex digits is matched whole, so the least length can stand in the pattern
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
#: Short escapes of strings, besides UNICODE, that escaped bytes may hold.
SHORT = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "0": "\0", "a": "\a", "v": "\v", '"': '"', "'": "'", "\\": "\\", "/": "/"}
ESCAPED = re.compile(UNICODE.pattern + r"|\\([bfnrt0av\"'\\/])")
#: A base64 run with its line breaks (also as escapes). The shortest secret has 16 characters, 22 in base64.
_X, _BREAK = "[A-Za-z0-9+/_-]", r"[ \t]*+(?:(?:\r\n|\n|\r|\\r\\n|\\n)[ \t]*+)++"
BASE64, BREAK, LEAST_BASE64 = re.compile(f"{_X}++(?:{_BREAK}{_X}++)*+={{0,2}}"), re.compile(_BREAK), 22
#: A text without a match of this has no finding in any layer. Over line breaks, 22 characters are three pieces or one of 11.
_B = r"[ \t]*(?:\r|\n|\\r|\\n)[ \t\r]*"
ANYTHING = rf"(?i)passw|secret|token|api_?key|AKIA|[0-9a-f]{{16}}|%[0-9a-f]{{2}}|\\u\{{?[0-9a-f]|\\x[0-9a-f]{{2}}|&#|[A-Za-z0-9+/_\-]{{22}}|[A-Za-z0-9+/_\-]{{11}}{_B}|{_B}[A-Za-z0-9+/_\-]{{11}}|{_B}[A-Za-z0-9+/_\-]{{1,10}}{_B}"
ANY = re.compile(ANYTHING)
#: Where gzip, bzip2, xz and zlib streams may begin; how those begin of which several may follow each other.
HEADER = re.compile(rb"(?=\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|[\x08\x18\x28\x38\x48\x58\x68\x78][\x00-\xff])", re.S)
MAGIC = {b"\x1f\x8b\x08": lambda: zlib.decompressobj(47), b"BZh": bz2.BZ2Decompressor, b"\xfd7z": lzma.LZMADecompressor}
#: A longer decompressed text is taken in pieces of about so many characters, cut after a character that is in no pattern.
PIECE = 4 << 20
IN_PATTERNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-\"':%\\{}&#; \t\r\n"


def scan(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end of the findings in one layer, leftmost and non-overlapping per kind."""
    low = text.lower()
    found = []
    if "passw" in low or "secret" in low or "token" in low or "key" in low:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


@dataclass
class Layer:
    """A decoded text; character i came from the original's starts[i] to ends[i]. No arrays: it is the original."""

    text: str
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None
    #: Where the source ends, with its padding, if that is after the last character; whether the source is cut there.
    stop: int = 0
    cut: bool = False

    def span(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.starts is None else (int(self.starts[a:b].min()), int(self.ends[a:b].max()))

    def key(self) -> bytes:
        """Equal for layers with the same text from the same characters of the original."""
        where = b"" if self.starts is None else self.starts.tobytes() + self.ends.tobytes()
        return hashlib.sha256(self.text.encode("utf-8", "surrogatepass") + b"\xff" + where).digest()


def _rewritten(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every match replaced by decode(match) -> [(character, start, end)], if it changes anything."""
    texts, starts, ends, at, changed = [], [], [], 0, False
    for m in pattern.finditer(layer.text):
        got = decode(m)
        if got is None:
            continue
        changed = True
        gap = np.arange(at, m.start())
        texts += [layer.text[at : m.start()], "".join(c for c, _, _ in got)]
        starts += [gap, np.array([a for _, a, _ in got], int)]
        ends += [gap + 1, np.array([b for _, _, b in got], int)]
        at = m.end()
    if not changed:
        return None
    gap = np.arange(at, len(layer.text))
    text = "".join([*texts, layer.text[at:]])
    starts, ends = np.concatenate([*starts, gap]), np.concatenate([*ends, gap + 1])
    if layer.starts is not None:
        starts, ends = layer.starts[starts], layer.ends[ends - 1]
    return Layer(text, starts, ends)


def _url(m: re.Match):
    text = bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape")
    ends = m.start() + 3 * np.cumsum(_widths(text))
    return list(zip(text, [m.start(), *ends[:-1].tolist()], ends.tolist()))


def _widths(text: str) -> np.ndarray:
    """UTF-8 bytes of each character, 1 for a byte that is no text."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return 1 + (c >= 0x80).astype(int) + (c >= 0x800) + (c >= 0x10000) - 2 * ((c >= 0xDC80) & (c < 0xDD00))


def _unicode(m: re.Match):
    code = next((int(g, 10 if k == 5 else 16) for k, g in enumerate(m.groups()) if g is not None), 0)
    return [(chr(code), m.start(), m.end())] if code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else None


def _escaped(m: re.Match):
    return [(SHORT[m[7]], m.start(), m.end())] if m[7] else _unicode(m)


def _inflated(data: memoryview, raw: bool = False) -> Iterator[tuple[bytes, int, bool]]:
    """Output of the stream at the start (with those of its kind behind it), each with the bytes read so far and if it has ended.

    Streams are told by how they begin, zlib if it is nothing else; raw is deflate without any header.
    """
    kind = b"" if raw else bytes(data[:3])
    make = MAGIC.get(kind, lambda: zlib.decompressobj(-15 if raw else 15))
    d, at = make(), 0
    while at < len(data):
        block = data[at : at + 256]
        at += len(block)
        try:
            out = d.decompress(block)
        except (zlib.error, lzma.LZMAError, OSError):
            return
        at -= len(d.unused_data)
        yield out, at, d.eof
        if d.eof:
            if kind not in MAGIC or bytes(data[at : at + 3]) != kind:
                return
            d = make()


def _texts(data: memoryview, raw: bool) -> Iterator[str]:
    """The stream's output as text, whole if it is binary, else in pieces that cut no pattern."""
    decoder, parts, size, limit = codecs.getincrementaldecoder("utf-8")("surrogateescape"), [], 0, PIECE
    for out, _, _ in _inflated(data, raw):
        parts.append(decoder.decode(out))
        size += len(parts[-1])
        if size >= limit:
            text = "".join(parts)
            stop = 0 if re.search("[\udc80-\udcff]", text) else len(text.rstrip(IN_PATTERNS))
            if stop:
                yield text[:stop]
            parts, size = [text[stop:]], len(text) - stop
            limit = PIECE if stop else 2 * size
    yield "".join([*parts, decoder.decode(b"", True)])


def _compressed(layer: Layer, data: bytes, widths: np.ndarray) -> Iterator[Layer]:
    """What the compressed streams anywhere in the layer's bytes hold; each counts as all of its stream.

    Deflate without a header is told by nothing but that it ends where the layer ends, so it must be all of the layer.
    """
    owner, done, view = np.repeat(np.arange(len(widths)), widths), 0, memoryview(data)
    for a, raw in [*((m.start(), False) for m in HEADER.finditer(data)), (0, True)]:
        if not raw and (a < done or bytes(view[a : a + 3]) not in MAGIC and ((data[a] << 8 | data[a + 1]) % 31 or data[a + 1] & 32)):
            continue
        n, read, ended = 0, 0, False
        for out, read, ended in _inflated(view[a:], raw):
            n += len(out)
        if n < 16 or layer.cut and not ended or raw and not (ended and read == len(data)):
            continue
        done = a + read if ended else done
        start, end = layer.span(int(owner[a]), int(owner[a + read - 1]) + 1)
        end = max(end, layer.stop) if a + read == len(data) else end
        for text in _texts(view[a:], raw):
            yield Layer(text, np.broadcast_to(start, len(text)), np.broadcast_to(end, len(text)))


def _base64(layer: Layer) -> Iterator[Layer]:
    for m in BASE64.finditer(layer.text):
        if m.end() - m.start() < LEAST_BASE64:
            continue
        pieces, a, last = [], m.start(), m.start() + len(m[0].rstrip("="))
        for gap in BREAK.finditer(layer.text, a, last):
            pieces.append((a, gap.start()))
            a = gap.end()
        pieces.append((a, last))
        for group in [[p] for p in pieces] + ([pieces] if len(pieces) > 1 else []):
            at = np.concatenate([np.arange(a, b) for a, b in group])
            if len(at) < LEAST_BASE64:
                continue
            run = "".join(layer.text[a:b] for a, b in group).replace("-", "+").replace("_", "/")
            end = m.end() if group[-1][1] == last else group[-1][1]
            for k in range(4):
                here = at[k : len(at) - ((len(at) - k) % 4 == 1)]
                data = base64.b64decode(run[k : k + len(here)] + "=" * (-len(here) % 4))
                text = data.decode("utf-8", "surrogateescape")
                widths = _widths(text)
                stop = np.cumsum(widths)
                a, b = here[(stop - widths) * 4 // 3], here[(stop * 4 + 2) // 3 - 1] + 1
                if layer.starts is not None:
                    a, b = layer.starts[a], layer.ends[b - 1]
                yield Layer(text, a, b, layer.span(end - 1, end)[1], len(group) < len(pieces))


def _inside(layer: Layer) -> Iterator[Layer]:
    """The layers directly under one."""
    if "%" in layer.text and (new := _rewritten(layer, URL, _url)):
        yield new
    if "\\" in layer.text or "&#" in layer.text:
        if new := _rewritten(layer, UNICODE, _unicode):
            yield new
        if (new := _rewritten(layer, ESCAPED, _escaped)) and any(c in new.text for c in ("\x1f\x8b", "\x08", "\x18", "(", "8", "H", "X", "h", "x")):
            yield from _compressed(new, new.text.encode("latin-1", "replace"), np.ones(len(new.text), int))
    if layer.starts is not None:
        yield from _compressed(layer, layer.text.encode("utf-8", "surrogateescape"), _widths(layer.text))
    yield from _base64(layer)


def findings(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Findings of the text itself, and of all layers, each by start, kind and end."""
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    base = sorted(scan(text), key=order)
    found, layer = set(base), Layer(text)
    seen, work = {layer.key()}, [_inside(layer)]
    while work:  # depth first, so that pieces of a long layer are not held together
        new = next(work[-1], None)
        if new is None:
            work.pop()
        elif (key := new.key()) not in seen:
            seen.add(key)
            work.append(_inside(new))
            found.update((kind, *new.span(a, b)) for kind, a, b in scan(new.text))
    return base, sorted(found, key=order)


SPANS = "array<struct<kind:string,start:long,end:long>>"


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    struct = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
    for batch in batches:
        texts = pc.fill_null(batch.column(1), "")
        rows: list = [([], [])] * len(texts)
        for i in np.flatnonzero(pc.match_substring_regex(texts, ANYTHING).to_numpy(zero_copy_only=False)):
            base, every = findings(texts[int(i)].as_py())
            rows[i] = (struct(base), struct(every))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b for b, _ in rows], pa.list_(kind)), pa.array([e for _, e in rows], pa.list_(kind))], names=["key", "base", "found"])


def secrets(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Key, base and found (arrays of kind, start, end in code points) of every row.

    Null and empty texts have no findings. Spans that several layers give count once. A null key stays null, repeated
    rows are scanned each, an empty table gives an empty one, other columns are not carried, texts are scanned whole.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.select(key).dtypes)[key]
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_scanned, f"key {kind}, base {SPANS}, found {SPANS}").withColumnRenamed("key", key)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts by kind of the base findings, the hash of their spans, and all spans as a string."""
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select(key, *map(n, KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("found").alias("spans"))


def redact(text: str, spans, mask: str = "[SECRET]") -> str:
    """The text with each (possibly overlapping) span replaced by the mask."""
    out, at = [], 0
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mask]
        at = end
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The same rows and columns with secrets masked in the text; a null text stays null."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            some = pc.match_substring_regex(pa.array(texts.fillna(""), pa.string()), ANYTHING).to_numpy(zero_copy_only=False)
            yield texts.where(~some, [redact(t, [{"start": a, "end": b} for _, a, b in findings(t)[1]]) if hit else t for t, hit in zip(texts, some)])

    return docs.withColumn(text, clean(F.col(text)))
