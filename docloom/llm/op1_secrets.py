"""Operator 1, secret scans through a recursive decoding worklist.

A layer is a text with, for each of its characters, the code-point range of the document it came
from. The document is the first layer. Each layer is scanned by every rule, then unwrapped: runs of
%XX escapes, \\uXXXX, \\xXX and &#N; escapes give one layer with all of them replaced in place; each
base64 run that decodes to text, or to gzip, zlib, bzip2 or zstandard data that expand to text, gives
one layer of its own. New layers join the worklist until none is new; a layer seen before (same text
from the same place) is not scanned again, so cycles and self-reproducing archives end. Findings are
mapped to the document range that their characters came from.

A layer that would take a document's decoded total beyond ``most_chars`` is refused and counted in
n_refused, the guard against archive bombs; the document's own text is always scanned whole.

Defined results. Null or empty text: no finding. Rows are independent: repeated rows give the same
result each, a null doc_id is carried through. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from docloom.llm.common import arrow_map, slices

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CUES = ("passw", "secret", "token", "apikey", "api_key")
MOST_CHARS = 64 << 20

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u[0-9A-Fa-f]{4}(?:\\u[0-9A-Fa-f]{4})*|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_URLSAFE = str.maketrans("-_", "+/")


def scan(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of each rule's matches, leftmost and non-overlapping."""
    out = []
    low = text.lower()
    if any(c in low for c in CUES):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    return out + [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]


def _replaced(text: str, pattern: re.Pattern, decode) -> tuple[str, np.ndarray, np.ndarray] | None:
    """The text with the matches that decode replaced, and each character's range in ``text``."""
    parts, lo, hi, at, changed = [], [], [], 0, False
    for m in pattern.finditer(text):
        got = decode(m[0])
        if got is None:
            continue
        new, widths = got
        changed = True
        parts += [text[at : m.start()], new]
        plain = np.arange(at, m.start())
        ends = m.start() + np.cumsum(widths)
        lo += [plain, ends - widths]
        hi += [plain + 1, ends]
        at = m.end()
    if not changed:
        return None
    rest = np.arange(at, len(text))
    return "".join([*parts, text[at:]]), np.concatenate([*lo, rest]), np.concatenate([*hi, rest + 1])


def _percent(run: str) -> tuple[str, list[int]] | None:
    """Bytes that are not UTF-8 stay as they are written."""
    new, widths = [], []
    for c in bytes.fromhex(run.replace("%", "")).decode(errors="surrogateescape"):
        if 0xDC80 <= ord(c) <= 0xDCFF:
            at = sum(widths)
            new.append(run[at : at + 3])
            widths += [1, 1, 1]
        else:
            new.append(c)
            widths.append(3 * len(c.encode()))
    out = "".join(new)
    return (out, widths) if out != run else None


def _escape(run: str) -> tuple[str, list[int]] | None:
    if run[0] == "&":
        new = html.unescape(run)
        return (new, [len(run)]) if len(new) == 1 else None
    if run[1] != "u":
        code = int(run[2:], 16)
        return (chr(code), [len(run)]) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None
    units = [int(run[i + 2 : i + 6], 16) for i in range(0, len(run), 6)]
    try:
        new = b"".join(u.to_bytes(2, "big") for u in units).decode("utf-16-be")
    except UnicodeDecodeError:
        return None
    return new, [12 if ord(c) > 0xFFFF else 6 for c in new]


def _expand(data: bytes, most: int) -> bytes | None:
    """Decompressed data, None if it is not compressed; MemoryError beyond ``most`` bytes."""
    try:
        if data[:4] == b"\x28\xb5\x2f\xfd":
            with zstandard.ZstdDecompressor(max_window_size=1 << 27).stream_reader(data) as f:
                out = f.read(most + 1)
        elif data[:2] == b"\x1f\x8b" or data[:1] == b"\x78" and len(data) > 1 and int.from_bytes(data[:2], "big") % 31 == 0:
            d = zlib.decompressobj(47)
            out = d.decompress(data, most + 1)
            if not d.eof and len(out) <= most:
                return None
        elif data[:3] == b"BZh":
            out = bz2.BZ2Decompressor().decompress(data, most + 1)
        else:
            return None
    except (zlib.error, OSError, EOFError, ValueError, zstandard.ZstdError):
        return None
    if len(out) > most:
        raise MemoryError
    return out


def _as_text(data: bytes) -> str | None:
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    odd = sum(1 for c in text if c < " " and c not in "\t\n\r\f")
    return text if text and 20 * odd <= len(text) else None


def _base64_layers(text: str, most: int) -> Iterator[tuple[str, np.ndarray, np.ndarray] | None]:
    """A layer for each base64 run that holds text; None for one refused for its size."""
    for m in _BASE64.finditer(text):
        run = m[0].rstrip("=").translate(_URLSAFE)
        if len(run) % 4 == 1:
            continue
        try:
            data = base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
        except (binascii.Error, ValueError):
            continue
        packed = False
        try:
            while (more := _expand(data, most)) is not None:
                if more == data:
                    break
                data, packed = more, True
                most -= len(data)
        except MemoryError:
            yield None
            continue
        if (new := _as_text(data)) is None:
            continue
        if packed:
            yield new, np.full(len(new), m.start()), np.full(len(new), m.end())
            continue
        sizes = np.array([len(c.encode()) for c in new]) if not new.isascii() else np.ones(len(new), np.int64)
        ends = np.cumsum(sizes)
        lo, hi = (ends - sizes) * 4 // 3, np.minimum(-(-ends * 4 // 3), len(run))
        yield new, m.start() + lo, m.start() + hi


def find_secrets(text: str | None, most_chars: int = MOST_CHARS) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]], int, int]:
    """(base spans, all spans, layers beyond the document, layers refused), spans by start, kind, end."""
    if not text:
        return [], [], 0, 0
    order = {k: i for i, k in enumerate(KINDS)}
    rank = lambda s: (s[0], order[s[1]], s[2])
    base = sorted(scan(text), key=rank)
    spans, seen, budget, layers, refused = set(base), set(), most_chars, 0, 0
    work: list[tuple[str, np.ndarray | None, np.ndarray | None]] = [(text, None, None)]
    while work:
        layer, lo, hi = work.pop()
        found: list = []
        if "%" in layer:
            found.append(_replaced(layer, _PERCENT, _percent))
        if "\\" in layer or "&#" in layer:
            found.append(_replaced(layer, _ESCAPE, _escape))
        for got in _base64_layers(layer, budget):
            if got is None:
                refused += 1
            else:
                found.append(got)
        for got in found:
            if got is None:
                continue
            new, a, b = got
            if lo is not None:
                a, b = (lo[np.minimum(a, len(lo) - 1)], hi[np.maximum(b, 1) - 1])
            key = hashlib.blake2b(new.encode("utf-8", "surrogatepass") + b"\0%d:%d" % (int(a.min(initial=0)), int(b.max(initial=0))), digest_size=16).digest()
            if key in seen:
                continue
            seen.add(key)
            if len(new) > budget:
                refused += 1
                continue
            budget -= len(new)
            layers += 1
            spans.update((int(a[s]), kind, int(b[e - 1])) for s, kind, e in scan(new))
            work.append((new, a, b))
    return base, sorted(spans, key=rank), layers, refused


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_chars: int = MOST_CHARS) -> DataFrame:
    """One row per input row: counts of base findings by kind, base and all spans, layers and refusals."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [find_secrets(t, most_chars) for t in part.column(1).to_pylist()]
            counts = [pa.array([sum(s[1] == k for s in base) for base, *_ in found], pa.int64()) for k in KINDS]
            texts = [pa.array([joined(f[i]) for f in found], pa.string()) for i in (0, 1)]
            more = [pa.array([f[i] for f in found], pa.int64()) for i in (2, 3)]
            yield pa.RecordBatch.from_arrays([part.column(0), *counts, *texts, *more], ["id", "n_assign", "n_access", "n_hex", "base_spans", "spans", "n_layers", "n_refused"])

    schema = f"id {kind}, n_assign long, n_access long, n_hex long, base_spans string, spans string, n_layers long, n_refused long"
    return arrow_map(docs.select(id_col, text_col), run, schema).withColumnRenamed("id", id_col)
