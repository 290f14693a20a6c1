"""Operator 10, fuzzy line dedup.

Lines (parts between \\n) are normalised: lower case, digits to 0, ASCII signs and
controls dropped, white space folded. Equal normalised lines are one class. A 128-bit SimHash of a
class's words is cut into four 32-bit blocks: two SimHashes that differ in at most three bits agree
in a block, so joining on blocks finds all such pairs. They are links if their edit similarity, 1 -
Levenshtein distance / longer length, is ``percent`` or more. Of each connected group of links the
first occurrence, by doc_id and line number, is kept and every other line is removed.

With ``bits`` None, as in the query and the pipeline, no SimHash stands before the edit check, since lines
that differ in a word are seldom within three bits (README has figures). Candidates then share a MinHash band
of byte shingles, met in the same part of lines whose lengths are in the same range, and two of 16 samples;
the borders of parts and ranges move with the band. Without the parts, lines that only share common syllables
would fill the buckets, and their pairs grow with the square of the input. Edit similarity alone makes the link.

Lines of fewer than ``min_words`` normalised words are never removed. With ``min_words`` 0, as in the
query and the pipeline, all lines but blank ones take part: those of five words or, as scripts without
blanks need, 20 characters are compared as above, shorter ones are removed only if an equal normalised
line came before. A line of signs alone is compared as it is written, without white space around it.

Defined results. Null text: no line, kept text null. Empty text: one empty line, kept. A repeated row's
lines have the same doc_id and line numbers as its twin's; they are one occurrence, so the row gets the
same result. Rows that share a doc_id but not a text are documents of their own; of equal lines in the
same place of both, one is kept. Lines of rows with a null doc_id are never removed and remove none. Extra
columns are ignored by ``line_dedup`` and carried along, whatever their names, by ``dedup_lines``.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from docloom.llm.common import arrow_map, bounded, slices, stage
from docloom.llm.components import Groups, Side, link_components
from docloom.llm.op4_minhash import WordHash, mix

MIN_WORDS, PERCENT, BITS = 5, 80, 3
#: Samples of a MinHash band, those of two lines that must agree, and the bands that these are of.
SAMPLES, AGREE, SKETCHED = 2, 2, 8
#: Bytes of shingles, bands, and parts of a line in which a sample is met, in length ranges that begin below SHORT bytes, and in longer ones.
SHORT, SHORT_BANDS, LONG_BANDS = 48, (6, 24, 6), (12, 13, 8)
#: Bytes of the shingles of short lines whose samples must agree.
SKETCH_SHINGLE = 5
#: Bits of a sample that tell its place in the line, below those of its hash.
PLACE_BITS = 10
#: Blocks of 64 letters of the lines that are compared together, and the most entries of their table of letters.
BLOCKS, MOST_TABLE = 6144, 4_000_000
#: Characters of the grams that two lines are first compared by, and the most places of a line's table of them.
GRAM, GRAM_PLACES = 2, 1024
#: Shorter lines, of fewer words than MIN_WORDS, are only compared for equality.
LEAST_CHARS = 20

_RNG = np.random.Generator(np.random.PCG64(20240310))
_A = (_RNG.integers(0, 2**32, (max(SHORT_BANDS[1], LONG_BANDS[1]), SAMPLES), dtype=np.uint32) | np.uint32(1)) << np.uint32(PLACE_BITS)
_BORDERS = _RNG.integers(0, 2**PLACE_BITS, _A.shape, dtype=np.uint32)
_P = _RNG.integers(0, 2**63, 6, dtype=np.uint64) | np.uint64(1)
#: A base of polynomial hashes and its inverse.
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)

#: On UTF-8 bytes of lower-cased text: digits to 0; ASCII signs and controls but white space go.
_DIGITS = bytes(48 if 48 <= b <= 57 else b for b in range(256))
_DROP = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122 or b in b"\t\n\x0b\x0c\r "))


def normal_lines(text: str) -> list[list[bytes]]:
    """The words of each normalised line."""
    return [line.split() for line in text.lower().encode().translate(_DIGITS, _DROP).split(b"\n")]


def normal(line: str) -> str:
    return b" ".join(normal_lines(line)[0]).decode()


def simhashes(of: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """128-bit SimHashes as four 32-bit blocks (int64) of n lines; of: each word's line, ascending, none without words."""
    first = np.searchsorted(of, np.arange(n))
    half = mix(hashes + np.uint64(0x9E3779B97F4A7C15))
    out = np.empty((n, 4), np.int64)
    for side, h in enumerate((hashes, half)):
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        sizes = np.diff(np.append(first, len(of)))
        word = np.packbits(2 * ones > sizes[:, None], axis=1)
        out[:, 2 * side : 2 * side + 2] = word.view(">u4").astype(np.int64)
    return out


def block_keys(blocks: np.ndarray) -> np.ndarray:
    """The pigeonhole keys of SimHashes (line, block): each block with its place."""
    return mix(blocks.view(np.uint64) + np.arange(blocks.shape[1], dtype=np.uint64) * _P[0]).view(np.int64)


_KNOWN: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers; those once computed are kept."""
    if base not in _KNOWN or len(_KNOWN[base]) < n:
        out = np.full(max(n, 1 << 18), base, np.uint64)
        out[0] = 1
        _KNOWN[base] = np.multiply.accumulate(out)
    return _KNOWN[base][:n]


def shingles(x: np.ndarray, sizes: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the q-byte shingles of lines that lie one after another in ``x``, and each line's first; lines have q bytes or more."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + _P[1]) * _powers(_BASE, len(x)))))
    h = ((sums[q:] - sums[:-q]) * _powers(_BACK, len(x) - q + 1)) * _P[2]
    inside = np.ones(len(h), bool)
    ends = np.cumsum(sizes)[:-1]
    inside[(ends[:, None] - np.arange(1, q)[None, :]).reshape(-1)] = False
    return (h[inside] >> np.uint64(32)).astype(np.uint32), np.concatenate(([0], np.cumsum(sizes - q + 1)[:-1]))


class _Sampler:
    """MinHash samples of lines: the least hash of their q-byte shingles and, in its lowest PLACE_BITS, where it is first met."""

    def __init__(self, lines: list[bytes], q: int):
        sizes = np.maximum([len(x) for x in lines], q)
        self.x, self.first = shingles(np.frombuffer(b"".join([x.ljust(q) for x in lines]), np.uint8), sizes, q)
        n = sizes - q + 1
        self.place = (((np.arange(len(self.x)) - np.repeat(self.first, n)) << PLACE_BITS) // np.repeat(n, n)).astype(np.uint32)
        self.work = np.empty_like(self.x)

    def least(self, k: int, r: int) -> np.ndarray:
        np.multiply(self.x, _A[k, r], out=self.work)
        np.bitwise_or(self.work, self.place, out=self.work)
        return np.minimum.reduceat(self.work, self.first)


def _low_byte(least: np.ndarray) -> np.ndarray:
    """The lowest byte of samples' hashes."""
    return (least >> np.uint32(PLACE_BITS)).astype(np.uint8)


def bands(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (line, band) and sketches (line, 2) of 16 samples' low bytes; both int64. In place of a key that a line lacks is its last before, or its first."""
    log = np.log2(np.maximum([len(x) for x in lines], 1))
    bytes_ = np.empty((len(lines), SKETCHED, SAMPLES), np.uint8)
    all_keys, all_here = [], []
    for is_short, (q, n, parts) in ((True, SHORT_BANDS), (False, LONG_BANDS)):
        shift = np.arange(n)[None, :] / n
        span = np.floor(log[:, None] + shift)
        here = (2 ** (span - shift) < SHORT) == is_short
        keys = np.zeros((len(lines), n), np.int64)
        all_keys.append(keys), all_here.append(here)
        own = np.flatnonzero(here.any(axis=1))
        sampler = _Sampler([lines[i] for i in own], q) if len(own) else None
        for k in range(n if len(own) else 0):
            key = mix(span[own, k].astype(np.int64).view(np.uint64) * _P[3] + np.uint64((2 * k + is_short) * int(_P[4]) % 2**64))
            for r in range(SAMPLES):
                least = sampler.least(k, r)
                part = ((least & np.uint32(2**PLACE_BITS - 1)) * np.uint32(parts) + _BORDERS[k, r]) >> np.uint32(PLACE_BITS)
                key = mix(key * _P[5] + ((least >> np.uint32(PLACE_BITS)).astype(np.uint64) << np.uint64(8) | part))
                if k < SKETCHED and not is_short:
                    bytes_[own, k, r] = _low_byte(least)
            keys[own, k] = key.view(np.int64)
    short = ~all_here[1][:, :SKETCHED]
    if len(own := np.flatnonzero(short.any(axis=1))):
        sampler = _Sampler([lines[i] for i in own], SKETCH_SHINGLE)
        for k in range(SKETCHED):
            for r in range(SAMPLES):
                bytes_[own[short[own, k]], k, r] = _low_byte(sampler.least(k, r))[short[own, k]]
    keys, here = np.concatenate(all_keys, axis=1), np.concatenate(all_here, axis=1)
    last = np.maximum.accumulate(np.where(here, np.arange(here.shape[1]), -1), axis=1)
    keys = np.take_along_axis(keys, np.where(last < 0, here.argmax(axis=1)[:, None], last), axis=1)
    return keys, bytes_.reshape(len(lines), SAMPLES * SKETCHED).view(np.int64)


def line_table(docs: DataFrame, min_words: int, bits: int | None) -> DataFrame:
    """(c1, c2, id, row, line, size, keys, s0..): of each line of (id, row, text) long enough its class (128
    bits of the normalised line), characters, and, unless it is only compared for equality, bucket keys and sketch."""
    kind = dict(docs.dtypes)["id"]
    longs = 2 if bits is None else 4
    names = ["c1", "c2", "id", "row", "line", "size", "keys", *(f"s{i}" for i in range(longs))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHash()
        for part in slices(batches, 128):
            digests, of, at, lines, words = [], [], [], [], []
            for i, text in enumerate(part.column(2).to_pylist()):
                raw = text.split("\n") if text and min_words <= 0 else ()
                for j, own in enumerate(normal_lines(text) if text else ()):
                    signs = raw[j].strip().encode("utf-8", "replace") if raw and not own else b""
                    if not (own or signs) or len(own) < min_words:
                        continue
                    lines.append(b" ".join(own) if own else b"\0" + signs)
                    words.append(own)
                    digests.append(xxhash.xxh3_128_digest(lines[-1])), of.append(i), at.append(j)
            if not of:
                continue
            sizes = [len(x) if x.isascii() else len(x.decode()) for x in lines]
            full = [i for i, (n, own) in enumerate(zip(sizes, words, strict=True)) if own and (n >= LEAST_CHARS or len(own) >= MIN_WORDS)]
            keys, sketch = np.empty((0, 1), np.int64), np.zeros((len(lines), longs), np.int64)
            if full and bits is None:
                keys, sketch[full] = bands([lines[i] for i in full])
            elif full:
                counts = [len(words[i]) for i in full]
                sketch[full] = simhashes(np.repeat(np.arange(len(full)), counts), hashed([w for i in full for w in words[i]]), len(full))
                keys = block_keys(sketch[full])
            # A key equal to the one before stands for none.
            new = np.ones(keys.shape, bool)
            new[:, 1:] = keys[:, 1:] != keys[:, :-1]
            has = np.zeros(len(lines), np.int32)
            has[full] = new.sum(axis=1)
            offsets = pa.array(np.concatenate(([0], np.cumsum(has))), pa.int32())
            rows = pa.array(of)
            c1, c2 = (np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).T.astype(np.uint64) - np.uint64(2**63)).view(np.int64)
            columns = [pa.array(c1), pa.array(c2), part.column(0).take(rows), part.column(1).take(rows), pa.array(at, pa.int32()), pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, pa.array(keys[new])), *(pa.array(np.ascontiguousarray(c)) for c in sketch.T)], names)

    return arrow_map(docs.select("id", "row", "text"), run, f"c1 long, c2 long, id {kind}, row long, line int, size int, keys array<long>, " + ", ".join(f"s{i} long" for i in range(longs)))


def line_texts(places: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, text): the normalised line of each class, from its first occurrence ``(id, of, row, line)``."""
    asked = places.groupBy("of", "row").agg(F.collect_list(F.struct("id", "line")).alias("asked"))
    met = docs.select(F.col("id").alias("of"), "row", "text").join(bounded(asked), ["of", "row"]).select("asked", "text")
    kind = dict(places.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            ids, out = [], []
            for asked, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                lines = text.split("\n") if text else []
                for x in asked:
                    if x["line"] < len(lines):
                        ids.append(x["id"]), out.append(normal(lines[x["line"]]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, part.column(0).type.value_type.field("id").type), pa.array(out, pa.string())], ["id", "text"])

    return arrow_map(met, run, f"id {kind}, text string").groupBy("id").agg(F.first("text").alias("text"))


def edit_distance(a: str, b: str) -> int:
    """Levenshtein's distance, a column of the table at a time in the bits of integers (Myers 1999)."""
    if not a:
        return len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    whole = (1 << len(a)) - 1
    last, up, down, out = 1 << len(a) - 1, whole, 0, len(a)
    for c in b:
        same = where.get(c, 0)
        level = (((same & up) + up) ^ up) | same | down
        plus, minus = down | (whole & ~(level | up)), up & level
        out += bool(plus & last) - bool(minus & last)
        plus, minus = (plus << 1 | 1) & whole, minus << 1 & whole
        up, down = minus | (whole & ~(level | plus)), plus & level
    return out


def word_distance(a: str, b: str, most: int) -> int:
    """The cost of changing ``a`` into ``b`` by whole words met one after another: the edit distance or more; ends beyond ``most``."""
    x, y = a.split(" "), b.split(" ")
    i = j = cost = 0
    while i < len(x) and j < len(y) and cost <= most:
        if x[i] == y[j]:
            i, j = i + 1, j + 1
        elif x[i + 1 : i + 2] == y[j : j + 1]:
            cost += len(x[i]) + 1
            i += 1
        elif y[j + 1 : j + 2] == x[i : i + 1]:
            cost += len(y[j]) + 1
            j += 1
        else:
            cost += max(len(x[i]), len(y[j]))
            i, j = i + 1, j + 1
    if cost > most:
        return cost
    return cost + sum(len(w) + 1 for w in x[i:]) + sum(len(w) + 1 for w in y[j:])


def _distances(a: list[str], b: list[str], most: list[int] | None = None) -> np.ndarray:
    """Levenshtein's distance of each pair, none empty; of a pair beyond ``most`` some number greater than that.

    Myers (1999) in blocks of 64 rows of all pairs' tables. A step takes every block a column further; a block is a column
    behind the one above, whose lower border it needs. Blocks that no path of ``most`` edits meets are left out, with borders
    that rise by one for each letter in their place (Hyyrö 2003), and so are pairs once every path is beyond ``most``. Both
    lines of a pair begin with as many equal letters as the first is short of whole blocks.
    """
    n = len(a)
    sizes = [np.array([len(x) for x in side]) for side in (a, b)]
    limit = np.maximum(*sizes) if most is None else np.array(most)
    high = -(-int(sizes[0].max()) // 64)
    before = 64 * high - sizes[0]
    ends = sizes[1] + before
    points = np.frombuffer("".join((*a, *b)).encode("utf-32-le"), np.uint32)
    letters = np.flatnonzero(np.bincount(points))
    code = np.zeros(letters[-1] + 1, np.int64)
    code[letters] = np.arange(1, len(letters) + 1)
    table = []
    for length, own in zip(sizes, np.split(code[points], [sizes[0].sum()]), strict=True):
        place = np.arange((length + before).max())
        full = np.zeros((n, len(place)), np.int64)
        full[(place >= before[:, None]) & (place < (length + before)[:, None])] = own
        table.append(full.T)
    rows, other = table[0], np.ascontiguousarray(table[1][::-1])
    same = np.zeros((len(letters) + 1, high, n), np.uint64)
    block, each = np.arange(high)[:, None], np.arange(n)
    for bit in range(64):
        same[rows[bit::64], block, each] |= np.uint64(1 << bit)
    one, top = np.uint64(1), np.uint64(63)
    up, down = np.full((high, n), 2**64 - 1, np.uint64), np.zeros((high, n), np.uint64)
    rise, fall = np.ones((high + 1, n), np.uint64), np.zeros((high + 1, n), np.uint64)
    out, alive, bottom = limit + 1, each, np.zeros(n, np.int64)
    columns, reach, last, deep = len(other), int(limit.max()), 0, 0
    for step in range(columns + high - 1):
        lo = max(0, step - columns + 1, -((64 + reach - step) // 65))
        hi = min(high, step + 1, (step + 1 + reach) // 65 + 1)
        if lo >= hi:
            break
        if 0 < lo == last:
            rise[lo], fall[lo] = 1, 0
        if hi > deep:
            bottom = bottom + 64 - (rise[hi - 1] - fall[hi - 1]).view(np.int64) if step else bottom + 64
        last, deep = lo, hi
        at = other[columns - 1 - step + lo : columns - 1 - step + hi] * (high * n) + np.arange(lo * n, hi * n).reshape(-1, n)
        equal = same.reshape(-1)[at]
        was_up, was_down = up[lo:hi], down[lo:hi]
        across = equal | was_down
        equal |= fall[lo:hi]
        along = (((equal & was_up) + was_up) ^ was_up) | equal
        plus, minus = was_down | ~(along | was_up), was_up & along
        plus_out, minus_out = plus >> top, minus >> top
        plus, minus = plus << one | rise[lo:hi], minus << one | fall[lo:hi]
        up[lo:hi], down[lo:hi] = minus | ~(across | plus), plus & across
        rise[lo + 1 : hi + 1], fall[lo + 1 : hi + 1] = plus_out, minus_out
        bottom = bottom + (plus_out[-1] - minus_out[-1]).view(np.int64)
        column = step - hi + 2
        if hi == high and (done := ends == column).any():
            out[alive[done]] = bottom[done]
        if step % 64 == 63:
            ups = np.bitwise_count(up[lo:hi]).astype(np.int64)
            # What each block's lower border is below the next one's; the least number in a block is that less its rises.
            less = (ups - np.bitwise_count(down[lo:hi]) - (rise[lo:hi] - fall[lo:hi]).view(np.int64))[:0:-1]
            border = bottom - np.concatenate((np.zeros((1, n), np.int64), np.cumsum(less, axis=0)))
            stay = (border - ups[::-1]).min(axis=0) - 1 <= limit
            if hi == high:
                stay &= ends > column
            if 4 * stay.sum() <= 3 * n:
                if not stay.any():
                    break
                alive, limit, ends, bottom, n = alive[stay], limit[stay], ends[stay], bottom[stay], int(stay.sum())
                other, same, up, down, rise, fall = (np.ascontiguousarray(x[..., stay]) for x in (other, same, up, down, rise, fall))
    return out


def edits_within(a: list[str], b: list[str], most: list[int]) -> np.ndarray:
    """Whether each pair's edit distance is at most ``most``; pairs of like lengths are compared together."""
    out = np.zeros(len(a), bool)
    left = []
    for i, (x, y, n) in enumerate(zip(a, b, most, strict=True)):
        if abs(len(x) - len(y)) <= n:
            out[i] = word_distance(x, y, n) <= n
            if not out[i]:
                left.append(i)
    left.sort(key=lambda i: (len(a[i]), len(b[i])))
    at = 0
    while at < len(left):
        words = len(a[left[at]]) // 64 + 1
        words += words // 8
        end = bisect.bisect_right(left, 64 * words, at, min(len(left), at + max(1, BLOCKS // words)), key=lambda i: len(a[i]))
        own = left[at:end]
        letters = len(set().union(*(x[i] for i in own for x in (a, b)))) + 1
        own = own[: max(1, MOST_TABLE // (letters * words))]
        at += len(own)
        first, second, limit = ([x[i] for i in own] for x in (a, b, most))
        if len(own) * (44 + words) > 800 and letters * words * len(own) <= MOST_TABLE and first[0] and all(second):
            out[own] = _distances(first, second, limit) <= np.array(limit)
        else:
            out[own] = [edit_distance(x, y) <= n for x, y, n in zip(first, second, limit, strict=True)]
    return out


def gram_table(lines: list[str], places: int) -> np.ndarray:
    """(line, place): how many of the line's grams are hashed to the place."""
    x = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
    of = np.repeat(np.arange(len(lines)), np.array([len(line) for line in lines], np.int64))
    n = max(0, len(x) - GRAM + 1)
    h = np.zeros(n, np.uint32)
    for i in range(GRAM):
        h = (h + x[i : i + n]) * np.uint32(0x9E3779B1)
    inside = of[:n] == of[GRAM - 1 :]
    spots = of[:n][inside] * places + ((h[inside] >> np.uint32(7)) & np.uint32(places - 1)).astype(np.int64)
    return np.minimum(np.bincount(spots, minlength=len(lines) * places), 2**16 - 1).astype(np.uint16).reshape(len(lines), places)


def gram_places(longest: int) -> int:
    """Places of the tables of lines that are compared with each other: a power of 2."""
    return min(GRAM_PLACES, 1 << (4 * longest).bit_length())


def may_be_within(common: np.ndarray, longer: np.ndarray, most: np.ndarray) -> np.ndarray:
    """An edit changes at most GRAM grams, so the rest of the longer line's are in both lines of a pair within ``most`` edits.

    ``common``, from tables of hashes, is their number or more; lines that could exceed the tables' numbers always pass.
    """
    return (common >= longer - GRAM + 1 - GRAM * most) | (longer >= 2**16)


def similar(a: list[str], b: list[str], percent: int) -> list[bool]:
    """Whether the edit similarity of each pair, 1 - distance / longer length, is ``percent`` or more."""
    most = [max(len(x), len(y)) * (100 - percent) // 100 for x, y in zip(a, b, strict=True)]
    return edits_within(a, b, most).tolist()


def block_lines(percent: int, bits: int | None):
    """The links between the lines of a block's two sides, as few as join its components."""

    def links(blocks: list[tuple[Side, Side, int]]) -> Iterator[tuple[int, int, int]]:
        groups = Groups()
        held: list[tuple] = []

        def decided() -> Iterator[tuple[int, int, int]]:
            apart = [x for x in held if groups.root(x[3]) != groups.root(x[4])]
            held.clear()
            good = edits_within(*([x[c] for x in apart] for c in (5, 6, 7)))
            for (n, i, j, of_i, of_j, *_), same in zip(apart, good.tolist(), strict=True):
                if same and groups.merge(of_i, of_j):
                    yield n, i, j

        for n, ((a, of_a, near, met_a), (b, of_b, far, met_b), key) in enumerate(blocks):
            a, b = [x.decode() for x in a], [x.decode() for x in b]
            sizes = np.array([len(x) for x in b])
            places = gram_places(max(map(len, (*a, *b))))
            grams_a, grams_b = gram_table(a, places), gram_table(b, places)
            for i, line in enumerate(a):
                apart = near[i] ^ far
                fits = np.bitwise_count(apart).sum(axis=1) <= bits if bits is not None else (apart.view(np.uint8) != 0).sum(axis=1) <= SAMPLES * SKETCHED - AGREE
                most = np.maximum(len(line), sizes) * (100 - percent) // 100
                fits &= np.abs(len(line) - sizes) <= most
                ids = np.flatnonzero(fits)
                common = np.minimum(grams_a[i], grams_b[ids]).sum(axis=1, dtype=np.int64)
                for j in ids[may_be_within(common, np.maximum(len(line), sizes[ids]), most[ids])].tolist():
                    if groups.root(of_a[i]) != groups.root(of_b[j]) and min(met_a[i] & met_b[j]) == key:
                        held.append((n, i, j, of_a[i], of_b[j], line, b[j], int(most[j])))
                if len(held) >= 16384:
                    yield from decided()
        yield from decided()

    return links


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT, bits: int | None = BITS) -> DataFrame:
    """(id, row, lines): of each text (id, row, text) the numbers of the lines to remove; row tells the texts of an id apart."""
    if bits is not None and not 0 <= bits <= 3:
        raise ValueError("four blocks find pairs that differ in up to three bits")
    if bits is not None and min_words < 1:
        raise ValueError("a SimHash is one of words")
    docs = docs.where("id IS NOT NULL AND text IS NOT NULL")
    lines = stage(line_table(docs, min_words, bits), "lines")
    sketch = [c for c in lines.columns if c in ("s0", "s1", "s2", "s3")]
    classes = stage(lines.groupBy("c1", "c2").agg(F.min(F.struct("id", "line", "row")).alias("first"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("size", *sketch)]), "classes")
    node = F.struct("c1", "c2")
    nodes = classes.select(node.alias("id"), F.col("c1").alias("half"), F.col("size").alias("weight"), *sketch)

    def near(a: str, b: str) -> F.Column:
        a_size, b_size = F.col(f"{a}weight"), F.col(f"{b}weight")
        fits = F.abs(a_size - b_size) <= (F.greatest(a_size, b_size) * (100 - percent) / 100).cast("int")
        apart = [F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}")) for c in sketch]
        if bits is not None:
            return fits & (sum((F.bit_count(x) for x in apart[1:]), F.bit_count(apart[0])) <= bits)
        return fits & (_unequal_bytes(apart[0]) + _unequal_bytes(apart[1]) <= SAMPLES * SKETCHED - AGREE)

    def texts(ids: DataFrame) -> DataFrame:
        asked = classes.select(node.alias("id"), F.col("first.id").alias("of"), F.col("first.row").alias("row"), F.col("first.line").alias("line"))
        return line_texts(asked.join(ids, "id", "left_semi"), docs)

    buckets = lines.select(F.explode("keys").alias("key"), F.col("c1").alias("half"))
    labels = link_components(buckets, nodes, near, texts, _confirm(percent), block_lines(percent, bits), sketch)
    linked = labels.select(F.col("id.c1").alias("c1"), F.col("id.c2").alias("c2"), "component")
    grouped = classes.select("c1", "c2", "first", "n").join(linked, ["c1", "c2"], "left")
    heads = grouped.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("head"))
    kept = grouped.where("component IS NOT NULL").join(heads, "component").select("c1", "c2", "head").union(grouped.where("component IS NULL AND n > 1").select("c1", "c2", "first"))
    kept = stage(kept.select("c1", "c2", F.col("head.id").alias("head_id"), F.col("head.line").alias("head_line"), F.col("head.row").alias("head_row")), "kept")
    gone = lines.select("c1", "c2", "id", "row", "line").join(bounded(kept), ["c1", "c2"]).where("NOT (id = head_id AND line = head_line AND row = head_row)")
    return stage(gone.groupBy("id", "row").agg(F.collect_set("line").alias("lines")), "gone")


def _unequal_bytes(x: F.Column) -> F.Column:
    """How many of a long's bytes are not 0."""
    for n in (4, 2, 1):
        x = x.bitwiseOR(F.shiftrightunsigned(x, n))
    return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))


def _confirm(percent: int) -> Callable[[DataFrame], DataFrame]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 8192):
            keep = similar(part.column("text_a").to_pylist(), part.column("text_b").to_pylist(), percent)
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def confirm(pairs: DataFrame) -> DataFrame:
        kind = dict(pairs.dtypes)["a"]
        return arrow_map(pairs.select("a", "b", "text_a", "text_b"), run, f"a {kind}, b {kind}")

    return confirm


def _kept(docs: DataFrame, id_col: str, text_col: str, min_words: int, percent: int, bits: int | None) -> DataFrame:
    """(own, n_lines, n_removed, kept): own is the row of ``docs``, kept the text that is left."""
    own = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("own"), docs[id_col].alias("id"), docs[text_col].alias("text"))
    own = own.withColumn("row", F.xxhash64("text"))
    gone = removed_lines(own.select("id", "row", "text"), min_words, percent, bits).select(F.col("id").alias("gone_id"), F.col("row").alias("gone_row"), "lines")
    parts = F.split("text", "\n", -1)
    met = own.join(bounded(gone), (F.col("id") == F.col("gone_id")) & (F.col("row") == F.col("gone_row")), "left")
    # The split has one part more than there are breaks; positions not in the set stay.
    stay = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains("lines", i)), "\n")
    return met.select("own", F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"), F.when(F.col("lines").isNotNull(), stay).otherwise(F.col("text")).alias("kept"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, percent: int = PERCENT, bits: int | None = BITS) -> DataFrame:
    """One row per input row: id, n_lines, n_removed, kept_text."""
    met = _kept(docs.select(id_col, text_col), id_col, text_col, min_words, percent, bits)
    return met.select(F.col(f"own.{id_col}").alias(id_col), "n_lines", "n_removed", F.col("kept").alias("kept_text"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", min_words: int = MIN_WORDS, percent: int = PERCENT, bits: int | None = BITS) -> DataFrame:
    """``docs`` with repeated lines cut out of the text (and its length redone); those that lose all words go."""
    met = _kept(docs, id_col, text_col, min_words, percent, bits).where((F.col("n_removed") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))

    def column(c: str) -> F.Column:
        was = F.col(f"own.`{c}`")
        if c == text_col:
            return F.col("kept").alias(c)
        if c == chars_col:
            return F.when(F.col("n_removed") > 0, F.length("kept").cast(dict(docs.dtypes)[c])).otherwise(was).alias(c)
        return was.alias(c)

    return met.select(*[column(c) for c in docs.columns])
