"""Operator 4, MinHash near-dedup by odd sketches.

MinHash samples of each distinct token sequence are cut into bands (candidate buckets) and folded
into a parity bitmap, the odd sketch: sample i with value m flips bit hash(i, m). The XOR of two
sketches holds the parity of the samples in which they differ, and its population count estimates a
high Jaccard similarity closely. The estimate only refuses pairs far below the threshold; every link
is confirmed on the full shingle sets.

Defined results. Null, empty or wordless text: n_shingles 0, linked with nothing. Fewer words than a
shingle: the whole sequence is the one shingle. Equal token sequences, repeated rows included, are
one class before any comparison; each input row gives one output row. Rows that share a doc_id but not a
text are documents of their own: neither takes the other's component. A row with a null doc_id has a null
component, is kept and is linked with nothing. An empty table gives an empty result. Extra columns are
ignored by ``near_dedup`` and carried along, whatever their names, by ``drop_near_duplicates``.

With 40 bands of 6 samples a pair at similarity 0.8 is missed with probability 5e-6, at 0.9 with
3e-14; a pair at 0.3 is a candidate with probability 0.03.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from docloom.llm.common import Staged, arrow_map, bounded, slices, utf8_list, words_of
from docloom.llm.components import Side, link_components

BANDS, ROWS, SKETCH_BITS = 40, 6, 512
#: XOR bits beyond which a pair is refused unseen: the mean at similarity 0.55, five deviations above that at 0.8.
FAR_BITS = 146
LONGS = SKETCH_BITS // 64

_RNG = np.random.Generator(np.random.PCG64(20240229))
_A = _RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_P = _RNG.integers(0, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (Stafford's variant 13)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class WordHash:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, most: int = 1 << 18):
        self.known, self.most = _Hashes(), most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word shingles of a document given its word hashes; the whole if it is shorter."""
    n = len(h)
    k = min(k, n)
    total = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        total += h[j : n - k + 1 + j] * _P[j]
    return mix(total + np.uint64(k))


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes and odd sketch (both int64) of a set of shingle hashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        part = x[at : at + 4096]
        np.minimum(least, (_A[:, None] * part[None, :] + _B[:, None]).min(axis=1), out=least)
    bands = np.zeros(BANDS, np.uint64)
    by_band = least.reshape(BANDS, ROWS).astype(np.uint64)
    for r in range(ROWS):
        bands = mix(bands * _P[0] + by_band[:, r] + np.uint64(r + 1))
    bands = mix(bands + np.arange(BANDS, dtype=np.uint64) * _P[1])
    spot = mix(least.astype(np.uint64) * _P[2] + np.arange(BANDS * ROWS, dtype=np.uint64) * _P[3]) % np.uint64(SKETCH_BITS)
    parity = (np.bincount(spot.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return bands.view(np.int64), np.packbits(parity).view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, row, h1, h2, n, bands, s0..s7): row is a hash of the text, h1 and h2 128 bits of the token sequence, null without words."""
    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, row long, h1 long, h2 long, n long, bands array<long>, " + ", ".join(f"s{i} long" for i in range(LONGS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHash()
        for part in slices(batches):
            h1, h2, ns, bands, sketch = [], [], [], [], []
            for text in utf8_list(part.column(1)):
                words = words_of(text.lower() if text else None)
                if not words:
                    h1.append(None), h2.append(None), ns.append(0), bands.append(None), sketch.append([None] * LONGS)
                    continue
                seen = xxhash.xxh3_128_intdigest(b" ".join(words))
                own = np.unique(shingle_hashes(hashed(words), k))
                b, s = signature(own)
                h1.append((seen >> 64) - 2**63), h2.append((seen & (2**64 - 1)) - 2**63)
                ns.append(len(own)), bands.append(b), sketch.append(s.tolist())
            columns = [part.column(0), part.column(2), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(ns, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            columns += [pa.array([s[i] for s in sketch], pa.int64()) for i in range(LONGS)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "row", "h1", "h2", "n", "bands", *[f"s{i}" for i in range(LONGS)]])

    return arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("row")), run, schema)


def shingle_set(text: bytes, k: int) -> set:
    w = words_of(text.lower())
    return set(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else {tuple(w)} if w else set()


def confirm_sets(k: int, percent: int):
    """Keeps the pairs whose full shingle sets overlap enough: 100 * shared >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, set()
        for part in slices(batches, 128):
            keep = []
            for a, b in zip(utf8_list(part.column("text_a")), utf8_list(part.column("text_b")), strict=True):
                if a != last:
                    last, kept = a, shingle_set(a, k)
                other = shingle_set(b, k)
                lo, hi = sorted((len(kept), len(other)))
                both = len(kept & other) if lo and 100 * lo >= percent * hi else 0
                keep.append(bool(both) and 100 * both >= percent * (len(kept) + len(other) - both))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def confirm(pairs: DataFrame) -> DataFrame:
        kind = dict(pairs.dtypes)["a"]
        return arrow_map(pairs.select("a", "b", "text_a", "text_b"), run, f"a {kind}, b {kind}")

    return confirm


def block_sets(k: int, percent: int):
    """The links between the shingle sets of a block's two sides: counts of common shingles by matrix products."""

    def links(blocks: list[tuple[Side, Side, int]]) -> Iterator[tuple[int, int, int]]:
        for n, (a, b, _) in enumerate(blocks):
            yield from ((n, i, j) for i, j in one(a, b))

    def one(a: Side, b: Side) -> Iterator[tuple[int, int]]:
        (left, of_left, *_), (right, of_right, *_) = a, b
        sets = [[shingle_set(t, k) for t in side] for side in (left, right)]
        number = {s: i for i, s in enumerate(set().union(*sets[0]) & set().union(*sets[1]))}
        sizes = [np.array([len(s) for s in side]) for side in sets]
        both = np.zeros((len(left), len(right)), np.float32)
        at = [[np.array([number[x] for x in s if x in number], np.int64) for s in side] for side in sets]
        for lo in range(0, len(number), 2048):
            held = [np.zeros((len(side), 2048), np.float32) for side in at]
            for part, side in zip(held, at, strict=True):
                for i, own in enumerate(side):
                    part[i, own[(own >= lo) & (own < lo + 2048)] - lo] = 1
            both += held[0] @ held[1].T
        both = both.astype(np.int64)
        close = 100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both)
        close &= (both > 0) & (np.array(of_left)[:, None] != np.array(of_right)[None, :])
        yield from zip(*(x.tolist() for x in np.nonzero(close)), strict=True)

    return links


def near_by_sketch(percent: int, far_bits: int):
    def near(a: str, b: str) -> F.Column:
        bits = F.bit_count(F.col(f"{a}s0").bitwiseXOR(F.col(f"{b}s0")))
        for i in range(1, LONGS):
            bits = bits + F.bit_count(F.col(f"{a}s{i}").bitwiseXOR(F.col(f"{b}s{i}")))
        lo, hi = F.least(f"{a}weight", f"{b}weight"), F.greatest(f"{a}weight", f"{b}weight")
        return (100 * lo >= percent * hi) & (bits <= far_bits)

    return near


def _components(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, percent: int) -> DataFrame:
    """(id, row, n, component) of every row: the component is the least id of those linked with the row's text."""
    seen = Staged(signatures(docs, id_col, text_col, shingle_words), "signatures").df
    sketch = [f"s{i}" for i in range(LONGS)]
    first = F.min(F.struct("id", "row")).alias("first")
    classes = Staged(seen.where("h1 IS NOT NULL AND id IS NOT NULL").groupBy("h1", "h2").agg(first, *[F.first(c).alias(c) for c in ("n", "bands", *sketch)]), "classes").df
    node = F.struct("h1", "h2")
    nodes = classes.select(node.alias("id"), F.col("h1").alias("half"), F.col("n").alias("weight"), *sketch)

    def texts(ids: DataFrame) -> DataFrame:
        """Of each class the text of its first row."""
        asked = classes.select(node.alias("id"), F.col("first.id").alias("of"), F.col("first.row").alias("row")).join(ids, "id", "left_semi").withColumnRenamed("id", "class")
        own = docs.select(F.col(id_col).alias("of"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
        return own.join(bounded(asked), ["of", "row"]).groupBy(F.col("class").alias("id")).agg(F.first("text").alias("text"))

    buckets = classes.select(F.explode("bands").alias("key"), F.col("h1").alias("half"))
    labels = link_components(buckets, nodes, near_by_sketch(percent, FAR_BITS), texts, confirm_sets(shingle_words, percent), block_sets(shingle_words, percent))
    named = classes.select("h1", "h2", node.alias("class"), F.col("first.id").alias("rep")).join(labels.select(F.col("id").alias("class"), F.col("component").alias("root")), "class")
    least = named.groupBy("root").agg(F.min("rep").alias("component"))
    linked = named.join(least, "root").select("h1", "h2", "component")
    alone = classes.select("h1", "h2", F.col("first.id").alias("rep")).join(linked, ["h1", "h2"], "left").select("h1", "h2", F.coalesce("component", "rep").alias("component"))
    return seen.select("id", "row", "n", "h1", "h2").join(alone, ["h1", "h2"], "left").select("id", "row", "n", F.expr("CASE WHEN id IS NOT NULL THEN coalesce(component, id) END").alias("component"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept (doc_id = component_id)."""
    found = _components(docs, id_col, text_col, shingle_words, percent)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, percent: int = 80) -> DataFrame:
    """``docs`` without the rows whose component has a smaller id. Rows with a null id stay."""
    gone = _components(docs, id_col, text_col, shingle_words, percent).where("id <> component").select(F.col("id").alias("gone_id"), F.col("row").alias("gone_row")).distinct()
    return docs.join(gone, (docs[id_col] == gone["gone_id"]) & (F.xxhash64(docs[text_col]) == gone["gone_row"]), "left_anti")
