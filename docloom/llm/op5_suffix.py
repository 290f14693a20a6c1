"""Operator 5, substring dedup by prefix-partitioned suffix trees.

A repeated window of ``window`` words holds the same least-hashed ``prefix``-word gram at the same
place, so only suffixes that start at such a gram (an anchor) and share it with another suffix can
belong to a repeat. Those suffixes are partitioned by their prefix. Groups that fit in memory become
a subtree each: it is walked one word at a time, and its nodes of the depth that a window reaches to
the right of the anchor, refined by the words to the left, are the repeats. Prefixes with more than
``group`` suffixes are lengthened to the whole window instead; these nodes only need their first
occurrence, which a map-side minimum and a join give, so no task holds all copies of a passage.
Every occurrence of a node but the first (least doc_id, then start) is a repeat. Texts whose whole word
sequence a smaller doc_id has are repeats throughout and take no part.

Defined results. Null, empty or wordless text: n_words 0, n_removed 0, the hash of the empty string.
Fewer words than a window: nothing is removed. A repeated row has the same doc_id and starts as its
twin; neither is earlier than the other, so each gets the result of one. A row with a null doc_id
counts as before all others; such rows share one id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from docloom.llm.common import arrow_map, slices, utf8_list, words_of
from docloom.llm.op4_minhash import WordHash, shingle_hashes

WINDOW, PREFIX, GROUP = 20, 8, 20_000


def anchors(h: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text's word hashes: gram hash and place of each anchor, first and last window start that it serves."""
    grams = shingle_hashes(h, prefix)
    span = window - prefix + 1
    # The top half of the hash with the place below it: the least is the left-most of equals.
    low = np.uint64(0xFFFFFFFF)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    starts = (least & low).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(np.diff(starts)) + 1))
    last = np.concatenate((first[1:] - 1, [len(starts) - 1]))
    at = starts[first]
    return grams[at].view(np.int64), at, first, last


def all_anchors(docs: DataFrame, window: int, prefix: int) -> DataFrame:
    """(gram, id, place) of each anchor of every text."""
    kind = dict(docs.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHash()
        for part in slices(batches):
            grams, at, of = [], [], []
            for i, text in enumerate(utf8_list(part.column(1))):
                words = words_of(text)
                if len(words) >= window:
                    g, a, _, _ = anchors(hashed(words), window, prefix)
                    grams.append(g), at.append(a), of.append(np.full(len(g), i))
            if grams:
                ids = part.column(0).take(pa.array(np.concatenate(of)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams)), ids, pa.array(np.concatenate(at).astype(np.int32))], ["gram", "id", "place"])

    return arrow_map(docs, run, f"gram long, id {kind}, place int")


def _wanted(batches: Iterator[pa.RecordBatch], window: int, prefix: int, hot: bool):
    """Of each text its id, words, and (gram, place, first, last) of the anchors asked for."""
    hashed = WordHash()
    for part in slices(batches, 64):
        rows = []
        for own, text, asked in zip(part.column("id").to_pylist(), utf8_list(part.column("text")), part.column("asked").to_pylist(), strict=True):
            words = words_of(text)
            wanted = {x["place"] for x in asked if x["hot"] == hot}
            if wanted and len(words) >= window:
                found = zip(*(x.tolist() for x in anchors(hashed(words), window, prefix)), strict=True)
                rows.append((own, words, [x for x in found if x[1] in wanted]))
        yield part.column("id").type, rows


def suffixes(met: DataFrame, window: int, prefix: int) -> DataFrame:
    """A row for each suffix whose prefix is shared: its words from its first window to its last."""
    kind = dict(met.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for id_type, texts in _wanted(batches, window, prefix, False):
            rows = [(g, own, lo, a - lo, hi - lo + 1, b" ".join(words[lo : hi + window])) for own, words, found in texts for g, a, lo, hi in found]
            if rows:
                kinds = [pa.int64(), id_type, pa.int32(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["gram", "id", "start", "anchor", "windows", "words"])

    return arrow_map(met, run, f"gram long, id {kind}, start int, anchor int, windows int, words binary")


def deep_nodes(met: DataFrame, window: int, prefix: int) -> DataFrame:
    """A row for each window at a prefix too frequent for one group, named by 128 bits of all its words."""
    kind = dict(met.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for id_type, texts in _wanted(batches, window, prefix, True):
            for own, words, found in texts:
                starts = [s for _, _, lo, hi in found for s in range(lo, hi + 1)]
                deep = [xxhash.xxh3_128_intdigest(b" ".join(words[s : s + window])) for s in starts]
                columns = [pa.array([(x >> 64) - 2**63 for x in deep], pa.int64()), pa.array([(x & (2**64 - 1)) - 2**63 for x in deep], pa.int64()), pa.array([own] * len(starts), id_type), pa.array(starts, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["h1", "h2", "id", "start"])

    return arrow_map(met, run, f"h1 long, h2 long, id {kind}, start int")


def repeats_in_group(rows: list[tuple], window: int, prefix: int) -> dict[int, list[int]]:
    """Row number -> starts of its windows that also start earlier.

    rows: (id, start, anchor offset, windows, words). Walks the subtree of the suffixes that begin with
    the common prefix, one word deeper at a time; a window that starts k words left of the anchor ends
    at depth window - k, where the node is refined by those k words.
    """
    found: dict[int, list[int]] = {}
    nodes = [list(range(len(rows)))]
    for depth in range(prefix, window + 1):
        left = window - depth
        for node in nodes:
            first: dict[tuple, tuple] = {}
            own: list[tuple[int, tuple, tuple]] = []
            for r in node:
                id_, start, anchor, windows, words = rows[r]
                at = anchor - left  # the window's first word, counted from the row's first
                if 0 <= at < windows:
                    key, place = tuple(words[at:anchor]), ((id_ is not None, *([id_] if id_ is not None else [])), start + at)
                    own.append((r, key, place))
                    if key not in first or place < first[key]:
                        first[key] = place
            for r, key, place in own:
                if place != first[key]:
                    found.setdefault(r, []).append(place[1])
        deeper: list[list[int]] = []
        for node in nodes:
            by: dict[bytes, list[int]] = {}
            for r in node:
                at = rows[r][2] + depth
                if at < len(rows[r][4]):
                    by.setdefault(rows[r][4][at], []).append(r)
            deeper += [x for x in by.values() if len(x) > 1]
        nodes = deeper
        if not nodes:
            break
    return found


def group_repeats(grouped: DataFrame, window: int, prefix: int) -> DataFrame:
    """(id, start, mask) of repeated windows, from suffixes dealt and sorted by prefix; bit k: start + k."""
    kind = dict(grouped.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None

        def out() -> Iterator[tuple]:
            if len(held) > 1:
                for r, starts in repeats_in_group(held, window, prefix).items():
                    id_, start = held[r][:2]
                    yield id_, start, sum(1 << (s - start) for s in starts)

        for part in slices(batches, 4096):
            done: list[tuple] = []
            columns = [part.column("gram").to_pylist(), part.column("id").to_pylist(), *(part.column(c).to_pylist() for c in ("start", "anchor", "windows")), utf8_list(part.column("words"))]
            for g, *row, words in zip(*columns, strict=True):
                if g != at:
                    done += out()
                    held, at = [], g
                held.append((*row, words.split()))
            if done:
                yield batch(done, part.column("id").type)
            id_type = part.column("id").type
        if rest := list(out()):
            yield batch(rest, id_type)

    def batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        ids, starts, masks = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(starts, pa.int32()), pa.array(masks, pa.int64())], ["id", "start", "mask"])

    return arrow_map(grouped, run, f"id {kind}, start int, mask long")


def repeated_windows(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """(id, start, mask) of the windows of (id, text) whose words also start earlier."""
    every = all_anchors(docs, window, prefix)
    sizes = every.groupBy("gram").count().where("count > 1")
    shared = every.join(sizes, "gram").select("id", F.struct("place", (F.col("count") > group).alias("hot")).alias("at"))
    by_doc = shared.groupBy("id").agg(F.collect_set("at").alias("asked"))
    met = docs.join(by_doc, docs["id"].eqNullSafe(by_doc["id"])).select(docs["id"], "text", "asked")
    grouped = suffixes(met, window, prefix).repartition("gram").sortWithinPartitions("gram")
    deep = deep_nodes(met.where(F.exists("asked", lambda x: x["hot"])), window, prefix)
    place = F.struct(F.col("id").isNotNull().alias("has"), "id", "start")
    first = deep.groupBy("h1", "h2").agg(F.min(place).alias("first"))
    later = deep.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first"))).select("id", "start", F.lit(1).cast("long").alias("mask"))
    return group_repeats(grouped, window, prefix).union(later)


def sequence_hashes(docs: DataFrame) -> DataFrame:
    """(id, h1, h2): 128 bits of each text's word sequence; texts without words or id are left out."""
    kind = dict(docs.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [xxhash.xxh3_128_intdigest(b" ".join(w)) if (w := words_of(t)) else None for t in utf8_list(part.column(1))]
            halves = [pa.array([x if x is None else x >> 64 for x in found], pa.uint64()), pa.array([x if x is None else x & (2**64 - 1) for x in found], pa.uint64())]
            yield pa.RecordBatch.from_arrays([part.column(0), *(h.view(pa.int64()) for h in halves)], ["id", "h1", "h2"])

    return arrow_map(docs, run, f"id {kind}, h1 long, h2 long").where("id IS NOT NULL AND h1 IS NOT NULL")


def marked_copies(docs: DataFrame) -> DataFrame:
    """(id, text) with ``copy``: whether a smaller id has the same word sequence.

    All windows of a copy start earlier, and it is never the first to have one, so copies need no suffixes.
    """
    seen = sequence_hashes(docs)
    first = seen.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = seen.join(first, ["h1", "h2"]).where("id <> first").select("id").distinct().withColumn("copy", F.lit(True))
    return docs.join(copies, docs["id"].eqNullSafe(copies["id"]), "left").select(docs["id"], "text", F.coalesce("copy", F.lit(False)).alias("copy"))


def removal(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept (the words left, joined by a blank), kept_sha256."""
    if not 0 < prefix <= window < prefix + 63:
        raise ValueError("a window is at most 62 words longer than a prefix")
    docs = marked_copies(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    firsts = docs.where("NOT copy").select("id", "text")
    starts = repeated_windows(firsts, window, prefix, group).groupBy("id").agg(F.collect_set(F.struct("start", "mask")).alias("starts"))
    met = docs.join(starts, docs["id"].eqNullSafe(starts["id"]), "left").select(docs["id"], "text", "copy", "starts")
    kind = dict(docs.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            n, gone, kept, digest = [], [], [], []
            for text, copy, at in zip(utf8_list(part.column("text")), part.column("copy").to_pylist(), part.column("starts").to_pylist(), strict=True):
                words = words_of(text)
                n.append(len(words))
                left = [] if copy and len(words) >= window else words
                if at:
                    first = np.array([x["start"] + k for x in at for k in range(x["mask"].bit_length()) if x["mask"] >> k & 1])
                    edge = np.zeros(len(words) + 1, np.int32)
                    np.add.at(edge, first, 1)
                    np.add.at(edge, first + window, -1)
                    stay = np.cumsum(edge)[:-1] == 0
                    left = [w for w, s in zip(words, stay, strict=True) if s]
                joined = b" ".join(left)
                gone.append(len(words) - len(left))
                kept.append(joined)
                digest.append(hashlib.sha256(joined).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(digest)], ["id", "n_words", "n_removed", "kept", "kept_sha256"])

    return arrow_map(met, run, f"id {kind}, n_words long, n_removed long, kept string, kept_sha256 string").withColumnRenamed("id", id_col)
