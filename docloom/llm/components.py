"""Connected components and similarity links, without a driver-side or single-task gather.

``connected_components`` alternates large-star and small-star steps (Kiveris et al. 2014) on
DataFrames. A node with very many neighbours is met by map-side ``min`` and by joins that AQE
splits, never by a list of its neighbours.

``link_components`` turns blocking buckets into components. Each bucket's members are compared with its
least and its greatest member, so a group of n copies costs about 2 n comparisons instead of n^2, and a
bucket of up to three is decided. What that leaves apart in larger buckets (members outside the bucket's
largest component) is compared with all of the bucket, in blocks of bounded size that are dealt over the
tasks; a block yields at most one link for each component that it joins, never its pairs. The result is
that of comparing all pairs that share a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docloom.llm.common import Staged, arrow_map, bounded, slices, utf8_list

#: Passes before giving up; a pass at least halves path lengths, so this is out of reach.
MAX_PASSES = 60
#: Buckets left apart that are broadcast; more are joined by shuffle.
MOST_BROADCAST = 200_000
#: Members and weight (characters or shingles) of a block.
BLOCK, BLOCK_WEIGHT = 1024, 4_000_000


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of one orderable type -> ``(id, component)``, component = least id reachable.

    Self-links and repeated or null links are ignored; only ids with a link to another id appear.
    """
    now = Staged(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "components",
    )
    for _ in range(MAX_PASSES):
        if _are_stars(now.df):
            break
        after = Staged(_small_star(_large_star(now.df)), "components")
        now.drop()
        now = after
    else:
        raise RuntimeError("components did not settle")
    stars = now.df
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).union(stars.select("v", "v").distinct())


def _are_stars(e: DataFrame) -> bool:
    """Whether each id has one parent and no parent has another."""
    ends = e.select(F.col("u").alias("id"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(e.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).where("c > 1 OR (c > 0 AND p > 0)").isEmpty()


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", "m")).distinct()


class Groups:
    """Union-find of the components that a block meets."""

    def __init__(self) -> None:
        self.of: dict = {}

    def root(self, x):
        path = []
        while (up := self.of.get(x, x)) != x:
            path.append(x)
            x = up
        for p in path:
            self.of[p] = x
        return x

    def merge(self, a, b) -> bool:
        """Whether ``a`` and ``b`` were apart."""
        a, b = self.root(a), self.root(b)
        if a != b:
            self.of[b] = a
        return a != b


#: A block's two sides, each (texts, components, carried longs (text, column), open buckets of the text), and
#: its bucket, of several blocks -> (block, i, j) of linked texts. Those whose components other links join
#: already can be left out, and so can pairs that meet in a lesser open bucket.
Side = tuple[list[bytes], list[int], np.ndarray, list[set[int]]]
BlockLinks = Callable[[list[tuple[Side, Side, int]]], Iterator[tuple[int, int, int]]]
#: Rows of blocks that are handed over at once.
ROWS = 4096


def link_components(
    buckets: DataFrame,
    nodes: DataFrame,
    near: Callable[[str, str], F.Column],
    texts: Callable[[DataFrame], DataFrame],
    confirm: Callable[[DataFrame], DataFrame],
    block_links: BlockLinks,
    carried: list[str] = [],  # noqa: B006
    most_broadcast: int = MOST_BROADCAST,
    block: int = BLOCK,
) -> DataFrame:
    """Components of the confirmed links among nodes that share a bucket: ``(id, component)``.

    buckets ``(key, half)``: half is a long that a node's id begins with; nodes ``(id, half, weight, ...)``
    with the columns that ``near`` compares (given two column prefixes, a cheap test that never refuses a
    true link); texts: ids -> ``(id, text)``; confirm: ``(a, b, text_a, text_b)`` -> the rows that are
    links, as ``(a, b)``; block_links does the same in Python and gets the ``carried`` columns of nodes, longs,
    to apply ``near``. Nodes in no link do not appear.
    """
    members = Staged(_members(buckets), "members")
    halves = members.df.where("half <> lo").select(F.col("lo").alias("a"), F.col("half").alias("b")).union(members.df.where("half <> hi AND n > 2").select("half", "hi"))
    a, b = (nodes.select(*[F.col(c).alias({"id": x, "half": f"half_{x}"}.get(c, f"{x}_{c}")) for c in nodes.columns]) for x in "ab")
    pairs = halves.distinct().withColumnsRenamed({"a": "half_a", "b": "half_b"})
    close = Staged(pairs.join(a, "half_a").join(b, "half_b").where(near("a_", "b_")).select("a", "b"), "pairs")
    held = Staged(texts(close.df.select(F.col("a").alias("id")).union(close.df.select("b")).distinct()), "texts")
    of_a, of_b = (held.df.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    links = Staged(confirm(close.df.join(of_b, "b").join(of_a, "a")).select("a", "b"), "links")
    labels = Staged(connected_components(links.df), "labels")
    for x in (close, held, links):
        x.drop()
    rows = members.df.where("n > 3").select("key", "half").join(nodes.select("half", "id", "weight", *carried), "half").join(labels.df, "id", "left").select("key", "id", "weight", F.array(*carried).cast("array<long>").alias("carried"), F.coalesce("component", "id").alias("label"))
    each = rows.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    apart = each.groupBy("key").agg(F.max(F.struct("n", "w", "label")).alias("top"), F.sum("n").alias("n"), F.sum("w").alias("w")).where("n > 3 AND top.n < n")
    blocks = lambda n, w: F.greatest(F.lit(1), F.ceil(n / block), F.ceil(w / BLOCK_WEIGHT)).cast("int")
    sized = apart.select("key", F.col("top.label").alias("top"), blocks(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w")).alias("few"), blocks(F.col("n"), F.col("w")).alias("many"))
    sized = Staged(sized, "sized")
    if sized.df.isEmpty():
        sized.drop()
        members.drop()
        return labels.df
    open_ = Staged(rows.join(bounded(sized.df, most_broadcast), "key"), "open")
    sized.drop()
    members.drop()
    met = open_.df.groupBy("id").agg(F.collect_set("key").alias("met"))
    held = Staged(texts(open_.df.select("id").distinct()).join(met, "id"), "texts")
    spark = held.spark
    spot = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = open_.df.where("label <> top").select("id", "label", "carried", "key", spot("few").alias("i"), every("many").alias("j"), F.lit(0).alias("side"))
    right = open_.df.select("id", "label", "carried", "key", every("few").alias("i"), spot("many").alias("j"), F.lit(1).alias("side"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.union(right).join(held.df, "id").select("key", "i", "j", "side", "label", "carried", "met", "text").repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
    joined = Staged(connected_components(_between(dealt, block_links)), "joined").df.select(F.col("id").alias("part"), F.col("component").alias("whole"))
    for x in (open_, held):
        x.drop()
    known = labels.df.join(joined, F.col("component") == F.col("part"), "left").select("id", F.coalesce("whole", "component").alias("component"))
    return known.union(joined.join(labels.df, F.col("part") == F.col("id"), "left_anti").select("part", "whole"))


def _members(buckets: DataFrame) -> DataFrame:
    """(key, half, lo, hi, n): the distinct members of each bucket that has two or more, with the least, the greatest and their number."""
    names = ["key", "half", "lo", "hi", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[part.column(c).to_numpy() for c in (0, 1)] for part in batches if part.num_rows]
        if not parts:
            return
        key, half = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        # Most keys occur once; only the others are put in order by both columns.
        order = np.argsort(key)
        twice = np.flatnonzero(key[order[1:]] == key[order[:-1]])
        order = order[np.union1d(twice, twice + 1)]
        key, half = key[order], half[order]
        order = np.lexsort((half, key))
        key, half = key[order], half[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (half[1:] != half[:-1])
        key, half = key[new], half[new]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        n = np.diff(np.append(first, len(key)))
        each = np.repeat(np.arange(len(n)), n)
        columns = (key, half, half[first][each], half[first + n - 1][each], n[each])
        more = n[each] > 1
        table = pa.RecordBatch.from_arrays([pa.array(c[more]) for c in columns], names)
        yield from slices(iter([table]), 10_000)

    return arrow_map(buckets.select("key", "half").repartition("key"), run, ", ".join(f"{c} long" for c in names))


def _between(dealt: DataFrame, block_links: BlockLinks) -> DataFrame:
    """(a, b): the components that blocks, sorted by (key, i, j, side), join."""
    kind = dict(dealt.dtypes)["label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides, label_type = None, ([], []), None
        held: list[tuple[list, list, int]] = []

        def out() -> Iterator[tuple]:
            """The merging links of the blocks held."""
            names: dict[str, int] = {}
            values: list = []

            def side(rows: list) -> Side:
                texts, labels, more, met = zip(*rows, strict=True)
                for x in labels:
                    if names.setdefault(repr(x), len(names)) == len(values):
                        values.append(x)
                return list(texts), [names[repr(x)] for x in labels], np.array(more, np.int64), [set(x) for x in met]

            blocks = [(side(a), side(b), key) for a, b, key in held]
            held.clear()
            groups = Groups()
            for k, i, j in block_links(blocks):
                a, b = blocks[k][0][1][i], blocks[k][1][1][j]
                if groups.merge(a, b):
                    yield values[a], values[b]

        def batch(found: list[tuple]) -> pa.RecordBatch:
            a, b = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, label_type), pa.array(b, label_type)], ["a", "b"])

        count = 0
        for part in slices(batches, 1024):
            label_type = part.column("label").type
            for key, i, j, side, label, more, met, text in zip(*(part.column(c).to_pylist() for c in ("key", "i", "j", "side", "label", "carried", "met")), utf8_list(part.column("text")), strict=True):
                if (key, i, j) != at:
                    if sides[0]:
                        held.append((*sides, at[0]))
                        count += len(sides[0]) + len(sides[1])
                    if count >= ROWS:
                        if found := list(out()):
                            yield batch(found)
                        count = 0
                    at, sides = (key, i, j), ([], [])
                sides[side].append((text, label, more, met))
        if sides[0]:
            held.append((*sides, at[0]))
        if found := list(out()):
            yield batch(found)

    return arrow_map(dealt, run, f"a {kind}, b {kind}")
