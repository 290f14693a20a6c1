"""Operator 8, benchmark decontamination as a prefix-filtered set join (DataFrame functions only).

Windows are ``window`` consecutive words of an item, or a whole shorter item. A text that contains a
window contains each of its word shingles (three words, or the whole window if it is shorter), so one
necessary shingle is enough to find it: the one that is rarest in the benchmark, ties to the least
hash. Texts' shingles are joined with these prefix shingles by hash. A match fixes where the window
would have to start; the length and position bounds (it must lie inside the text) and the comparison
of all its words decide. The prefix table is broadcast only while the benchmark's windows are at most
``most_broadcast``, and comparing goes on in the same stage; beyond that, matches are found by a
shuffled join of ids and hashes and then compared beside the text, with the same results.

Defined results. Null, empty or wordless texts and items have no words, so no windows and no hits.
Windows that several items share count for each. Repeated document rows give the same result each; a
repeated item row changes nothing. Rows that share a doc_id but not a text share their hits. A null
doc_id or item_id is an id like any other (a null item_id is left out of items). An empty table gives
an empty result, an empty benchmark no hits. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from docloom.llm.common import LOWER, UPPER, stage

WINDOW, SHINGLE = 13, 3
#: About 50 MB of windows.
MOST_BROADCAST = 200_000
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str) -> F.Column:
    return F.filter(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), SPLIT), lambda w: w != "")


def shingles(tokens: str, k: int) -> F.Column:
    """Hashes of the k-word shingles by position; no shingle if there are fewer words."""
    n = F.size(tokens)
    at = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(k), *[F.get(F.col(tokens), i + j) for j in range(k)]))


def windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(words, length, item): distinct windows of each item."""
    t = items.select(F.col(id_col).alias("item"), words(text_col).alias("t")).withColumn("n", F.size("t")).where("n > 0")
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n") - window + 1))
    return t.select("item", F.explode(F.transform(at, lambda i: F.slice("t", i, F.least(F.lit(window), F.col("n"))))).alias("words")).distinct()


def prefixes(each: DataFrame, shingle: int) -> DataFrame:
    """(words, length, k, hash, offset): of each distinct window, its rarest shingle."""
    w = each.select("words").distinct().withColumn("length", F.size("words")).withColumn("k", F.least(F.lit(shingle), F.col("length")))
    every = None
    for k in range(1, shingle + 1):
        part = w.where(F.col("k") == k).select("words", "length", "k", F.posexplode(shingles("words", k)).alias("offset", "hash"))
        every = part if every is None else every.union(part)
    often = every.groupBy("hash").count()
    rank = F.struct("count", "hash", "offset")
    best = every.join(often, "hash").groupBy("words").agg(F.min(rank).alias("best"))
    return best.select("words", F.size("words").alias("length"), F.least(F.lit(shingle), F.size("words")).alias("k"), F.col("best.hash").alias("hash"), F.col("best.offset").alias("offset"))


def occurrences(docs: DataFrame, prefix: DataFrame, shingle: int, broadcast: bool) -> DataFrame:
    """(id, start, length, words): where windows occur in texts (id, t), start from 0."""
    found = None
    for k in [r.k for r in prefix.select("k").distinct().collect()]:
        own = prefix.where(F.col("k") == k).select("hash", "offset", "length", F.col("words").alias("w"))
        start = F.col("place") - F.col("offset")
        fits = (start >= 0) & (start + F.col("length") <= F.col("n"))
        same = F.slice("t", start + 1, F.col("length")) == F.col("w")
        if broadcast:
            # The outer form: else the optimizer adds a filter on the size of h and computes t anew in it for each place.
            with_hashes = docs.withColumn("n", F.size("t")).withColumn("h", shingles("t", k))
            met = with_hashes.select("id", "t", "n", F.posexplode_outer("h").alias("place", "hash")).join(F.broadcast(own), "hash").where(fits).where(same)
            part = met.select("id", start.alias("start"), "length", "w")
        else:
            hashes = docs.select("id", F.size("t").alias("n"), shingles("t", k).alias("h")).select("id", "n", F.posexplode_outer("h").alias("place", "hash"))
            maybe = hashes.join(own, "hash").where(fits).select(F.col("id").alias("maybe"), start.alias("start"), "length", "w").distinct()
            part = docs.join(maybe, F.col("id").eqNullSafe(F.col("maybe"))).where(F.slice("t", F.col("start") + 1, F.col("length")) == F.col("w")).select("id", "start", "length", "w")
        found = part if found is None else found.union(part)
    return found


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """One row per document row: n_words, n_hit, n_items, item_ids (sorted as strings), contaminated."""
    each = windows(items, item_col, item_text, window)
    prefix = stage(prefixes(each, shingle), "prefixes")
    base = docs.select(F.col(id_col).alias("id"), words(text_col).alias("t"))
    rows = base.select("id", F.size("t").cast("long").alias("n_words"))
    fits = prefix.limit(most_broadcast + 1).count() <= most_broadcast
    found = occurrences(base, prefix, shingle, fits)
    if found is None:
        return rows.select(F.col("id").alias(id_col), "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.lit("").alias("item_ids"), F.lit(False).alias("contaminated"))
    found = stage(found, "occurrences")
    spans = found.select("id", "start", (F.col("start") + F.col("length")).alias("end")).distinct()
    before = F.max("end").over(Window.partitionBy("id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))))
    hit = spans.withColumn("fresh", fresh).groupBy("id").agg(F.sum("fresh").alias("n_hit"))
    texts = each.select(F.col("words").alias("w"), F.col("item").cast("string").alias("item")).where("item IS NOT NULL")
    names = found.select("id", "w").distinct().join(F.broadcast(texts) if fits else texts, "w").groupBy("id").agg(F.sort_array(F.collect_set("item")).alias("items"))
    hits = hit.join(names, hit["id"].eqNullSafe(names["id"]), "left").select(hit["id"].alias("hit_id"), "n_hit", "items")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.join(hits, F.col("id").eqNullSafe(F.col("hit_id")), "left").select(
        F.col("id").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_join("items", ","), F.lit("")).alias("item_ids"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without contaminated documents; rows with a null id stay unless contaminated."""
    bad = contamination(docs, items, id_col, **options).where("contaminated").select(F.col(id_col).alias("bad_id")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["bad_id"]), "left_anti")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM benchmark),
w AS (
  SELECT DISTINCT item_id, least(13, len(t)) AS k, array_to_string(list_slice(t, i, i + least(13, len(t)) - 1), ' ') AS w
  FROM (SELECT item_id, t, unnest(range(1, greatest(1, len(t) - 12) + 1)) AS i FROM b WHERE len(t) > 0)),
s AS (
  SELECT doc_id, k, i, array_to_string(list_slice(t, i, i + k - 1), ' ') AS w
  FROM (SELECT doc_id, t, k, unnest(range(1, len(t) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM w))),
h AS (SELECT doc_id, s.k, i, item_id FROM s JOIN w ON s.k = w.k AND s.w = w.w),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY 1),
q AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY 1)
SELECT doc_id, len(t)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(t) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)
"""
