"""Operator 6, mixing sources to target weights by Poisson replication (DataFrame functions only).

A source's rate is the mean number of copies that brings it to its weight's share of the target size.
A document's count is the Poisson quantile, at its source's rate, of a number in [0, 1) that a seeded
hash of its doc_id gives; it is exploded by that count and all copies are dealt globally by a hash of
(seed, doc_id, copy). Sources without a weight of their own share ``other``, so the table of rates has
at most len(weights) + 1 rows; it is computed by a map-side count and is the only thing broadcast.

Defined results. A null source belongs to ``other``. A null doc_id hashes as 'null'. Repeated rows of
one doc_id get the same count each. Null or empty texts are copied like any other. Ties in the deal
are ordered by doc_id and copy. A group of weight 0 or without documents yields nothing. An empty
table gives an empty result. Other columns are carried along; a column named like one added here
(copy_no, mix_order) is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

#: Shares of the mix in the registered queries: twice the weight for src0, half for src1, the rest equal.
WEIGHTS = {"src0": 2.0, "src1": 0.5} | {f"src{i}": 1.0 for i in range(2, 20)}
OTHER = 1.0
SEED = "mix-1"
#: Rates whose tables begin at 0 end here.
LARGE = 700.0
_ADDED = ("copy_no", "mix_order")


def uniform(seed: str, *columns: F.Column) -> F.Column:
    """52 bits of an MD5 as a double in [0, 1)."""
    text = F.concat_ws(":", F.lit(seed), *columns)
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_start(rate: F.Column) -> F.Column:
    """The first count of the table: 0, or for rates where exp(-rate) nears the least double, one that has less than 2^-52 below."""
    return F.when(rate > LARGE, (rate - 10 * F.sqrt(rate) - 40).cast("long")).otherwise(F.lit(0).cast("long"))


def poisson_table(rate: F.Column) -> F.Column:
    """Cumulative probabilities of ``poisson_start`` and more up to where less than 2^-52 is left."""
    low = poisson_start(rate)
    most = (rate + 10 * F.sqrt(rate) + 40).cast("long")
    step = lambda s, k: F.struct((s["p"] * rate / k).alias("p"), (s["c"] + s["p"] * rate / k).alias("c"), F.array_append(s["a"], s["c"] + s["p"] * rate / k).alias("a"))
    # By Stirling's series; in logarithms.
    k0 = low.cast("double")
    at_low = F.exp(k0 * F.log(rate / k0) - (rate - k0) - F.log(2 * math.pi * k0) / 2 - 1 / (12 * k0) + 1 / (360 * k0 * k0 * k0))
    p0 = F.when(rate > LARGE, at_low).otherwise(F.exp(-rate))
    start = F.struct(p0.alias("p"), p0.alias("c"), F.array(p0).alias("a"))
    return F.aggregate(F.sequence(low + 1, most), start, step, lambda s: s["a"])


def mix(docs: DataFrame, weights: dict[str, float] = WEIGHTS, other: float = OTHER, size: int | None = None, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` replicated and shuffled, with copy_no and mix_order; ``size`` (all rows by default) is the expected total."""
    total = math.fsum([*weights.values(), other])
    if not total > 0 or min([*weights.values(), other]) < 0:
        raise ValueError("weights are not negative, and one is positive")
    carried = [c for c in docs.columns if c not in _ADDED]
    group = F.when(docs[source_col].isin(list(weights)), docs[source_col])
    # The row as one column, so that no name of its columns can clash with those added here.
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in carried]).alias("own"), docs[id_col].alias("id"), group.alias("key"), F.coalesce(docs[id_col].cast("string"), F.lit("null")).alias("name"))
    counts = rows.groupBy("key").count()
    share = F.lit(other / total)
    for name, weight in weights.items():
        share = F.when(F.col("key") == name, weight / total).otherwise(share)
    whole = F.lit(float(size)) if size is not None else F.sum("count").over(Window.partitionBy(F.lit(0))).cast("double")
    rate = F.col("rate")
    rates = counts.select("key", (share * whole / F.col("count")).alias("rate")).select(F.col("key").alias("rate_key"), poisson_start(rate).alias("low"), poisson_table(rate).alias("table"))
    met = rows.join(F.broadcast(rates), F.col("key").eqNullSafe(F.col("rate_key"))).withColumn("u", uniform(seed, F.lit("count"), F.col("name")))
    copies = met.withColumn("times", F.col("low") + F.size(F.filter("table", lambda c: c <= F.col("u")))).where("times > 0").drop("table")
    out = copies.withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times").cast("long"))))
    out = out.withColumn("mix_order", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.col("name"), F.col("copy_no").cast("string"))))
    return out.orderBy("mix_order", "id", "copy_no").select(*[F.col(f"own.`{c}`").alias(c) for c in carried], "copy_no", "mix_order")


SQL = """
WITH g AS (SELECT *, CASE WHEN source IN ({names}) THEN source END AS mix_group FROM documents),
n AS (SELECT mix_group, count(*) AS n FROM g GROUP BY 1),
r AS (SELECT mix_group, CASE {cases} ELSE {other} END * (SELECT sum(n)::DOUBLE FROM n) / n AS rate FROM n),
s AS (SELECT mix_group, rate, CASE WHEN rate > {large} THEN trunc(rate - 10 * sqrt(rate) - 40)::BIGINT ELSE 0 END AS k0 FROM r),
b AS (
  SELECT mix_group, rate, k0, CASE WHEN k0 > 0
    THEN exp(k0 * ln(rate / k0) - (rate - k0) - ln(2 * pi() * k0) / 2 - 1 / (12.0 * k0) + 1 / (360.0 * k0 * k0 * k0)) ELSE exp(-rate) END AS p0 FROM s),
t AS (
  WITH RECURSIVE t(mix_group, rate, k0, k, p, c) AS (
    SELECT mix_group, rate, k0, k0, p0, p0 FROM b
    UNION ALL
    SELECT mix_group, rate, k0, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM t WHERE k < CAST(floor(rate + 10 * sqrt(rate) + 40) AS BIGINT))
  SELECT mix_group, any_value(k0) AS k0, list(c) AS cs FROM t GROUP BY 1),
u AS (
  SELECT g.*, k0, cs, ('0x' || substr(md5('{seed}:count:' || doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u
  FROM g JOIN t ON g.mix_group IS NOT DISTINCT FROM t.mix_group),
e AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(1, k0 + len(list_filter(cs, lambda x: x <= u)) + 1)) AS copy_no FROM u)
SELECT doc_id, text, lang, source, n_chars, copy_no, md5('{seed}:order:' || doc_id || ':' || copy_no) AS mix_order FROM e
"""


def sql(weights: dict[str, float] = WEIGHTS, other: float = OTHER, seed: str = SEED) -> str:
    """The mix of ``documents`` in DuckDB's SQL, without its order."""
    total = math.fsum([*weights.values(), other])
    cases = " ".join(f"WHEN mix_group = '{k}' THEN {v / total!r}::DOUBLE" for k, v in weights.items())
    return SQL.format(names=", ".join(f"'{k}'" for k in weights), cases=cases, other=f"{other / total!r}::DOUBLE", seed=seed, large=LARGE)
