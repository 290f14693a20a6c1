"""Items: positional merge, deduplication, reductions and finishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docloom.functions import text as tx
from docloom.functions import values as va
from docloom.sources.dimensions import CURRENCIES


def fill_missing(primary: DataFrame, helper: DataFrame, fields: list[str], keys: tuple[str, ...] = ("doc_id", "position")) -> DataFrame:
    """M1, M2: primary rows whose empty fields take the helper's values at the same place; ``updates`` counts them."""
    other = helper.select(*keys, *[F.col(f).alias(f"helper_{f}") for f in fields])
    takes = {f: va.is_empty_value(F.col(f)) & ~va.is_empty_value(F.col(f"helper_{f}")) for f in fields}
    updates = sum((F.coalesce(t, F.lit(False)).cast("int") for t in takes.values()), F.lit(0))
    met = primary.join(other, list(keys), "left").withColumn("updates", updates)
    return met.select(*[F.when(takes[c], F.col(f"helper_{c}")).otherwise(F.col(c)).alias(c) if c in takes else F.col(c) for c in primary.columns], "updates")


def close_enough(a: Column, b: Column) -> Column:
    """M5: both positive, and apart by 5 or a fifth of the first at most."""
    return (a > 0) & (b > 0) & (F.abs(a - b) <= F.greatest(F.lit(5), F.floor(a / 5)))


def helper_modes(primary: DataFrame, helper: DataFrame) -> DataFrame:
    """M3, M4: per document the counts of both sides and what a scan-table or a visual helper would do."""
    p = primary.groupBy("doc_id").agg(F.count("*").alias("n_primary"))
    h = helper.groupBy("doc_id").agg(F.count("*").alias("n_helper"))
    met = p.join(h, "doc_id", "full").select("doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_primary", "n_helper")])
    override = F.col("n_helper") > F.col("n_primary") + F.greatest(F.lit(3), F.floor(F.col("n_primary") / 10))
    scan = F.when(F.col("n_helper") == 0, None).when(F.col("n_primary") == 0, "rescue").when(override, "override").otherwise("merge")
    visual = F.when(F.col("n_helper") == 0, "empty").when(F.col("n_primary") == 0, "rescue").when(~close_enough(F.col("n_primary"), F.col("n_helper")), "count_mismatch").otherwise("merge")
    return met.withColumn("scan_mode", scan).withColumn("visual_mode", visual)


def apply_scan_helper(primary: DataFrame, helper: DataFrame, fields: list[str]) -> DataFrame:
    """M3: items after the helper's rescue, override or enrichment, with the mode of their document."""
    modes = helper_modes(primary, helper).select("doc_id", "scan_mode")
    turned = modes.where("scan_mode IN ('rescue', 'override')").select("doc_id")
    columns = ["doc_id", "position", *fields]
    kept = fill_missing(primary.select(columns).join(turned, "doc_id", "left_anti"), helper, fields)
    swapped = fill_missing(helper.select(columns).join(turned, "doc_id", "left_semi"), primary, fields)
    every = kept.unionByName(swapped)
    total = every.groupBy("doc_id").agg(F.sum("updates").alias("total"))
    mode = F.when(F.col("scan_mode") == "merge", F.when(F.col("total") > 0, "enrich").otherwise("noop")).otherwise(F.col("scan_mode"))
    return every.join(modes, "doc_id").join(total, "doc_id").select(*columns, mode.alias("mode"), F.col("total").alias("updates"))


def fingerprint(columns: tuple[str, ...] = ("description", "quantity", "price", "cost")) -> Column:
    """Folded lower-case values joined by pipes; nulls and zeros are empty."""
    def one(c: str) -> Column:
        text = F.lower(tx.fold(F.col(c).cast("string")))
        return F.when(F.col(c).isNull() | text.rlike(r"^-?0(\.0+)?$"), F.lit("")).otherwise(text)

    return F.concat_ws("|", *[one(c) for c in columns])


def dedupe_recent(items: DataFrame, keep: int = 25) -> DataFrame:
    """G1: items (doc_id, position, fp) without those whose fingerprint is among the last ``keep`` kept ones.

    A document's items are folded in order; documents are small, the fold is one array per document.
    """
    rows = items.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("position", "fp"))).alias("rows"))
    start = F.array().cast(dict(rows.dtypes)["rows"])

    def step(kept: Column, row: Column) -> Column:
        size = F.size(kept)
        recent = F.slice(kept, F.greatest(F.lit(1), size - (keep - 1)), F.lit(keep))
        return F.when(F.exists(recent, lambda k: k["fp"] == row["fp"]), kept).otherwise(F.array_append(kept, row))

    return rows.select("doc_id", F.explode(F.aggregate("rows", start, step)).alias("row")).select("doc_id", "row.position")


def first_by_slug(items: DataFrame, slug: list[Column], order: str) -> DataFrame:
    """The first row of each document and slug."""
    window = Window.partitionBy("doc_id", *slug).orderBy(order)
    return items.withColumn("nth", F.row_number().over(window)).where("nth = 1").drop("nth")


def first_values(items: DataFrame, fields: list[str], order: str = "position") -> DataFrame:
    """A1: of each document and field the first value that is neither empty nor zero."""
    def one(f: str) -> Column:
        text = F.lower(F.col(f).cast("string"))
        says = F.col(f).isNotNull() & ~text.isin("none", "null", "") & ~text.rlike(r"^-?0(\.0+)?$")
        return F.min_by(F.when(says, F.col(f)), F.when(says, F.col(order))).alias(f)

    return items.groupBy("doc_id").agg(*[one(f) for f in fields])


def fill_rates(items: DataFrame, fields: list[str]) -> DataFrame:
    """A2: (field, fill_rate, n) over all rows; no rows give 0."""
    def filled(f: str) -> Column:
        text = F.col(f).cast("string")
        return F.coalesce(F.col(f).isNotNull() & ~text.isin("", "null", "none") & ~text.rlike(r"^-?0(\.0+)?$"), F.lit(False)).cast("int")

    row = items.agg(F.count("*").alias("n"), *[F.coalesce(F.round(F.avg(filled(f)), 3), F.lit(0.0)).alias(f) for f in fields])
    return row.select("n", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("fill_rate")) for f in fields])).alias("x")).select("x.field", "x.fill_rate", "n")


def merge_usage(rows: DataFrame, key: str) -> DataFrame:
    """A3: maps of counters (usage) added up by key: one map per ``key``."""
    sums = rows.select(key, F.explode("usage").alias("name", "value")).where("value IS NOT NULL").groupBy(key, "name").agg(F.sum("value").alias("value"))
    return sums.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("usage"))


def header_to_items(items: DataFrame, header: DataFrame, fields: list[str]) -> DataFrame:
    """Header values where an item has none."""
    own = header.select("doc_id", *[F.col(f).alias(f"header_{f}") for f in fields])
    return items.join(own, "doc_id", "left").select(*[F.when(va.is_empty_value(F.col(c)), F.col(f"header_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in items.columns])


def finalize(items: DataFrame, db: list[tuple[str, str]]) -> DataFrame:
    """Folded description, resolved currency and countries, and the missing one of price and cost."""
    raw = F.coalesce(F.nullif("currency_code", F.lit("")), F.col("currency_name"))
    found = va.resolve_currency(raw, db) if db else F.struct(F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("name"))
    common = F.upper(tx.strip(raw))
    code = F.coalesce(found["code"], F.when(common.isin(*CURRENCIES), common))
    name = F.coalesce(F.nullif(found["name"], F.lit("")), va.mapped(code, CURRENCIES), code)
    origin = F.col("country_origin")
    alpha3 = F.coalesce(va.country_alpha3(F.col("country_origin_code")), va.country_alpha3(origin), va.country_alpha3(va.country_name(origin)), F.col("country_origin_code"))
    q, p, c = (va.to_float(F.col(x).cast("string")) for x in ("quantity", "price", "cost"))
    new = {
        "description": tx.fold(F.col("description")),
        "currency_code": F.coalesce(code, F.col("currency_code")),
        "currency_name": F.when(code.isNotNull(), name).otherwise(F.col("currency_name")),
        "country_origin": va.country_name(origin),
        "country_sender": va.country_name(F.col("country_sender")),
        "country_origin_code": alpha3,
        "cost": F.when(c.isNull() & q.isNotNull() & p.isNotNull(), va.round6(q * p)).otherwise(c),
        "price": F.when(p.isNull() & c.isNotNull() & q.isNotNull() & (q != 0), va.round6(c / q)).otherwise(p),
    }
    return items.withColumns(new)
