"""Registered queries: each operator over its whole input table. SQL for them is in ``oracle``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docloom.functions import jsontext as js, protocol as pr, text as tx, values as va
from docloom.operators import chunks, items as it, jobs, scan_table as st
from docloom.plans import oracle
from docloom.sources import dimensions as dim, files
from docloom.sources.rendered import HELPER, NOISY, SIDES, rendered_invoices, run, table
from docloom.streaming.jobs import job_events

FLAGSHIP = "scan_table_items"
MERGED = ["description", "unit", "quantity", "hs_code"]
CURRENCY_DB = [("XAU", "Gold ounce"), ("NGN", "Naira of Nigeria"), ("USD", "Dollar of the States")]
CONFIGURED = {"gemini": "gemini-2", "openai": "gpt-x"}

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f):
    _Q[f.__name__] = f
    return f


def _noisy(name: str, column: Callable[[Column], Column], out: str) -> None:
    """A query of one text function over the noisy documents."""
    _Q[name] = lambda spark, sf: run(spark, sf, NOISY).select("doc_id", column(F.col("text")).alias(out))


def _cased(query: str, base: str, source: str, /, **columns: Callable[[Column], Column]) -> None:
    """A query of functions over a rendered value ``v`` of each row."""
    _Q[query] = lambda spark, sf: run(spark, sf, source).select(base, *[c(F.col("v")).alias(k) for k, c in columns.items()])


# --- text (T1-T9) ---
_noisy("t1_clean_invoice_text", lambda c: F.md5(tx.clean_invoice_text(c)), "clean_md5")
_noisy("t3_normalize_ocr", lambda c: F.md5(tx.normalize_ocr_text(c)), "clean_md5")
_noisy("t4_item_zone", lambda c: F.md5(tx.item_zone(c)), "zone_md5")
_noisy("t5_empty_ocr", tx.effectively_empty, "is_empty")
_noisy("t6_content_lines", lambda c: F.size(tx.content_lines(c)), "n_lines")
_noisy("t7_header_block", lambda c: F.length(tx.header_block(c)), "n_chars")
_noisy("t8_nullish", lambda c: F.md5(tx.nullish(c)), "text_md5")
_noisy("t9_description", lambda c: F.md5(tx.clean_description(c)), "text_md5")


@_query
def t2_scan_lines(spark, sf):
    return st.lines(run(spark, sf, NOISY), "text").select("doc_id", "line_no", F.md5("line").alias("line_md5"))


# --- scanned tables (P1-P13) ---
@_query
def scan_table_items(spark, sf):
    found = st.scan_table_items(rendered_invoices(spark, sf))
    return found.select("doc_id", "position", "description", "hs_code", "quantity", "unit", "price", "cost", "country_origin", "country_origin_code", "document_number", "document_date", "currency_code", "currency_name", "country_sender")


@_query
def p2_numeric_tail(spark, sf):
    return st.lines(rendered_invoices(spark, sf)).select("doc_id", "line_no", F.col("line").rlike(st.POSITION).alias("is_position"), tx.numeric_tail(F.col("line")).alias("has_tail"), tx.header_only(F.col("line")).alias("header_only"))


@_query
def p3_table_documents(spark, sf):
    return st.table_documents(st.lines(rendered_invoices(spark, sf)))


@_query
def p4_row_blocks(spark, sf):
    return st.row_blocks(st.lines(rendered_invoices(spark, sf))).groupBy("doc_id").agg(F.count("*").alias("n_blocks"))


@_query
def p6_header_fields(spark, sf):
    return st.header_fields(st.lines(rendered_invoices(spark, sf)))


_cased("p10_parse_number", "key", oracle.NUMBERS, value=va.parse_number)
_cased("p11_units", "key", oracle.UNITS, unit=lambda c: va.mapped(F.lower(F.trim(c)), dim.UNITS))

# --- values (N*, M6-M10) ---
_cased("n1_infer_currency", "doc_id", oracle.MONEY, currency=va.infer_currency)
_cased("n3_to_float", "key", oracle.NUMBERS, value=va.to_float)
_cased("n4_round", "key", oracle.RATIOS, value=va.round6)
_cased("n6_object_date", "key", oracle.DATES, day=va.object_date)
_cased("n7_technical_date", "key", oracle.DATES, day=va.technical_date)
_cased("m6_resolve_currency", "key", oracle.CODES, code=lambda c: va.resolve_currency(c, CURRENCY_DB)["code"], name=lambda c: va.resolve_currency(c, CURRENCY_DB)["name"])
_cased("m7_country_name", "key", oracle.PLACES, name=va.country_name)
_cased("m8_country_alpha3", "key", oracle.PLACES, alpha3=va.country_alpha3)
_cased("m9_country_numeric", "key", oracle.PLACES, code=va.country_numeric)
_cased("m10_country_from_numeric", "key", oracle.NUMERIC, name=va.country_from_numeric)


@_query
def n5_currency_db_json(spark, sf):
    db = table(spark, sf, "nation").select(F.concat(F.lit("C"), "n_nationkey").alias("code"), F.col("n_name").alias("name"), "n_regionkey")
    return db.groupBy("n_regionkey").agg(F.to_json(F.array_sort(F.collect_list(F.struct("code", "name")))).alias("db"))


@_query
def n2_finalize(spark, sf):
    base = run(spark, sf, oracle.UNFINISHED)
    return it.finalize(base, []).select("doc_id", "position", "description", "currency_code", "currency_name", "country_origin", "country_origin_code", "country_sender", "cost", "price")


@_query
def n8_default_date(spark, sf):
    rows = run(spark, sf, oracle.DATES)
    return rows.select("key", F.coalesce(va.object_date(F.col("v")), F.lit("01/02/2024")).alias("day"))


@_query
def n9_final_fields(spark, sf):
    rows = run(spark, sf, oracle.DATES)
    return rows.select("key", va.object_date(F.col("v")).alias("document_date"), va.is_meaningful(F.col("v")).alias("meaningful"))


# --- merge and reduction ---
@_query
def m1_positional_merge(spark, sf):
    return it.fill_missing(run(spark, sf, SIDES), run(spark, sf, HELPER), MERGED)


@_query
def m3_helper_modes(spark, sf):
    return it.helper_modes(run(spark, sf, SIDES), run(spark, sf, HELPER))


@_query
def m3_scan_helper(spark, sf):
    return it.apply_scan_helper(run(spark, sf, SIDES), run(spark, sf, HELPER), MERGED)


@_query
def m11_registry(spark, sf):
    requests = run(spark, sf, oracle.REQUESTS)
    types = F.broadcast(dim.document_types(spark))
    met = requests.join(types, "document_code", "left")
    return met.select("doc_id", "document_code", "label", "result_type", F.size("fields").alias("n_fields"), F.when(F.col("label").isNull(), "failed").otherwise("ok").alias("status"))


@_query
def m12_header_currency(spark, sf):
    rows = run(spark, sf, oracle.UNFINISHED).select("doc_id", "position", "currency_code")
    return it.header_to_items(rows, it.first_values(rows, ["currency_code"]), ["currency_code"])


@_query
def g1_dedupe_recent(spark, sf):
    rows = run(spark, sf, oracle.REPEATED)
    return it.dedupe_recent(rows.select("doc_id", "position", it.fingerprint(("description", "quantity")).alias("fp")), keep=3)


@_query
def g2_fingerprint(spark, sf):
    return run(spark, sf, oracle.REPEATED).select("doc_id", "position", it.fingerprint(("description", "quantity")).alias("fp"))


@_query
def g3_first_by_slug(spark, sf):
    return it.first_by_slug(run(spark, sf, oracle.REPEATED), [F.lower("description"), F.col("quantity")], "position").select("doc_id", "position")


@_query
def a1_first_values(spark, sf):
    return it.first_values(run(spark, sf, SIDES), ["description", "quantity", "hs_code"])


@_query
def a2_fill_rates(spark, sf):
    return it.fill_rates(run(spark, sf, SIDES), MERGED)


@_query
def a3_token_usage(spark, sf):
    calls = table(spark, sf, "events").select("user_id", F.create_map(F.lit("calls"), F.lit(1).cast("long"), "event_type", F.length("props").cast("long")).alias("usage"))
    merged = it.merge_usage(calls, "user_id")
    return merged.select("user_id", F.explode("usage").alias("name", "value"))


@_query
def a4_item_count(spark, sf):
    return run(spark, sf, SIDES).groupBy("doc_id").agg(F.count("*").alias("n_items"))


@_query
def a5_any_chunk(spark, sf):
    rows = run(spark, sf, oracle.RESPONSES).select("doc_id", "position", js.technical_items(F.col("raw")).alias("t"))
    return rows.groupBy("doc_id").agg(F.bool_or("t.is_valid").alias("any_valid"), F.sum(F.coalesce(F.size("t.items"), F.lit(0))).alias("n_items"))


@_query
def a6_public_items(spark, sf):
    hidden = ("parsing_confidence", "review_required", "review_priority", "review_reason_count", "review_notes")
    rows = run(spark, sf, SIDES).withColumn("review_required", F.lit(True)).withColumn("review_notes", F.lit("x"))
    return rows.drop(*hidden)


# --- JSON (J1-J8) ---
@_query
def j1_json_array(spark, sf):
    return run(spark, sf, oracle.RESPONSES).select("doc_id", "position", F.size(js.json_array(F.col("raw"))).alias("n"))


@_query
def j2_verdict(spark, sf):
    return run(spark, sf, oracle.RESPONSES).select("doc_id", "position", js.invoice_verdict(F.col("raw")).alias("v")).select("doc_id", "position", "v.is_valid", "v.reason")


@_query
def j3_invoice_items(spark, sf):
    return run(spark, sf, oracle.RESPONSES).select("doc_id", "position", F.explode(js.invoice_items(F.col("raw"))).alias("i")).select("doc_id", "position", "i.*")


@_query
def j4_technical_items(spark, sf):
    rows = run(spark, sf, oracle.RESPONSES).select("doc_id", "position", js.technical_items(F.col("raw")).alias("t"))
    return rows.select("doc_id", "position", "t.is_valid", "t.reason", F.posexplode_outer("t.items").alias("item_no", "i")).select("doc_id", "position", "is_valid", "reason", "item_no", "i.*")


@_query
def j5_json_object(spark, sf):
    return run(spark, sf, oracle.RESPONSES).select("doc_id", "position", js.text_of(js.json_object(F.col("raw")), "description").alias("description"))


@_query
def j6_repaired_object(spark, sf):
    return run(spark, sf, oracle.BROKEN).select("doc_id", "position", js.text_of(js.repaired_object(F.col("raw")), "n").cast("int").alias("n"))


@_query
def j7_deep_merge(spark, sf):
    rows = run(spark, sf, oracle.MERGED)
    shape = {"n": "int", "code": {"list": "string", "value": "string", "more": {"a": "int"}}}
    merged = rows.select("doc_id", "position", js.deep_merge(F.parse_json("base"), F.parse_json("over"), shape).alias("m"))
    # A null can override a constant, so constants are set again.
    return merged.select("doc_id", "position", "m.n", F.col("m.code.value").alias("value"), F.col("m.code.more.a").alias("a"), F.col("m.code.list").alias("merged_list"), F.lit("2021").alias("code_list"))


@_query
def j8_as_list(spark, sf):
    return run(spark, sf, oracle.RESPONSES).select("doc_id", "position", F.size(js.as_list(js.json_object(F.col("raw")))).alias("n"))


# --- chunks (C1-C6) ---
@_query
def c1_invoice_chunks(spark, sf):
    return chunks.split_chunks(table(spark, sf, "documents"), 2000, 400).select("doc_id", "chunk_no", "start", "end", F.md5("chunk").alias("chunk_md5"))


@_query
def c2_technical_chunks(spark, sf):
    return chunks.split_chunks(table(spark, sf, "documents"), 5000, 600, 2000).select("doc_id", "chunk_no", "start", "end", F.md5("chunk").alias("chunk_md5"))


@_query
def c3_line_chunks(spark, sf):
    return chunks.line_chunks(table(spark, sf, "documents"), 2).select("doc_id", "chunk_no", F.md5("chunk").alias("chunk_md5"))


@_query
def c4_overlap(spark, sf):
    rows = run(spark, sf, oracle.SPECS).select("key", F.lower("v").alias("p"), (F.col("key") % 900).cast("int").alias("size"))
    return rows.select("key", va.overlap_for(F.col("p"), F.col("size"), 600, 100).alias("overlap"))


@_query
def c5_chunk_settings(spark, sf):
    rows = run(spark, sf, oracle.SPECS).select("key", va.chunk_settings(F.col("v")).alias("s"))
    return rows.select("key", "s.size", "s.workers")


@_query
def c6_page_batches(spark, sf):
    pages = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_no")).distinct()
    return chunks.page_batches(pages, 2).select("doc_id", "batch_no", F.size("pages").alias("n_pages"), F.array_max("pages").alias("last_page"))


# --- routing (F*) ---
_cased("f1_model_target", "key", oracle.SPECS, provider=lambda c: va.model_target(c, CONFIGURED)["provider"], model_id=lambda c: va.model_target(c, CONFIGURED)["model_id"], error=lambda c: va.model_target(c, CONFIGURED)["error"])
_cased("f2_inferred_provider", "key", oracle.SPECS, provider=va.inferred_provider)
_cased("f14_error_status", "key", oracle.ERRORS, status=va.error_status)


@_query
def f3_model_families(spark, sf):
    rows = run(spark, sf, oracle.SPECS).select(va.model_target(F.col("v"), CONFIGURED).alias("t")).where("t.provider IS NOT NULL")
    return rows.groupBy(F.col("t.provider").alias("provider")).agg(F.array_join(F.array_sort(F.collect_set("t.model_id")), ",").alias("models"))


@_query
def f7_chunk_fallback(spark, sf):
    rows = run(spark, sf, oracle.RESPONSES)
    other = rows.select("doc_id", (F.col("position") - 1).alias("position"), F.col("raw").alias("fallback"))
    met = rows.join(other, ["doc_id", "position"], "left").select("doc_id", "position", js.invoice_items(F.col("raw")).alias("a"), js.invoice_items(F.col("fallback")).alias("b"))
    return met.select("doc_id", "position", F.size(F.when(F.size("a") > 0, F.col("a")).otherwise(F.col("b"))).alias("n_items"), (F.size("a") == 0).alias("asked_fallback"))


@_query
def f8_document_fallback(spark, sf):
    rows = run(spark, sf, oracle.RESPONSES).select("doc_id", (F.col("position") % 2 == 1).alias("primary"), js.technical_items(F.col("raw"))["is_valid"].alias("valid"))
    met = rows.groupBy("doc_id").agg(F.coalesce(F.bool_or(F.col("valid") & F.col("primary")), F.lit(False)).alias("p"), F.coalesce(F.bool_or(F.col("valid") & ~F.col("primary")), F.lit(False)).alias("f"))
    return met.select("doc_id", F.when(F.col("p"), "primary").when(F.col("f"), "fallback").otherwise("failed").alias("used"))


@_query
def f9_first_good_attempt(spark, sf):
    rows = run(spark, sf, oracle.RESPONSES).select("doc_id", "position", js.text_of(js.json_object(F.col("raw")), "description").alias("d"))
    good = va.is_meaningful(F.col("d"))
    return rows.groupBy("doc_id").agg(F.min(F.when(good, F.col("position"))).alias("attempt"), F.min_by(F.when(good, F.col("d")), F.when(good, F.col("position"))).alias("description"))


@_query
def f10_exception_fallback(spark, sf):
    rows = run(spark, sf, oracle.BROKEN)
    return rows.select("doc_id", "position", F.coalesce(js.text_of(js.json_object(F.col("raw")), "n").cast("int"), F.lit(-1)).alias("n"))


@_query
def f12_helper_target(spark, sf):
    rows = run(spark, sf, oracle.SPECS).select("key", F.trim("v").alias("v"), va.model_target(F.col("v"), CONFIGURED).alias("t"))
    return rows.select("key", F.when((F.lower("v") != "off") & (F.col("t.provider") == "vlm"), F.col("t.model_id")).alias("helper"))


@_query
def f13_execute(spark, sf):
    met = run(spark, sf, oracle.REQUESTS).join(F.broadcast(dim.document_types(spark)), "document_code", "left")
    error = F.when(F.col("label").isNull(), F.concat(F.lit("unsupported document code "), "document_code")).otherwise("")
    return met.select("doc_id", error.alias("error"), F.when(error == "", "success").otherwise("failed").alias("status"))


@_query
def f15_prompt(spark, sf):
    met = run(spark, sf, oracle.REQUESTS).join(F.broadcast(dim.document_types(spark)), "document_code")
    return met.select("doc_id", F.concat(F.lit("Extract from "), "label", F.lit(": "), F.array_join("fields", ", ")).alias("prompt"))


# --- sources ---
@_query
def s1_requests(spark, sf):
    packed = run(spark, sf, oracle.REQUESTS).select(F.to_json(F.struct("doc_id", "document_code")).alias("body"))
    return packed.select(F.from_json("body", "doc_id long, document_code string, ocr_draft string, model string").alias("r")).select("r.*")


@_query
def s6_model_list(spark, sf):
    parts = F.filter(F.transform(F.split("v", r"[|,\n]"), lambda x: F.trim(x)), lambda x: x != "")
    return run(spark, sf, oracle.LISTS).select("key", F.array_join(F.array_distinct(parts), ";").alias("models"))


@_query
def s7_currency_json(spark, sf):
    rows = run(spark, sf, oracle.DB_TEXT).select("key", F.coalesce(F.from_json("v", "array<struct<code:string,name:string>>"), F.array()).alias("db"))
    return rows.select("key", F.posexplode("db").alias("ord", "row")).select("key", "ord", "row.code", "row.name")


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as uploaded files of several types."""
    kinds = F.array(*[F.lit(x) for x in ("png", "PDF", "jpeg", "txt", "webp")])
    path = F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit("."), F.element_at(kinds, (F.col("doc_id") % 5 + 1).cast("int")))
    return table(spark, sf, "documents").select("doc_id", path.alias("path"), F.encode("text", "UTF-8").alias("content"))


@_query
def s2_uploads(spark, sf):
    return _files(spark, sf).select("doc_id", files.suffix(F.col("path")).alias("suffix"), F.length("content").alias("n_bytes"))


@_query
def s3_data_urls(spark, sf):
    return _files(spark, sf).select("doc_id", F.md5(files.data_url(F.col("path"), F.col("content"))).alias("url_md5"))


@_query
def s5_visual_kind(spark, sf):
    return _files(spark, sf).select("doc_id", files.visual_kind(F.col("path")).alias("kind"))


@_query
def s8_json_results(spark, sf):
    return run(spark, sf, SIDES).where("description IS NOT NULL").select(F.to_json(F.struct("doc_id", "position", "description")).alias("line"))


# --- protocols (R*) ---
_cased("r1_iso_date", "key", oracle.OCR_DATES, day=pr.iso_date)
_cased("r2_country_code", "key", oracle.OCR_CODES, code=pr.country_code)
_cased("r3_kind_codes", "key", oracle.KINDS, address_kind=pr.address_kind_code, doc_kind=lambda c: pr.doc_kind_code(c, F.lit("AB-77")), entity=lambda c: F.coalesce(pr.country_code(c), F.lit("KG")))
_cased("r4_legal_form", "key", oracle.ORGS, form=pr.legal_form)
_cased("r5_organisation", "key", oracle.ORGS, name=pr.organisation, noisy=pr.noisy_name)
_cased("r6_doc_id", "key", oracle.IDS, doc_id=pr.doc_id, is_protocol=pr.is_protocol_id)
_cased("r12_country_of_place", "key", oracle.CITIES, by_city=pr.country_of_city, by_text=pr.country_of_text)
_cased("r7_doc_header", "key", oracle.PROTOCOLS, name=lambda c: pr.doc_header(c)["name"], id=lambda c: pr.doc_header(c)["id"], day=lambda c: pr.doc_header(c)["date"])


def _protocols(spark: SparkSession, sf: str) -> DataFrame:
    """Header texts with their header blocks."""
    return run(spark, sf, oracle.PROTOCOLS).withColumn("head", tx.header_block(F.col("v")))


@_query
def r8_laboratory(spark, sf):
    return _protocols(spark, sf).select("key", pr.laboratory(F.col("head")).alias("name")).select("key", pr.legal_form(F.col("name")).alias("form"), "name")


@_query
def r9_accreditation(spark, sf):
    return _protocols(spark, sf).select("key", *[v.alias(k) for k, v in pr.accreditation(F.col("v"), F.col("head")).items()])


@_query
def r10_address(spark, sf):
    lines = _protocols(spark, sf).select("key", F.get(pr.address_candidates(F.col("head")), F.lit(0)).alias("line"))
    return lines.select("key", pr.address(F.col("line")).alias("a")).select("key", "a.post_code", "a.city", "a.street", "a.building")


@_query
def r11_address_candidates(spark, sf):
    return _protocols(spark, sf).select("key", F.size(pr.address_candidates(F.col("head"))).alias("n"))


@_query
def r13_payload(spark, sf):
    rows = run(spark, sf, oracle.PROTOCOLS)
    model = F.struct(*[F.lit(v).cast("string").alias(k) for k, v in (("doc_name", "X"), ("doc_id", "9"), ("doc_date", "2020-01-01"), ("lab_name", "Y"), ("lab_form", None), ("city", None), ("street", "Model street"))])
    out = pr.protocol_payload(rows, "v", model)
    return out.select("key", "doc_name", "doc_id", "doc_date", "lab_form", "city", "street", "country", F.col("certificate_id").alias("certificate"), "code_list")


# --- jobs ---
@_query
def w3_job_states(spark, sf):
    return jobs.job_states(job_events(table(spark, sf, "events")))


@_query
def a7_prune(spark, sf):
    states = jobs.job_states(job_events(table(spark, sf, "events")))
    return jobs.prune(states, oracle.NOW, 5 * 86400, 40).select("job_id", "status")


@_query
def w5_job_view(spark, sf):
    states = jobs.job_states(job_events(table(spark, sf, "events")))
    target = va.model_target(F.when(F.col("job_id") % 2 == 0, "openai::gpt-x").otherwise("gemini"), CONFIGURED)
    return states.select("job_id", "status", target["model_id"].alias("result_model_id"), target["provider"].alias("final_provider"), (F.col("job_id") % 2 == 0).alias("fallback_used"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracle.sql().items() if k in _Q}


