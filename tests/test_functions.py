"""Functions and operators on hand-worked values."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import jsontext as js, protocol as pr, text as tx, values as va
from docloom.operators import chunks, items as it
from docloom.operators.scan_table import number_value, parse_row, scan_table_items
from docloom.plans import queries


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    ("row", "wanted"),
    [
        ("1 Widget A 8471490000 1 pcs 27280 27280 CN", (1, "Widget A", 1.0, "pcs", 27280.0, 27280.0, "8471490000", "China", "CN")),
        ("2) Gadget, steel KZ 12345678 1 250,5 kg 1.234,56 2 469,12", (2, "Gadget, steel", 1250.5, "kg", 2469.12, 1234.56, "12345678", "Kazakhstan", "KZ")),
        ("3.", None),
        ("no position", None),
    ],
)
def test_parse_row(row, wanted):
    assert parse_row(row) == wanted


def test_number_value():
    assert [number_value(x) for x in ("1.234,56", "1,234.56", "1.500", "1.5", "1,2,3", ".")] == [1234.56, 1234.56, 1500.0, 1.5, 123.0, None]


def test_scan_invoice(spark):
    text = "ИНВОЙС № 000223420\nот 12.12.2025\nUSD\nОписание Код ТН Кол-во Цена\n1 Widget A CN 8471490000 1 pcs 27280 27280\n2 Widget B DE 8471490001 2 pcs 1000 2000\nИтого 29280"
    rows = scan_table_items(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, ocr_text string")).orderBy("position").collect()
    assert len(rows) == 2
    first = rows[0]
    assert (first.description, first.hs_code, first.quantity, first.unit, first.price, first.cost, first.country_origin_code, first.document_number, first.document_date) == ("Widget A", "8471490000", 1, "pcs", 27280, 27280, "CN", "000223420", "12.12.2025")


def test_finalize(spark):
    columns = "doc_id long, position int, description string, quantity double, price double, cost double, country_origin string, country_origin_code string, country_sender string, currency_code string, currency_name string"
    row = it.finalize(spark.createDataFrame([(1, 1, " Widget ", 20.0, 8.82, None, "DE", "Кыргызстан", "Germany", "EUR", None)], columns), []).first()
    assert (row.description, row.country_origin, row.country_origin_code, row.country_sender, row.currency_name, row.cost) == ("Widget", "Германия", "KGZ", "Германия", "Euro", 176.4)


def test_text_functions(spark):
    assert one(spark, "a\r\n\n\n b \t c \n", tx.clean_invoice_text) == "a\nb c"
    assert one(spark, "a\r\nb  c", tx.scan_lines) == ["a", "b c"]
    assert one(spark, None, tx.clean_invoice_text) == ""
    assert one(spark, "Total Amount (EUR): 34.839,63", va.infer_currency) == "EUR"
    assert one(spark, "31/02/2024", va.object_date) == "31/02/2024"


def test_chunks_overlap_and_progress(spark):
    assert list(chunks.spans("x" * 1800, 1000, 600, 600))[:2] == [(0, 1000), (400, 1400)]
    docs = spark.createDataFrame([(1, "x" * 1800), (2, None), (3, "")], "doc_id long, text string")
    assert chunks.split_chunks(docs, 1000, 400).where("doc_id > 1").count() == 0
    with pytest.raises(ValueError):
        chunks.split_chunks(docs, 1000, 600)


def test_nearby_repeats_go_and_far_ones_stay(spark):
    rows = [(1, i, f) for i, f in enumerate(["a", "a", "b", "c", "d", "a"])]
    kept = it.dedupe_recent(spark.createDataFrame(rows, "doc_id long, position int, fp string"), keep=3).orderBy("position").collect()
    assert [r.position for r in kept] == [0, 2, 3, 4, 5]


def test_streamed_jobs_end_as_batch_jobs_do(spark, tmp_path):
    from docloom.operators.jobs import job_states
    from docloom.streaming.jobs import track

    rows = [(j, 1_700_000_000 + 10 * k, 10 * j + k, a) for j in range(1, 6) for k, a in enumerate(["submit", "start", "cancel", "finish", "fail"][: j + 1])]
    events = spark.createDataFrame(rows, "job_id long, s long, event_id long, action string").select("job_id", F.timestamp_seconds("s").alias("ts"), "event_id", "action")
    events.write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    query = track(stream).writeStream.format("memory").queryName("tracked").outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").start()
    query.awaitTermination(120)
    streamed = {r.job_id: r.status for r in spark.table("tracked").collect()}
    assert streamed == {r.job_id: r.status for r in job_states(events).collect()}


def test_every_sql_has_a_query():
    assert set(queries.oracle_sql()) <= set(queries.queries()) and queries.FLAGSHIP in queries.queries()


def test_protocol_header_takes_the_dated_number_first(spark):
    got = one(spark, "номер протокола: 77\n№ 12 от 01.01.2024", pr.doc_header)
    assert (got.id, got.date) == ("12", "2024-01-01T00:00:00")
    assert one(spark, "номер протокола: 77", pr.doc_header).id == "77"


def test_laboratory_name_ends_before_what_it_is(spark):
    assert one(spark, "ТОО «Эксперт Сервис» испытательная лаборатория пищевой продукции", pr.laboratory) == "ТОО «Эксперт Сервис»"
    assert one(spark, "ТОО испытательная лаборатория", pr.laboratory) == "ТОО испытательная лаборатория"


def test_bare_certificate_id(spark):
    assert one(spark, "ТОО «Лаб»\nKZ.Т.02.1234 действителен до 01.02.2026", lambda c: pr.accreditation(c, c)["id"]) == "KZ.T.02.1234"


def test_deep_merge(spark):
    shape = {"a": "int", "b": {"c": "string", "d": "string"}}
    base = '{"a": 1, "b": {"c": "x", "d": "y"}}'
    cases = {"{}": (1, "x", "y"), '{"a": null}': (None, "x", "y"), '{"b": {"d": "z"}}': (1, "x", "z"), '{"b": [1]}': (1, None, None), '{"b": null}': (1, None, None), '{"b": {"c": null}}': (1, None, "y")}
    for over, wanted in cases.items():
        got = one(spark, over, lambda c: js.deep_merge(F.parse_json(F.lit(base)), F.parse_json(c), shape))
        assert (got.a, got.b.c, got.b.d) == wanted


def test_items_keep_all_fields(spark):
    raw = '[{"description": " a  b ", "hs_code": "null", "price": 2.5, "cost": "7", "unit": "pcs", "country_sender": "DE", "document_date": "1.2.2024"}, {"description": "none"}, 3]'
    (item,) = one(spark, raw, js.invoice_items)
    assert len(item) == 13 and (item.description, item.hs_code, item.price, item.cost, item.unit, item.country_sender, item.document_date, item.quantity) == ("a b", None, 2.5, 7.0, "pcs", "DE", "1.2.2024", None)
    refused = one(spark, "I cannot help.", js.technical_items)
    assert (refused.is_valid, refused.reason) == (False, "refusal")


def test_responses_are_parsed_once(spark):
    """Fields of a verdict don't each parse the text again; deep repetition made J2 and J4 slow."""
    texts = ['[{"description": "a"}]', '[{"description": " "}, 7]', "[7, 8]", '{"items": []}', "[1", "", None, "```json\n[{\"description\": \"b\"}]\n```"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, v string")
    verdict = rows.select("k", js.invoice_verdict(F.col("v")).alias("v")).select("k", "v.is_valid", "v.reason")
    technical = rows.select("k", js.technical_items(F.col("v")).alias("t")).select("k", "t.is_valid", "t.reason", F.posexplode_outer("t.items").alias("n", "i")).select("k", "is_valid", "reason", "n", "i.*")
    for df, most in ((verdict, 1), (technical, 2)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("parse_json") + df._jdf.queryExecution().optimizedPlan().toString().count("parseJson") <= most
    assert [(r.is_valid, r.reason) for r in verdict.orderBy("k").collect()] == [(1, ""), (0, "no valid items"), (0, "no valid items"), (0, "not array"), (0, "invalid"), (0, "empty"), (0, "empty"), (1, "")]
    assert [(r.k, r.is_valid, r.reason, r.n, r.product_name) for r in technical.orderBy("k", "n").collect()] == [
        (0, True, "", 0, "a"), (1, True, "", None, None), (2, True, "", None, None), (3, True, "", None, None), (4, False, "refusal", None, None), (5, False, "refusal", None, None), (6, False, "refusal", None, None), (7, True, "", 0, "b"),
    ]


def test_scanned_texts_are_read_once(spark):
    text = "1. Rod %d CN 8400000286 40 pcs 9286 335640"
    docs = spark.createDataFrame([(i, "Qty\r\n" + "\r\n".join(text % n for n in range(i))) for i in range(1, 7)], "doc_id long, ocr_text string")
    found = scan_table_items(docs)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert sorted((r.doc_id, r.block, r.description) for r in found.collect()) == [(i, n + 1, f"Rod {n}") for i in range(2, 7) for n in range(i)]
