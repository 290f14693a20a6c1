"""Inputs that Spark and DuckDB both render, and the DuckDB SQL of the registered queries.

Value functions are fed from small tables of cases with results worked out by hand, dealt over the
rows of a table; the rest is compared with DuckDB's own functions or with the relational truth that
a text was rendered from.
"""

from __future__ import annotations

from docloom.sources import dimensions as dim
from docloom.sources.rendered import HELPER, ITEMS, NOISY, SCAN_CODES, SIDES, TABLES

NOW = "2024-02-01 00:00:00"


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def _rows(cases: list[tuple], width: int) -> str:
    return ", ".join("(" + ", ".join([str(i), *map(_literal, c[:width])]) + ")" for i, c in enumerate(cases))


def dealt(cases: list[tuple], table: str = "orders", key: str = "o_orderkey") -> str:
    """SQL of (key, v): the cases' first values dealt over a table by its key."""
    return f"SELECT key, v FROM (SELECT {key} AS key, CAST({key} % {len(cases)} AS INT) AS k FROM {{{table}}}) a JOIN (VALUES {_rows(cases, 1)}) AS c(i, v) ON k = i"


def expected(cases: list[tuple], *names: str, table: str = "orders", key: str = "o_orderkey", kinds: tuple[str, ...] = ()) -> str:
    """DuckDB SQL of (key, *names): the cases' other values, dealt likewise."""
    picks = ", ".join(f"c.{n}::{k} AS {n}" if k else f"c.{n}" for n, k in zip(names, kinds or ("",) * len(names), strict=True))
    return f"SELECT {key} AS key, {picks} FROM {table} JOIN (VALUES {_rows([c[1:] for c in cases], len(names))}) AS c(i, {', '.join(names)}) ON {key} % {len(cases)} = i"


# (text, P10 value, N3 value)
_NUMBERS = [
    ("1.234,56", 1234.56, None), ("1,234.56", 1234.56, None), ("12,5", 12.5, 12.5), ("12,500", 12500.0, 12.5), ("1.5", 1.5, 1.5), ("1.500", 1500.0, 1.5),
    ("1 250", 1250.0, 1250.0), ("1.2.3", 123.0, None), ("abc", None, None), ("", None, None), (None, None, None), ("USD 7", 7.0, None), ("-", None, None),
    ("27280", 27280.0, 27280.0), ("1,2,3", 123.0, None), ("none", None, None), ("34.839,63", 34839.63, None),
]
NUMBERS = dealt(_NUMBERS)
_UNITS = [("PCS", "pcs"), (" шт.", "шт"), ("кг", "кг"), ("boxes", "box"), ("bag", None), (None, None), ("упак", "упак"), ("Pieces", "pcs")]
UNITS = dealt(_UNITS)
# (text, N6, N7)
_DATES = [
    ("12.03.2024", "12/03/2024", "12/03/2024"), ("2024-03-12", "12/03/2024", "2024-03-12"), ("1/2/2024", "01/02/2024", "01/02/2024"), ("31/02/2024", "31/02/2024", "31/02/2024"),
    ("on 5.6.2023 in", "05/06/2023", "05/06/2023"), ("", None, None), (None, None, None), ("NO_DATE_FOUND", "NO_DATE_FOUND", None), (" soon ", "soon", "soon"), ("07-08-2020", "07/08/2020", "07/08/2020"),
]
DATES = dealt(_DATES)
_CODES = [("ngn", "NGN", "Naira of Nigeria"), ("naira", "NGN", "Naira of Nigeria"), ("of", "NGN", "Naira of Nigeria"), (" usd ", "USD", "Dollar of the States"), ("EUR", "EUR", None), ("", None, None), (None, None, None)]
CODES = dealt(_CODES)
# (text, M7, M8, M9)
_PLACES = [
    ("DE", "Германия", "DEU", 276), ("kgz", "Кыргызстан", "KGZ", None), ("КИТАЙ", "Китай", "CHN", 156), ("Germany", "Германия", "DEU", None), ("Atlantis", "Atlantis", None, None),
    (" se ", "Швеция", "SWE", 752), ("", "", None, None), (None, None, None, None), ("United States", "США", "USA", None), ("AE", "AE", None, None),
]
PLACES = dealt(_PLACES)
_NUMERIC = [("276", "Германия"), (" 752 ", "Швеция"), ("x", None), (None, None), ("999", None), ("008", "Албания")]
NUMERIC = dealt(_NUMERIC)
# (specification, F1 provider, F1 model, F1 error, F2 provider, C5 size, C5 workers, F12 helper)
_SPECS = [
    ("gemini", "gemini", "gemini-2", None, None, 100000, 5, None), ("vllm::m/x", "vllm", "m/x", None, "ollama", 100000, 5, None), ("VLM:: v1 ", "vlm", "v1", None, "ollama", 100000, 5, "v1"),
    ("zzz::a", None, None, "unsupported provider", "ollama", 100000, 5, None), ("openai::", None, None, "empty model id", "ollama", 100000, 5, None), ("llama3.2:latest", "ollama", "llama3.2:latest", None, "ollama", 100000, 5, None),
    ("llama3.1-8b", "cerebras", "llama3.1-8b", None, "cerebras", 100000, 5, None), ("gpt-x", "openai", "gpt-x", None, "openai", 100000, 5, None), ("", "gemini", "gemini-2", None, None, 100000, 5, None),
    ("cerebras", None, None, "no models configured", None, 3500, 5, None), ("what", None, None, "unsupported model spec", None, 100000, 5, None), ("vllm", None, None, "no models configured", None, 20000, 2, None),
    ("off", None, None, "unsupported model spec", None, 100000, 5, None), ("openai", "openai", "gpt-x", None, None, 80000, 5, None),
]
SPECS = dealt(_SPECS)
_ERRORS = [("Rate limit hit", 429), ("read Timed Out", 504), ("Network error: x", 503), ("Request failed for model z", 502), ("Unsupported provider", 400), ("No fields extracted", 422), ("boom", 500), ("HTTP 429 timeout", 429), ("Empty OCR text", 400)]
ERRORS = dealt(_ERRORS)
_LISTS = [("a|b,a\nc", "a;b;c"), (" x , ,y|", "x;y"), ("", ""), ("one", "one")]
LISTS = dealt(_LISTS)
DB_TEXT = dealt([('[{"code":"A","name":"Aa"},{"code":"B","name":"Bb"}]',), ("not json",), ("[]",)])
_OCR_DATES = [
    ("12.03.2024", "2024-03-12T00:00:00"), ("2024-03-12", "2024-03-12T00:00:00"), ("О1.О2.2О23 г.", "2023-02-01T00:00:00"), ("1l.1І.23", "2023-11-11T00:00:00"), ("31.02.2024", None), ("05.2022", "2022-05-01T00:00:00"),
    ("n/a", None), (None, None), ("7 . 8 . 2019", "2019-08-07T00:00:00"), ("01.01.1850", None),
]
OCR_DATES = dealt(_OCR_DATES)
_OCR_CODES = [("KG", "KG"), ("кг", None), ("КZ", "KZ"), ("ВY-1", "BY"), ("RUS", None), ("null", None), (None, None), ("de.", "DE")]
OCR_CODES = dealt(_OCR_CODES)
# (text, address kind, document kind, entity)
_KINDS = [("02", "02", None, "KG"), ("legal_address", "01", "LEGAL_ADDRESS", "KG"), ("ACTUAL_ADDRESS", "02", "ACTUAL_ADDRESS", "KG"), ("12345", "01", None, "KG"), ("X-AB-77", "01", None, "KG"), ("two words", "01", None, "KG"), (None, "01", None, "KG"), ("BY", "01", "BY", "BY")]
KINDS = dealt(_KINDS)
# (text, form, organisation, noisy)
_ORGS = [
    ('ТОО «Лаб Плюс» адрес: Алматы', "ТОО", "ТОО «Лаб Плюс»", True), ("ГУ Центр экспертизы", "ГУ", "ГУ Центр экспертизы", False), ("Заявитель: ООО Рога", "ООО", "ООО Рога", True), ("Plain name", None, "Plain name", False),
    ("null", None, None, True), (None, None, None, True), ("ОсОО Альфа тел. 123456", "ОСОО", "ОсОО Альфа", False), ("a - b - c", None, "a - b - c", True),
]
ORGS = dealt(_ORGS)
_IDS = [("№ 123/А от 01.02.2023", "123/А", True), ("N 45-7", "45-7", True), ("ГОСТ 123", None, False), ("1 2 3 4", "1234", True), ("абвгдежз 12", "абвгдежз 12", False), ("none", None, False), (None, None, False), ("без номера", None, False)]
IDS = dealt(_IDS)
_CITIES = [("г. Алматы", "KZ", None), ("Бишкек, Кыргызская Республика", "KG", "KG"), ("Москва", "RU", None), ("made in China", None, "CN"), ("Казахстан", None, "KZ"), (None, None, None), ("Paris", None, None)]
CITIES = dealt(_CITIES)

#: Protocol headers with known fields, one for each supplier.
PROTOCOLS = """
SELECT s_suppkey AS key, 'ТОО «Лаборатория ' || s_suppkey || '»' || chr(10) || 'Адрес: 0' || (50000 + s_suppkey) || ', г. ' || CASE s_suppkey % 3 WHEN 0 THEN 'Алматы' WHEN 1 THEN 'Бишкек' ELSE 'Минск' END
  || ', ул. Новая, дом ' || s_suppkey || chr(10) || 'Аттестат аккредитации № KZ.Т.' || (1000 + s_suppkey) || ' от 01.02.2021 действителен до 01.02.2026' || chr(10) || chr(10)
  || 'ПРОТОКОЛ ИСПЫТАНИЙ № ' || (200 + s_suppkey) || '/А от ' || lpad(CAST(s_suppkey % 28 + 1 AS STRING), 2, '0') || '.03.2024' || chr(10) || 'Результаты' AS v
FROM {supplier}
"""

MONEY = """
SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'Total (EUR): 5' WHEN 1 THEN 'XUSDX paid $7' WHEN 2 THEN 'сумма: сто  рубль' WHEN 3 THEN 'KGS and USD' WHEN 4 THEN '7 £' WHEN 5 THEN 'zzz' WHEN 6 THEN 'US  Dollar' ELSE substr(text, 1, 100) END AS v
FROM {documents}
"""
RATIOS = "SELECT l_orderkey AS key, l_extendedprice / l_quantity AS v FROM {lineitem}"
REQUESTS = """
SELECT o_orderkey AS doc_id, CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN '04021' WHEN 1 THEN '9012' WHEN 2 THEN 'ELSE' WHEN 3 THEN '4021' WHEN 4 THEN '10999' ELSE '22222' END AS document_code FROM {orders}
"""
#: Items with currency and country gaps.
UNFINISHED = f"""
SELECT doc_id, position, '  ' || name || '   x ' AS description, CASE position % 3 WHEN 0 THEN 'usd' WHEN 1 THEN NULL ELSE 'EUR' END AS currency_code, CASE WHEN position % 2 = 1 THEN 'KGS' END AS currency_name,
  CASE country % 4 WHEN 0 THEN 'DE' WHEN 1 THEN 'КИТАЙ' WHEN 2 THEN 'Nowhere' ELSE NULL END AS country_origin, CASE country % 3 WHEN 0 THEN 'kg' WHEN 1 THEN NULL ELSE '??' END AS country_origin_code,
  'Germany' AS country_sender, CAST(quantity AS DOUBLE) AS quantity, CASE WHEN position % 4 <> 1 THEN CAST(price AS DOUBLE) END AS price, CASE WHEN position % 3 <> 2 THEN CAST(cost AS DOUBLE) END AS cost
FROM ({ITEMS}) x
"""
#: Items whose description and quantity repeat within a document.
REPEATED = f"""
SELECT doc_id, position, CASE WHEN (position + doc_id) % 3 = 0 THEN ' Same  Name' ELSE name END AS description, CASE WHEN position % 2 = 0 THEN 0 ELSE CAST((position + doc_id) % 3 AS INT) END AS quantity FROM ({ITEMS}) x
"""
_ONE = """'{"description": " ' || name || '  x ", "hs_code": "' || hs_code || '", "quantity": ' || quantity || ', "currency_code": " usd ", "unit": "pcs", "price": ' || price || ', "cost": ' || cost || ', "country_origin": "Китай", "country_origin_code": "CN", "country_sender": null, "document_number": "N-' || doc_id || '", "document_date": "12.03.2024", "model": "M' || position || '"}'"""
#: Model responses: a list in an object, a fenced list, truncated, a refusal, null, a single object.
RESPONSES = f"""
SELECT doc_id, position, name, hs_code, quantity, price, cost, CAST((doc_id + position) % 6 AS INT) AS kind, CASE CAST((doc_id + position) % 6 AS INT)
  WHEN 0 THEN '{{"items": [' || {_ONE} || ', {{"description": "null"}}, 7]}}'
  WHEN 1 THEN 'Here: ```json' || chr(10) || '[' || {_ONE} || ']```'
  WHEN 2 THEN '{{"items": [{{"description": "abc"' WHEN 3 THEN 'I cannot help.' WHEN 4 THEN NULL
  ELSE '{{"description": "' || name || '", "hs_code": " none "}}' END AS raw
FROM ({ITEMS}) x
"""
MERGED = f"""
SELECT doc_id, position, CAST((doc_id + position) % 5 AS INT) AS kind, '{{"n": -1, "code": {{"list": "2020", "value": "' || name || '", "more": {{"a": 1}}}}}}' AS base,
  CASE CAST((doc_id + position) % 5 AS INT) WHEN 0 THEN '{{"n": ' || position || ', "x": [1]}}' WHEN 1 THEN '{{"code": {{"value": "v' || doc_id || '", "more": {{"b": 2}}}}}}'
  WHEN 2 THEN '{{"n": null, "code": null}}' WHEN 3 THEN '{{"code": {{"more": {{"a": ' || position || '}}, "list": null}}}}' ELSE '{{"code": [1, 2]}}' END AS over
FROM ({ITEMS}) x
"""
BROKEN = f"""
SELECT doc_id, position, CASE CAST((doc_id + position) % 4 AS INT) WHEN 0 THEN '```json {{"n": ' || position || ',}} ```' WHEN 1 THEN '{{"n": None}}' WHEN 2 THEN 'nothing' ELSE '{{"n": ' || position || ', "list": "x"}}' END AS raw FROM ({ITEMS}) x
"""


_given = """CASE WHEN kind <> 5 THEN 'pcs' END AS unit, CASE WHEN kind <> 5 THEN 'Китай' END AS country_origin, CASE WHEN kind <> 5 THEN 'CN' END AS country_origin_code, NULL::VARCHAR AS country_sender,
    CASE WHEN kind <> 5 THEN 'N-' || doc_id END AS document_number, CASE WHEN kind <> 5 THEN '12.03.2024' END AS document_date"""


def _plain(statement: str) -> str:
    """A rendered statement for DuckDB, where tables are views."""
    for t in TABLES:
        statement = statement.replace("{" + t + "}", t)
    return statement.replace("AS STRING", "AS VARCHAR")


def _clean_lines(column: str) -> str:
    """DuckDB's list of folded lines."""
    return f"list_transform(string_split(regexp_replace(coalesce({column}, ''), chr(13), '', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'), ' ' || chr(9) || chr(160) || chr(10)))"


_MD_IMAGE = r"!\[[^\]]*\]\([^)]*\)"
_FOLD = "trim(regexp_replace({}, '[\\s\\x{{A0}}]+', ' ', 'g'))"
_EMPTY = "coalesce(lower(trim({}::VARCHAR)) IN ('', 'none', 'null', '-'), TRUE)"


def sql() -> dict[str, str]:
    noisy, items, sides, helper = (_plain(x) for x in (NOISY, ITEMS, SIDES, HELPER))
    responses, broken, repeated, unfinished = (_plain(x) for x in (RESPONSES, BROKEN, REPEATED, UNFINISHED))
    codes = ", ".join(f"({i}, '{c}', '{dim.SCAN_COUNTRIES[c]}')" for i, c in enumerate(SCAN_CODES))
    lines = f"SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS line_no FROM (SELECT doc_id, list_filter(list_transform(string_split(replace(replace(text, chr(13), chr(10)), chr(160), ' '), chr(10)), lambda x: {_FOLD.format('x')}), lambda x: x <> '') AS l FROM ({noisy}))"
    merged = ", ".join(f"CASE WHEN {_EMPTY.format('p.' + f)} AND NOT {_EMPTY.format('h.' + f)} THEN h.{f} ELSE p.{f} END AS {f}" for f in ("description", "unit", "quantity", "hs_code"))
    updates = " + ".join(f"CAST({_EMPTY.format('p.' + f)} AND NOT {_EMPTY.format('h.' + f)} AS INT)" for f in ("description", "unit", "quantity", "hs_code"))
    modes = f"""SELECT doc_id, coalesce(a.n, 0) AS n_primary, coalesce(b.n, 0) AS n_helper FROM (SELECT doc_id, count(*) AS n FROM ({sides}) GROUP BY 1) a FULL JOIN (SELECT doc_id, count(*) AS n FROM ({helper}) GROUP BY 1) b USING (doc_id)"""
    both_modes = f"""SELECT *, CASE WHEN n_helper = 0 THEN NULL WHEN n_primary = 0 THEN 'rescue' WHEN n_helper > n_primary + greatest(3, n_primary // 10) THEN 'override' ELSE 'merge' END AS scan_mode,
      CASE WHEN n_helper = 0 THEN 'empty' WHEN n_primary = 0 THEN 'rescue' WHEN abs(n_primary - n_helper) > greatest(5, n_primary // 5) THEN 'count_mismatch' ELSE 'merge' END AS visual_mode FROM ({modes})"""
    swap = merged.replace("p.", "q.").replace("h.", "p.").replace("q.", "h.")
    swap_updates = updates.replace("p.", "q.").replace("h.", "p.").replace("q.", "h.")
    types = ", ".join(f"('{c}', '{label}', '{kind}', {len(f.split())}, '{', '.join(f.split())}')" for c, label, kind, f in dim.DOCUMENT_TYPES)
    registry = f"(VALUES {types}) AS t(document_code, label, result_type, n_fields, fields)"
    fp = "lower({d}) || '|' || CASE WHEN quantity = 0 THEN '' ELSE quantity::VARCHAR END".format(d=_FOLD.format("description"))
    job_rows = "SELECT user_id AS job_id, ts, event_id, ['submit', 'start', 'finish', 'cancel', 'fail'][event_id % 5 + 1] AS action FROM events"
    good = "kind IN (0, 1, 5)"
    states = f"""
      WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY job_id) AS n, min(ts) OVER (PARTITION BY job_id) AS created_at, max(ts) OVER (PARTITION BY job_id) AS updated_at FROM ({job_rows})),
      f AS (
        SELECT job_id, 0::BIGINT AS k, 'new' AS status, n, created_at, updated_at FROM r WHERE k = 1
        UNION ALL
        SELECT f.job_id, r.k, CASE
          WHEN f.status = 'new' AND action = 'submit' THEN 'queued'
          WHEN f.status = 'queued' AND action = 'cancel' THEN 'cancelled' WHEN f.status = 'queued' AND action = 'start' THEN 'running'
          WHEN f.status = 'running!' AND action IN ('finish', 'fail', 'start') THEN 'cancelled'
          WHEN f.status IN ('running', 'running!') AND action = 'cancel' THEN 'running!'
          WHEN f.status = 'running' AND action = 'finish' THEN 'completed' WHEN f.status = 'running' AND action = 'fail' THEN 'failed'
          ELSE f.status END, f.n, f.created_at, f.updated_at
        FROM f JOIN r ON r.job_id = f.job_id AND r.k = f.k + 1)
      SELECT job_id, replace(status, '!', '') AS status, created_at, updated_at, n AS n_events FROM f WHERE k = n AND status <> 'new'"""
    rendered = f"""SELECT x.*, count(*) OVER (PARTITION BY doc_id) AS n_rows, strftime(o_orderdate, '%d.%m.%Y') AS day, lpad(doc_id::VARCHAR, 9, '0') AS number FROM ({items}) x JOIN orders ON o_orderkey = doc_id"""
    out = {
        "t1_clean_invoice_text": f"SELECT doc_id, md5(array_to_string(list_filter({_clean_lines('text')}, lambda x: x <> ''), chr(10))) AS clean_md5 FROM ({noisy})",
        "t2_scan_lines": f"SELECT doc_id, line_no, md5(line) AS line_md5 FROM ({lines})",
        "t3_normalize_ocr": f"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t\\f\\v]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(160))) AS clean_md5 FROM ({noisy})",
        "t4_item_zone": f"""SELECT doc_id, md5(coalesce(array_to_string(l[list_position(list_transform(l, lambda x: len(x) - len(replace(x, '|', '')) >= 3), TRUE):], chr(10)), text)) AS zone_md5
          FROM (SELECT doc_id, text, CASE WHEN len(list_filter(string_split(text, chr(10)), lambda x: len(x) - len(replace(x, '|', '')) >= 3)) > 0 THEN string_split(text, chr(10)) END AS l FROM ({noisy}))""",
        "t5_empty_ocr": f"SELECT doc_id, len(regexp_replace(regexp_replace(text, '{_MD_IMAGE}', ' ', 'g'), '[^A-Za-zА-Яа-яЁё0-9]', '', 'g')) < 8 AS is_empty FROM ({noisy})",
        "t6_content_lines": f"SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(text, '{_MD_IMAGE}', ' ', 'g'), chr(10)), lambda x: lower({_FOLD.format('x')})), lambda x: x NOT IN ('', 'null', 'none', 'unknown', 'неизвестно', 'n/a', '-')))::INT AS n_lines FROM ({noisy})",
        "t7_header_block": f"""SELECT doc_id, len(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(substr(text, 1, CASE WHEN regexp_matches(text, '(?i)\\b(test\\s+report|report)\\b') THEN len(regexp_extract(text, '(?is)^(.*?)\\b(test\\s+report|report)\\b', 1)) ELSE 1800 END), '{_MD_IMAGE}', ' ', 'g'),
            '(?m)^#+\\s*', '', 'g'), '\\r\\n?', chr(10), 'g'), '[ \\t\\f\\v]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(160)))::INT AS n_chars FROM ({noisy})""",
        "t8_nullish": f"SELECT doc_id, CASE WHEN lower({_FOLD.format('text')}) NOT IN ('', 'null', 'none', 'unknown', 'неизвестно', 'n/a', '-') THEN md5({_FOLD.format('text')}) END AS text_md5 FROM ({noisy})",
        "t9_description": f"SELECT doc_id, md5(trim({_FOLD.format(chr(39).join(['regexp_replace(text, ', '<[^>]+>', ', ', ' ', ', ', 'g', ')']))}, ' .,')) AS text_md5 FROM ({noisy})",
        "scan_table_items": f"""SELECT doc_id, position, name AS description, hs_code, quantity::DOUBLE AS quantity, 'pcs' AS unit, price::DOUBLE AS price, cost::DOUBLE AS cost, c.country AS country_origin, c.code AS country_origin_code,
            number AS document_number, day AS document_date, 'USD' AS currency_code, 'US Dollar' AS currency_name, NULL::VARCHAR AS country_sender
          FROM ({rendered}) r JOIN (VALUES {codes}) AS c(i, code, country) ON r.country = c.i WHERE n_rows >= 2""",
        "p3_table_documents": f"SELECT doc_id FROM ({items}) GROUP BY 1 HAVING count(*) >= 2",
        "p4_row_blocks": f"SELECT doc_id, count(*) AS n_blocks FROM ({items}) GROUP BY 1",
        "p6_header_fields": f"SELECT DISTINCT doc_id, number AS document_number, day AS document_date, 'USD' AS currency_code, 'US Dollar' AS currency_name, NULL::VARCHAR AS country_sender FROM ({rendered})",
        "p2_numeric_tail": f"""SELECT doc_id, (position + 3)::INT AS line_no, TRUE AS is_position, TRUE AS has_tail, FALSE AS header_only FROM ({items})
          UNION ALL SELECT doc_id, unnest([0, 1, 2, 3]), FALSE, FALSE, unnest([FALSE, FALSE, FALSE, TRUE]) FROM (SELECT DISTINCT doc_id FROM ({items}))
          UNION ALL SELECT doc_id, (count(*) + 4)::INT, FALSE, FALSE, FALSE FROM ({items}) GROUP BY 1""",
        "p10_parse_number": expected([(c[0], c[1]) for c in _NUMBERS], "value", kinds=("DOUBLE",)),
        "n3_to_float": expected([(c[0], c[2]) for c in _NUMBERS], "value", kinds=("DOUBLE",)),
        "p11_units": expected(_UNITS, "unit"),
        "n4_round": "SELECT l_orderkey AS key, round(l_extendedprice / l_quantity, 6) AS value FROM lineitem",
        "n6_object_date": expected([(c[0], c[1]) for c in _DATES], "day"),
        "n7_technical_date": expected([(c[0], c[2]) for c in _DATES], "day"),
        "n8_default_date": expected([(c[0], c[1] or "01/02/2024") for c in _DATES], "day"),
        "n9_final_fields": expected([(c[0], c[1], bool(c[0])) for c in _DATES], "document_date", "meaningful"),
        "n1_infer_currency": """SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'RUB' WHEN 3 THEN 'USD' WHEN 4 THEN 'GBP' WHEN 6 THEN 'USD' WHEN 7 THEN (
            SELECT CASE WHEN v LIKE '%$%' THEN 'USD' WHEN lower(v) LIKE '%som%' THEN 'KGS' END FROM (SELECT substr(text, 1, 100) AS v)) END AS currency FROM documents""",
        "n5_currency_db_json": """SELECT n_regionkey, '[' || string_agg('{"code":"C' || n_nationkey || '","name":"' || n_name || '"}', ',' ORDER BY 'C' || n_nationkey) || ']' AS db FROM nation GROUP BY 1""",
        "n2_finalize": f"""SELECT doc_id, position, {_FOLD.format('description')} AS description,
            CASE position % 3 WHEN 0 THEN 'USD' WHEN 2 THEN 'EUR' ELSE CASE WHEN position % 2 = 1 THEN 'KGS' END END AS currency_code,
            CASE position % 3 WHEN 0 THEN 'US Dollar' WHEN 2 THEN 'Euro' ELSE CASE WHEN position % 2 = 1 THEN 'Kyrgyzstani Som' END END AS currency_name,
            CASE country_origin WHEN 'DE' THEN 'Германия' WHEN 'КИТАЙ' THEN 'Китай' ELSE country_origin END AS country_origin,
            CASE WHEN country_origin_code = 'kg' THEN 'KGZ' WHEN country_origin = 'DE' THEN 'DEU' WHEN country_origin = 'КИТАЙ' THEN 'CHN' ELSE country_origin_code END AS country_origin_code,
            'Германия' AS country_sender, coalesce(cost, round(quantity * price, 6)) AS cost, coalesce(price, round(cost / quantity, 6)) AS price FROM ({unfinished})""",
        "m6_resolve_currency": expected(_CODES, "code", "name"),
        "m7_country_name": expected([(c[0], c[1]) for c in _PLACES], "name"),
        "m8_country_alpha3": expected([(c[0], c[2]) for c in _PLACES], "alpha3"),
        "m9_country_numeric": expected([(c[0], c[3]) for c in _PLACES], "code"),
        "m10_country_from_numeric": expected(_NUMERIC, "name"),
        "m1_positional_merge": f"SELECT p.doc_id, p.position, {merged}, {updates} AS updates FROM ({sides}) p LEFT JOIN ({helper}) h USING (doc_id, position)",
        "m3_helper_modes": both_modes,
        "m3_scan_helper": f"""WITH m AS ({both_modes}),
          e AS (
            SELECT p.doc_id, p.position, {merged}, {updates} AS u, scan_mode FROM ({sides}) p JOIN m USING (doc_id) LEFT JOIN ({helper}) h ON h.doc_id = p.doc_id AND h.position = p.position WHERE coalesce(scan_mode, '') NOT IN ('rescue', 'override')
            UNION ALL SELECT h.doc_id, h.position, {swap}, {swap_updates}, scan_mode FROM ({helper}) h JOIN m USING (doc_id) LEFT JOIN ({sides}) p ON h.doc_id = p.doc_id AND h.position = p.position WHERE scan_mode IN ('rescue', 'override')),
          t AS (SELECT *, sum(u) OVER (PARTITION BY doc_id) AS total FROM e)
          SELECT doc_id, position, description, unit, quantity, hs_code, CASE WHEN scan_mode = 'merge' THEN CASE WHEN total > 0 THEN 'enrich' ELSE 'noop' END ELSE scan_mode END AS mode, total::BIGINT AS updates FROM t""",
        "m11_registry": f"SELECT doc_id, document_code, label, result_type, n_fields, CASE WHEN label IS NULL THEN 'failed' ELSE 'ok' END AS status FROM ({_plain(REQUESTS)}) LEFT JOIN {registry} USING (document_code)",
        "m12_header_currency": f"""WITH u AS ({unfinished}), h AS (SELECT doc_id, arg_min(currency_code, position) FILTER (WHERE currency_code IS NOT NULL) AS c FROM u GROUP BY 1)
          SELECT doc_id, position, coalesce(currency_code, c) AS currency_code FROM u JOIN h USING (doc_id)""",
        "g2_fingerprint": f"SELECT doc_id, position, {fp} AS fp FROM ({repeated})",
        "g3_first_by_slug": f"SELECT doc_id, position FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(description), quantity ORDER BY position) AS k FROM ({repeated})) WHERE k = 1",
        "g1_dedupe_recent": f"""WITH RECURSIVE r AS (SELECT doc_id, position, {fp} AS fp, count(*) OVER (PARTITION BY doc_id) AS n FROM ({repeated})),
          f AS (
            SELECT doc_id, 0 AS k, []::VARCHAR[] AS kept, []::INT[] AS places, n FROM r WHERE position = 1
            UNION ALL SELECT f.doc_id, k + 1, CASE WHEN list_contains(kept[-3:], r.fp) THEN kept ELSE list_append(kept, r.fp) END, CASE WHEN list_contains(kept[-3:], r.fp) THEN places ELSE list_append(places, r.position) END, f.n FROM f JOIN r ON r.doc_id = f.doc_id AND r.position = f.k + 1)
          SELECT doc_id, unnest(places) AS position FROM f WHERE k = n""",
        "a1_first_values": f"""SELECT doc_id, arg_min(description, position) FILTER (WHERE description IS NOT NULL) AS description, arg_min(quantity, position) FILTER (WHERE quantity IS NOT NULL) AS quantity,
            arg_min(hs_code, position) FILTER (WHERE hs_code IS NOT NULL) AS hs_code FROM ({sides}) GROUP BY 1""",
        "a2_fill_rates": " UNION ALL ".join(f"SELECT '{f}' AS field, round(avg(CASE WHEN {f} IS NOT NULL AND {f}::VARCHAR NOT IN ('', 'null', 'none') THEN 1 ELSE 0 END), 3) AS fill_rate, count(*) AS n FROM ({sides})" for f in ("description", "unit", "quantity", "hs_code")),
        "a3_token_usage": "SELECT user_id, name, sum(v)::BIGINT AS value FROM (SELECT user_id, 'calls' AS name, 1 AS v FROM events UNION ALL SELECT user_id, event_type, len(props) FROM events) GROUP BY 1, 2",
        "a4_item_count": f"SELECT doc_id, count(*) AS n_items FROM ({sides}) GROUP BY 1",
        "a5_any_chunk": f"SELECT doc_id, bool_or({good}) AS any_valid, sum(CASE kind WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 5 THEN 1 ELSE 0 END)::BIGINT AS n_items FROM ({responses}) GROUP BY 1",
        "a6_public_items": sides,
        "j1_json_array": f"SELECT doc_id, position, CASE kind WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 5 THEN 1 ELSE 0 END AS n FROM ({responses})",
        "j2_verdict": f"SELECT doc_id, position, 0 AS is_valid, CASE kind WHEN 0 THEN 'not array' WHEN 5 THEN 'not array' WHEN 4 THEN 'empty' ELSE 'invalid' END AS reason FROM ({responses})",
        "j3_invoice_items": f"""SELECT doc_id, position, CASE WHEN kind = 5 THEN name ELSE name || ' x' END AS description, CASE WHEN kind <> 5 THEN hs_code END AS hs_code, CASE WHEN kind <> 5 THEN quantity::DOUBLE END AS quantity,
            CASE WHEN kind <> 5 THEN 'USD' END AS currency_code, NULL::VARCHAR AS currency_name, CASE WHEN kind <> 5 THEN price::DOUBLE END AS price, CASE WHEN kind <> 5 THEN cost::DOUBLE END AS cost, {_given} FROM ({responses}) WHERE {good}""",
        "j4_technical_items": f"""SELECT doc_id, position, {good} AS is_valid, CASE WHEN {good} THEN '' ELSE 'refusal' END AS reason, CASE WHEN {good} THEN i::INT END AS item_no,
            CASE WHEN i = 1 THEN 'null' WHEN kind = 5 THEN name WHEN {good} THEN name || ' x' END AS product_name, CASE WHEN i = 1 THEN 'null' WHEN kind = 5 THEN name WHEN {good} THEN name || ' x' END AS technical_description,
            CASE WHEN i = 0 AND kind < 2 THEN hs_code END AS hs_code, CASE WHEN i = 0 AND kind < 2 THEN 'M' || position END AS model, CASE WHEN i = 0 AND kind < 2 THEN 'Китай' END AS country_origin,
            CASE WHEN i = 0 AND kind < 2 THEN '12.03.2024' END AS document_date, CASE WHEN i = 0 AND kind < 2 THEN 'N-' || doc_id END AS document_number
            FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 2 ELSE 1 END)) AS i FROM ({responses}))""",
        "j5_json_object": f"SELECT doc_id, position, CASE kind WHEN 1 THEN ' ' || name || '  x ' WHEN 5 THEN name END AS description FROM ({responses})",
        "j6_repaired_object": f"SELECT doc_id, position, CASE WHEN (doc_id + position) % 4 IN (0, 3) THEN position END AS n FROM ({broken})",
        "j7_deep_merge": f"""SELECT doc_id, position, CASE kind WHEN 0 THEN position WHEN 2 THEN NULL ELSE -1 END AS n, CASE WHEN kind IN (0, 3) THEN name WHEN kind = 1 THEN 'v' || doc_id END AS value,
            CASE WHEN kind IN (0, 1) THEN 1 WHEN kind = 3 THEN position END::INT AS a, CASE WHEN kind IN (0, 1) THEN '2020' END AS merged_list, '2021' AS code_list
            FROM (SELECT doc_id, position, name, ((doc_id + position) % 5)::INT AS kind FROM ({_plain(ITEMS)}))""",
        "j8_as_list": f"SELECT doc_id, position, CASE WHEN {good} THEN 1 ELSE 0 END AS n FROM ({responses})",
        "c1_invoice_chunks": _chunks(2000, 400, 1000),
        "c2_technical_chunks": _chunks(5000, 600, 2000),
        "c3_line_chunks": """SELECT doc_id, k::INT AS chunk_no, md5(array_to_string(l[k * 8 + 1:k * 8 + 8], chr(10))) AS chunk_md5 FROM (
            SELECT doc_id, l, unnest(range((len(l) - 1) // 8 + 1)) AS k FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents) WHERE len(l) > 0)""",
        "c4_overlap": f"SELECT key, greatest(0, least(CASE WHEN v = 'vllm' THEN 100 ELSE 600 END, greatest(0, key % 900 - 1)))::INT AS overlap FROM ({_plain(SPECS)})",
        "c5_chunk_settings": expected([(c[0], c[5], c[6]) for c in _SPECS], "size", "workers"),
        "c6_page_batches": "SELECT l_orderkey AS doc_id, (l_linenumber // 2)::INT AS batch_no, count(DISTINCT l_linenumber)::INT AS n_pages, max(l_linenumber) AS last_page FROM lineitem GROUP BY 1, 2",
        "f1_model_target": expected([c[:4] for c in _SPECS], "provider", "model_id", "error"),
        "f2_inferred_provider": expected([(c[0], c[4]) for c in _SPECS], "provider"),
        "f3_model_families": f"SELECT provider, string_agg(DISTINCT model_id, ',' ORDER BY model_id) AS models FROM ({expected([c[:4] for c in _SPECS], 'provider', 'model_id', 'error')}) WHERE provider IS NOT NULL GROUP BY 1",
        "f12_helper_target": expected([(c[0], c[7]) for c in _SPECS], "helper"),
        "f14_error_status": expected(_ERRORS, "status"),
        "f7_chunk_fallback": f"""WITH r AS ({responses}) SELECT a.doc_id, a.position, CASE WHEN a.kind IN (0, 1, 5) OR b.kind IN (0, 1, 5) THEN 1 ELSE 0 END AS n_items, a.kind NOT IN (0, 1, 5) AS asked_fallback
          FROM r a LEFT JOIN r b ON a.doc_id = b.doc_id AND b.position = a.position + 1""",
        "f8_document_fallback": f"SELECT doc_id, CASE WHEN bool_or({good} AND position % 2 = 1) THEN 'primary' WHEN bool_or({good} AND position % 2 = 0) THEN 'fallback' ELSE 'failed' END AS used FROM ({responses}) GROUP BY 1",
        "f9_first_good_attempt": f"SELECT doc_id, min(position) FILTER (WHERE kind IN (1, 5)) AS attempt, arg_min(CASE kind WHEN 1 THEN ' ' || name || '  x ' ELSE name END, position) FILTER (WHERE kind IN (1, 5)) AS description FROM ({responses}) GROUP BY 1",
        "f10_exception_fallback": f"SELECT doc_id, position, CASE WHEN (doc_id + position) % 4 = 3 THEN position ELSE -1 END AS n FROM ({broken})",
        "f13_execute": f"SELECT doc_id, CASE WHEN label IS NULL THEN 'unsupported document code ' || document_code ELSE '' END AS error, CASE WHEN label IS NULL THEN 'failed' ELSE 'success' END AS status FROM ({_plain(REQUESTS)}) LEFT JOIN {registry} USING (document_code)",
        "f15_prompt": f"SELECT doc_id, 'Extract from ' || label || ': ' || fields AS prompt FROM ({_plain(REQUESTS)}) JOIN {registry} USING (document_code)",
        "s1_requests": f"SELECT doc_id, document_code, NULL::VARCHAR AS ocr_draft, NULL::VARCHAR AS model FROM ({_plain(REQUESTS)})",
        "s6_model_list": expected(_LISTS, "models"),
        "s7_currency_json": "SELECT o_orderkey AS key, ord, code, name FROM orders, (VALUES (0, 'A', 'Aa'), (1, 'B', 'Bb')) AS c(ord, code, name) WHERE o_orderkey % 3 = 0",
        "s2_uploads": "SELECT doc_id, ['png', 'pdf', 'jpeg', 'txt', 'webp'][doc_id % 5 + 1] AS suffix, octet_length(encode(text))::INT AS n_bytes FROM documents",
        "s3_data_urls": "SELECT doc_id, md5('data:' || ['image/png', NULL, 'image/jpeg', NULL, 'image/webp'][doc_id % 5 + 1] || ';base64,' || base64(encode(text))) AS url_md5 FROM documents",
        "s5_visual_kind": "SELECT doc_id, ['image', 'pdf', 'image', 'unsupported', 'image'][doc_id % 5 + 1] AS kind FROM documents",
        "s8_json_results": f"""SELECT '{{"doc_id":' || doc_id || ',"position":' || position || ',"description":"' || description || '"}}' AS line FROM ({sides}) WHERE description IS NOT NULL""",
        "r1_iso_date": expected(_OCR_DATES, "day"),
        "r2_country_code": expected(_OCR_CODES, "code"),
        "r3_kind_codes": expected(_KINDS, "address_kind", "doc_kind", "entity"),
        "r4_legal_form": expected([c[:2] for c in _ORGS], "form"),
        "r5_organisation": expected([(c[0], c[2], c[3]) for c in _ORGS], "name", "noisy"),
        "r6_doc_id": expected(_IDS, "doc_id", "is_protocol"),
        "r12_country_of_place": expected(_CITIES, "by_city", "by_text"),
        "r7_doc_header": "SELECT s_suppkey AS key, 'ПРОТОКОЛ ИСПЫТАНИЙ' AS name, (200 + s_suppkey) || '/А' AS id, '2024-03-' || lpad((s_suppkey % 28 + 1)::VARCHAR, 2, '0') || 'T00:00:00' AS day FROM supplier",
        "r8_laboratory": "SELECT s_suppkey AS key, 'ТОО' AS form, 'ТОО «Лаборатория ' || s_suppkey || '»' AS name FROM supplier",
        "r9_accreditation": "SELECT s_suppkey AS key, 'Аттестат аккредитации' AS kind, 'KZ.T.' || (1000 + s_suppkey) AS id, '2021-02-01T00:00:00' AS start, '2026-02-01T00:00:00' AS valid, NULL::VARCHAR AS event FROM supplier",
        "r10_address": "SELECT s_suppkey AS key, '0' || (50000 + s_suppkey) AS post_code, ['Алматы', 'Бишкек', 'Минск'][s_suppkey % 3 + 1] AS city, 'Новая' AS street, s_suppkey::VARCHAR AS building FROM supplier",
        "r11_address_candidates": "SELECT s_suppkey AS key, 1 AS n FROM supplier",
        "r13_payload": """SELECT s_suppkey AS key, 'ПРОТОКОЛ ИСПЫТАНИЙ' AS doc_name, (200 + s_suppkey) || '/А' AS doc_id, '2024-03-' || lpad((s_suppkey % 28 + 1)::VARCHAR, 2, '0') || 'T00:00:00' AS doc_date, 'ТОО' AS lab_form,
            ['Алматы', 'Бишкек', 'Минск'][s_suppkey % 3 + 1] AS city, 'Model street' AS street, ['KZ', 'KG', 'BY'][s_suppkey % 3 + 1] AS country, 'KZ.T.' || (1000 + s_suppkey) AS certificate, '2021' AS code_list FROM supplier""",
        "w3_job_states": states,
        "a7_prune": f"""WITH j AS (SELECT * FROM ({states})), k AS (SELECT * FROM j WHERE NOT (status IN ('completed', 'failed', 'cancelled') AND epoch(TIMESTAMP '{NOW}') - epoch(updated_at) > 432000)),
          t AS (SELECT *, status IN ('completed', 'failed', 'cancelled') AS ended, count(*) OVER () AS n FROM k), o AS (SELECT *, row_number() OVER (PARTITION BY ended ORDER BY updated_at, created_at, job_id) AS nth FROM t)
          SELECT job_id, status FROM o WHERE NOT (ended AND nth <= n - 40)""",
        "w5_job_view": f"SELECT job_id, status, CASE WHEN job_id % 2 = 0 THEN 'gpt-x' ELSE 'gemini-2' END AS result_model_id, CASE WHEN job_id % 2 = 0 THEN 'openai' ELSE 'gemini' END AS final_provider, job_id % 2 = 0 AS fallback_used FROM ({states})",
    }
    return out


def _chunks(size: int, overlap: int, threshold: int) -> str:
    """Chunk ranges by a recursive query."""
    cut = f"len(substr(text, s + 1, {size})) - coalesce(nullif(position(chr(10) IN reverse(substr(text, s + 1, {size}))), 0), {size} + 1)"
    return f"""
      WITH RECURSIVE c AS (
        SELECT doc_id, text, 0 AS chunk_no, 0 AS s, CASE WHEN len(text) > {size} AND ({cut.replace('s + 1', '1')}) > {threshold} THEN {cut.replace('s + 1', '1')} ELSE least({size}, len(text)) END AS e FROM documents WHERE len(text) > 0
        UNION ALL
        SELECT doc_id, text, chunk_no + 1, s, CASE WHEN len(text) > s + {size} AND ({cut}) > {threshold} THEN s + ({cut}) ELSE least(s + {size}, len(text)) END
        FROM (SELECT doc_id, text, chunk_no, e - {overlap} AS s FROM c WHERE e < len(text)))
      SELECT doc_id, chunk_no, s::INT AS start, e::INT AS "end", md5(substr(text, s + 1, e - s)) AS chunk_md5 FROM c"""
