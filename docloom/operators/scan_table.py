"""Table-like invoices in scanned text: lines, row blocks, header fields and items."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from docloom.functions import text as tx
from docloom.functions.values import mapped
from docloom.sources import dimensions as dim

POSITION = r"^\d{1,4}(?:[.)]|\s)"
HS_CODE = r"(?<!\d)\d{8,12}(?!\d)"
DATE = r"\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b"
MONTHS = "января|февраля|марта|апреля|мая|июня|июля|августа|сентября|октября|ноября|декабря"
MONTH_DATE = rf"(?iu)\b\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}}\b"
NUMBER = r"(?iu)(?:invoice|инвойс|счет[- ]?фактура|счет)\D{0,30}(?:№|no\.?|n[oо]\.?)\s*([A-Za-z0-9./_-]{3,})"
CURRENCY = r"(?i)\b(" + "|".join(dim.SCAN_CURRENCIES) + r")\b"
HEADER_LINES = 60
_TEXT, _NUMBER = T.StringType(), T.DoubleType()
ITEM = T.StructType(
    [
        T.StructField("position", T.IntegerType()),
        *[T.StructField(n, k) for n, k in (("description", _TEXT), ("quantity", _NUMBER), ("unit", _TEXT), ("cost", _NUMBER), ("price", _NUMBER))],
        *[T.StructField(n, _TEXT) for n in ("hs_code", "country_origin", "country_origin_code")],
    ]
)


def lines(docs: DataFrame, text_col: str = "ocr_text") -> DataFrame:
    """(doc_id, line_no, line): the non-empty lines of each text."""
    return docs.select("doc_id", F.posexplode(tx.scan_lines(F.col(text_col))).alias("line_no", "line"))


def _marks(line: Column) -> dict[str, Column]:
    """What P3 and P4 ask of a line."""
    low = F.lower(line)
    return {"starts": line.rlike(POSITION), "tail": tx.numeric_tail(line), "marker": tx.has_any(low, dim.HEADER_MARKERS), "total": tx.has_any(low, dim.TOTAL_MARKERS)}


def _is_table(rows: Column, tails: Column, header: Column) -> Column:
    return ((rows >= 5) & (tails >= 3)) | ((rows >= 2) & (tails >= 2) & header)


def table_documents(lines_: DataFrame) -> DataFrame:
    """Ids of the documents with enough position lines and numeric tails."""
    marks = _marks(F.col("line"))
    facts = lines_.groupBy("doc_id").agg(F.count_if(marks["starts"]).alias("rows"), F.count_if(marks["tail"]).alias("tails"), F.bool_or(marks["marker"]).alias("header"))
    return facts.where(_is_table(F.col("rows"), F.col("tails"), F.col("header"))).select("doc_id")


def _placed(marked: DataFrame) -> DataFrame:
    """Lines with the block that they are in and whether a total line came."""
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("block", F.sum(F.col("starts").cast("int")).over(order)).withColumn("stopped", F.max("total").over(order))


def row_blocks(lines_: DataFrame) -> DataFrame:
    """(doc_id, block, row): each position line with its continuations, up to the first total line."""
    marks = _marks(F.col("line"))
    marked = lines_.select("doc_id", "line_no", "line", marks["starts"].alias("starts"), marks["total"].alias("total"), tx.header_only(F.col("line")).alias("header"))
    kept = _placed(marked).where("NOT stopped AND block > 0 AND (starts OR NOT header)")
    rows = kept.groupBy("doc_id", "block").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("parts"))
    return rows.select("doc_id", "block", F.array_join(F.col("parts.line"), " ").alias("row"))


def _header(head: Column) -> dict[str, Column]:
    """Fields of a document's first lines, joined by line breaks."""
    found = lambda pattern, group=0: F.nullif(F.regexp_extract(head, pattern, group), F.lit(""))
    code = F.upper(found(CURRENCY, 1))
    sender = F.coalesce(*[F.when(F.contains(F.lower(head), F.lit(a)), F.lit(dim.SCAN_COUNTRIES[c])) for a, c in dim.SCAN_ALIASES.items()])
    return {
        "document_number": found(NUMBER, 1),
        "document_date": F.coalesce(found(DATE), found(MONTH_DATE)),
        "currency_code": code,
        "currency_name": mapped(code, dim.SCAN_CURRENCIES),
        "country_sender": sender,
    }


def header_fields(lines_: DataFrame) -> DataFrame:
    """Document number, date, currency and sender from the first lines of each document."""
    top = lines_.where(F.col("line_no") < HEADER_LINES).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("parts"))
    t = top.select("doc_id", F.array_join(F.col("parts.line"), "\n").alias("head"))
    return t.select("doc_id", *[v.alias(k) for k, v in _header(F.col("head")).items()])


# --- one row's text, read from the right (P7-P12) ---

_DIGITS = re.compile(r"[\d.,]+")
_JUNK = "()[]{};,"
_EDGE = " -|,.;:"
_ALIAS = [(a, re.compile(rf"\b{re.escape(a)}\b"), c) for a, c in dim.SCAN_ALIASES.items()]

_RUN = re.compile(r"\d+")
_HS = re.compile(HS_CODE)
_COUNTRY = {c: (re.compile(rf"(?i)\b{c}\b"), re.compile(f"(?i){re.escape(name)}")) for c, name in dim.SCAN_COUNTRIES.items()}


def number_value(digits: str) -> float | None:
    """P10 for one token."""
    comma, dot = digits.rfind(","), digits.rfind(".")
    if comma >= 0 and dot >= 0:
        decimal = "," if comma > dot else "."
    else:
        only = "," if comma >= 0 else "."
        decimal = only if digits.count(only) == 1 and len(digits) - max(comma, dot) in (2, 3) else ""
    kept = "".join("." if c == decimal else c for c in digits if c.isdigit() or c == decimal)
    try:
        return float(kept)
    except ValueError:
        return None


def _one_number(parts: list[str]) -> bool:
    """Whether neighbouring tokens can be one number written with blanks."""
    if not all(_DIGITS.fullmatch(p) for p in parts):
        return False
    if len(parts) == 1 or any(not p.isdigit() for p in parts):
        return True
    return len(parts[0]) <= 3 and all(len(p) == 3 for p in parts[1:])


def pop_number(tokens: list[str], most: float) -> float | None:
    """The right-most number of up to three tokens; it and all to its right leave the list."""
    bare = [t.strip(_JUNK) for t in tokens]
    last = max((i for i, t in enumerate(bare) if _DIGITS.fullmatch(t)), default=-1)
    for first in range(max(0, last - 2), last + 1):
        parts = bare[first : last + 1]
        value = number_value("".join(parts)) if _one_number(parts) else None
        if value is not None and value <= most:
            del tokens[first:]
            return value
    return None


def origin(body: str) -> tuple[str | None, str | None]:
    low = body.lower()
    code = next((c for alias, pattern, c in _ALIAS if alias in low and pattern.search(low)), None)
    if code is None:
        codes = (t.strip("()[]{};,.").upper() for t in body.split())
        code = next((c for c in codes if c in dim.SCAN_COUNTRIES), None)
    return (dim.SCAN_COUNTRIES[code], code) if code else (None, None)


def parse_row(row: str) -> tuple | None:
    """A row block's item in the order of ITEM, or None."""
    m = re.match(r"\s*(\d{1,4})(?:[.)]|\s+)", row)
    body = row[m.end() :].strip() if m else ""
    if not body:
        return None
    country, code = origin(body)
    hs = (_HS.findall(body) or [None])[-1]
    tokens = body.split()
    cost = pop_number(tokens, 1e9)
    price = pop_number(tokens, 1e9)
    unit = dim.UNITS.get(tokens[-1].lower()) if tokens else None
    if unit:
        tokens.pop()
    quantity = pop_number(tokens, 1e6)
    description = " ".join(tokens).strip(_EDGE)
    if hs:
        # A pattern of each row's own code would be compiled for each row.
        description = _RUN.sub(lambda run: " " if run[0] == hs else run[0], description)
    for pattern in _COUNTRY.get(code, ()):
        description = pattern.sub(" ", description)
    description = " ".join(description.split()).strip(_EDGE) or " ".join(body.split()).strip(_EDGE)
    if not description:
        return None
    return int(m[1]), description, quantity, unit, cost, price, hs, country, code


def parse_rows(rows: DataFrame) -> DataFrame:
    """Items of (doc_id, block, own, row), each row read once; own's fields become columns."""
    own = rows.schema["own"].dataType.fields
    schema = T.StructType([rows.schema["doc_id"], rows.schema["block"], *ITEM.fields, *own])
    kinds = [{T.IntegerType(): pa.int32(), _TEXT: pa.string(), _NUMBER: pa.float64()}[f.dataType] for f in ITEM.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [parse_row(r) for r in batch.column("row").to_pylist()]
            kept = pa.array([x is not None for x in parsed], pa.bool_())
            columns = list(zip(*filter(None, parsed), strict=True)) or [()] * len(kinds)
            carried = batch.filter(kept)
            arrays = [carried.column("doc_id"), carried.column("block"), *map(pa.array, columns, kinds), *carried.column("own").flatten()]
            yield pa.RecordBatch.from_arrays(arrays, schema.fieldNames())

    return rows.select("doc_id", "block", "own", "row").mapInArrow(run, schema)


def scan_table_items(docs: DataFrame, text_col: str = "ocr_text") -> DataFrame:
    """Items with the header's fields, of documents that look like a scanned table.

    The texts are read once: header fields go along with each line, and what P3 asks is counted over the lines
    in the same pass that tells P4's blocks.
    """
    cut = docs.select("doc_id", tx.scan_lines(F.col(text_col)).alias("every"))
    head = cut.select("doc_id", "every", F.array_join(F.slice("every", 1, HEADER_LINES), "\n").alias("head"))
    own = head.select("doc_id", "every", F.struct(*[v.alias(k) for k, v in _header(F.col("head")).items()]).alias("own"))
    each = own.select("doc_id", "own", F.posexplode("every").alias("line_no", "line"))
    marked = each.select("doc_id", "own", "line_no", "line", *[v.alias(k) for k, v in _marks(F.col("line")).items()])
    whole = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    facts = _is_table(F.count_if("starts").over(whole), F.count_if("tail").over(whole), F.bool_or("marker").over(whole))
    kept = _placed(marked.withColumn("is_table", facts)).where("is_table AND NOT stopped AND block > 0 AND (starts OR NOT (marker AND NOT tail))")
    rows = kept.groupBy("doc_id", "block").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("parts"), F.first("own").alias("own"))
    return parse_rows(rows.select("doc_id", "block", "own", F.array_join(F.col("parts.line"), " ").alias("row")))
