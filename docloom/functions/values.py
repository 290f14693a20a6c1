"""Numbers, dates, countries, currencies and routing as column expressions (P10, N*, M6-M10, F*)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from docloom.functions.text import strip
from docloom.sources import dimensions as dim

FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def mapped(c: Column, table: dict) -> Column:
    """The value of a key in a small fixed map, null for another."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def first_of(*options: Column) -> Column:
    return F.coalesce(*options)


def parse_number(c: Column) -> Column:
    """P10: of comma and dot the later is decimal; one kind alone is, if it occurs once before 1 or 2 digits."""
    kept = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\d,.-]", "")
    comma, dot = F.instr(F.reverse(kept), ","), F.instr(F.reverse(kept), ".")
    both = F.when(comma < dot, F.replace(F.replace(kept, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(kept, F.lit(","), F.lit("")))
    one = lambda mark, spot: F.when((F.length(kept) - F.length(F.replace(kept, F.lit(mark), F.lit(""))) == 1) & spot.isin(2, 3), F.replace(kept, F.lit(mark), F.lit("."))).otherwise(F.replace(kept, F.lit(mark), F.lit("")))
    plain = F.when((comma > 0) & (dot > 0), both).when(comma > 0, one(",", comma)).when(dot > 0, one(".", dot)).otherwise(kept)
    return F.when(plain.rlike(FLOAT), plain.try_cast("double"))


def to_float(c: Column) -> Column:
    """Blanks dropped, a lone comma is a dot, otherwise a plain number or null."""
    text = F.regexp_replace(c, " ", "")
    text = F.when(F.contains(text, F.lit(",")) & ~F.contains(text, F.lit(".")), F.translate(text, ",", ".")).otherwise(text)
    return F.when(text.rlike(FLOAT), text.try_cast("double"))


def round6(c: Column) -> Column:
    return F.round(c, 6)


def object_date(c: Column) -> Column:
    """Strict day-month-year or ISO dates as dd/MM/yyyy, else the first such digits unchecked, else the text."""
    text = strip(c)
    parsed = None
    for pattern in ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy-M-d"):
        option = F.date_format(F.try_to_timestamp(text, F.lit(pattern)), "dd/MM/yyyy")
        parsed = option if parsed is None else F.coalesce(parsed, option)
    return F.when(text != "", F.coalesce(parsed, loose_date(text), text))


def loose_date(text: Column) -> Column:
    pattern = r"([0-9]{1,2})[./-]([0-9]{1,2})[./-]([0-9]{4})"
    part = lambda i: F.regexp_extract(text, pattern, i)
    return F.when(text.rlike(pattern), F.concat_ws("/", F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0"), part(3)))


def technical_date(c: Column) -> Column:
    """Null for nothing or NO_DATE_FOUND, else the first date's digits, else the text."""
    text = strip(c)
    return F.when((text != "") & (F.upper(text) != "NO_DATE_FOUND"), F.coalesce(loose_date(text), text))


def _countries() -> dict[str, dict]:
    rows = dim.country_rows()
    name = {a3: ru for _, a3, _, ru in rows}
    return {
        "ru": {i2: ru for i2, _, _, ru in rows} | name | {ru.upper(): ru for *_, ru in rows},
        "english": {k: name[v] for k, v in dim.ENGLISH.items()},
        "alpha3": {a3: a3 for _, a3, _, _ in rows} | {i2: a3 for i2, a3, _, _ in rows},
        "ru_alpha3": {ru.lower(): a3 for _, a3, _, ru in rows} | dim.ENGLISH,
        "numeric": {i2: n for i2, _, n, _ in rows},
        "ru_numeric": {ru.lower(): n for _, _, n, ru in rows},
        "by_numeric": {n: ru for _, _, n, ru in rows},
    }


_C = _countries()


def country_name(c: Column) -> Column:
    """M7: Russian name of an ISO code or a known name, else the value unchanged."""
    text = strip(c)
    return F.when(c == "", c).otherwise(F.coalesce(mapped(F.upper(text), _C["ru"]), mapped(F.lower(text), _C["english"]), c))


def country_alpha3(c: Column) -> Column:
    """M8: alpha-3 of an ISO code or a known name, else null."""
    text = strip(c)
    return F.coalesce(mapped(F.upper(text), _C["alpha3"]), mapped(F.lower(text), _C["ru_alpha3"]))


def country_numeric(c: Column) -> Column:
    """M9: numeric code of an alpha-2 code or a Russian name."""
    text = strip(c)
    return F.coalesce(mapped(F.upper(text), _C["numeric"]), mapped(F.lower(text), _C["ru_numeric"]))


def country_from_numeric(c: Column) -> Column:
    """Russian name of a numeric code."""
    return mapped(strip(c.cast("string")).try_cast("int"), _C["by_numeric"])


def infer_currency(c: Column, db: list[tuple[str, str]] = ()) -> Column:
    """Code by word, then symbol, then name stem, then the given table's codes and names; first in order."""
    upper, lower = F.upper(c), F.lower(F.regexp_replace(c, r"(?U)\s+", " "))
    options = [F.when(upper.rlike(f"(?<![A-Z]){code}(?![A-Z])"), F.lit(code)) for code in dim.CURRENCIES]
    options += [F.when(F.contains(c, F.lit(s)), F.lit(code)) for s, code in dim.SYMBOLS.items()]
    options += [F.when(F.contains(lower, F.lit(s)), F.lit(code)) for s, code in dim.CURRENCY_STEMS.items()]
    for code, name in db:
        options += [F.when(upper.rlike(f"(?<![A-Z]){code}(?![A-Z])"), F.lit(code)), F.when(F.contains(lower, F.lit(name.lower())), F.lit(code))]
    return F.coalesce(*options)


def resolve_currency(c: Column, db: list[tuple[str, str]]) -> Column:
    """M6: struct(code, name): an exact code, else the first row whose name contains the key, else (value, null)."""
    key = F.upper(strip(c))
    rows = [F.struct(F.lit(code).alias("code"), F.lit(name).alias("name")) for code, name in db]
    exact = [F.when(key == code, r) for (code, _), r in zip(db, rows, strict=True)]
    inside = [F.when(F.contains(F.lit(name.upper()), key), r) for (_, name), r in zip(db, rows, strict=True)]
    own = F.struct(c.alias("code"), F.lit(None).cast("string").alias("name"))
    return F.when(c.isNotNull() & (key != ""), F.coalesce(*exact, *inside, own))


def overlap_for(provider: Column, size: Column, default: int = 600, vllm: int = 0) -> Column:
    """C4: overlap of chunks, between 0 and size - 1."""
    raw = F.when(provider == "vllm", F.lit(vllm)).otherwise(F.lit(default))
    return F.greatest(F.lit(0), F.least(raw, F.greatest(F.lit(0), size - 1)))


def chunk_settings(provider: Column) -> Column:
    """struct(size, workers) of a provider, or the default's."""
    pair = lambda t: F.struct(F.lit(t[0]).alias("size"), F.lit(t[1]).alias("workers"))
    return F.coalesce(*[F.when(provider == k, pair(v)) for k, v in dim.PROVIDERS.items()], pair(dim.DEFAULT_CHUNK))


def inferred_provider(c: Column) -> Column:
    """provider of a bare model name by its form."""
    raw = F.lower(strip(c))
    return F.when(F.contains(raw, F.lit(":")), "ollama").when(raw.startswith("gpt-"), "openai").when(raw.startswith("gemini-"), "gemini").when(raw.startswith("llama"), "cerebras")


def model_target(c: Column, configured: dict[str, str], primary: str = "gemini") -> Column:
    """struct(provider, model_id, error) of a model specification; failures are rows, not exceptions."""
    raw = strip(F.when(F.coalesce(c, F.lit("")) == "", F.lit(primary)).otherwise(c))
    at = F.instr(raw, "::")
    provider, model = F.lower(strip(F.substring(raw, F.lit(1), at - 1))), strip(F.substring(raw, at + 2, F.length(raw)))
    text = lambda x: F.lit(x) if x is None or isinstance(x, str) else x
    out = lambda p, m, e: F.struct(text(p).cast("string").alias("provider"), text(m).cast("string").alias("model_id"), text(e).cast("string").alias("error"))
    split = F.when(~provider.isin(*dim.SUPPORTED), out(None, None, "unsupported provider")).when(model == "", out(None, None, "empty model id")).otherwise(out(provider, model, None))
    bare = F.coalesce(*[F.when(raw == k, out(k, v, None)) for k, v in configured.items()], out(None, None, "no models configured"))
    guess = inferred_provider(raw)
    return F.when(at > 0, split).when(raw.isin(*dim.SUPPORTED), bare).when(guess.isNotNull(), out(guess, raw, None)).otherwise(out(None, None, "unsupported model spec"))


# HTTP status by the first group with a phrase in the lower-cased error.
STATUS_PHRASES = [
    (429, ("rate limit", "too many requests", "429")),
    (504, ("timed out", "timeout")),
    (503, ("network error",)),
    (502, ("request failed for model",)),
    (400, ("unsupported", "empty ocr text", "empty model id", "no models configured")),
    (422, ("failed to parse structured response", "no invoice items extracted", "no fields extracted", "extraction failed for both primary and fallback models")),
]


def error_status(c: Column) -> Column:
    """F14."""
    low = F.lower(c)
    options = []
    for status, phrases in STATUS_PHRASES:
        hit = F.lit(False)
        for p in phrases:
            hit = hit | F.contains(low, F.lit(p))
        options.append(F.when(hit, F.lit(status)))
    return F.coalesce(*options, F.lit(500))


def is_empty_value(c: Column) -> Column:
    """Null, or text that trims to nothing, none, null or a dash."""
    return c.isNull() | F.lower(strip(c.cast("string"))).isin("", "none", "null", "-")


def is_meaningful(c: Column) -> Column:
    return c.isNotNull() & ~F.lower(strip(c.cast("string"))).isin("", "none", "null")
