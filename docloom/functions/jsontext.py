"""JSON inside model responses as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from docloom.functions.text import fold, strip

# Keys of items that are kept as they are.
ITEM_NUMBERS = ("quantity", "price", "cost")
ITEM_TEXTS = ("unit", "country_origin", "country_origin_code", "country_sender", "document_number", "document_date")
TECHNICAL_TEXTS = ("model", "country_origin", "document_date", "document_number")


def unfenced(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"(?i)^```(?:json)?", ""), r"```$", ""))


def repaired(c: Column) -> Column:
    """Trailing commas dropped, Python literals as JSON."""
    out = F.regexp_replace(c, r",\s*([}\]])", "$1")
    for old, new in (("None", "null"), ("True", "true"), ("False", "false")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _balanced(found: Column) -> Column:
    def of_bare(bare: Column) -> Column:
        rest = lambda mark: F.length(F.replace(bare, F.lit(mark), F.lit("")))
        return (rest("{") == rest("}")) & (rest("[") == rest("]"))

    return let(F.regexp_replace(found, r'"(?:[^"\\]|\\.)*"', ""), of_bare)


def _span(c: Column, pattern: str) -> Column:
    """The first match, if its brackets balance (the parser would accept what follows a value)."""
    return let(F.nullif(F.regexp_extract(c, pattern, 0), F.lit("")), lambda found: F.when(_balanced(found), found))


def _parsed(c: Column, pattern: str) -> Column:
    return F.try_parse_json(_span(c, pattern))


def _from_bracket(c: Column) -> Column:
    return F.regexp_replace(c, r"^[^{}\[\]]*", "")


def _listed(c: Column) -> Column:
    return F.try_variant_get(_parsed(c, r"(?s)\[.*\]"), "$", "array<variant>")


def _items_or_one(c: Column) -> Column:
    """An object's items, else the object alone, else null."""
    return let(_parsed(c, r"(?s)\{.*\}"), lambda one: F.coalesce(F.try_variant_get(one, "$.items", "array<variant>"), F.when(one.isNotNull(), F.array(one))))


def json_array(c: Column) -> Column:
    """array<variant> in a text: a bracketed list, else an object's items, else the object alone, else none."""
    none = F.array().cast("array<variant>")
    return let(_from_bracket(F.coalesce(strip(c), F.lit(""))), lambda text: F.coalesce(_listed(text), _items_or_one(text), none))


def json_object(c: Column) -> Column:
    """Variant of the text from the first to the last brace, null if it does not parse."""
    return _parsed(F.coalesce(c, F.lit("")), r"(?s)\{.*\}")


def repaired_object(c: Column) -> Column:
    """Like J5 without code fences, with a second try after repair; an empty object otherwise."""
    tried = lambda text: F.coalesce(_parsed(text, r"(?s)\{.*\}"), _parsed(repaired(text), r"(?s)\{.*\}"), F.parse_json(F.lit("{}")))
    return let(unfenced(F.coalesce(c, F.lit(""))), tried)


def text_of(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "string")


def _is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def _said(c: Column) -> Column:
    return F.when(~F.lower(strip(c)).isin("none", "null", ""), c)


def invoice_items(c: Column) -> Column:
    """The response's items that have a description, with all thirteen fields; a missing one is null."""
    kept = F.filter(json_array(c), lambda v: _is_object(v) & _said(text_of(v, "description")).isNotNull())

    def clean(v: Column) -> Column:
        made = {
            "description": fold(text_of(v, "description")),
            "hs_code": _said(text_of(v, "hs_code")),
            "currency_code": F.nullif(F.upper(strip(text_of(v, "currency_code"))), F.lit("")),
            "currency_name": F.nullif(strip(text_of(v, "currency_name")), F.lit("")),
        }
        made |= {k: F.try_variant_get(v, f"$.{k}", "double") for k in ITEM_NUMBERS} | {k: text_of(v, k) for k in ITEM_TEXTS}
        return F.struct(*[x.alias(k) for k, x in made.items()])

    return F.transform(kept, clean)


def invoice_verdict(c: Column) -> Column:
    """struct(is_valid, reason) of a response that should be a list of items."""
    good = lambda v: _is_object(v) & (F.coalesce(strip(text_of(v, "description")), F.lit("")) != "")

    def of_items(items: Column) -> Column:
        return F.when(items.isNull(), "not array").when(~F.exists(items, good), "no valid items").otherwise("")

    def of_parsed(parsed: Column) -> Column:
        return F.when(parsed.isNull(), "invalid").otherwise(let(F.try_variant_get(parsed, "$", "array<variant>"), of_items))

    def of_text(text: Column) -> Column:
        whole = F.when(text.rlike(r"(?s)^[\[{]"), text)
        return F.when(text == "", "empty").otherwise(let(F.try_parse_json(F.when(_balanced(whole), whole)), of_parsed))

    return let(let(unfenced(F.coalesce(c, F.lit(""))), of_text), lambda reason: F.struct((reason == "").cast("int").alias("is_valid"), reason.alias("reason")))


def technical_items(c: Column) -> Column:
    """struct(is_valid, reason, items): unlike J3 a response without JSON is invalid, a short one as a refusal."""
    names = ("product_name", "technical_description")

    def named(v: Column) -> Column:
        name = lambda said, key: F.nullif(fold(F.coalesce(F.nullif(text_of(v, key), F.lit("")), said)), F.lit(""))
        return let(text_of(v, "description"), lambda said: F.struct(v.alias("v"), *[name(said, k).alias(k) for k in names]))

    def clean(x: Column) -> Column:
        made = {k: x[k] for k in names} | {"hs_code": _said(text_of(x["v"], "hs_code"))}
        made |= {k: text_of(x["v"], k) for k in TECHNICAL_TEXTS}
        return F.struct(*[y.alias(k) for k, y in made.items()])

    def of_text(text: Column) -> Column:
        found = let(_from_bracket(text), lambda t: F.when(t.rlike(r"(?s)\[.*\]"), _listed(t)).otherwise(_items_or_one(t)))
        short = F.length(text) < 200

        def of_found(items: Column) -> Column:
            reason = F.when(items.isNotNull(), "").when(short, "refusal").otherwise("unparsable")
            kept = F.filter(F.transform(F.filter(items, _is_object), named), lambda x: x[names[0]].isNotNull() | x[names[1]].isNotNull())
            return F.struct(items.isNotNull().alias("is_valid"), reason.alias("reason"), F.transform(kept, clean).alias("items"))

        return let(found, of_found)

    return let(F.coalesce(strip(c), F.lit("")), of_text)


def deep_merge(base: Column, over: Column, shape: dict[str, object], path: str = "$") -> Column:
    """Struct of two variants' fields, ``over`` winning at every depth.

    shape names the fields: a nested dict for an object, a type for a value. A null or a value that ``over``
    has in the place of an object replaces the object; only what it doesn't have comes from ``base``.
    """
    at = lambda v, p: F.try_variant_get(v, p, "variant")

    def one(name: str, kind: object) -> Column:
        place = f"{path}.{name}"
        if isinstance(kind, dict):
            replaced = at(over, place).isNotNull() & ~F.coalesce(_is_object(at(over, place)), F.lit(False))
            kept = F.when(~replaced, base)
            return deep_merge(kept, over, kind, place)
        return F.when(at(over, place).isNotNull(), F.try_variant_get(over, place, kind)).otherwise(F.try_variant_get(base, place, kind))

    return F.struct(*[one(name, kind).alias(name) for name, kind in shape.items()])


def as_list(v: Column) -> Column:
    """A list itself, an object as a list of one, anything else as none."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(_is_object(v), F.array(v)), F.array().cast("array<variant>"))
