"""Operator 9, language ID by Bayesian evidence fusion.

log posterior = tempered log likelihood of the text (byte trigrams, naive Bayes) + log P(declared
markup language | language) + log P(address suffix | language) + log prior of the host. Host priors
are smoothed down a hierarchy: corpus, domain (last two labels), host. Each level's counts are the
text-and-markup posteriors of its rows summed by a grouped aggregation, plus ``strength`` pseudo-rows
in its parent's proportions. Only ids, hosts and four numbers per row are shuffled, never texts, and
sums are made map-side first, so a host with a third of the rows is one row per task.

The text model is fitted on a bounded sample: of each language, the ``per_language`` labelled
documents with the least hash of their id and text, read whole. Everything else is computed over all rows.

Texts of no language of the model are ``other``. Each labelled sample is scored by a model of the other
half of it; a language's floor is ``DEVIATIONS`` deviations below the median of these scores for each
trigram, where a text of n trigrams deviates as documents do and by 1/n of what single trigrams do. A
fifth class has the likelihood that the text would have on the floor of the language it exceeds most, or
falls short of least. A language of fewer than ``LEAST_FLOOR`` labelled documents has no floor.

Defined results. Null or empty text: the likelihood says nothing; the other evidence decides. No
evidence at all: the corpus prior decides and ``known`` is false. A missing host takes the corpus
prior. Ties go to the first language in alphabetical order. Repeated rows give one row each with the
same result; a null id is carried along. No training rows: the likelihood says nothing. An empty table
gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docloom.llm.common import arrow_map, slices, stage, utf8_list

LANGUAGES = ("de", "en", "es", "fr")
PER_LANGUAGE = 400
SLOTS = 1 << 16
TEMPER, AGREE, STRENGTH = 0.25, 0.9, 20.0
#: Country suffixes that speak for a language.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en"}
#: Deviations from the mean score of a language's texts to its floor; labelled documents that a floor takes.
DEVIATIONS, LEAST_FLOOR = 5.0, 8
OTHER, OTHER_PRIOR = "other", 0.1
#: A row's language is accepted at this posterior.
ACCEPT = 0.5

_UNSEEN_TAGS = re.compile(r"(?is)<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>|<[^>]*>")
_UNREAD = re.compile(r"(?is)<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>")
_LANG = re.compile(r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?\s*([a-z]{2,3})""")


def visible(page: str) -> str:
    return html_lib.unescape(_UNSEEN_TAGS.sub(" ", page))


def declared_language(page: str) -> str | None:
    """The language of the first html tag that has one, outside comments, scripts and the like."""
    if not _LANG.search(page):
        return None
    m = _LANG.search(_UNREAD.sub(" ", page))
    return m[1].lower() if m else None


def slots(text: bytes) -> np.ndarray:
    """Hashed byte trigrams of a text with white space folded and A-Z lowered."""
    b = np.frombuffer(b" " + b" ".join(text.lower().split()) + b" ", np.uint8).astype(np.uint32)
    x = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    return (x >> 16).astype(np.int64)


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, languages: tuple[str, ...], per_language: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot, language) log likelihoods from the bounded sample, even where nothing was seen; ``floors``."""
    table = np.full((2, SLOTS, len(languages)), 0.25)
    own = docs.where(F.col(lang_col).isin(list(languages)) & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    keyed = own.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("spot"), F.pmod(F.xxhash64(F.lit("half"), id_col), F.lit(2)).cast("int").alias("half"))
    # Of each language the hash of its last row in the sample: narrow columns are scanned and partial lists kept.
    bounds = [(lang, [r.spot for r in keyed.where(F.col("lang") == lang).select("spot").orderBy("spot").limit(per_language).collect()]) for lang in languages]
    picked = [(F.col("lang") == lang) & (F.col("spot") <= spots[-1]) for lang, spots in bounds if spots]
    sample = None
    if picked:
        last = picked[0]
        for more in picked[1:]:
            last = last | more
        sample = keyed.where(last).select("lang", "text", "half")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, SLOTS, len(languages)), np.int64)
        for part in slices(batches):
            for lang, text, half in zip(part.column(0).to_pylist(), utf8_list(part.column(1)), part.column(2).to_pylist(), strict=True):
                if text and text.strip():
                    seen[half, :, languages.index(lang)] += np.bincount(slots(text), minlength=SLOTS)
        half, at, lang = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(half), pa.array(at), pa.array(lang), pa.array(seen[half, at, lang])], ["half", "slot", "lang", "n"])

    if sample is not None:
        # By columns: a Python object for each of the counts would cost the driver some hundred bytes each.
        met = arrow_map(sample, counts, "half long, slot long, lang long, n long").groupBy("half", "slot", "lang").agg(F.sum("n").alias("n")).toArrow()
        half, at, lang, n = (met.column(c).to_numpy() for c in ("half", "slot", "lang", "n"))
        table[half, at, lang] += n
    logs = lambda t: np.log(t / t.sum(0)).astype(np.float32)
    return logs(table.sum(0)), floors(sample, logs(table[0] + 0.25), logs(table[1] + 0.25), languages)


def floors(sample: DataFrame | None, first: np.ndarray, second: np.ndarray, languages: tuple[str, ...]) -> np.ndarray:
    """(language, 3): mean score for each trigram of texts that the half's model did not see, variance of
    texts and of single trigrams; the mean is -inf without a floor."""
    out = np.tile([-np.inf, 0.0, 0.0], (len(languages), 1))
    if sample is None:
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for lang, text, half in zip(part.column(0).to_pylist(), utf8_list(part.column(1)), part.column(2).to_pylist(), strict=True):
                if text and text.strip():
                    x = (first if half else second)[slots(text), languages.index(lang)].astype(np.float64)
                    rows.append((languages.index(lang), x.mean(), x.var()))
            lang, mean, var = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int64()), pa.array(mean, pa.float64()), pa.array(var, pa.float64())], ["lang", "mean", "var"])

    scored = arrow_map(sample, run, "lang long, mean double, var double")
    seen = np.array([(r.lang, r.mean, r.var) for r in scored.select("lang", "mean", "var").collect()]).reshape(-1, 3)
    for i in range(len(languages)):
        _, mean, var = seen[seen[:, 0] == i].T
        if len(mean) >= LEAST_FLOOR:  # medians, as some labels are wrong
            out[i] = (np.median(mean), (1.4826 * np.median(np.abs(mean - np.median(mean)))) ** 2, np.median(var))
    return out


def evidence(rows: DataFrame, model: np.ndarray, limits: np.ndarray, languages: tuple[str, ...], is_html: bool) -> DataFrame:
    """rows (id, text, declared, host) -> (id, host, domain, declared, told, other, l0..): log evidence but for the host's."""
    kind = dict(rows.dtypes)["id"]
    count = len(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            out, declared, domains, told, others = [], [], [], [], []
            raw = part.column("text")
            texts = raw.to_pylist() if is_html else utf8_list(raw)
            for text, said, host in zip(texts, part.column("declared").to_pylist(), part.column("host").to_pylist(), strict=True):
                if is_html and text:
                    said = said or declared_language(text)
                    text = visible(text).encode("utf-8", "replace")
                score = np.zeros(count)
                has = bool(text and text.strip())
                if has:
                    at = slots(text)
                    score += TEMPER * model[at].sum(axis=0, dtype=np.float64)
                    floor = limits[:, 0] - DEVIATIONS * np.sqrt(limits[:, 1] + limits[:, 2] / len(at))
                    over = float((score - TEMPER * len(at) * floor).max())
                others.append(float(score.max()) - over if has and over < np.inf else -np.inf)
                said = said.lower()[:2] if said else None
                if said in languages:
                    score += np.log(np.where(np.arange(count) == languages.index(said), AGREE, (1 - AGREE) / (count - 1)))
                labels = host.lower().rstrip(".").split(".") if host else []
                suffix = SUFFIXES.get(labels[-1]) if len(labels) > 1 else None
                if suffix in languages:
                    score += np.log(np.where(np.arange(count) == languages.index(suffix), AGREE, (1 - AGREE) / (count - 1)))
                out.append(score)
                declared.append(said)
                domains.append(".".join(labels[-2:]) if labels else None)
                told.append(has or said in languages or suffix in languages)
            scores = np.array(out)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("host"), pa.array(domains, pa.string()), pa.array(declared, pa.string()), pa.array(told, pa.bool_()), pa.array(others, pa.float64()), *(pa.array(np.ascontiguousarray(scores[:, i])) for i in range(count))], ["id", "host", "domain", "declared", "told", "other", *(f"l{i}" for i in range(count))])

    return arrow_map(rows.select("id", "text", "declared", "host"), run, f"id {kind}, host string, domain string, declared string, told boolean, other double, " + ", ".join(f"l{i} double" for i in range(count)))


def _posterior(logs: list[F.Column]) -> list[F.Column]:
    top = F.greatest(*logs)
    powers = [F.exp(x - top) for x in logs]
    total = sum(powers[1:], powers[0])
    return [p / total for p in powers]


def fuse(seen: DataFrame, languages: tuple[str, ...], strength: float = STRENGTH) -> DataFrame:
    """Adds p0.. (posteriors with the host prior) and that of other texts, the last p, to ``evidence`` rows."""
    count = len(languages)
    soft = _posterior([F.col(f"l{i}") for i in range(count)])
    other = F.col("other") + math.log(OTHER_PRIOR)
    own = seen.where(F.col("told") & (other < F.greatest(*[F.col(f"l{i}") for i in range(count)]))).select("host", "domain", *[soft[i].alias(f"s{i}") for i in range(count)])
    by_host = own.groupBy("host", "domain").agg(*[F.sum(f"s{i}").alias(f"h{i}") for i in range(count)])
    by_domain = by_host.groupBy("domain").agg(*[F.sum(f"h{i}").alias(f"d{i}") for i in range(count)])
    row = by_domain.agg(*[F.sum(f"d{i}") for i in range(count)]).first()
    whole = np.array([1.0 + (x or 0.0) for x in row])
    whole /= whole.sum()
    total = lambda c: sum((F.col(f"{c}{i}") for i in range(1, count)), F.col(f"{c}0"))
    domains = by_domain.where("domain IS NOT NULL").select("domain", *[((F.col(f"d{i}") + float(strength * whole[i])) / (total("d") + strength)).alias(f"q{i}") for i in range(count)])
    hosts = by_host.join(domains, "domain").select("host", *[F.log((F.col(f"h{i}") + strength * F.col(f"q{i}")) / (total("h") + strength)).alias(f"a{i}") for i in range(count)])
    met = seen.join(hosts, "host", "left").select("*", *[F.lit(float(np.log(whole[i]))).alias(f"g{i}") for i in range(count)])
    final = _posterior([F.col(f"l{i}") + F.coalesce(F.col(f"a{i}"), F.col(f"g{i}")) for i in range(count)] + [other])
    return met.select("id", "host", "declared", "told", *[final[i].alias(f"p{i}") for i in range(count + 1)])


def identify(rows: DataFrame, labelled: DataFrame, languages: tuple[str, ...] = LANGUAGES, is_html: bool = False, per_language: int = PER_LANGUAGE, label_id: str = "doc_id", label_text: str = "text", label_lang: str = "lang") -> DataFrame:
    """rows (id, text, declared, host) -> id, lang, confidence, declared, known: one row per input row."""
    languages = tuple(sorted(languages))
    model, limits = fit(labelled, label_id, label_text, label_lang, languages, per_language)
    # Staged, else the choice below repeats the posteriors' terms until the generated code no longer compiles.
    fused = stage(fuse(stage(evidence(rows, model, limits, languages, is_html), "evidence"), languages), "fused")
    best = F.greatest(*[F.col(f"p{i}") for i in range(len(languages) + 1)])
    lang = F.lit(OTHER)
    for i in reversed(range(len(languages))):
        lang = F.when(F.col(f"p{i}") == best, F.lit(languages[i])).otherwise(lang)
    return fused.select("id", lang.alias("lang"), best.alias("confidence"), "declared", F.col("told").alias("known"))


def identify_pages(pages: DataFrame, labelled: DataFrame, **options) -> DataFrame:
    """pages (page_id, url, html) -> page_id, lang, confidence, declared, known."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    rows = pages.select(F.col("page_id").alias("id"), F.col("html").alias("text"), F.lit(None).cast("string").alias("declared"), F.when(host != "", host).alias("host"))
    return identify(rows, labelled, is_html=True, **options).withColumnRenamed("id", "page_id")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", accept: float = ACCEPT, **options) -> DataFrame:
    """``docs`` whose language is known with posterior ``accept`` or more, with it as their lang; the source is the host, lang the declaration."""
    # A row's own key: rows of one id may differ.
    row = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in (id_col, "lang", "source", "text")]))
    rows = docs.select(row.alias("id"), F.col("text"), F.col("lang").alias("declared"), F.col("source").alias("host"))
    found = identify(rows, docs, label_id=id_col, **options)
    good = found.where((F.col("confidence") >= accept) & F.col("known") & (F.col("lang") != OTHER)).groupBy(F.col("id").alias("good_row")).agg(F.first("lang").alias("good_lang"))
    # Text of no letter says nothing: a declaration alone does not keep a document.
    worded = docs.where(F.col("text").rlike(r"\p{L}")).withColumn("own_row", row)
    met = worded.join(good, F.col("own_row") == F.col("good_row"))
    return met.select(*[F.col("good_lang").alias(c) if c == "lang" else F.col(c) for c in docs.columns])
