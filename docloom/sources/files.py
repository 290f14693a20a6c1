"""File inputs and outputs (S2-S5, S8): uploads, images as data URLs, PDF pages, JSON results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Image types by suffix.
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp"}


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files under a path; they stay where they are."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def data_url(path: Column, content: Column) -> Column:
    """S3: an image as a data URL, null for another type."""
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv]), suffix(path))
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def visual_kind(path: Column) -> Column:
    """Image, pdf, or an error as a value."""
    s = suffix(path)
    return F.when(s == "pdf", "pdf").when(s.isin(*MIME), "image").otherwise("unsupported")


def pdf_pages(files: DataFrame, render: Callable[[bytes, float, int], list[bytes]], dpi: int = 150, most_pages: int = 20) -> DataFrame:
    """(path, page_no, url) of the first pages, by a renderer (content, scale, pages) -> PNGs that the caller brings."""
    scale = max(dpi, 72) / 72

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pages = render(content, scale, most_pages)[:most_pages]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(pages), pa.string()), pa.array(range(len(pages)), pa.int32()), pa.array(pages, pa.binary())], ["path", "page_no", "png"])

    pages = files.where(suffix(F.col("path")) == "pdf").select("path", "content").mapInArrow(run, "path string, page_no int, png binary")
    return pages.select("path", "page_no", data_url(F.lit("x.png"), F.col("png")).alias("url"))


def write_results(results: DataFrame, path: str) -> None:
    """One JSON object per row."""
    results.write.mode("overwrite").json(path)
