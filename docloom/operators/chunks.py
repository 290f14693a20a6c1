"""Splitting texts into overlapping chunks, and grouping lines and pages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def spans(text: str, size: int, overlap: int, threshold: int) -> Iterator[tuple[int, int]]:
    """Chunk ranges: a chunk ends at its last line break if that lies beyond its start + threshold."""
    at, n = 0, len(text)
    while at < n:
        stop = min(at + size, n)
        if stop < n:
            cut = text.rfind("\n", at, stop)
            stop = cut if cut > at + threshold else stop
        yield at, stop
        at = stop - overlap if stop < n else n


def split_chunks(docs: DataFrame, size: int, overlap: int = 600, threshold: int | None = None, text_col: str = "text") -> DataFrame:
    """(doc_id, chunk_no, start, end, chunk). Overlaps that could stop progress are refused."""
    threshold = size // 2 if threshold is None else threshold
    if not 0 <= overlap <= threshold < size:
        raise ValueError("a chunk must get beyond the overlap")
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [
                    (doc, i, a, b, text[a:b])
                    for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
                    for i, (a, b) in enumerate(spans(text or "", size, overlap, threshold))
                ]
                kinds = [part.column(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string()]
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "chunk_no", "start", "end", "chunk"])

    return docs.select("doc_id", text_col).mapInArrow(run, f"doc_id {kind}, chunk_no int, start int, end int, chunk string")


def line_chunks(docs: DataFrame, items: int = 50, text_col: str = "text") -> DataFrame:
    """(doc_id, chunk_no, chunk): non-blank lines in groups of four times ``items``."""
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), lambda x: F.trim(x) != "")
    group = 4 * items
    starts = F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / group).cast("int"))
    parts = docs.select("doc_id", lines.alias("lines")).where(F.size("lines") > 0)
    return parts.select("doc_id", "lines", F.explode(starts).alias("chunk_no")).select("doc_id", "chunk_no", F.array_join(F.slice("lines", F.col("chunk_no") * group + 1, F.lit(group)), "\n").alias("chunk"))


def page_batches(pages: DataFrame, per_prompt: int) -> DataFrame:
    """(doc_id, batch_no, pages): consecutive pages, ``per_prompt`` at a time, in page order."""
    batch = F.floor(F.col("page_no") / per_prompt).cast("int").alias("batch_no")
    return pages.groupBy("doc_id", batch).agg(F.array_sort(F.collect_list("page_no")).alias("pages"))
