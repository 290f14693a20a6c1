"""Model calls as the one impure step (F4-F6, F11): a provider answers chunks, its answers become a table.

Answers should be written before anything is computed from them: a retried task asks again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


class Provider(Protocol):
    def generate(self, system: str, user: str, model: str) -> str: ...


class RetryLater(Exception):
    """A failure worth another try; ``after`` is the wait the server asked for, in seconds."""

    def __init__(self, message: str, after: float | None = None):
        super().__init__(message)
        self.after = after


def with_retries(call: Callable[[], str], attempts: int = 3, pause: Callable[[float], None] = time.sleep) -> str:
    """up to ``attempts`` tries, with the asked wait or twice the number of tries in between."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except RetryLater as e:
            if n == attempts:
                raise
            pause(e.after if e.after is not None else 2.0 * n)
    raise AssertionError


def ask(chunks: DataFrame, factory: Callable[[], Provider], system: str, model: str, attempts: int = 3) -> DataFrame:
    """chunks (doc_id, chunk_no, chunk) -> (doc_id, chunk_no, model, raw, error); the factory runs once a task."""
    kind = dict(chunks.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = factory()
        for batch in batches:
            raw, error = [], []
            for chunk in batch.column("chunk").to_pylist():
                try:
                    raw.append(with_retries(lambda c=chunk: provider.generate(system, c, model), attempts))
                    error.append(None)
                except Exception as e:  # a failed call is a row, never a failed job
                    raw.append(None)
                    error.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("chunk_no"), pa.array([model] * len(raw), pa.string()), pa.array(raw, pa.string()), pa.array(error, pa.string())], ["doc_id", "chunk_no", "model", "raw", "error"])

    return chunks.select("doc_id", "chunk_no", "chunk").mapInArrow(run, f"doc_id {kind}, chunk_no int, model string, raw string, error string")


def ask_with_fallback(chunks: DataFrame, primary: tuple, fallback: tuple, good: Callable[[DataFrame], DataFrame], system: str) -> DataFrame:
    """answers of the primary (factory, model); what ``good`` doesn't keep of them is asked of the fallback."""
    first = good(ask(chunks, *_order(primary, system)))
    rest = chunks.join(first.select("doc_id", "chunk_no"), ["doc_id", "chunk_no"], "left_anti")
    return first.withColumn("fallback_used", F.lit(False)).unionByName(ask(rest, *_order(fallback, system)).withColumn("fallback_used", F.lit(True)))


def _order(target: tuple, system: str) -> tuple:
    factory, model = target
    return factory, system, model
