"""Shared pieces of the training-data operators: staged tables, Arrow maps, word rules.

Staged tables are Parquet written under ``spark.checkpoint.dir`` (the folder all executors
share), so a plan that continues from one survives the loss of any executor. Only where that
setting is absent, as in local tests, a folder of our own is made.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: ASCII A-Z to a-z for the JVM side (``translate``); Python's bytes.lower() does the same on UTF-8.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for staged tables; one of our own only where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="docloom-"))
        atexit.register(shutil.rmtree, _OWN_DIR[0], True)
    return _OWN_DIR[0]


class Staged:
    """A table written to the shared folder. ``df`` reads it back; ``drop()`` removes the files."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        # The plan that wrote it is garbage now; collecting it lets Spark delete its shuffle files.
        self.spark._jvm.System.gc()

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of it (lineage ends there)."""
    return Staged(df, name).df


def bounded(df: DataFrame, most: int = 200_000) -> DataFrame:
    """``df`` marked for broadcast if it has ``most`` rows at most; left to a shuffled join beyond that."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def utf8_list(column) -> list[bytes | None]:
    """An Arrow string column as Python bytes, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return column.cast(pa.large_binary() if large else pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, so that work arrays stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def words_of(text: bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of UTF-8 bytes: bytes.split() parts at exactly these six characters."""
    return text.split() if text else []


def unsigned_to_long(values):
    """numpy uint64 seen as Spark's signed LONG."""
    return values.view("int64")
