"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import discarded, sent, shared_dir, written

__all__ = ["HOLD_OUT_MOD", "aside", "discarded", "held_out", "learnable", "partitions", "sent", "shared_dir", "slices", "small_batches", "table", "written"]

#: Rows and bytes of an Arrow batch of whole texts.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20

#: Rows whose crc32(doc_id as text) leaves this remainder are never learned from.
HOLD_OUT_MOD = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 5 is 0; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % HOLD_OUT_MOD == 0, F.lit(False))


def learnable(doc_id: Column) -> Column:
    """Rows that may be learned from: a doc_id that isn't null and isn't held out."""
    return doc_id.isNotNull() & ~held_out(doc_id)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs`` as they are; Arrow batches of this session's Python stages hold at most BATCH_ROWS rows and end at BATCH_BYTES.

    A worker's memory then follows the longest text, not the length of 10,000 texts. Smaller settings of the session stay.
    """
    conf = docs.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(str(conf.get(key)).rstrip("bB")) <= most:
            conf.set(key, str(most))
    return docs


def slices(batch: pa.RecordBatch, column: int, rows: int, size: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """A batch in parts of at most ``rows`` rows and ``size`` characters (one longer text alone), each with its texts."""
    texts, start = batch.column(column).to_pylist(), 0
    while start < len(texts):
        stop, chars = start, 0
        while stop < len(texts) and stop - start < rows and (stop == start or chars + len(texts[stop] or "") <= size):
            chars, stop = chars + len(texts[stop] or ""), stop + 1
        yield batch.slice(start, stop - start), texts[start:stop]
        start = stop


def aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """``docs`` without names that begin with an underscore, which operators use for their own columns.

    Also the new name of each renamed column, and a function that gives a result the old names back.
    """
    taken, names = {c.lower() for c in docs.columns}, {}
    for c in docs.columns:
        if c.startswith("_"):
            new = f"x{c}"
            while new.lower() in taken:
                new = f"x{new}"
            taken.add(new.lower())
            names[c] = new
    return docs.withColumnsRenamed(names), names, lambda out: out.withColumnsRenamed({v: k for k, v in names.items()})
