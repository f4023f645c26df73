"""Quartile bucket digests of documents.

Hashed triplets of a text's UTF-8 bytes are counted in 128 buckets. The digest
holds the text's length on a logarithmic scale (2 hex digits), the ratios of the
counts' quartiles (2 hex digits) and for each bucket the quartile that its
count falls into (2 bits). Likeness is one less a bounded difference score.

Edge cases: null counts as empty; an empty text has the digest of all-zero
counts. Equal texts have equal digests. Very long texts are counted in chunks.
Repeated rows are documents of their own: rows of one doc_id follow each other in
order of a hash of their text, equal ones in any order, which changes no result. No
documents: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, slices, small_batches, written

BUCKETS = 128
CHUNK, TEXTS = 1 << 20, 512
#: Each triplet: the first byte of a window and two of its next three.
TRIPLETS = [(1, 2, 2654435761), (1, 3, 2246822519), (2, 3, 3266489917)]
#: Weights of the parts of the difference score, whose sum of weights bounds it.
LENGTH_WEIGHT, RATIO_WEIGHT, BODY_WEIGHT = 0.1, 0.1, 0.8


def bucket_counts(raw: bytes) -> np.ndarray:
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(raw), CHUNK):
        b = np.frombuffer(raw[at : at + CHUNK + 3], np.uint8).astype(np.uint32)
        for j, k, mix in TRIPLETS:
            n = min(CHUNK, len(b) - k)
            if n > 0:
                code = ((b[:n] << 16) | (b[j : j + n] << 8) | b[k : k + n]) * np.uint32(mix)
                counts += np.bincount(code >> np.uint32(25), minlength=BUCKETS)
    return counts


def fingerprint(text: str | None) -> str:
    """Lowercase hex digest of a whole text."""
    raw = (text or "").encode("utf-8", "replace")
    counts = bucket_counts(raw)
    low, mid, high = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    length = min(255, round(8 * np.log2(1 + len(raw))))
    ratios = (int(15 * low / high) << 4 | int(15 * mid / high)) if high else 0
    codes = ((counts > low).astype(np.uint8) + (counts > mid) + (counts > high)).reshape(-1, 4)
    body = (codes[:, 0] << 6 | codes[:, 1] << 4 | codes[:, 2] << 2 | codes[:, 3]).astype(np.uint8)
    return f"{length:02x}{ratios:02x}{body.tobytes().hex()}"


def likeness(a: str, b: str) -> float:
    """1 for equal digests, down to 0: one less the bounded difference of lengths, quartile ratios and bucket quartiles."""
    x, y = (np.frombuffer(bytes.fromhex(d), np.uint8).astype(np.int64) for d in (a, b))
    length = min(1.0, abs(x[0] - y[0]) / 32)
    ratio = (min(4, abs((x[1] >> 4) - (y[1] >> 4))) + min(4, abs((x[1] & 15) - (y[1] & 15)))) / 8
    apart = sum(np.abs((x[2:] >> s & 3) - (y[2:] >> s & 3)).sum() for s in (0, 2, 4, 6))
    # digests of unrelated counts differ by 1.25 quartiles a bucket
    return float(1 - LENGTH_WEIGHT * length - RATIO_WEIGHT * ratio - BODY_WEIGHT * min(1.0, apart / (1.25 * BUCKETS)))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the digest of ``text`` added as ``fingerprint`` (a column of that name is replaced)."""
    docs = docs.drop("fingerprint")
    at = docs.columns.index(text)

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in slices(whole, at, TEXTS, CHUNK):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(fingerprint, texts), pa.string())], names=[*batch.schema.names, "fingerprint"])

    return small_batches(docs).mapInArrow(taken, T.StructType([*docs.schema.fields, T.StructField("fingerprint", T.StringType())]))


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
PART = f"{RESULT}, part int, first boolean, last boolean, text string"


def rows_of(items: list[tuple], part: int) -> pa.RecordBatch:
    fields = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.bool_(), pa.bool_(), pa.string()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "part", "first", "last", "text"]
    full = [(*x[:7], part, *x[7:]) for x in items]
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in full], f) for k, f in enumerate(fields)], names=names)


def compared(doc_id: int | None, text: str, print_: str, following: str, next_print: str) -> tuple:
    """The result's row for one document and the one that follows it."""
    new = edited(text, following)
    new_print = fingerprint(new)
    return doc_id, len(text), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), print_, new_print, likeness(print_, new_print), likeness(print_, next_print)


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each with the next one's text. The first row of a partition also brings its text; the last one brings only that."""
    part, first, before, out = TaskContext.get().partitionId(), True, None, []
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            here = (doc_id, text, fingerprint(text))
            if before is not None:
                out.append((*compared(*before, *here[1:]), first, False, before[1] if first else None))
                first = False
            before = here
            if len(out) >= 512:
                yield rows_of(out, part)
                out = []
    if before is not None:
        out.append((before[0], len(before[1]), None, before[2], None, None, None, first, True, before[1]))
    if out:
        yield rows_of(out, part)


def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last rows of the partitions, each joined by the first row of the next partition."""
    for batch in batches:
        found = [compared(*x) for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        yield rows_of([(*x, False, True, None) for x in found], 0)


def with_next(docs: DataFrame) -> DataFrame:
    """Digests of every document, of its edited text (see ``edited``) and likeness to that and to the next document.

    The next document follows in descending doc_id (null ids last, equal ids by a
    hash of the text); the first one follows the last. Documents are sorted into
    ranges with one shuffle, in which rows of one id and even equal rows are dealt
    out too; only the first and last text of each range, two a partition, are
    joined across ranges. No documents: no rows.
    """
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc(), F.xxhash64("text"), F.col("from")]
    ranged = rows.withColumn("from", F.spark_partition_id()).repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    parts = written(ranged.select("doc_id", "text").mapInArrow(chained, PART), "digests")
    firsts = parts.where("first").select("part", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    ids = parts.where("first").select("part")  # one row a range, as small as the number of partitions
    following = ids.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next_part"))
    ends = parts.where("last").join(following, "part").join(firsts.withColumnRenamed("part", "next_part"), "next_part")
    ends = ends.select("doc_id", "text", "fingerprint", "next_text", "next_print").mapInArrow(closed, PART)
    names = [x.split()[0] for x in RESULT.split(", ")]
    return parts.where("not last").select(names).unionByName(ends.select(names))
