"""Interaction of document filters, from truth-table survival words.

A document fails some of at most five filters. Its survival word has a bit for each
of the 32 subsets of them: set if the document survives when just these filters
run. The number of survivors of every subset is then the positional popcount of
all words: carry-save adders turn many words into bit planes of their counts, in
batches, for each part and label; Spark adds the counts up. What any order of the
filters removes, repeats or alone catches follows from these 32 numbers.

Edge cases: a null text is an empty one; a null part is the part ''. A document
without a label is neither good nor toxic; several labels of one doc_id count if any
of them says so. A null doc_id is never a later copy and has no label; rows of equal
doc_id and text aren't later than each other. Repeated rows count each. A very long
text is one row. No documents: no rows.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

FILTERS = "ABCDE"
#: Words of a text are maximal runs of other characters than these.
BLANKS = r"[\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER, SYMBOLS = 50, 65, 5, "[#$%&*|]"
#: Words that wait in a task for their popcount, and keys whose counts wait to be sent.
WAITING, KEYS = 1 << 20, 1 << 12
#: Texts with more copies than this part of all rows are broadcast; there can't be as many of them.
HOT = 1000
#: survival word of each set of failed filters
WORDS = np.array([sum(1 << kept for kept in range(32) if not failed & kept) for failed in range(32)], np.uint32)
COUNTS = "part string, good boolean, toxic boolean, survivors array<long>"


def failures(text: Column) -> Column:
    """The failed ones of the filters A to D of a text, as bits from 1 on."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, BLANKS), "")
    n = F.size(words)
    fails = [n < LEAST_WORDS, 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n, 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > MOST_UPPER * F.length(text), text.rlike(SYMBOLS)]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def marked(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, good, toxic, failed (bits of all five filters) of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = written(docs.select(F.col("doc_id").alias("_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("_part"), F.unhex(F.sha2(text, 256)).alias("_text"), failures(text).alias("_failed")), "failures")
    copies = written(rows.groupBy("_text").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1"), "copies")
    hot = F.col("_n") > rows.count() / HOT
    # texts with very many copies are broadcast, and their rows are dealt out by their ids, which are no text's hash
    rows = rows.join(F.broadcast(copies.where(hot).select("_text", F.col("_first").alias("_early"))), "_text", "left")
    key = F.when(F.col("_early").isNull(), F.col("_text")).otherwise(F.unhex(F.md5(F.coalesce(F.col("_id").cast("string"), F.lit("")))))
    copies, rows = copies.where(~hot).select("_text", "_first"), rows.withColumn("_text", key)
    known = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    late = F.coalesce(F.when(F.coalesce("_early", "_first") < F.col("_id"), 1 << 4), F.lit(0))
    joined = rows.join(copies, "_text", "left").select("_id", "_part", (F.col("_failed") + late).alias("failed")).join(known, "_id", "left")
    return joined.select(F.col("_part").alias("part"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")], F.col("failed").cast("int").alias("failed"))


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit ``words`` have each bit set.

    planes[k] holds words whose bits weigh 2^k. Three of them are added by a carry-save adder to one of the same
    weight and a carry of twice that; at most two of a weight are left, whose bits are counted one by one.
    """
    counts, weight, plane = np.zeros(32, np.int64), 0, [np.asarray(words, np.uint32)]
    while plane:
        left, carries = np.concatenate(plane), []
        while len(left) > 2:
            third = len(left) // 3
            a, b, c, rest = left[:third], left[third : 2 * third], left[2 * third : 3 * third], left[3 * third :]
            either = a ^ b
            carries.append((a & b) | (either & c))
            left = np.concatenate([either ^ c, rest])
        counts += ((left[:, None] >> np.arange(32, dtype=np.uint32)) & 1).sum(0, dtype=np.int64) << weight
        weight, plane = weight + 1, carries
    return counts


def survivors(rows: DataFrame) -> DataFrame:
    """part, good, toxic, survivors (of each subset of the filters) from part, good, toxic, failed; one row each."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple, list[np.ndarray]] = {}
        sums: dict[tuple, np.ndarray] = {}
        n = 0

        def added() -> None:
            for key, words in waiting.items():
                sums[key] = sums.get(key, 0) + positional_popcount(np.concatenate(words))
            waiting.clear()

        def sent() -> pa.RecordBatch:
            keys = list(sums)
            columns = [pa.array([k[i] for k in keys], kind) for i, kind in enumerate((pa.string(), pa.bool_(), pa.bool_()))]
            out = pa.RecordBatch.from_arrays([*columns, pa.array([sums[k] for k in keys], pa.list_(pa.int64()))], names=["part", "good", "toxic", "survivors"])
            sums.clear()
            return out

        for b in batches:
            parts = b.column(0).dictionary_encode()
            key = parts.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 4
            key += b.column(1).to_numpy(zero_copy_only=False).astype(np.int64) * 2 + b.column(2).to_numpy(zero_copy_only=False)
            order = np.argsort(key, kind="stable")
            words = WORDS[b.column(3).to_numpy(zero_copy_only=False)[order]]
            found, starts = np.unique(key[order], return_index=True)
            names = parts.dictionary.to_pylist()
            for k, some in zip(found.tolist(), np.split(words, starts[1:]), strict=True):
                waiting.setdefault((names[k >> 2], bool(k & 2), bool(k & 1)), []).append(some)
            n += len(words)
            if n >= WAITING or len(waiting) >= KEYS:
                added()
                n = 0
            if len(sums) >= KEYS:
                yield sent()
        added()
        if sums:
            yield sent()

    partial = rows.select("part", "good", "toxic", "failed").mapInArrow(counted, COUNTS)
    each = partial.select("part", "good", "toxic", F.posexplode("survivors").alias("subset", "n"))
    total = each.groupBy("part", "good", "toxic", "subset").agg(F.sum("n").alias("n"))
    return total.groupBy("part", "good", "toxic").agg(F.transform(F.array_sort(F.collect_list(F.struct("subset", "n"))), lambda x: x["n"]).alias("survivors"))


def orders(names: str = FILTERS) -> list[dict]:
    """Every order of the filters and step in it, as subsets of their bits."""
    out = []
    for order in itertools.permutations(range(len(names))):
        before = 0
        for step, i in enumerate(order, 1):
            out.append({"filter_order": "".join(names[j] for j in order), "step": step, "own": 1 << i, "before": before, "after": before | 1 << i, "rest": (1 << len(names)) - 1 & ~(1 << i)})
            before |= 1 << i
    return out


def report(counts: DataFrame, names: str = FILTERS) -> DataFrame:
    """A row for each part, order and step from the survivors of subsets: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    everything = (1 << len(names)) - 1
    each = counts.select("part", "good", "toxic", F.posexplode("survivors").alias("subset", "n")).groupBy("part", "subset").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
    parts = each.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", "n", "good", "toxic"))).alias("s"))
    schema = "array<struct<filter_order string, step int, own int, before int, after int, rest int>>"
    rows = parts.select("part", "s", F.inline(F.from_json(F.lit(json.dumps(orders(names))), schema)))
    at = lambda subset, what="n": F.get("s", subset if isinstance(subset, Column) else F.col(subset))[what]
    removed = lambda what: at("before", what) - at("after", what)
    # a subset of k other filters stands before this one in k! (m - 1 - k)! orders
    weights = F.lit([factorial(k) * factorial(len(names) - 1 - k) for k in range(len(names))])
    others = F.filter(F.sequence(F.lit(0), F.lit(everything)), lambda x: x.bitwiseAND(F.col("own")) == 0)
    shapley = F.aggregate(others, F.lit(0).cast("long"), lambda total, x: total + F.get(weights, F.bit_count(x)) * (at(x) - at(x.bitwiseOR(F.col("own")))))
    return rows.select(
        "part", "filter_order", "step", at("after").alias("kept"), removed("n").alias("removed"), (at(F.lit(0)) - at("own") - removed("n")).alias("redundant"),
        (at("rest") - at(F.lit(everything))).alias("unique_fails"), removed("good").alias("good_lost"), removed("toxic").alias("toxic_lost"), shapley.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """The report of the five filters over all documents."""
    return report(survivors(marked(docs, labels, part)))
