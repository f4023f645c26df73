"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of each whole text are taken in Arrow batches; the trees are complete
binary trees flattened into arrays, so that a batch goes down all trees at once
in numpy. Fitting uses a bounded sample of labelled rows (about ``max_rows``).

Edge cases: a null text counts as empty, and empty texts are scored like any
other. Several labels of one doc_id count as their mean, rounded up at 0.5. Very
long texts are counted in chunks; repeated rows are scored alike. If nothing can be
learned, every score is 0.5. No documents: no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import learnable, sent, slices, small_batches

CHUNK = 1 << 22
TEXTS = 1024
KINDS = 9
LOWER, UPPER, DIGIT, SPACE, NEWLINE, STOP, MARK, SYMBOL, WIDE = range(KINDS)


def byte_kind(b: int) -> int:
    c = chr(b)
    if b >= 128:
        return WIDE
    if c == "\n":
        return NEWLINE
    for kind, chars in ((STOP, ".?!"), (MARK, ",;:'\"()-")):
        if c in chars:
            return kind
    return LOWER if c.islower() else UPPER if c.isupper() else DIGIT if c.isdigit() else SPACE if c.isspace() else SYMBOL


KIND_OF = np.array([byte_kind(b) for b in range(256)], np.uint8)
STATISTICS = ["log_chars", "upper", "digits", "spaces", "newlines", "stops", "marks", "symbols", "wide", "exclamations", "bars", "word_chars", "long_words", "short_words", "distinct_words", "repeated_next", "distinct_lines", "words_a_line", "top_word"]


def statistics(text: str | None) -> list[float]:
    """The values of STATISTICS for one whole text; all zero for an empty one."""
    if not text:
        return [0.0] * len(STATISTICS)
    raw = text.encode("utf-8", "replace")
    kinds = np.zeros(KINDS, np.int64)
    for at in range(0, len(raw), CHUNK):
        kinds += np.bincount(KIND_OF[np.frombuffer(raw, np.uint8, min(CHUNK, len(raw) - at), at)], minlength=KINDS)
    n, letters = len(raw), max(1, kinds[LOWER] + kinds[UPPER] + kinds[WIDE])
    words, lines = text.split(), text.split("\n")
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    seen = len(words) or 1
    distinct = Counter(words)
    common = max(distinct.values(), default=0)
    return [
        float(np.log1p(len(text))), kinds[UPPER] / letters, kinds[DIGIT] / n, kinds[SPACE] / n, kinds[NEWLINE] / n, kinds[STOP] / n, kinds[MARK] / n, kinds[SYMBOL] / n, kinds[WIDE] / n,
        text.count("!") / seen, text.count("|") / seen, float(sizes.mean()), float((sizes > 12).mean()), float((sizes <= 3).mean()), len(distinct) / seen,
        sum(map(eq, words, words[1:])) / seen, len(set(lines)) / len(lines), len(words) / len(lines), common / seen,
    ]


class Boosted:
    """Trees in arrays: feature and bound of each inner node, value of each leaf; a row goes right where its value is above the bound."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 2.0):
        self.depth, inner = depth, 2**depth - 1
        self.feature, self.bound = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
        self.leaf = np.zeros((trees, 2**depth))
        n, width = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
        cell = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        margin, offset = np.full(n, self.base), np.arange(width) * bins
        for t in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(depth):
                first, count = 2**level - 1, 2**level
                flat = ((node * width * bins)[:, None] + offset + cell).ravel()
                left_g, left_h = (np.bincount(flat, np.repeat(v, width), count * width * bins).reshape(count, width, bins).cumsum(2) for v in (g, h))
                all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
                gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
                gain[(left_h < least) | (all_h - left_h < least)] = 0
                for j, e in enumerate(edges):
                    gain[:, j, len(e) :] = 0
                best = gain.reshape(count, -1).argmax(1)
                f, b = best // bins, best % bins
                splits = gain.reshape(count, -1)[np.arange(count), best] > 1e-6
                self.feature[t, first : first + count] = f
                self.bound[t, first : first + count] = [edges[j][k] if s else np.inf for j, k, s in zip(f, b, splits, strict=True)]
                node = 2 * node + (splits[node] & (cell[np.arange(n), f[node]] > b[node]))
            self.leaf[t] = -rate * np.bincount(node, g, 2**depth) / (np.bincount(node, h, 2**depth) + ridge)
            margin += self.leaf[t][node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.leaf))[None, :]
        node = np.zeros((len(x), len(self.leaf)), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.bound[trees, node])
        return 1 / (1 + np.exp(-(self.base + self.leaf[trees, node - 2**self.depth + 1].sum(1))))


def with_statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` and the statistics of the text as one array column ``doc_stats``."""
    kept = docs.select(*(keep or []), F.col(text).alias("doc_stats"))
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("doc_stats", T.ArrayType(T.DoubleType()))])

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in slices(whole, whole.num_columns - 1, TEXTS, CHUNK):
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))], names=batch.schema.names)

    return small_batches(kept).mapInArrow(taken, schema)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Boosted | None:
    """Fit on about ``max_rows`` labelled rows, drawn by a hash of doc_id and text.

    Only their statistics reach the driver; rows of one doc_id with equal ones count once.
    """
    known = labels.where(learnable(F.col("doc_id")) & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    rate = min(1.0, max_rows / max(1, docs.select("doc_id").join(known, "doc_id").count()))
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit("quality")), F.lit(1 << 24)) / float(1 << 24) < rate
    chosen = docs.select("doc_id", "text").where(drawn).join(known, "doc_id")
    rows = with_statistics(chosen, keep=["doc_id", "y"]).distinct().collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["doc_id"], r["doc_stats"]))
    return Boosted(np.array([r["doc_stats"] for r in rows]), np.array([r["y"] for r in rows], np.float64))


def score(docs: DataFrame, model: Boosted | None, text: str = "text") -> DataFrame:
    """``docs`` with quality_score added (a column of that name is replaced)."""
    docs = small_batches(docs.drop("quality_score"))
    at = docs.columns.index(text)
    held = sent(docs.sparkSession, model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = held()
        for whole in batches:
            for batch, texts in slices(whole, at, TEXTS, CHUNK):
                scores = fitted.predict(np.array([statistics(t) for t in texts])) if fitted else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "quality_score"])

    return docs.mapInArrow(scored, T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType())]))
