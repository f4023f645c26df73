"""Alignment of two tokenizers over the same texts, by an associative monoid of fragments.

Byte offsets where tokens of both tokenizers end cut a text into groups; the last
tokens of a group are linked. A text is read in byte ranges. The tokens that end in a
range are a fragment: an open head (up to the first common end), closed groups,
and an open tail (behind the last common end), or all open tokens where there is
no common end. Fragments compose associatively: a tail and the next head close a
group. A text of one range is done where it stands; the ranges of longer ones are
dealt over the cluster, tokenized there, and composed by a tree of small groups of
neighbours, so no task tokenizes or aligns a very long text alone.

A range is tokenized with its surroundings up to the next space between two letters:
neither tokenizer has a token over such a place, so its tokens are those of the
whole text. Ranges without such a place are read together, so one run without
spaces is one unit of work.

Two linked tokens end alike, so one's bytes are a suffix of the other's. There can be
no more distinct pairs than bytes in both vocabularies, which is the proven bound
of the table of pair counts that is broadcast.

Edge cases: null and empty texts and those whose joined bytes of either tokenizer
differ from space + text have no tokens. Strings of special tokens are plain text.
Rows of equal doc_id are rows of their own, null ones too. No documents: no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discarded, partitions, sent, slices, small_batches, written
from .packing import CHARS, TEXTS, VOCABULARY, token_ids
from .subwords import MARK, MODEL

#: Bytes of a range, and fragments composed at once.
RANGE, FAN = 1 << 16, 16
SPANS = "_row long, doc_id long, _k long, _to long, _at long, _text string"
OPEN = ("head_a", "head_b", "closed", "tail_a", "tail_b")
TOKENS = "_row long, doc_id long, _k long, ok boolean, n_a long, n_b long, n_groups long, groups_sha256 string, groups string, " + ", ".join(f"{c} string" for c in OPEN) + ", pairs array<long>, counts array<int>"
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 7, pa.list_(pa.int64()), pa.list_(pa.int32())]
SUMS = "_row long, doc_id long, ok boolean, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"
NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


@dataclass(frozen=True)
class Fragment:
    """Ids of tokens that end in a stretch of bytes. closed is None where no common end lies in it; all tokens are in the head then."""

    head_a: str = ""
    head_b: str = ""
    closed: str | None = None
    tail_a: str = ""
    tail_b: str = ""


def listed(x: str, y: str, mark: str = ",") -> str:
    return x + mark + y if x and y else x or y


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring stretches; associative, with Fragment() as its neutral element."""
    if x.closed is None:
        return Fragment(listed(x.head_a, y.head_a), listed(x.head_b, y.head_b), y.closed, y.tail_a, y.tail_b)
    a, b = listed(x.tail_a, y.head_a), listed(x.tail_b, y.head_b)
    if y.closed is None:
        return Fragment(x.head_a, x.head_b, x.closed, a, b)
    return Fragment(x.head_a, x.head_b, listed(listed(x.closed, f"{a}|{b}", ";"), y.closed, ";"), y.tail_a, y.tail_b)


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and the text of each id with the mark behind it."""

    def __init__(self, vocabulary: bytes, model: bytes):
        import sentencepiece
        import tiktoken

        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
        self.a = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_a[rank] = token
        size = self.b.get_piece_size()
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else self.b.id_to_piece(i).replace(MARK, " ").encode() for i in range(size)]
        self.long_a, self.long_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        n = max(len(self.bytes_a), size)
        # codes: 4 x id, + 1 for the last of its group, + 2 for the second tokenizer
        self.names = [f"{i}{mark}" for i in range(n) for mark in (",", "|", ",", ";")]

    @property
    def most_pairs(self) -> int:
        return int(self.long_a.sum() + self.long_b.sum())

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both for texts that begin with a space; None for an empty text and where their bytes differ from the text's."""
        out = []
        for text, b in zip(texts, self.b.encode([t[1:] for t in texts], num_threads=1), strict=True):
            a, whole = token_ids(self.a, text), text.encode()
            same = b"".join(map(self.bytes_a.__getitem__, a.tolist())) == whole and b"".join(map(self.bytes_b.__getitem__, b)) == whole
            out.append((a.astype(np.int64), np.array(b, np.int64)) if text and same else None)
        return out

    def written(self, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> str:
        """Groups as text from ids and the group of each, without the mark at the end."""
        last = lambda g: np.append(g[1:] != g[:-1], True)
        codes = np.concatenate([a * 4 + last(of_a), b * 4 + 2 + last(of_b)])
        order = np.argsort(np.concatenate([of_a * 2, of_b * 2 + 1]), kind="stable")
        return "".join(map(self.names.__getitem__, codes[order].tolist()))[:-1]


def plain(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def fragment(t: Tokenizers, a: np.ndarray, end_a: np.ndarray, b: np.ndarray, end_b: np.ndarray, whole: bool) -> tuple[Fragment | str, int, np.ndarray, np.ndarray]:
    """The fragment of these tokens (``whole``: the groups as text), its common ends, and the distinct links with their numbers."""
    common = np.intersect1d(end_a, end_b, assume_unique=True)
    m = len(common)
    of_a, of_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
    pairs, counts = np.unique(a[np.searchsorted(end_a, common)] * len(t.bytes_b) + b[np.searchsorted(end_b, common)], return_counts=True)
    if whole:
        return t.written(a, b, of_a, of_b), m, pairs, counts
    if not m:
        return Fragment(plain(a), plain(b)), 0, pairs, counts
    mid_a, mid_b = (of_a > 0) & (of_a < m), (of_b > 0) & (of_b < m)
    closed = t.written(a[mid_a], b[mid_b], of_a[mid_a], of_b[mid_b]) if m > 1 else ""
    return Fragment(plain(a[of_a == 0]), plain(b[of_b == 0]), closed, plain(a[of_a == m]), plain(b[of_b == m])), m, pairs, counts


def ranges_of(text: str, size: int) -> list[tuple[int, int, int, str]]:
    """(first range, range behind the last, byte offset, text) of the stretches in which the ranges of space + text are tokenized."""
    data = (" " + text).encode()
    x = np.frombuffer(data, np.uint8)
    lower = x | 32
    letter = (lower >= ord("a")) & (lower <= ord("z"))
    cuts = np.concatenate([[0], np.flatnonzero((x[1:-1] == 32) & letter[:-2] & letter[2:]) + 1, [len(x)]])
    n = -(-len(x) // size)
    lows = np.arange(n) * size
    before = cuts[np.searchsorted(cuts, lows, "right") - 1]
    after = cuts[np.searchsorted(cuts, np.minimum(lows + size, len(x)))]
    out, k = [], 0
    while k < n:
        to = k + 1
        while to < n and before[to] < lows[to - 1]:  # the next range would reach back over this one
            to += 1
        out.append((k, to, int(before[k]), data[before[k] : after[to - 1]].decode()))
        k = to
    return out


def stretches(docs: DataFrame, size: int) -> DataFrame:
    """The stretches of texts longer than a range, dealt over the cluster. docs: _row, doc_id, text."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for row, doc_id, text in zip(*(c.to_pylist() for c in whole.columns), strict=True):
                found = ranges_of(text, size)
                columns = [[row] * len(found), [doc_id] * len(found), *zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, [*[pa.int64()] * 5, pa.string()], strict=True)], names=["_row", "doc_id", "_k", "_to", "_at", "_text"])

    return docs.mapInArrow(split, SPANS).repartition(partitions(docs.sparkSession), "_row", "_k")


def tokenized(rows: DataFrame, files: tuple[bytes, bytes], size: int, keep: bool) -> DataFrame:
    """Stretches (SPANS) as TOKENS: groups where a stretch is a whole text (null _row), else a fragment a range."""
    held = sent(rows.sparkSession, files)

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tokenizers(*held())
        for batch in batches:
            for part, texts in slices(batch, 5, TEXTS, CHARS):
                out = []
                for (row, doc_id, k, to, at), ids in zip(zip(*(c.to_pylist() for c in part.columns[:5]), strict=True), t.encode([x or "" for x in texts]), strict=True):
                    if ids is None:
                        out.append((row, doc_id, k, False, 0, 0, 0, *[None] * 7, [], []))
                        continue
                    a, b = ids
                    end_a, end_b = at + np.cumsum(t.long_a[a]), at + np.cumsum(t.long_b[b])
                    if row is None:
                        groups, m, pairs, counts = fragment(t, a, end_a, b, end_b, True)
                        out.append((row, doc_id, k, True, len(a), len(b), m, hashlib.sha256(groups.encode()).hexdigest(), groups if keep else None, *[None] * 5, pairs, counts))
                        continue
                    for r in range(k, to):
                        of = lambda ends, low=r * size: slice(*np.searchsorted(ends, [low, low + size], "right"))
                        x, y = of(end_a), of(end_b)
                        f, m, pairs, counts = fragment(t, a[x], end_a[x], b[y], end_b[y], False)
                        out.append((row, doc_id, r, True, x.stop - x.start, y.stop - y.start, m, None, None, f.head_a, f.head_b, f.closed, f.tail_a, f.tail_b, pairs, counts))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(KINDS)], names=[c.split()[0] for c in TOKENS.split(", ")])

    return rows.mapInArrow(aligned, TOKENS)


def composed(fragments: DataFrame, ranges: int, fan: int) -> DataFrame:
    """_row, groups of each long text: neighbours are composed ``fan`` at a time until one fragment is left of at most ``ranges``."""
    schema = "_row long, _k long, " + ", ".join(f"{c} string" for c in OPEN)

    def neighbours(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_k")
        parts = (Fragment(*(None if pd.isna(c) else c for c in row)) for row in rows[list(OPEN)].itertuples(index=False, name=None))
        x = reduce(compose, parts)
        return pd.DataFrame([(rows["_row"].iloc[0], rows["_k"].iloc[0] // fan, x.head_a, x.head_b, x.closed, x.tail_a, x.tail_b)], columns=["_row", "_k", *OPEN])

    fragments = fragments.select("_row", "_k", *OPEN)
    while ranges > 1:
        fragments = fragments.groupBy("_row", F.floor(F.col("_k") / fan).alias("_next")).applyInPandas(neighbours, schema)
        ranges = -(-ranges // fan)
    closed = F.when(F.col("closed") == "", F.lit(None)).otherwise(F.col("closed"))
    return fragments.select("_row", F.concat_ws(";", F.concat("head_a", F.lit("|"), "head_b"), closed).alias("groups"))


def pair_counts(tokens: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pairs and how many links of the corpus hold each; at most ``most``, as both vocabularies allow."""
    found = tokens.select(F.inline(F.arrays_zip("pairs", "counts"))).groupBy("pairs").agg(F.sum("counts").alias("n")).limit(most + 1).toArrow().sort_by("pairs")
    if found.num_rows > most:
        raise ValueError(f"more than {most} pairs: linked tokens don't end alike")
    return found.column(0).to_numpy().astype(np.int64), found.column(1).to_numpy().astype(np.int64)


def align(docs: DataFrame, vocabulary: str | None = None, model: str | None = None, size: int = RANGE, fan: int = FAN, keep: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row; ``keep``: also groups, as text.

    ``vocabulary`` is the rank file of the first tokenizer, ``model`` the second's file; only the driver reads them.
    """
    spark = docs.sparkSession
    files = Path(vocabulary or public_tokenizers.path(VOCABULARY)).read_bytes(), Path(model or public_tokenizers.path(MODEL)).read_bytes()
    t = Tokenizers(*files)
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.nullif(F.col("text").cast("string"), F.lit("")).alias("text"))
    is_long = F.coalesce(F.octet_length("text") + 1 > size, F.lit(False))
    nothing = F.lit(None).cast("long")
    short = rows.where(~is_long).select(nothing.alias("_row"), "doc_id", F.lit(0).cast("long").alias("_k"), F.lit(1).cast("long").alias("_to"), F.lit(0).cast("long").alias("_at"), F.concat(F.lit(" "), "text").alias("_text"))
    long = written(rows.where(is_long).select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text"), "long_texts")
    tokens = written(tokenized(short.unionByName(stretches(long, size)), files, size, keep), "tokens")
    discarded(long)
    parts = tokens.where("_row is not null")
    whole = parts.groupBy("_row").agg(F.min("ok").alias("whole"), F.max("_k").alias("_last"))
    ranges = (whole.agg(F.max("_last")).first()[0] or 0) + 1
    sound = tokens.where("_row is null and ok").unionByName(parts.join(whole.where("whole"), "_row", "left_semi"))
    pairs, counts = pair_counts(sound, t.most_pairs)
    best = np.zeros(len(t.bytes_b), np.int64)
    np.maximum.at(best, pairs % len(t.bytes_b), counts)
    held = sent(spark, (pairs, counts, counts == best[pairs % len(t.bytes_b)]))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, top = held()
        for b in batches:
            lists = b.column("pairs")
            sizes = np.diff(lists.offsets.to_numpy())
            at = np.searchsorted(pairs, lists.flatten().to_numpy(zero_copy_only=False))
            n = b.column("counts").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            totals = []
            for value in (n, n * (top[at] if len(at) else 1), n * (counts[at] if len(at) else 1)):
                total = np.zeros(len(sizes), np.int64)
                np.add.at(total, row, value)
                totals.append(pa.array(total))
            kept = [b.column(c) for c in ("_row", "doc_id", "ok", "n_a", "n_b", "n_groups")]
            yield pa.RecordBatch.from_arrays([*kept, *totals, b.column("groups_sha256"), b.column("groups")], names=[c.split()[0] for c in SUMS.split(", ")])

    columns = ["_row", "doc_id", "ok", "n_a", "n_b", "n_groups", "groups_sha256", "groups", "pairs", "counts"]
    # rows without sound tokens have no pairs to look up
    empty = [F.when(F.col("ok"), F.col(c)).otherwise(F.array().cast(tokens.schema[c].dataType)).alias(c) for c in ("pairs", "counts")]
    checked = tokens.where("_row is null").unionByName(parts.join(whole.select("_row", "whole"), "_row").withColumn("ok", F.col("whole")).drop("whole"))
    sums = checked.select(*columns[:-2], *empty).mapInArrow(summed, SUMS)
    each = sums.where("_row is null")
    of_long = sums.where("_row is not null").groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.min("ok").alias("ok"), *[F.sum(c).alias(c) for c in NUMBERS])
    of_long = of_long.join(composed(parts.join(whole.where("whole"), "_row", "left_semi"), ranges, fan), "_row", "left").withColumn("groups_sha256", F.sha2("groups", 256))
    out = each.select("doc_id", "ok", *NUMBERS, "groups_sha256", "groups").unionByName(of_long.select("doc_id", "ok", *NUMBERS, "groups_sha256", "groups"))
    numbers = [F.when(F.col("ok"), F.col(c)).otherwise(0).cast("long").alias(c) for c in NUMBERS]
    return out.select("doc_id", *numbers, *[F.when(F.col("ok"), F.col(c)).otherwise("").alias(c) for c in ("groups_sha256", *(["groups"] if keep else []))])
