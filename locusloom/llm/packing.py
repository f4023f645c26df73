"""Best-fit packing of token sequences, planned over the histogram of lengths.

Documents are tokenized once; those longer than a sequence are cut so that only
their first piece may be shorter than a sequence. The plan works on counts: for
each length from the longest down, pieces fill the open sequences with the least
sufficient room first. It has a few rows for each length, however many documents
there are. A piece takes its planned slot by a join on its rank within its length.

Edge cases: a null text counts as empty; every document has at least the end
token. Repeated rows are packed each on their own, ties of length in any order. Very
long texts are cut into pieces. No documents: no rows.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import aside, partitions, slices, small_batches, written

CAPACITY = 1024
END = 2
#: The tokenizer, and its vocabulary as ranks, which encode faster to the same ids; tests hold one against the other.
TOKENIZER, VOCABULARY = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Texts and characters tokenized at once.
TEXTS, CHARS = 256, 1 << 20
PIECES = "doc_id long, piece int, start long, length long, ids binary"


def added_tokens(path: str) -> dict[str, int]:
    """The strings that a tokenizer's file has as tokens beside its vocabulary."""
    return {t["content"]: t["id"] for t in json.loads(Path(path).read_text(encoding="utf-8"))["added_tokens"]}


def encoder(path: str, special: dict[str, int]):
    """The byte-level BPE of a rank file; strings of ``special`` are tokens wherever they stand in a text."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(tokens, text: str) -> np.ndarray:
    """Ids of a text. A run of a million blanks is more than the encoder's own splitting bears; such a text is split here, by the same pattern."""
    try:
        return tokens.encode_to_numpy(text, allowed_special="all", disallowed_special=())
    except ValueError:
        special = {name: tokens.encode_single_token(name) for name in tokens.special_tokens_set}
        strings = regex.split("(" + "|".join(map(regex.escape, special)) + ")", text) if special else [text]
        ids = [[special[part]] if part in special else tokens._encode_single_piece(piece) for part in strings for piece in ([part] if part in special else regex.findall(public_tokenizers.PATTERN, part))]
        return np.array([i for some in ids for i in some], np.uint32)


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, but the first, which may be shorter."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((start, capacity) for start in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit).

    Ids are those of ``tokenizer`` without special tokens around a text; ``vocabulary`` is the file of its ranks.
    """
    path, special = vocabulary or public_tokenizers.path(VOCABULARY), added_tokens(tokenizer or public_tokenizers.path(TOKENIZER))

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path, special)
        for whole in batches:
            for batch, texts in slices(whole, 1, TEXTS, CHARS):
                out = []
                for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                    ids = np.append(token_ids(tokens, text), end).astype("<u4") if text else np.array([end], "<u4")
                    out += [(doc_id, k, start, n, ids[start : start + n].tobytes()) for k, (start, n) in enumerate(cut_points(len(ids), capacity))]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=["doc_id", "piece", "start", "length", "ids"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tokenized, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first_rank, n, first_sequence, offset) for ``counts`` pieces of each length.

    The n pieces of that length from first_rank on go to n sequences from
    first_sequence on, at the offset. Best fit over counts, longest first.
    """
    open_: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first sequence, how many) of alike sequences
    slots, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = next((r for r in range(length, capacity + 1) if open_.get(r)), None)
            if room is None:
                # a new run takes as many sequences as these pieces fill by themselves
                each = capacity // length
                first, many = sequences, left // each or 1
                inside = min(each, left)
                sequences += many
                for k in range(inside):
                    slots.append((length, rank, many, first, k * length))
                    rank += many
                left -= inside * many
                open_.setdefault(capacity - inside * length, []).append((first, many))
                continue
            first, many = open_[room].pop()
            used = min(many, left)
            if used < many:
                open_[room].append((first + used, many - used))
            slots.append((length, rank, used, first, capacity - room))
            rank, left = rank + used, left - used
            open_.setdefault(room - length, []).append((first, used))
    return slots


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` (a column ``length`` from 1 to ``capacity``, and any others) with sequence_id and offset added.

    Ranks come from counts by (length, bucket) and row numbers inside a bucket, so
    a length that most pieces share is dealt over many tasks; a row's bucket hashes
    its place in its partition too, so equal rows are dealt out like any others.
    The driver gets one row a length, ``capacity`` at most, and the plan that goes
    out has a few rows for each length and each number of pieces in a sequence.
    """
    spark = rows.sparkSession
    buckets = max(32, partitions(spark))
    named, _, back = aside(rows.drop("sequence_id", "offset"))
    held = written(named.withColumn("_order", F.monotonically_increasing_id()).withColumn("_bucket", F.pmod(F.xxhash64("_order"), F.lit(buckets)).cast("int")), "pieces")
    inside = Window.partitionBy("length", "_bucket").orderBy("_order")
    counts = held.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = counts.select("length", "_bucket", (F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    totals = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.count("*").alias("n")).collect()}
    planned = spark.createDataFrame(plan(totals, capacity), "length long, _first_rank long, _n long, _first_sequence long, offset long")
    ranked = held.withColumn("_row", F.row_number().over(inside)).join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_row") - 1)
    placed = ranked.join(F.broadcast(planned), (ranked["length"] == planned["length"]) & (ranked["_rank"] >= planned["_first_rank"]) & (ranked["_rank"] < planned["_first_rank"] + planned["_n"]))
    return back(placed.select(*[ranked[c] for c in named.columns], (F.col("_first_sequence") + F.col("_rank") - F.col("_first_rank")).alias("sequence_id"), planned["offset"]))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of ``docs`` with their ids, sequence_id and offset."""
    return pack(pieces(docs, capacity), capacity)
