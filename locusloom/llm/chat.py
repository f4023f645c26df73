"""Chat formatting with collapse of cumulative snapshots.

A conversation that was logged again and again as it grew is kept once, in its
longest form: a rolling hash over the turns gives each conversation the hashes of
all its prefixes; a conversation whose own hash is a proper prefix of another's is
dropped by an anti join. Of equal conversations the least conv_id stays. What
stays is rendered with a role header and an end mark around each turn.

Edge cases: rows with a null conv_id belong to no conversation and are left out;
a null role or text counts as empty; turns are ordered by (turn, role, text), null
turns first; repeated rows of a conversation count once. The turns of a conversation
are one row, so a very long one is bounded by what a row can hold; its prefixes take
16 bytes a turn. No rows: no conversations. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

HEADER, END = "<|{role}|>\n", "<|end|>\n"


def rolling(turns: list[dict]) -> list[bytes]:
    """A 128-bit hash of each prefix, from the first turn alone to the whole."""
    found, last = [], b""
    for turn in turns:
        parts = (blake2b(turn[k].encode("utf-8", "replace"), digest_size=16).digest() for k in ("role", "text"))
        last = blake2b(last + b"".join(parts), digest_size=16).digest()
        found.append(last)
    return found


def gathered(rows: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, turns (sorted, without repeats)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.array_distinct(F.sort_array(F.collect_list(turn))).alias("turns"))


def hashed(conversations: DataFrame) -> DataFrame:
    """conv_id, whole (the hash of all turns), prefixes (hashes of the proper prefixes)."""

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [rolling(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[-1] for x in found], pa.binary()), pa.array([x[:-1] for x in found], pa.list_(pa.binary()))], names=["conv_id", "whole", "prefixes"])

    kind = conversations.schema["conv_id"].dataType.simpleString()
    return small_batches(conversations).select("conv_id", "turns").mapInArrow(taken, f"conv_id {kind}, whole binary, prefixes array<binary>")


def collapse(rows: DataFrame) -> DataFrame:
    """conv_id, turns, n_logged (equal conversations) of the maximal conversations."""
    conversations = written(gathered(rows), "conversations")
    hashes = written(hashed(conversations), "prefixes")
    distinct = hashes.groupBy("whole").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_logged"))
    within = hashes.select(F.explode("prefixes").alias("whole")).distinct()
    return conversations.join(distinct.join(within, "whole", "left_anti").drop("whole"), "conv_id")


def render(conversations: DataFrame) -> DataFrame:
    """``conversations`` with their turns as one chat_text."""
    before, after = HEADER.split("{role}")
    return conversations.withColumn("chat_text", F.array_join(F.transform("turns", lambda t: F.concat(F.lit(before), t["role"], F.lit(after), t["text"], F.lit("\n" + END))), ""))


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, turns, n_logged, chat_text of the maximal conversations."""
    return render(collapse(rows))
