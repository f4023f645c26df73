"""Exact duplicates by content-defined chunk recipes, with DataFrame functions only.

Texts are equal when they are identical without their white space
(``[\\x20\\x09-\\x0D]``). Each such text is cut where its content says so: behind a
sentence mark, no chunk shorter than ``LEAST`` characters where it can be helped
and none longer than ``MOST``. Equal texts are cut alike, and texts that share a
passage share most of its chunks.

A chunk's identifier is a hash of 128 bits. It is verified: the distinct chunks of
all texts are grouped by identifier, and should two different ones share it, all
identifiers are drawn anew with the next seed. So equal identifiers mean equal
chunks, and equal ordered lists of them (recipes) mean equal texts. Whole texts
don't move: each distinct chunk crosses the network once a task, and then only
recipes do, 16 bytes a chunk.

Of equal texts the row with the most code points in the original text stays, then
the least doc_id (null last), then one of equal rows. Edge cases: a null text
counts as empty, all texts of white space are equal, repeated rows are rows of
their group like any other. A very long text is one row with a longer recipe. No
documents: no rows. A hot recipe is counted before it is shuffled, and the join back to
its rows is dealt over several tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, written

#: White space that doesn't count, and the marks behind which a text may be cut.
BLANKS, MARKS = r"[\x20\x09-\x0D]+", ".!?;:…。！？；："
#: Characters of a chunk.
LEAST, MOST = 128, 1024
#: Groups of more than this part of all rows (there can't be as many of them) are dealt over so many tasks.
HOT, SALTS = 1000, 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), BLANKS, "")


def chunks_of(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The chunks of a text in order; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least - 1},{most - 1}}}?[{MARKS}]|.{{1,{most}}}"), F.lit(0))


def identifier(chunk: Column, seed: int) -> Column:
    """Two long numbers for a chunk."""
    return F.array(F.xxhash64(F.lit(seed), chunk), F.xxhash64(chunk, F.lit(seed)))


def clashes(chunks: DataFrame) -> DataFrame:
    """Identifiers that different chunks share. chunks: _id, _chunk, a row an occurrence."""
    return chunks.distinct().groupBy("_id").agg(F.count("*").alias("_n")).where("_n > 1")


def recipes(docs: DataFrame, text: str = "text", carry: Sequence[str] = (), identify: Callable[[Column, int], Column] = identifier) -> DataFrame:
    """A written table of a row a document: the carried columns, _row (unique), _chars, _sha, _recipe (verified identifiers in order)."""
    plain, seed = normalised(F.col(text)), 0
    pieces = docs.select(F.explode(chunks_of(plain)).alias("_chunk"))
    while not clashes(pieces.select(identify(F.col("_chunk"), seed).alias("_id"), "_chunk")).isEmpty():
        seed += 1
    return written(
        docs.select(
            *carry, F.monotonically_increasing_id().alias("_row"), F.char_length(F.coalesce(F.col(text).cast("string"), F.lit(""))).cast("long").alias("_chars"),
            F.sha2(plain, 256).alias("_sha"), F.flatten(F.transform(chunks_of(plain), lambda chunk: identify(chunk, seed))).alias("_recipe"),
        ), "recipes",
    )


def duplicates(docs: DataFrame, text: str = "text", carry: Sequence[str] = ("doc_id",), identify: Callable[[Column, int], Column] = identifier) -> DataFrame:
    """The carried columns (doc_id among them) and keep_id, group_size, kept, text_sha256 for every row.

    Carried columns must not begin with an underscore (``aside`` renames them).
    """
    rows = recipes(docs, text, carry, identify)
    order = F.struct((-F.col("_chars")).alias("c"), F.col("doc_id").isNull().alias("u"), F.col("doc_id").alias("d"), F.col("_row").alias("r"))
    groups = written(rows.groupBy("_recipe").agg(F.count("*").alias("_n"), F.min(order).alias("_best")).where("_n > 1"), "groups")
    # rows of very large groups, known by hashes of their recipes, are dealt over several tasks
    mark = F.xxhash64("_recipe")
    hot = mark.isin([r["h"] for r in groups.where(F.col("_n") > rows.count() / HOT).select(mark.alias("h")).collect()])
    groups = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(hot, SALTS - 1).otherwise(0))))
    joined = rows.withColumn("_salt", F.when(hot, F.pmod("_row", F.lit(SALTS))).otherwise(0).cast("int")).join(groups, ["_recipe", "_salt"], "left")
    alone = F.col("_n").isNull()
    return joined.select(
        *carry, F.when(alone, F.col("doc_id")).otherwise(F.col("_best.d")).alias("keep_id"), F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_best.r") == F.col("_row"))).alias("kept"), F.col("_sha").alias("text_sha256"),
    )


def dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    inner, names, back = aside(docs)
    clash = {c: f"x_{i}_" for i, c in enumerate(inner.columns) if c in ("keep_id", "group_size", "kept", "text_sha256")}
    inner = inner.withColumnsRenamed(clash)
    text = names.get(text, text)
    found = duplicates(inner, clash.get(text, text), inner.columns).where("kept").select(inner.columns)
    return back(found.withColumnsRenamed({v: k for k, v in clash.items()}))
