"""Removal of boilerplate lines by the number of distinct sites that they stand on.

HyperLogLog sketches of the sites are built for each line hash and merged by the
aggregation. Lines whose estimate lies near the threshold get an exact distinct
count. A line on at least ``min_sites`` sites stays only where it first occurs
(least doc_id, then text hash and position), so its content stays in the corpus once.

Lines are compared without surrounding blanks; blank lines are never removed.
Edge cases: a null text or one without lines stays as it is; a null site counts
for no line; repeated rows are treated alike. A very long text is one row, whose
lines are hashed and cut in time in proportion to its length. No documents: no
rows. Extra columns are passed through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside, written

#: A quarter of the sites of the tables at hand. Copies of a document stand on two or three.
MIN_SITES = 5
#: The sketch has 2^12 cells: a standard error of 1.6 %. Estimates this near the threshold are counted exactly.
SKETCH_BITS, NEAR = 12, 0.25
#: Hashes of 16 bytes that may be broadcast; tasks that share a line of many texts beyond that.
SENT, SALTS = 200_000, 16
BLANKS = " \t\r"


def lines_of(docs: DataFrame, site: str, text: str) -> DataFrame:
    """One row a line that isn't blank: the document's key, site, position and the line's 128-bit hash."""
    line = F.btrim(F.col("_line"), F.lit(BLANKS))
    rows = docs.select(F.col("doc_id").alias("_id"), F.xxhash64(text).alias("_text"), F.col(site).cast("string").alias("_site"), F.posexplode(F.split(text, "\n")).alias("_at", "_line"))
    return rows.where(line != "").select("_id", "_text", "_site", "_at", F.unhex(F.md5(line)).alias("_hash"))


def of_hashes(lines: DataFrame, chosen: DataFrame) -> DataFrame:
    """The ``lines`` of the chosen hashes (written): by a broadcast of at most SENT hashes, else by a join that deals a line of very many texts over SALTS tasks."""
    if chosen.limit(SENT + 1).count() <= SENT:
        return lines.join(F.broadcast(chosen), "_hash", "left_semi")
    dealt = lines.withColumn("_salt", F.pmod("_text", F.lit(SALTS)).cast("int"))
    return dealt.join(chosen.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge"), ["_hash", "_salt"], "left_semi")


def boilerplate(docs: DataFrame, site: str = "source", text: str = "text", min_sites: int = MIN_SITES) -> DataFrame:
    """Hashes of the lines on at least ``min_sites`` sites, with the place of the first occurrence."""
    lines = lines_of(docs, site, text)
    spread = lines.groupBy("_hash").agg(F.hll_sketch_agg("_site", F.lit(SKETCH_BITS)).alias("_sketch"), F.min(F.struct("_id", "_text", "_at")).alias("_first"))
    counted = spread.select("_hash", "_first", F.hll_sketch_estimate("_sketch").alias("_sites")).where(F.col("_sites") >= min_sites * (1 - NEAR))
    suspects = written(counted, "suspects")
    exact = of_hashes(lines, suspects.where(F.col("_sites") < min_sites * (1 + NEAR)).select("_hash")).where("_site is not null").select("_hash", "_site").distinct().groupBy("_hash").agg(F.count("*").alias("_exact"))
    sites = F.coalesce(F.col("_exact"), F.col("_sites"))
    return suspects.join(exact, "_hash", "left").where(sites >= min_sites).select("_hash", "_first")


def dedup_lines(docs: DataFrame, site: str = "source", text: str = "text", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with the text less its boilerplate lines, and n_lines and n_removed added (columns of these names are replaced)."""
    docs, names, back = aside(docs.drop("n_lines", "n_removed"))
    site, text = names.get(site, site), names.get(text, text)
    found = written(boilerplate(docs, site, text, min_sites), "boilerplate")
    lines = lines_of(docs, site, text).join(found, "_hash")
    place = F.struct("_id", "_text", "_at")
    gone = lines.where(~F.col("_first").eqNullSafe(place)).groupBy("_id", "_text").agg(F.collect_set("_at").alias("_gone"))
    joined = docs.withColumn("_lt", F.xxhash64(text)).join(gone, F.col("_lt").eqNullSafe(F.col("_text")) & docs["doc_id"].eqNullSafe(F.col("_id")), "left")
    # the set difference of places is hashed, and the text is split once
    stay = lambda parts: F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "_gone"), lambda i: F.get(parts, i))
    cut = F.array_join(F.get(F.transform(F.array(F.split(text, "\n")), stay), F.lit(0)), "\n")
    removed = F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone"))
    out = joined.select(
        *[F.when(F.col("_gone").isNull(), F.col(c)).otherwise(cut).alias(c) if c == text else docs[c] for c in docs.columns],
        F.when(F.col(text).isNull(), 0).otherwise(F.size(F.split(text, "\n"))).alias("n_lines"), removed.alias("n_removed"),
    )
    return back(out)
