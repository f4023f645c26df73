"""From calls and variants to per-sample genotypes, and counts over them.

The canonical genotype table is long: chrom, pos, ref, alt, sample, gt (1 or 2);
absent means homozygous reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import written
from .checks import require_rows, require_unique

SITE = ["chrom", "pos", "ref", "alt"]


def in_ranges(rows: DataFrame, order: list, name: str = "id", buckets: int = 64) -> DataFrame:
    """``rows`` with ids 0..n-1 in that order and ``_part``, the number of their range, without a window over all rows.

    Rows are sorted into ranges; the counts of the ranges give their first ids, and a
    row's place in its range the rest.
    """
    ranged = rows.repartitionByRange(buckets, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    # written, since ranges are sampled anew whenever they are computed
    placed = written(ranged.withColumn("_part", F.shiftright("_at", 33).cast("int")), "ranges")
    before, at = [], 0
    for r in sorted(placed.groupBy("_part").agg(F.count("*").alias("n")).collect()):  # one row a range
        before += [at] * (r["_part"] + 1 - len(before))
        at += r["n"]
    first = F.get(F.lit([0, *before]).cast("array<bigint>"), F.col("_part") + 1)
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(name, first + inside).drop("_at")


def dense_ids(rows: DataFrame, order: list, name: str = "id", buckets: int = 64) -> DataFrame:
    """``rows`` with ids 0..n-1 in that order."""
    return in_ranges(rows, order, name, buckets).drop("_part")


def add_variant_ids(variants: DataFrame, key: list[str] = SITE, order_by: list[str] | None = None, chromosomes: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Variants with dense ids after the first of each key is kept, and the duplicates.

    ``order_by`` says which row is first and the order of the ids (default: the key).
    """
    rows = variants.where(F.col(key[0]).isin(chromosomes)) if chromosomes else variants
    order = order_by or key
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    ranked = rows.withColumn("_n", rank)
    return dense_ids(ranked.where("_n = 1").drop("_n"), order), ranked.where("_n > 1").drop("_n")


def exclude_variants(variants: DataFrame, excluded: DataFrame, key: list[str] = SITE) -> DataFrame:
    """Variants without those listed; raises if none remain."""
    return require_rows(variants.join(excluded.select(*key).distinct(), key, "left_anti"), "variants")


def exclude_samples(samples: DataFrame, excluded: DataFrame, key: str = "sample") -> DataFrame:
    """Distinct samples without those listed; raises if none remain."""
    return require_rows(samples.select(key).distinct().join(excluded.select(key), key, "left_anti"), "samples")


def exclude_calls(calls: DataFrame, excluded: DataFrame, key: list[str] | None = None) -> DataFrame:
    key = key or [*SITE, "sample"]
    return calls.join(excluded.select(*key).distinct(), key, "left_anti")


def sample_filter(calls: DataFrame, samples: DataFrame, key: str = "sample") -> DataFrame:
    return calls.join(samples.select(key), key, "left_semi")


def attach_ids(calls: DataFrame, variants: DataFrame, key: list[str] = SITE, check: bool = True) -> DataFrame:
    """Calls of known variants with their ids; a site may stand in ``variants`` once only."""
    if check:
        require_unique(variants, key, "variants")
    return calls.join(variants.select(*key, "id").withColumnRenamed("id", "variant_id"), key).drop(*key)


def process_calls(calls: DataFrame, variants: DataFrame, samples: DataFrame, excluded_variants: DataFrame | None = None, excluded_samples: DataFrame | None = None, excluded_calls: DataFrame | None = None, key: list[str] = SITE) -> DataFrame:
    """sample, variant_id, gt of the calls that pass all lists. Filters come before the id join; no shuffle but the joins'."""
    if excluded_variants is not None:
        variants = exclude_variants(variants, excluded_variants, key)
    if excluded_samples is not None:
        samples = exclude_samples(samples, excluded_samples)
    calls = sample_filter(calls, samples)
    if excluded_calls is not None:
        calls = exclude_calls(calls, excluded_calls, [*key, "sample"])
    return attach_ids(calls, variants, key).select("sample", "variant_id", "gt")


def sample_genotypes(calls: DataFrame, samples: DataFrame) -> DataFrame:
    """One row a sample: its calls sorted by variant id (empty without any) and their number."""
    gathered = calls.groupBy("sample").agg(F.sort_array(F.collect_list(F.struct("variant_id", "gt"))).alias("calls"))
    empty = F.array().cast("array<struct<variant_id:bigint,gt:int>>")
    joined = samples.select("sample").distinct().join(gathered.withColumn("calls", F.col("calls").cast("array<struct<variant_id:bigint,gt:int>>")), "sample", "left")
    return joined.withColumn("calls", F.coalesce("calls", empty)).withColumn("n_calls", F.size("calls"))


def combine_genotypes(parts: list[DataFrame]) -> DataFrame:
    """One genotype table of parts (sample, calls) that hold the same samples; raises if they don't."""
    from functools import reduce

    tagged = [p.select("sample", "calls", F.lit(i).alias("part")) for i, p in enumerate(parts)]
    rows = reduce(DataFrame.unionByName, tagged).groupBy("sample").agg(F.flatten(F.collect_list("calls")).alias("calls"), F.count_distinct("part").alias("n"))
    require_rows(rows, "samples")
    if not rows.where(F.col("n") != len(parts)).isEmpty():
        raise ValueError("the parts hold different samples")
    return rows.select("sample", F.sort_array("calls").alias("calls"), F.size("calls").alias("n_calls"))


def padded(genotypes: DataFrame, width: int, pad: int = -1) -> DataFrame:
    """Variant and genotype arrays filled up to ``width`` with ``pad``; the ragged form is the default elsewhere."""
    fill = F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(width) - F.size("calls")))
    return genotypes.select("sample", F.concat(F.col("calls.variant_id").cast("array<int>"), fill).alias("variant_matrix"), F.concat(F.col("calls.gt").cast("array<int>"), fill).alias("genotype_matrix"))


def allele_frequency(calls: DataFrame, variants: DataFrame, n_samples: int, skip_id_zero: bool = False) -> DataFrame:
    """id, af = sum(gt) / 2n of every variant id, 0 without a call, null without samples. ``skip_id_zero``: id 0 is never counted."""
    counted = calls.where("variant_id > 0") if skip_id_zero else calls
    sums = counted.groupBy(F.col("variant_id").alias("id")).agg(F.sum("gt").alias("ac"))
    return variants.select("id").join(sums, "id", "left").select("id", (F.coalesce("ac", F.lit(0)) / F.nullif(F.lit(2.0 * n_samples), F.lit(0.0))).alias("af"))


def calls_per_sample(calls: DataFrame, samples: DataFrame) -> DataFrame:
    return samples.select("sample").distinct().join(calls.groupBy("sample").agg(F.count("*").alias("n_calls")), "sample", "left").fillna(0, ["n_calls"])


def common_calls(calls: DataFrame, variants: DataFrame, is_common) -> tuple[DataFrame, DataFrame]:
    """(variants with matrix_index, -1 unless common; calls of common variants as sample, matrix_index, gt)."""
    index = dense_ids(variants.where(is_common).select("id"), ["id"], "matrix_index")
    indexed = variants.join(index, "id", "left").withColumn("matrix_index", F.coalesce("matrix_index", F.lit(-1)))
    long = calls.join(index.withColumnRenamed("id", "variant_id"), "variant_id").select("sample", "matrix_index", "gt")
    return indexed, long
