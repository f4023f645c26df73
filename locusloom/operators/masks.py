"""Variant, gene and sample selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chromosomes(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows of the named chromosomes, with or without a chr prefix."""
    return df.where(F.col("chrom").isin([n if n.startswith("chr") else f"chr{n}" for n in names]))


def thresholds(rules: list[str] | dict[str, str]) -> Column:
    """All of predicates like "MAF < 1e-3"; a null comparison is false."""
    exprs = [F.expr(r) for r in (rules.values() if isinstance(rules, dict) else rules)]
    return F.coalesce(reduce(lambda a, b: a & b, exprs, F.lit(True)), F.lit(False))


def variant_type(kind: str, missense: str = "Consequence_missense_variant", plof: str = "is_plof") -> Column:
    """missense, plof or all."""
    if kind == "all":
        return F.lit(True)
    if kind not in ("missense", "plof"):
        raise ValueError(f"unknown variant type {kind!r}")
    return F.col(missense if kind == "missense" else plof) == 1


def rare(maf: str, bound: float) -> Column:
    return (F.col(maf) < bound) & (F.col(maf) > 0)


def common_by_frequency(af: str, bound: float) -> Column:
    return F.col(af).between(bound, 1 - bound)


def common_by_count(count: str, least: int, n: int) -> Column:
    return F.col(count).between(least, n - least)


def keep_listed(df: DataFrame, listed: DataFrame, on: str) -> DataFrame:
    return df.join(listed.select(on).distinct(), on, "left_semi")


def max_pval(df: DataFrame, bounds: dict[str, float]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(c) < v for c, v in bounds.items()]))


def explode_genes(df: DataFrame, genes: str = "gene_ids", gene: str = "gene") -> DataFrame:
    """One row a variant and gene; repeats of a gene in a list count once, empty lists and nulls go."""
    return df.withColumn(gene, F.explode(F.array_distinct(genes))).drop(genes).where(F.col(gene).isNotNull())


def group_features(rows: DataFrame, by: str, features: list[str], how: str | dict[str, str] = "max") -> DataFrame:
    """``by`` and each feature aggregated by name (max, min, sum, mean), one for all or one a feature."""
    named = {"max": F.max, "min": F.min, "sum": F.sum, "mean": F.avg}
    return rows.groupBy(by).agg(*[named[how if isinstance(how, str) else how[f]](f).alias(f) for f in features])


def carried_slots(rows: DataFrame, features: list[str], least: int) -> DataFrame:
    """sample of samples that carry at least ``least`` variants with a feature in one gene."""
    used = rows.where(reduce(lambda a, b: a | b, [F.col(f) != 0 for f in features]))
    return used.groupBy("sample", "gene").agg(F.count("*").alias("n")).groupBy("sample").agg(F.max("n").alias("n")).where(F.col("n") >= least).select("sample")


def eac_filter(df: DataFrame, least: float, inclusive: bool = False, column: str = "EAC") -> DataFrame:
    return df.where(F.col(column) >= least if inclusive else F.col(column) > least)


def coding_genes(genes: DataFrame, column: str = "gene") -> DataFrame:
    """Base gene ids, without those of the Y pseudoautosomal region."""
    return genes.where(~F.col(column).contains("PAR_Y")).withColumn(column, F.split(column, r"\.")[0])


def share_of_samples(samples: DataFrame, share: float, key: str = "sample") -> DataFrame:
    """The first round(n x share) samples by key."""
    return samples.orderBy(key).limit(round(samples.count() * share))


def first_of(df: DataFrame, n: int, key: str = "sample") -> DataFrame:
    """The rows of the first n keys in order: samples or genes of a trial run."""
    chosen = df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).limit(n)
    return df.join(chosen, key, "left_semi")
