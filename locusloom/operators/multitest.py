"""Correction of p-values for many tests, and combination of several p-values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .genotype import in_ranges


#: Ranges of a table whose rows are ranked without a window over all of them.
RANGES = 64


def ranks(df: DataFrame, group: list[str], pval: str, ties: list[str] | None = None) -> DataFrame:
    """Rows with _rank by ascending p within the group (nulls last), _m p-values of it, and the _part of their range.

    Equal p-values go by the columns ``ties``, then by a hash of the row, so no value is a range of its own.
    """
    keyed = df.withColumns({f"_k{i}": F.coalesce(F.col(c).cast("string"), F.lit("")) for i, c in enumerate(group)} | {f"_u{i}": F.col(c).isNull() for i, c in enumerate(group)})
    keys = [f"{k}{i}" for i in range(len(group)) for k in ("_k", "_u")]
    tie = F.xxhash64(*df.columns)
    placed = in_ranges(keyed.withColumn("_tie", tie), [*keys, F.col(pval).asc_nulls_last(), *(ties or []), "_tie"], "_id", RANGES)
    if not group:
        return placed.withColumns({"_rank": F.col("_id") + 1, "_m": F.lit(placed.where(F.col(pval).isNotNull()).count())}).drop("_tie", "_id")
    counts = placed.groupBy(*keys).agg(F.min("_id").alias("_first"), F.count(pval).alias("_m"))
    return placed.join(counts, keys).withColumn("_rank", F.col("_id") - F.col("_first") + 1).drop("_tie", "_id", "_first")


def fdr(df: DataFrame, alpha: float = 0.05, partition_by: list[str] | None = None, pval: str = "pval", ranged: bool = False) -> DataFrame:
    """Benjamini-Hochberg: pval_corrected and significant (<= alpha) in each partition.

    By default a window sees each partition, which suits tables of a row a gene.
    ``ranged`` is for tables of a row a variant: rows are ranked by sorted ranges,
    and the least value of all later ranks is found in two passes, over the ranges
    and inside each.
    """
    group = partition_by or []
    if ranged:
        keys = [f"{k}{i}" for i in range(len(group)) for k in ("_k", "_u")]
        ranked = ranks(df, group, pval)
        raw = F.col(pval) * F.col("_m") / F.col("_rank")
        each = ranked.groupBy(*keys, "_part").agg(F.min(raw).alias("_least"))
        if group:  # a row a range and group
            later = each.withColumn("_later", F.min("_least").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(1, Window.unboundedFollowing))).drop("_least")
            joined = ranked.join(later, [*keys, "_part"])
        else:  # a row a range
            least, so_far = [None] * RANGES, None
            for r in sorted(each.collect(), reverse=True):
                least[r["_part"]] = so_far
                so_far = r["_least"] if so_far is None or (r["_least"] is not None and r["_least"] < so_far) else so_far
            joined = ranked.withColumn("_later", F.get(F.array(*[F.lit(v).cast("double") for v in least]), F.col("_part")))
        inside = Window.partitionBy(*keys, "_part").orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
        out = joined.withColumn("pval_corrected", F.when(F.col(pval).isNotNull(), F.least(F.min(raw).over(inside), F.col("_later"), F.lit(1.0))))
        out = out.drop(*keys, "_part", "_later", "_m", "_rank")
    else:
        every = Window.partitionBy(*group)
        ranked = df.withColumn("_m", F.count(pval).over(every)).withColumn("_rank", F.row_number().over(every.orderBy(F.col(pval).asc_nulls_last())))
        raw = F.col(pval) * F.col("_m") / F.col("_rank")
        down = every.orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
        out = ranked.withColumn("pval_corrected", F.when(F.col(pval).isNotNull(), F.least(F.min(raw).over(down), F.lit(1.0)))).drop("_m", "_rank")
    return out.withColumn("significant", F.coalesce(F.col("pval_corrected") <= alpha, F.lit(False)))


def bonferroni(df: DataFrame, alpha: float = 0.05, partition_by: list[str] | None = None, pval: str = "pval") -> DataFrame:
    """p times the number of tests, not clipped; significant is strictly below alpha."""
    n = F.count("*").over(Window.partitionBy(*(partition_by or [])))
    out = df.withColumn("pval_corrected", F.col(pval) * n)
    return out.withColumn("significant", F.coalesce(F.col("pval_corrected") < alpha, F.lit(False)))


METHODS = {"FDR": fdr, "Bonferroni": bonferroni}


def correct(df: DataFrame, method: str, alpha: float = 0.05, partition_by: list[str] | None = None, pval: str = "pval", **options) -> DataFrame:
    """Correction by name, with a column ``correction_method``; an unknown name is an error. options: those of the correction."""
    if method not in METHODS:
        raise ValueError(f"unknown correction {method!r}; there are {sorted(METHODS)}")
    return METHODS[method](df, alpha, partition_by, pval, **options).withColumn("correction_method", F.lit(method))


def min_bonferroni(pval: str = "pval") -> Column:
    """The least p times the number of p-values (not clipped)."""
    return F.min(pval) * F.count(pval)


def cauchy(pval: str = "pval") -> Column:
    """Cauchy combination of p-values; a tangent near its pole is replaced by 1/(p pi)."""
    p = F.col(pval)
    term = F.when(p < 1e-15, 1 / (p * math.pi)).when(p > 1 - 1e-15, F.lit(-1e15)).otherwise(F.tan((0.5 - p) * math.pi))
    t = F.avg(term)
    return F.when(t > 1e15, 1 / t / math.pi).otherwise(0.5 - F.atan(t) / math.pi)


COMBINATIONS = {"bonferroni": min_bonferroni, "cct": cauchy}


def combine(df: DataFrame, keys: list[str], method: str = "bonferroni", pval: str = "pval") -> DataFrame:
    """One p-value a group; null keys are a group of their own."""
    if method not in COMBINATIONS:
        raise ValueError(f"unknown combination {method!r}; there are {sorted(COMBINATIONS)}")
    return df.groupBy(*keys).agg(COMBINATIONS[method](pval).alias("pval"))


def combine_several(df: DataFrame, keys: list[str], methods: dict[str, str], pval: str = "pval") -> DataFrame:
    """One column a method (name -> method), from one aggregation."""
    return df.groupBy(*keys).agg(*[COMBINATIONS[m](pval).alias(name) for name, m in methods.items()])


def with_n_tests(df: DataFrame, partition_by: list[str]) -> DataFrame:
    return df.withColumn("n_tests", F.count("*").over(Window.partitionBy(*partition_by)))


def qq_points(df: DataFrame, partition_by: list[str] | None = None, pval: str = "pval", ranged: bool = False, ties: list[str] | None = None) -> DataFrame:
    """Observed and expected -log10 p by ascending p, equal ones by the columns ``ties``; ``ranged`` as in ``fdr``, for tables without null p-values."""
    if ranged:
        ranked = ranks(df, partition_by or [], pval, ties)
        out = ranked.withColumns({"expected": -F.log10(F.col("_rank") / F.col("_m")), "observed": -F.log10(pval)})
        return out.select(*df.columns, "expected", "observed")
    every = Window.partitionBy(*(partition_by or []))
    rank = F.row_number().over(every.orderBy(pval, *(ties or [])))
    return df.withColumn("expected", -F.log10(rank / F.count("*").over(every))).withColumn("observed", -F.log10(pval))


def genomic_inflation(chi2: str = "chi2") -> Column:
    """Median of one-degree chi-squared statistics over the median of that distribution."""
    return F.percentile(chi2, 0.5) / 0.45493642311957283
