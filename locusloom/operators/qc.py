"""Quality control of calls, variants and samples. Calls carry sample, site, dosage gt (null: missing), depth, allele_ratio."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .genotype import SITE


def is_snp() -> Column:
    return (F.length("ref") == 1) & (F.length("alt") == 1)


def allelic_imbalance(calls: DataFrame, key: list[str] = SITE, snp: float = 0.15, indel: float = 0.20) -> DataFrame:
    """Sites with heterozygous calls of which none has an allele ratio above the bound for its type."""
    het = calls.where("gt = 1")
    good = F.col("allele_ratio") > F.when(is_snp(), snp).otherwise(indel)
    return het.groupBy(*key).agg(F.max(F.coalesce(good, F.lit(False))).alias("good")).where("not good").drop("good")


def variant_missingness(calls: DataFrame, key: list[str] = SITE, bound: float = 0.1) -> DataFrame:
    """Sites of which at least ``bound`` of the calls are missing."""
    return calls.groupBy(*key).agg(F.avg(F.col("gt").isNull().cast("double")).alias("missing")).where(F.col("missing") >= bound)


def low_depth(calls: DataFrame, snp: int = 7, indel: int = 10) -> DataFrame:
    """Non-reference calls read less often than the bound for their type."""
    return calls.where((F.col("gt") > 0) & (F.col("depth") < F.when(is_snp(), snp).otherwise(indel)))


def log_factorial(n: np.ndarray) -> np.ndarray:
    """Natural logarithms of n!, by Stirling's series from 10 on."""
    x = np.maximum(np.asarray(n, float), 0) + 1
    small = x < 10
    z = np.where(small, x + 10, x)
    series = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return np.where(small, series - sum(np.log(x + k) for k in range(10)), series)


def outward(h: np.ndarray, rare: np.ndarray, n: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Sum of the chances of h, h + 2 side, ... over that of h, for each site, until terms no longer count."""
    total, term, h = np.ones(len(h)), np.ones(len(h)), h.astype(float)
    on = np.arange(len(h))
    while len(on):
        x, r, c = h[on], (rare[on] - h[on]) / 2, n[on] - (rare[on] + h[on]) / 2
        ratio = np.where(side[on] > 0, 4 * r * c / ((x + 2) * (x + 1)), x * (x - 1) / (4 * (r + 1) * (c + 1)))
        term[on] *= np.maximum(ratio, 0)
        total[on] += term[on]
        h[on] += 2 * side[on]
        on = on[term[on] > 1e-17 * total[on]]
    return total


def hwe_batch(ref: np.ndarray, het: np.ndarray, alt: np.ndarray) -> np.ndarray:
    """Exact Hardy-Weinberg p-values of genotype counts: the summed chance of all heterozygote counts no likelier than that seen.

    Sums run outwards from the likeliest count, from the one seen, and from the
    first on the other side that is no likelier; they end where terms vanish, after
    some standard deviations and not after all counts.
    """
    n, rare = (ref + het + alt).astype(float), (2 * np.minimum(ref, alt) + het).astype(float)
    seen, p = het.astype(float), np.ones(len(ref))
    with np.errstate(invalid="ignore", divide="ignore"):
        logs = lambda h, at: h * math.log(2) - log_factorial((rare[at] - h) / 2) - log_factorial(h) - log_factorial(n[at] - (rare[at] + h) / 2)
        mode = np.floor(np.where(n > 0, rare * (2 * n - rare) / (2 * n), 0))
    mode += (mode - rare) % 2
    mode = np.minimum(mode, rare)
    every = np.arange(len(ref))
    for _ in range(3):  # the estimate is at most a step or two off
        for side in (2, -2):
            other = np.clip(mode + side, rare % 2, rare)
            mode = np.where(logs(other, every) > logs(mode, every), other, mode)
    top, own = logs(mode, every), logs(seen, every)
    far = np.flatnonzero((rare > 0) & (own < top - 1e-9))
    if not len(far):
        return p
    h, m, rare_, n_ = seen[far], mode[far], rare[far], n[far]
    right = h > m
    side = np.where(right, 1, -1)
    whole = outward(m, rare_, n_, side) + outward(m, rare_, n_, -side) - 1
    # on the other side: the count nearest to the mode that is no likelier than that seen, by bisection; beyond the end if there is none
    near, end = m.copy(), np.where(right, rare_ % 2 - 2, rare_ + 2)
    while (wide := np.abs(near - end) > 2).any():
        middle = near + 2 * np.trunc((end - near) / 4)
        low = logs(middle, far) <= own[far] + 1e-9
        end, near = np.where(wide & low, middle, end), np.where(wide & ~low, middle, near)
    tail = outward(h, rare_, n_, side)
    there = np.flatnonzero((end >= 0) & (end <= rare_))
    tail[there] += outward(end[there], rare_[there], n_[there], -side[there]) * np.exp(logs(end[there], far[there]) - own[far[there]])
    p[far] = np.minimum(1.0, np.exp(own[far] - top[far]) * tail / whole)
    return p


def hwe_exact(ref: int, het: int, alt: int) -> float:
    """The p-value of one site."""
    return float(hwe_batch(*(np.array([x]) for x in (ref, het, alt)))[0])


def hardy_weinberg(calls: DataFrame, n_samples: int | None = None, key: list[str] = SITE, bound: float = 1e-15) -> DataFrame:
    """Sites with their genotype counts and exact p, where p <= ``bound``. With ``n_samples``, absent calls are reference."""
    n = F.lit(n_samples) if n_samples else F.count("gt")
    counts = calls.groupBy(*key).agg(F.count_if(F.col("gt") == 1).alias("het"), F.count_if(F.col("gt") == 2).alias("hom_alt"), n.alias("n"))
    counts = counts.withColumn("hom_ref", F.col("n") - F.col("het") - F.col("hom_alt"))

    @F.pandas_udf("double")
    def p(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ref, het, alt in batches:
            yield pd.Series(hwe_batch(*(x.to_numpy(np.int64) for x in (ref, het, alt))))

    return counts.withColumn("hwe_p", p("hom_ref", "het", "hom_alt")).where(F.col("hwe_p") <= bound)


def individual_missingness(samples: DataFrame, sites: DataFrame, threshold: float = 0.1) -> DataFrame:
    """sample, missingness of samples at or above the threshold. samples: sample, n_missing a file; sites: n_sites a file."""
    total = sites.agg(F.sum("n_sites").alias("total")).first()["total"] or 0
    summed = samples.groupBy("sample").agg(F.sum("n_missing").alias("n_missing"))
    rate = summed.select("sample", (F.col("n_missing") / F.nullif(F.lit(total), F.lit(0))).alias("missingness"))
    return rate.where(F.col("missingness") >= threshold)
