"""Significant genes: corrected, combined and ranked results, seed genes, fold handling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from .checks import CheckFailed, checked_join, require_same_rows, require_unique
from .genotype import dense_ids
from .masks import eac_filter
from .multitest import combine, correct, genomic_inflation, qq_points
from .transform import standardize, transform_y, union_all


# The two types of discovery.
NEW, BASELINE = "New discovery", "Baseline"


def load_baseline(results: DataFrame, method: str, least_eac: float = 50, alpha: float = 0.05, correction: str = "FDR") -> DataFrame:
    """Rows of a baseline with enough expected alleles and a p-value, labelled and corrected."""
    rows = eac_filter(results, least_eac, inclusive=True).where(F.col("pval").isNotNull())
    return correct(rows, correction, alpha).withColumn("Method", F.lit(method)).withColumn("Discovery type", F.lit(BASELINE))


def combine_results(network: DataFrame, baselines: list[DataFrame], alpha: float = 0.05, correction: str = "FDR", combination: str = "bonferroni") -> DataFrame:
    """All results with a combined baseline, corrected for each method; the combined rows have no effect size."""
    found = network.withColumn("Method", F.lit("network")).withColumn("Discovery type", F.lit(NEW))
    out = [found]
    if baselines:
        rows = union_all(baselines)
        combined = combine(rows, ["phenotype", "gene"], combination).withColumn("Method", F.lit("combined baseline"))
        out += [rows.drop("pval_corrected", "significant", "correction_method"), combined]
    tests = union_all(out)
    return correct(tests, correction, alpha, ["Method"]).withColumn("-log10pval", scalar.minus_log10("pval"))


def process_results(results: DataFrame, baselines: list[DataFrame] | None = None, alpha: float = 0.05, correction: str = "FDR", combination: str = "bonferroni", repeats: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(significant, all) rows: a network's results of the named repeats with the baselines and their combination.

    Raises if a gene of a phenotype has several results of the network. A
    significant gene of a phenotype and method stands once (see ``ranked``).
    """
    rows = results.where(scalar.repeat_of("model").isin(repeats)) if repeats else results
    if not rows.groupBy("phenotype", "gene").count().where("count > 1").isEmpty():
        raise CheckFailed("a gene has several results of the network")
    every = combine_results(rows, baselines or [], alpha, correction, combination)
    every = every if "beta" in every.columns else every.withColumn("beta", F.lit(None).cast("double"))
    every = every.select("phenotype", "gene", "Method", "Discovery type", "beta", "pval", "-log10pval", "pval_corrected", "significant")
    return ranked(every.where("significant")), every


def ranked(significant: DataFrame) -> DataFrame:
    """Ordered by phenotype, gene, method, baselines before new discoveries (no type last) and p; the first row of each phenotype, gene and method."""
    kind = F.when(F.col("Discovery type") == BASELINE, 0).when(F.col("Discovery type") == NEW, 1).otherwise(2)
    first = F.row_number().over(Window.partitionBy("phenotype", "gene", "Method").orderBy(kind, "pval"))
    return significant.withColumn("_n", first).where("_n = 1").drop("_n").orderBy("phenotype", "gene", "Method", kind, "pval")


def seed_genes(results: DataFrame, alpha: float = 0.05, correction: str = "Bonferroni", least: int = 3, most: int | None = None, min_eac: float | None = None, below: float | None = None) -> DataFrame:
    """One row a gene: all significant ones, or the ``least`` best if fewer are; ``below`` is another bound for the corrected p.

    Gene-level tables: the corrections' windows see one row a test.
    """
    rows = eac_filter(results, min_eac) if min_eac is not None else results
    tested = correct(rows, correction, alpha)
    if below is not None:
        tested = tested.withColumn("significant", F.col("pval_corrected") < below)
    best = tested.withColumn("_n", F.row_number().over(Window.partitionBy("gene").orderBy("pval_corrected", "pval"))).where("_n = 1").drop("_n")
    place = F.row_number().over(Window.orderBy("pval_corrected", "pval", "gene"))
    n = F.sum(F.col("significant").cast("int")).over(Window.partitionBy())
    out = best.withColumn("_place", place).withColumn("_hits", n).where(F.col("significant") & (F.col("_hits") >= least) | (F.col("_hits") < least) & (F.col("_place") <= least))
    return (out.where(F.col("_place") <= most) if most else out).drop("_place", "_hits")


def seed_genes_with_ids(seeds: DataFrame, genes: DataFrame) -> DataFrame:
    return checked_join(seeds, genes, ["gene"], "inner", "1:1")


def significant_genes(results: DataFrame, genes: DataFrame, correction: str = "FDR", alpha: float = 0.05, top: int | None = None) -> DataFrame:
    """Significant genes with their metadata; ``top`` keeps the first few for a debugging run, equal p-values by gene."""
    found = correct(results, correction, alpha).where("significant").select("gene", "pval_corrected").join(genes, "gene")
    return found.orderBy("pval_corrected", "gene").limit(top) if top else found


def evaluate_seed(results: DataFrame, alpha: float = 0.05, least_eac: float = 50) -> DataFrame:
    """phenotype, method, n_significant, n_genes, lambda_gc under both corrections; chi2 statistics in a column ``stat``."""
    rows = results.where((F.col("EAC") > least_eac) & F.col("pval").isNotNull())
    parts = [correct(rows, m, alpha, ["phenotype"]) for m in ("FDR", "Bonferroni")]
    return union_all(parts).groupBy("phenotype", F.col("correction_method").alias("method")).agg(
        F.count_if("significant").alias("n_significant"), F.count_distinct(F.when(F.col("significant"), F.col("gene"))).alias("n_genes"), genomic_inflation("stat").alias("lambda_gc"))


def qq_table(results: DataFrame, partition_by: list[str], ties: list[str] | None = None) -> DataFrame:
    return qq_points(results.where("pval is not null"), partition_by, ties=ties)


def external_results(rows: DataFrame, genes: DataFrame) -> DataFrame:
    """phenotype, gene, beta, pval of an external tool's table (ID: name_of_gene, LOG10P)."""
    keyed = rows.withColumn("gene_name", F.split("ID", "_")[2])
    joined = checked_join(keyed, genes.select("gene_name", "gene"), ["gene_name"], "left", "m:1", equal_rows=True)
    return joined.select("phenotype", "gene", F.col("BETA").alias("beta"), scalar.from_log10("LOG10P").alias("pval"))


def with_phenotype(burdens: DataFrame, samples: DataFrame) -> DataFrame:
    """Burdens with y and x by sample; raises on repeated samples or none in common."""
    joined = checked_join(burdens, samples, ["sample"], "inner", "m:1")
    if joined.isEmpty():
        raise CheckFailed("no sample has both a burden and a phenotype")
    return joined


def with_simulated(samples: DataFrame, simulated: DataFrame, y: str = "y") -> DataFrame:
    """Samples with a simulated phenotype in place of ``y``; null where a sample has none, raises on repeated samples."""
    return checked_join(samples.drop(y), simulated.select("sample", y), ["sample"], "left", "1:1")


def aligned(tables: list[DataFrame], key: str = "sample") -> list[DataFrame]:
    """The tables themselves; raises unless all hold the same samples, once each."""
    for other in tables:
        require_same_rows(tables[0].select(key), require_unique(other, [key], "a fold's table").select(key), [key], [])
    return tables


def combine_folds(folds: list[DataFrame | list[DataFrame]], x: list[str], y: str, how: str | None = None) -> DataFrame:
    """Held-out samples of all folds, x standardised and y transformed anew over the union.

    A fold is a table, or several (burdens, covariates, phenotype) that must hold
    the same samples. Raises if they don't, or if a sample is held out twice.
    """
    joined = [f if isinstance(f, DataFrame) else reduce(lambda a, b: a.join(b, "sample"), aligned(f)) for f in folds]
    rows = union_all(joined)
    if not rows.groupBy("sample").count().where("count > 1").isEmpty():
        raise CheckFailed("a sample is held out by several folds")
    return transform_y(standardize(rows, x), y, how)


def seeded(seed: int, key: str = "sample") -> Column:
    """A seeded order of samples: the first 32 bits of an MD5 digest."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")


def bagged(samples: DataFrame, share: float, seed: int, replace: bool = False) -> tuple[DataFrame, DataFrame]:
    """(training, validation) samples of one bag: drawn by a seeded hash (or with replacement), and those not drawn.

    With replacement round(share x n) draws fall on the n samples, each by the hash
    of its number; counts are exactly multinomial and the same however rows are dealt.
    """
    if replace:
        indexed = dense_ids(samples, ["sample"], "_i")
        n = indexed.count()
        draws = samples.sparkSession.range(round(share * n)).select((seeded(seed, "id") % max(1, n)).alias("_i"))
        counts = draws.groupBy("_i").agg(F.count("*").cast("int").alias("_t"))
        found = indexed.join(counts, "_i", "left").drop("_i")
        return found.where("_t > 0").withColumn("_t", F.explode(F.sequence(F.lit(1), F.col("_t")))).drop("_t"), found.where("_t is null").drop("_t")
    bound = int(share * (1 << 32))
    return samples.where(seeded(seed) < bound), samples.where(seeded(seed) >= bound)


def upsampled(samples: DataFrame, y: str, seed: int = 0) -> DataFrame:
    """The smaller of two classes repeated until it is as large as the other; no collect but of the two counts.

    Rows of it come the same number of times, the first few in a seeded order once more.
    """
    counts = {r[y]: r["count"] for r in samples.where(F.col(y).isNotNull()).groupBy(y).count().limit(3).collect()}
    if len(counts) != 2:
        return samples
    (few, a), (_, b) = sorted(counts.items(), key=lambda kv: kv[1])
    small = dense_ids(samples.where(F.col(y) == few), [seeded(seed), "sample"], "_i")
    small = small.withColumn("_t", F.explode(F.sequence(F.lit(1), F.lit(b // a) + (F.col("_i") < b % a).cast("int")))).drop("_t", "_i")
    return samples.where((F.col(y) != few) | F.col(y).isNull()).unionByName(small)


def shuffled_index(samples: DataFrame, seed: int = 0) -> DataFrame:
    """A running index of each phenotype's samples in a seeded random order."""
    return samples.withColumn("index", F.row_number().over(Window.partitionBy("phenotype").orderBy(seeded(seed), "sample")) - 1)
