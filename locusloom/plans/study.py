"""A study's tables taken from an order database: customers are samples, parts are variants, brands are genes.

A call is a part that a customer ordered; its dosage is 2 if the largest quantity
is 25 or more. Phenotypes are account balances, covariates nation and segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Variants with fewer alternative alleles than this among all samples are rare.
RARE_ALLELES = 45


def rare_bound(spark: SparkSession, sf_dir: str) -> float:
    """The allele frequency below which a variant is rare."""
    return RARE_ALLELES / (2.0 * table(spark, sf_dir, "customer").count())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, variant_id, gt."""
    ordered = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    gt = 1 + (F.max("l_quantity") >= 25).cast("int")
    return ordered.groupBy(F.col("o_custkey").alias("sample"), F.col("l_partkey").alias("variant_id")).agg(gt.alias("gt"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, chrom, pos, ref, alt, gene and the numeric features of each variant."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_type").alias("chrom"), F.col("p_partkey").alias("pos"), F.col("p_brand").alias("ref"), F.col("p_name").alias("alt"),
        F.col("p_brand").alias("gene"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))


def site_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by site, as they come from a file."""
    v = variants(spark, sf_dir).select(F.col("id").alias("variant_id"), "chrom", "pos", "ref", "alt")
    return calls(spark, sf_dir).join(v, "variant_id").select("chrom", "pos", "ref", "alt", "sample", "gt")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, y, y_binary, nation, segment."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("sample"), F.col("c_acctbal").alias("y"), (F.col("c_acctbal") < 0).cast("int").alias("y_binary"), F.col("c_nationkey").cast("double").alias("nation"), F.col("c_mktsegment").alias("segment"))


def annotated(spark: SparkSession, sf_dir: str, called: DataFrame | None = None) -> DataFrame:
    """Variants with allele frequency, MAF and weights; ``called`` are the calls, where they are at hand."""
    from ..functions import scalar
    from ..operators.genotype import allele_frequency

    v = variants(spark, sf_dir)
    n = table(spark, sf_dir, "customer").count()
    af = allele_frequency(calls(spark, sf_dir) if called is None else called, v, n)
    return v.join(af, "id").withColumns({"MAF": scalar.maf("af"), "MAF_MB": scalar.maf_mb("af"), "plof": (F.col("size") > 45).cast("int")})


def carriers(spark: SparkSession, sf_dir: str, called: DataFrame | None = None) -> DataFrame:
    """sample, gene, variant_id, gt, weight and features of rare calls: the rows that every gene test starts from."""
    from ..functions import scalar
    from ..operators.masks import thresholds

    called = calls(spark, sf_dir) if called is None else called
    v = annotated(spark, sf_dir, called).where(thresholds([f"MAF < {rare_bound(spark, sf_dir)!r}"]))
    weight = scalar.variant_weight(scalar.beta_weight("MAF"), "plof")
    chosen = v.select(F.col("id").alias("variant_id"), "gene", "MAF", "size", "price", "plof", weight.alias("weight"))
    return called.join(chosen, "variant_id")


def weighted(rows: DataFrame) -> DataFrame:
    """Rows with value = gt x sqrt(weight)."""
    return rows.withColumn("value", F.col("gt") * F.sqrt("weight"))


def gene_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which genes' rare-variant burden goes with the phenotype: gene, beta, stat, pval, pval_corrected, significant."""
    from ..operators import gene_test, multitest, null_model

    people = samples(spark, sf_dir)
    model = null_model.fit_linear(people, "y", ["nation"])
    found = gene_test.score_test(gene_test.collapse(weighted(carriers(spark, sf_dir))), model, people)
    return multitest.correct(found, "FDR").select("gene", "beta", "stat", "pval", "pval_corrected", "significant")
