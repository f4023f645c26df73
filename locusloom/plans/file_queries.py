"""Queries over text files and partitioned tables that are written from the study's tables first, into the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.shared import shared_dir
from ..operators import annotate, gene_test
from ..sources import readers, sinks
from . import study
from .queries import CALLS, STUDY, query, rounded


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def text_of(df: DataFrame, cells: list[Column | str], name: str, sep: str = "\t", head: list[str] | None = None) -> str:
    """The folder of a text file a partition: a row's cells, with ``head`` as the first lines of one more file."""
    path = place(df.sparkSession, name)
    df.select(F.concat_ws(sep, *[F.coalesce(scalar.col(c).cast("string"), F.lit("")) for c in cells]).alias("value")).write.text(path)
    if head:
        df.sparkSession.createDataFrame([(line,) for line in head], "value string").coalesce(1).write.mode("append").text(path)
    return path


@query("scan_calls", f"with {CALLS} select p_type as chrom, p_partkey as pos, p_brand as ref, p_name as alt, cast(sample as varchar) as sample, gt from calls join part on p_partkey = variant_id")
def scan_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls written as headerless TSV, an empty file among them, and read back."""
    path = text_of(study.site_calls(spark, sf_dir), ["chrom", "pos", "ref", "alt", "sample", "gt"], "calls")
    study.calls(spark, sf_dir).where("false").select(F.lit("").alias("value")).coalesce(1).write.mode("append").text(path)
    return readers.calls(spark, path)


@query("scan_variants", "select p_type as chrom, p_partkey - 1 as start, p_partkey as end, p_brand || '/' || p_name as name from part")
def scan_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants read from TSV, as BED rows."""
    return readers.bed(readers.variants(spark, text_of(study.variants(spark, sf_dir), ["chrom", "pos", "ref", "alt"], "variants")))


@query("scan_exclusions", "select p_type as chrom, count(distinct p_partkey) as n_variants, count(*) as n_calls, (select count(distinct p_brand) from part) as n_samples, (select count(distinct p_brand) from part) as n_listed from part join lineitem on l_partkey = p_partkey group by 1")
def scan_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of variants (repeats count once), calls and samples to leave out, in nested folders by file name."""
    rows = study.table(spark, sf_dir, "lineitem").join(study.variants(spark, sf_dir), F.col("id") == F.col("l_partkey"))
    root = place(spark, "exclusions")
    site = F.concat_ws("\t", "chrom", "pos", "ref", "alt")
    write = lambda df, folder, suffix: df.select("value").write.option("compression", "none").format("csv").options(sep="\x01", quote="", escape="", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").save(f"{root}/{folder}/part.{suffix}")
    write(rows.select(site.alias("value")), "variants/all", "dir")
    write(rows.select(F.concat_ws("\t", site, "l_orderkey").alias("value")), "calls/all", "dir")
    write(study.variants(spark, sf_dir).select(F.col("gene").alias("value")), "samples/all", "dir")
    # the readers pick files by their suffix; Spark names its own .csv
    variants = readers.tsv(spark, f"{root}/variants", readers.VARIANTS, recursive=True, glob="*.csv").distinct()
    calls = readers.tsv(spark, f"{root}/calls", f"{readers.VARIANTS}, sample string", recursive=True, glob="*.csv")
    samples, listed = readers.excluded_samples(spark, f"{root}/samples").count(), readers.sample_list(spark, f"{root}/samples/all/part.dir").count()
    counted = calls.groupBy("chrom").agg(F.count("*").alias("n_calls"))
    return variants.groupBy("chrom").agg(F.count("*").alias("n_variants")).join(counted, "chrom").withColumns({"n_samples": F.lit(samples).cast("long"), "n_listed": F.lit(listed).cast("long")})


@query("scan_annotator", """select p_type as chrom, p_partkey as pos, 'A' as ref, 'T' as alt, nullif(case when p_size % 4 = 0 then '-' else p_brand || '.2' end, '-') as "Gene",
(p_size % 3 = 0)::int as "Consequence_stop_gained", 1 as "Consequence_missense_variant" from part""")
def scan_annotator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An annotator's table with comments and a header line, its names parsed and its consequences flagged."""
    v = study.variants(spark, sf_dir).withColumn("chrom", F.regexp_replace("chrom", " ", "-"))
    name = F.concat(F.lit("chr"), "chrom", F.lit("_"), F.col("pos").cast("string"), F.lit("_A/T"))
    gene = F.when(F.col("size") % 4 == 0, "-").otherwise(F.concat("gene", F.lit(".2")))
    kind = F.when(F.col("size") % 3 == 0, "missense_variant,stop_gained").otherwise("missense_variant")
    path = text_of(v, [name, gene, kind], "annotator", head=["## made for the study", "#Uploaded_variation\tGene\tConsequence"])
    sites = v.select(name.alias("#Uploaded_variation"), F.concat(F.lit("chr"), "chrom").alias("chrom"), "pos", F.lit("A").alias("ref"), F.lit("T").alias("alt"))
    found = annotate.process_annotator(readers.annotator_table(spark, path), sites, ["stop_gained", "missense_variant"])
    return found.select(F.regexp_replace(F.regexp_replace("chrom", "^chr", ""), "-", " ").alias("chrom"), "pos", "ref", "alt", "Gene", *[F.col(c).cast("int").alias(c) for c in ("Consequence_stop_gained", "Consequence_missense_variant")])


@query("scan_gtf", "with g as (select p_brand || '.1' as gene, min(p_partkey) as s, max(p_partkey) as e from part group by 1) select row_number() over (order by s - 1, gene) - 1 as id, gene, 'N' || replace(gene, '.1', '') as gene_name from g")
def scan_gtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene intervals of a GTF text with comments, repeated versions of a gene taken once."""
    genes = study.variants(spark, sf_dir).groupBy("gene").agg(F.min("pos").alias("s"), F.max("pos").alias("e"))
    every = genes.select("gene", F.explode(F.array(F.lit("1"), F.lit("2"))).alias("version"), "s", "e")
    # a later version of a gene begins after all others
    start = F.when(F.col("version") == "1", F.col("s")).otherwise(F.col("s") + 10_000_000)
    about = F.format_string('gene_id "%s.%s"; gene_type "protein_coding"; gene_name "N%s";', "gene", "version", "gene")
    cells = [F.lit("chr1"), F.lit("HAVANA"), F.lit("gene"), start, F.col("e") + 20_000_000, F.lit("."), F.lit("+"), F.lit("."), about]
    path = text_of(every, cells, "gtf", head=["#!genome-build x"])
    return annotate.gene_table(readers.gtf(spark, path)).select("id", "gene", "gene_name")


@query("scan_missingness", "select cast(o_custkey as varchar) as sample, count(*) as n_missing, (select count(*) from part) as n_sites from orders group by 1")
def scan_missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-sample and per-site statistics lines."""
    counts = study.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    zeros = [F.lit("0")] * 9
    samples = readers.missingness_samples(spark.read.text(text_of(counts, [F.lit("FLT0"), "o_custkey", *zeros, "n", F.lit("0")], "sample_statistics")))
    total = study.variants(spark, sf_dir).agg(F.count("*").alias("n"))
    sites = readers.missingness_sites(spark.read.text(text_of(total, [F.lit("SITE0"), "n"], "site_statistics", head=["FLT0\t3"]))).first()["n_sites"]
    return samples.withColumn("n_sites", F.lit(sites).cast("long"))


@query("text_table_back", "select cast(c_custkey as varchar) as \"FID\", cast(c_custkey as varchar) as \"IID\", case when c_acctbal >= 0 then c_acctbal end as y, c_nationkey::double as nation from customer")
def text_table_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A covariate table with missing values in an external tool's form, written and read."""
    people = study.samples(spark, sf_dir).withColumn("y", F.when(F.col("y") >= 0, F.col("y")))
    path = place(spark, "covariates")
    sinks.text_table(sinks.covariate_table(people, ["y", "nation"]), path)
    return readers.space_separated(spark, path, "FID string, IID string, y double, nation double")


@query("genotypes_by_chromosome", f"with {CALLS} select p_type as chrom, count(*) as n, sum(gt)::bigint as alleles, 'chrom,gt,sample,variant_id' as columns from calls join part on p_partkey = variant_id group by 1")
def genotypes_by_chromosome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls written in a folder a chromosome; counted from the folders, with the names in the footers."""
    rows = study.site_calls(spark, sf_dir).join(study.variants(spark, sf_dir).select(F.col("id").alias("variant_id"), "chrom", "pos"), ["chrom", "pos"])
    path = place(spark, "genotypes")
    sinks.genotypes_by_chromosome(rows.select("chrom", "sample", "variant_id", "gt"), path)
    columns = ",".join(sorted(readers.parquet_columns(spark, path)))
    return readers.parquet(spark, path).groupBy("chrom").agg(F.count("*").alias("n"), F.sum("gt").cast("long").alias("alleles"), F.lit(columns).alias("columns"))


@query("saved_burdens_back", f"with {STUDY} select gene, count(*) as n, round(sum(value), 4) as total from (select sample, gene, sum(value) as value from vals group by 1, 2) group by 1")
def saved_burdens_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: burdens saved in buckets of genes, each gene in one bucket only."""
    burdens = gene_test.collapse(study.weighted(study.carriers(spark, sf_dir)))
    path = place(spark, "burdens")
    sinks.saved_burdens(burdens, path, 8)
    found = readers.parquet(spark, path).groupBy("gene").agg(F.count("*").alias("n"), F.sum("b").alias("total"), F.count_distinct("gene_bucket").alias("buckets"))
    return rounded(found.where("buckets = 1").drop("buckets"), "total", digits=4)


@query("scalar_forms", """select p_partkey as id, case when p_size = 7 then -1 else p_size end as size, p_size % 9 as repeat, case when p_size % 5 = 0 then -1 else (p_size % 3 > 0)::int + (p_size % 4 > 1)::int end as dosage,
replace(p_brand, 'Brand#', '') as bare, p_partkey % 11 as shifted from part""")
def scalar_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replaced values, numbers of repeats in names, dosages of genotype strings, names without a prefix."""
    v, size = study.variants(spark, sf_dir), F.col("size")
    second = F.when(size % 5 == 0, ".").otherwise((size % 4 > 1).cast("int").cast("string"))
    genotype = F.concat((size % 3 > 0).cast("int").cast("string"), F.when(size % 2 == 0, "/").otherwise("|"), second)
    name = F.concat(F.lit("model_a_"), (size % 9).cast("string"))
    return v.select(
        "id", scalar.replaced("size", 7, -1).alias("size"), scalar.repeat_of(name).alias("repeat"), F.coalesce(scalar.dosage(genotype), F.lit(-1)).alias("dosage"),
        scalar.remove_prefix("gene", "Brand#").alias("bare"), scalar.remove_prefix((F.col("id") % 11).cast("string"), "chr").cast("long").alias("shifted"),
    )
