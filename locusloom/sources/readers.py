"""Scans of the file kinds of a rare-variant study. Every reader names its schema; nothing is inferred."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar

CALLS = "chrom string, pos long, ref string, alt string, sample string, gt int"
VARIANTS = "chrom string, pos long, ref string, alt string"
GTF = "chrom string, source string, feature string, start long, end long, score string, strand string, frame string, attributes string"


def tsv(spark: SparkSession, path: str | list[str], schema: str, recursive: bool = False, glob: str | None = None, **options) -> DataFrame:
    """Headerless tab-separated files; empty files give no rows."""
    reader = spark.read.schema(schema).option("sep", "\t").options(**options)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.csv(path)


def calls(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return tsv(spark, path, CALLS)


def variants(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return tsv(spark, path, VARIANTS)


def sample_list(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.schema("sample string").csv(path).where("sample is not null").distinct()


def excluded_variants(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, VARIANTS, recursive=True, glob="*.tsv*").distinct()


def excluded_calls(spark: SparkSession, path: str, chromosome: str | None = None) -> DataFrame:
    """Lists of calls to leave out; one scan of all files, with those of a chromosome selected by a filter."""
    rows = tsv(spark, path, "chrom string, pos long, ref string, alt string, sample string", recursive=True, glob="*.tsv*")
    return rows.where(F.col("chrom") == chromosome) if chromosome else rows


def excluded_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("sample string").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").csv(path).where("sample is not null").distinct()


def parquet(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return df.select(*columns) if columns else df


def parquet_columns(spark: SparkSession, path: str) -> list[str]:
    """Names of the columns, from the footer only."""
    return spark.read.parquet(path).columns


def labelled_results(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of result files with ``method``: the two folders above a file's own, joined by a dash (.../type/test/eval/file.parquet is type-test)."""
    return concat_same([spark.read.parquet(p).withColumn("method", scalar.method_of(F.lit(p))) for p in paths])


def file_stem(path: Column | None = None) -> Column:
    """The file's name without folders and suffixes."""
    return F.regexp_extract(path if path is not None else F.input_file_name(), r"([^/]+?)(\.[^/.]+)*$", 1)


def annotator_table(spark: SparkSession, path: str) -> DataFrame:
    """Annotator output: lines from ## on are comments, the next line names the columns, - is null. All columns are strings."""
    lines = spark.read.text(path)
    header = lines.where(~F.startswith("value", F.lit("##")) & F.startswith("value", F.lit("#"))).first()["value"]
    names = header.split("\t")
    cells = F.split("value", "\t")
    rows = lines.where(~F.startswith("value", F.lit("#")))
    return rows.select(*[F.nullif(F.get(cells, F.lit(i)), F.lit("-")).alias(n) for i, n in enumerate(names)])


def concat_same(tables: list[DataFrame]) -> DataFrame:
    """Rows of all tables; different columns are an error."""
    names = set(tables[0].columns)
    for t in tables[1:]:
        if set(t.columns) != names:
            raise ValueError(f"columns differ: {sorted(names ^ set(t.columns))}")
    return reduce(DataFrame.unionByName, tables)


def attribute(name: str) -> Column:
    return F.nullif(F.regexp_extract("attributes", rf'(?:^|;)\s*{name} "?([^";]*)"?', 1), F.lit(""))


def gtf(spark: SparkSession, path: str, attributes: tuple[str, ...] = ("gene_id", "gene_name", "gene_type", "transcript_type")) -> DataFrame:
    """Intervals with 0-based start and the named attributes as columns."""
    rows = tsv(spark, path, GTF, comment="#", quote="")
    return rows.withColumn("start", F.col("start") - 1).select("chrom", "source", "feature", "start", "end", "strand", *[attribute(a).alias(a) for a in attributes])


def bed(variants_: DataFrame) -> DataFrame:
    """Variants as BED rows named ref/alt, 0-based."""
    return variants_.select("chrom", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"), F.concat_ws("/", "ref", "alt").alias("name"))


def missingness_samples(lines: DataFrame) -> DataFrame:
    """sample, n_missing of per-sample statistics lines (columns 1 and 11)."""
    cells = F.split("value", r"\t")
    return lines.select(cells[1].alias("sample"), cells[11].cast("long").alias("n_missing"))


def missingness_sites(lines: DataFrame) -> DataFrame:
    """n_sites of per-site statistics: column 1 of each file's first line, the one of kind SITE0."""
    cells = F.split("value", r"\t")
    return lines.where(cells[0] == "SITE0").select(cells[1].cast("long").alias("n_sites"))


def space_separated(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Result tables of an external regression tool."""
    reader = spark.read.option("sep", " ").option("header", "true").option("nullValue", "NA")
    return (reader.schema(schema) if schema else reader).csv(path)


def wide_genotypes(df: DataFrame, meta: int = 6) -> DataFrame:
    """Long form of a table whose columns after the first ``meta`` are allele counts of variants chr:pos:..."""
    ids = df.columns[:meta]
    long = df.unpivot(ids, df.columns[meta:], "var_name", "ac")
    parts = F.split("var_name", ":")
    return long.withColumn("chrom", parts[0]).withColumn("pos", parts[1].cast("long"))


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """Text VCF in long form: chrom, pos, ref, alt (list), sample, genotype string; the header line names the samples."""
    lines = spark.read.text(path)
    header = lines.where(F.startswith("value", F.lit("#CHROM"))).first()["value"].split("\t")
    cells = F.split("value", "\t")
    rows = lines.where(~F.startswith("value", F.lit("#")))
    site = rows.select(cells[0].alias("chrom"), cells[1].cast("long").alias("pos"), cells[3].alias("ref"), F.split(cells[4], ",").alias("alts"), F.posexplode(F.slice(cells, 10, len(header) - 9)).alias("at", "cell"))
    names = F.array(*[F.lit(s) for s in header[9:]])
    return site.select("chrom", "pos", "ref", "alts", F.get(names, F.col("at")).alias("sample"), F.split("cell", ":")[0].alias("genotype"))


def split_alleles(sites: DataFrame) -> DataFrame:
    """One row an alternative allele, with the dosage of that allele; null where an allele is missing."""
    rows = sites.select("chrom", "pos", "ref", "sample", "genotype", F.posexplode("alts").alias("k", "alt"))
    alleles = F.split("genotype", r"[/|]")
    count = F.size(F.filter(alleles, lambda a: a == (F.col("k") + 1).cast("string")))
    return rows.select("chrom", "pos", "ref", "alt", "sample", F.when(~F.array_contains(alleles, "."), count).alias("gt"))


def carried_variants(calls_: DataFrame) -> DataFrame:
    """Variants with at least one alternative call."""
    return calls_.groupBy("chrom", "pos", "ref", "alt").agg(F.sum("gt").alias("ac")).where("ac > 0").drop("ac")


def nonref_calls(calls_: DataFrame) -> DataFrame:
    return calls_.where("gt > 0")


def named_variants(variants_: DataFrame) -> DataFrame:
    """Variants without chr and with the name chr_pos_ref_alt."""
    bare = F.regexp_replace("chrom", "^chr", "")
    return variants_.withColumn("chrom", bare).withColumn("name", F.concat_ws("_", "chrom", "pos", "ref", "alt"))
