"""Outputs: Parquet tables, and text tables in the forms of external regression tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.checks import CheckFailed
from ..operators.transform import union_all


def parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists", compression: str = "zstd") -> None:
    writer = df.write.mode(mode).option("compression", compression)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def genotypes_by_chromosome(calls: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder a chromosome, so that scans of one read only its files."""
    parquet(calls.repartition("chrom", F.pmod(F.xxhash64("sample"), F.lit(16))), path, ["chrom"], mode)


def text_table(df: DataFrame, path: str, sep: str = " ") -> None:
    df.write.option("sep", sep).option("header", "true").option("nullValue", "NA").csv(path)


def covariate_table(samples: DataFrame, columns: list[str]) -> DataFrame:
    """FID, IID and the columns."""
    return samples.select(F.col("sample").alias("FID"), F.col("sample").alias("IID"), *columns)


def sample_file(samples: DataFrame) -> DataFrame:
    """ID_1, ID_2, missing with a first row of zeros; ``row`` gives the order."""
    rows = samples.select(F.col("sample").cast("string").alias("ID_1"), F.col("sample").cast("string").alias("ID_2"), F.lit("0").alias("missing"), F.lit(1).alias("row"))
    first = samples.sparkSession.createDataFrame([("0", "0", "0", 0)], "ID_1 string, ID_2 string, missing string, row int")
    return first.unionByName(rows)


def pseudovariants(burdens: DataFrame, genes: DataFrame, position: str = "span") -> DataFrame:
    """gene, chrom, pos, alleles A and C and the probabilities (b, 0, 1-b) of each sample; pos is end - start or the centre."""
    pos = F.col("end") - F.col("start") if position == "span" else F.floor((F.col("start") + F.col("end")) / 2)
    joined = burdens.join(genes.select("gene", "chrom", pos.alias("pos")), "gene")
    return joined.select("gene", "chrom", "pos", F.lit("A").alias("allele1"), F.lit("C").alias("allele2"), "sample", F.array(F.col("b"), F.lit(0.0), 1 - F.col("b")).alias("probabilities"))


def combined_chunks(rows: DataFrame, n_chunks: int, chunk: str = "chunk", index: str = "index") -> DataFrame:
    """Rows of chunks 0..n-1, each numbered from 0, with their place in the whole as ``row``.

    Raises if a chunk is missing or unknown, or its rows aren't numbered without gaps. One count a chunk reaches the driver.
    """
    found = rows.groupBy(chunk).agg(F.count("*").alias("n"), F.count_distinct(index).alias("d"), F.min(index).alias("low"), F.max(index).alias("high")).orderBy(chunk).limit(n_chunks + 1).collect()
    if [r[chunk] for r in found] != list(range(n_chunks)):
        raise CheckFailed(f"chunks 0 to {n_chunks - 1} are wanted; there are {[r[chunk] for r in found]}")
    before, starts = 0, []
    for r in found:
        if (r["low"], r["high"], r["d"]) != (0, r["n"] - 1, r["n"]):
            raise CheckFailed(f"the rows of chunk {r[chunk]} are not numbered from 0 without gaps")
        starts += [F.lit(r[chunk]), F.lit(before)]
        before += r["n"]
    return rows.withColumn("row", F.create_map(*starts)[F.col(chunk)].cast("long") + F.col(index))


def written_chunks(rows: DataFrame, path: str, n_chunks: int, overwrite: bool = False) -> None:
    """Combined chunks as one table in order; an existing one is an error unless ``overwrite``."""
    parquet(combined_chunks(rows, n_chunks).repartitionByRange("row").sortWithinPartitions("row"), path, mode="overwrite" if overwrite else "errorifexists")


def combined_results(chunks: list[DataFrame], model: str | None = None) -> DataFrame:
    rows = union_all(chunks)
    return rows.withColumn("model", F.lit(model)) if model is not None else rows


def combined_seed_results(chunks: list[DataFrame], least: float = 50) -> tuple[DataFrame, DataFrame]:
    """All rows, and gene, pval, EAC of those with EAC above the bound and a p-value."""
    rows = union_all(chunks)
    return rows, rows.where((F.col("EAC") > least) & F.col("pval").isNotNull()).select("gene", "pval", "EAC")


def saved_burdens(rows: DataFrame, path: str, buckets: int = 64, mode: str = "errorifexists") -> None:
    """Per-gene weighted genotypes, in folders of gene buckets."""
    parquet(rows.withColumn("gene_bucket", F.pmod(F.xxhash64("gene"), F.lit(buckets)).cast("int")), path, ["gene_bucket"], mode)
