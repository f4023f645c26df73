"""The annotation chain: keyed merges onto (variant, gene) rows, derived features, ranges, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import scalar
from ..functions.matrices import matrix_of, row_sums
from ..functions.shared import sent
from .checks import CheckFailed, checked_join
from .genotype import SITE, dense_ids


def suffixed(df: DataFrame, keys: list[str], suffix: str, drop: list[str] | None = None) -> DataFrame:
    """Keys and all other columns with a suffix, one row a key (the least by all columns)."""
    rows = df.drop(*(drop or []))
    named = rows.select(*keys, *[F.col(c).alias(f"{c}{suffix}") for c in rows.columns if c not in keys])
    return first_of_key(named, keys, [c for c in named.columns if c not in keys])


def first_of_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in that order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or keys)))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def add_ids(scores: DataFrame, variants: DataFrame, rename: dict[str, str] | None = None, keys: list[str] = SITE) -> DataFrame:
    """Score rows (the first of each key) with variant ids."""
    rows = scores.withColumnsRenamed(rename or {})
    rows = first_of_key(rows, keys, [c for c in rows.columns if c not in keys])
    return checked_join(rows, variants.select(*keys, "id"), keys, "left", "1:1")


def merge_annotations(annotated: DataFrame, variants: DataFrame, scores: list[DataFrame], keys: list[str] = SITE) -> DataFrame:
    """Annotator rows with variant ids and the columns of the score tables; many rows a variant, one a score key."""
    out = checked_join(annotated, variants.select(*keys, "id"), keys, "left", "m:1")
    for s in scores:
        out = checked_join(out, s, keys, "left", "m:1")
    return out


def merge_scores(annotations: DataFrame, scores: DataFrame, suffix: str, keys: list[str]) -> DataFrame:
    return checked_join(annotations, suffixed(scores, keys, suffix), keys, "left", "m:1")


def merge_components(annotations: DataFrame, components: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """Component columns (by prefix) joined to distinct annotation rows."""
    names = [c for c in components.columns if c.startswith(prefix)]
    return annotations.dropDuplicates().join(first_of_key(components.select(*keys, *names), keys, names), keys, "left")


def aggregate_splice(scores: DataFrame, score: str = "score", exclude: list[str] | None = None) -> DataFrame:
    """chrom, pos, ref, alt, gene_id and the largest score over tissues."""
    rows = scores.where(~F.col("tissue").isin(exclude)) if exclude else scores
    best = rows.groupBy("variant", "gene_id").agg(F.max(score).alias(score))
    return best.select(*[c.alias(n) for n, c in scalar.parse_variant("variant").items()], "gene_id", score)


def merge_splice(annotations: DataFrame, scores: DataFrame, score: str, keys: list[str], fill: float = 0.0) -> DataFrame:
    """Splice scores on variant and gene, ``fill`` where there is none; an older score column goes."""
    best = scores.groupBy(*keys).agg(F.max(score).alias(score))
    return checked_join(annotations.drop(score), best, keys, "left", "m:1").fillna({score: fill})


def merge_af(annotations: DataFrame, af: DataFrame) -> DataFrame:
    return annotations.join(af.select("id", "af"), "id", "left")


def add_maf(annotations: DataFrame, af: str = "af") -> DataFrame:
    return annotations.withColumns({"MAF": scalar.maf(af), "MAF_MB": scalar.maf_mb(af)})


def add_gene_ids(annotations: DataFrame, genes: DataFrame, column: str = "Gene") -> DataFrame:
    """gene_id by base gene id; rows are preserved."""
    base = genes.select(scalar.strip_version("gene").alias("_base"), F.col("id").alias("gene_id"))
    keyed = annotations.withColumn("_base", scalar.strip_version(column))
    return checked_join(keyed, base, ["_base"], "left", "m:1", equal_rows=True).drop("_base")


def gene_table(gtf: DataFrame) -> DataFrame:
    """id, gene, gene_name, gene_type of protein-coding HAVANA genes; ids are given before the first of each base id is kept."""
    rows = gtf.where("feature = 'gene' and gene_type = 'protein_coding' and source = 'HAVANA'").select(F.col("gene_id").alias("gene"), "gene_name", "gene_type", "chrom", "start")
    numbered = dense_ids(rows, ["chrom", "start", "gene"], "id", 8)
    return first_of_key(numbered.withColumn("_base", scalar.strip_version("gene")), ["_base"], ["id"]).select("id", "gene", "gene_name", "gene_type")


def coding_exons(gtf: DataFrame) -> DataFrame:
    return gtf.where("feature = 'exon' and source = 'HAVANA' and gene_type = 'protein_coding' and transcript_type = 'protein_coding'")


def islands(exons: DataFrame, max_dist: int, gene: str = "gene_id") -> DataFrame:
    """_g, _low, _high: the disjoint stretches of a gene in its exons or within ``max_dist`` of one of their ends."""
    s, e = F.col("start"), F.col("end")
    # an exon that ends before it starts has only the surroundings of both
    parts = F.when(s <= e, F.array(F.struct((s - max_dist).alias("l"), (e + max_dist).alias("h")))).otherwise(F.array(*[F.struct((c - max_dist).alias("l"), (c + max_dist).alias("h")) for c in (s, e)]))
    each = exons.select(F.col(gene).alias("_g"), F.inline(parts)).where("l is not null and h is not null").distinct()
    order = Window.partitionBy("_g").orderBy("l", "h")
    begins = F.coalesce(F.col("l") > F.max("h").over(order.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True))
    numbered = each.withColumn("_new", begins.cast("int")).withColumn("_i", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("_g", "_i").agg(F.min("l").alias("_low"), F.max("h").alias("_high")).drop("_i")


def near_exons(annotations: DataFrame, exons: DataFrame, max_dist: int = 300, keep_unmatched: bool = False, pos: str = "pos", gene: str = "gene_id", bin_size: int = 4096) -> DataFrame:
    """Annotation rows in an exon of their gene, or within ``max_dist`` of its start or end.

    Overlapping padded exons are merged first, and a variant is looked up among the
    few merged ones in its bin of the gene, so crowded genes don't multiply. The
    join only tests for a match. ``keep_unmatched`` keeps all rows.
    """
    if keep_unmatched:
        return annotations
    bin_ = lambda c: F.floor(c / bin_size)
    places = islands(exons, max_dist, gene).withColumn("_bin", F.explode(F.sequence(bin_(F.col("_low")), bin_(F.col("_high")))))
    kept = annotations.join(places, (F.col(gene) == F.col("_g")) & (bin_(F.col(pos)) == F.col("_bin")) & F.col(pos).between(F.col("_low"), F.col("_high")), "left_semi")
    if kept.isEmpty():
        raise CheckFailed("no variant lies near an exon")
    return kept


def in_windows(variants: DataFrame, genes: DataFrame, padding: int = 500_000, bin_size: int = 1_000_000) -> DataFrame:
    """gene and variant columns of variants in a gene's window: equal (chrom, bin), then the exact range."""
    bin_ = lambda c: F.floor(c / bin_size)
    low, high = F.col("start") - padding, F.col("end") + padding
    windows = genes.select("gene", "chrom", low.alias("_low"), high.alias("_high")).withColumn("_bin", F.explode(F.sequence(bin_(F.col("_low")), bin_(F.col("_high")))))
    placed = variants.withColumn("_bin", bin_(F.col("pos")))
    return placed.join(windows, ["chrom", "_bin"]).where(F.col("pos").between(F.col("_low"), F.col("_high"))).drop("_bin", "_low", "_high")


def conditioning_genotypes(calls: DataFrame, windows: DataFrame) -> DataFrame:
    """gene, sample, marker, value of the calls of variants in each gene's window.

    The value is minus the allele count: with an intercept in the model it stands
    for 2 - count, and samples without the variant need no row.
    """
    wanted = windows.select("gene", F.col("id").alias("variant_id")).distinct()
    return calls.join(wanted, "variant_id").select("gene", "sample", F.col("variant_id").cast("string").alias("marker"), (-F.col("gt")).cast("double").alias("value"))


def process_annotator(rows: DataFrame, variants: DataFrame, consequences: list[str], types: dict[str, str] | None = None) -> DataFrame:
    """Annotator rows with site columns (from the variant list, else from the name), consequence flags, splice delta and casts."""
    name = "#Uploaded_variation"
    out = rows.join(variants.select(name, *SITE), name, "left")
    parsed = scalar.parse_name(F.col(name))
    out = out.withColumns({c: F.coalesce(F.col(c), parsed[c]) for c in SITE}).withColumn("chrom", scalar.normal_chrom("chrom"))
    out = out.withColumns(scalar.consequence_flags("Consequence", consequences))
    if "SpliceAI_pred" in out.columns:
        out = out.withColumn("SpliceAI_delta_score", scalar.splice_delta("SpliceAI_pred"))
    return out.withColumns({c: F.col(c).cast(t) for c, t in (types or {}).items() if c in out.columns})


def select_rename_fill(annotations: DataFrame, columns: dict[str, list], keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """(filled, unfilled) tables of the listed columns: source name -> [new name, fill value, type]."""
    picked: list[Column] = [F.col(s).cast(v[2] if len(v) > 2 else "double").alias(v[0]) for s, v in columns.items() if s in annotations.columns]
    unfilled = annotations.select(*keep, *picked)
    return unfilled.fillna({v[0]: v[1] for s, v in columns.items() if s in annotations.columns and v[1] is not None}), unfilled


#: Columns of a table of scores: their covariance is solved on the driver.
MOST_COLUMNS = 4096
#: Terms of a projection that is written as expressions; a larger one takes products of Arrow batches.
MOST_TERMS = 1024


def fit_components(df: DataFrame, columns: list[str], k: int) -> tuple[dict[str, tuple[float, float]], list[list[float]]]:
    """Means and deviations, and k principal components of the standardised columns; null counts as 0.

    Two passes of matrix products over Arrow batches: the means, then the products
    of centred columns, so that large means cost no digits. The largest loading of a
    component is positive.
    """
    params, components, _ = component_analysis(df, columns, k)
    return params, components


def component_analysis(df: DataFrame, columns: list[str], k: int) -> tuple[dict[str, tuple[float, float]], list[list[float]], np.ndarray]:
    """``fit_components`` and the covariance of the columns."""
    if len(columns) > MOST_COLUMNS:
        raise ValueError(f"{len(columns)} columns, at most {MOST_COLUMNS} are allowed")
    table = df.select(*[F.col(c).cast("double") for c in columns])
    sums = row_sums(table, lambda x: np.append(x.sum(0), len(x))[None])
    n = sums[0, -1] if len(sums) else 0
    if not n:
        return {c: (0.0, 1.0) for c in columns}, np.eye(len(columns))[:k].tolist(), np.zeros((len(columns),) * 2)
    mean = sums[0, :-1] / n
    covariance = row_sums(table, lambda x: (x - mean).T @ (x - mean)) / n
    sd = np.sqrt(np.diag(covariance))
    scale = np.where(sd > 0, sd, 1)
    _, vectors = np.linalg.eigh(covariance / np.outer(scale, scale))
    top = vectors[:, ::-1][:, :k].T
    top = top * np.sign(top[np.arange(len(top)), np.abs(top).argmax(1)])[:, None]
    return {c: (float(m), float(s)) for c, m, s in zip(columns, mean, scale, strict=True)}, top.tolist(), covariance


def project(df: DataFrame, params: dict[str, tuple[float, float]], components: list[list[float]], prefix: str = "PC_") -> DataFrame:
    """``df`` without the columns, with their components: column expressions for a few terms, else products of Arrow batches."""
    names = [f"{prefix}{i}" for i in range(1, len(components) + 1)]
    rest = df.drop(*params).columns
    if len(components) * len(params) <= MOST_TERMS:
        score = [(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - m) / s for c, (m, s) in params.items()]
        return df.select(*rest, *[sum((w * x for w, x in zip(row, score, strict=True)), F.lit(0.0)).alias(name) for name, row in zip(names, components, strict=True)])
    held = sent(df.sparkSession, (np.array(components).T, *map(np.array, zip(*params.values(), strict=True))))
    table = df.select(*rest, *[F.col(c).cast("double") for c in params])

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, mean, sd = held()
        for b in batches:
            if b.num_rows:
                y = ((matrix_of(b.columns[len(rest) :]) - mean) / sd) @ w
                yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], *[pa.array(c) for c in y.T]], names=[*rest, *names])

    schema = StructType([*df.select(*rest).schema.fields, *[StructField(name, DoubleType()) for name in names]])
    return table.mapInArrow(projected, schema)


def shift_delta(predictions: DataFrame) -> DataFrame:
    """variant, delta: mean over shifts of the mutated allele's score less the wild one's."""
    wide = predictions.groupBy("variant", "shift").pivot("allele", ["mut", "wild"]).agg(F.first("score"))
    return wide.groupBy("variant").agg(F.avg(F.col("mut") - F.col("wild")).alias("delta"))
