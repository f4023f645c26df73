"""A study's rare-variant dataset: masked samples, transformed phenotypes, and one row a carried variant and gene."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .masks import keep_listed, thresholds
from .transform import mean_std, sample_mask, standardize, standardize_nonzero, transform_y


@dataclass
class Dataset:
    """rows: sample, gene, variant_id, gt, features. samples: sample, y, x. variants and genes that were kept; (mean, std) of features."""

    rows: DataFrame
    samples: DataFrame
    variants: DataFrame
    genes: DataFrame
    params: dict[str, tuple[float, float]]


def assemble(
    calls: DataFrame, annotations: DataFrame, phenotypes: DataFrame, y: str, x: list[str], features: list[str], rules: list[str] | None = None, rare: Column | None = None,
    genes: DataFrame | None = None, samples: DataFrame | None = None, variants: DataFrame | None = None, y_transform: str | None = None, standardize_x: bool = True,
    standardize_features: bool = False, skip_y_na: bool = True,
) -> Dataset:
    """Masks samples first, then transforms x and y of those left, filters variants, and joins calls to them.

    annotations: id, gene (one row each) and features; rows without a gene go.
    ``skip_y_na`` false keeps samples without y, as scoring does.
    """
    people = sample_mask(phenotypes, calls, samples, [y], x, skip_y_na)
    people = transform_y(standardize(people, x) if standardize_x and x else people, y, y_transform)
    chosen = annotations.where(F.col("gene").isNotNull())
    for rule in ([thresholds(rules)] if rules else []) + ([rare] if rare is not None else []):
        chosen = chosen.where(rule)
    if genes is not None:
        chosen = keep_listed(chosen, genes, "gene")
    if variants is not None:
        chosen = keep_listed(chosen, variants, "id")
    params = mean_std(chosen, features, ignore_zero=True) if standardize_features else {}
    kept = standardize_nonzero(chosen, params) if params else chosen
    rows = keep_listed(calls, people, "sample").join(kept.select(F.col("id").alias("variant_id"), "gene", *features), "variant_id")
    return Dataset(rows, people.select("sample", y, *x), chosen.select("id").distinct(), chosen.select("gene").distinct(), params)


def variant_groups(annotations: DataFrame) -> DataFrame:
    """id, gene_ids: the sorted genes of each variant."""
    return annotations.groupBy("id").agg(F.sort_array(F.collect_set("gene")).alias("gene_ids"))


def split_flags(variants: DataFrame, previous: DataFrame) -> DataFrame:
    """Training and validation flags of variants carried over from an earlier table by id."""
    return variants.join(previous.select("id", "split"), "id", "left")
