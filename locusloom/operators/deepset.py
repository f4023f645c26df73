"""Gene scores of annotated variant sets: a network for each variant, a pool over a gene's variants, a network for the pool.

A set always holds one row of zeros (max pooling) or ``pad_to`` rows less its own
(sum pooling). Only carriers are scored; a sample without a variant in a gene has
the constant score of the empty set (``empty_score``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import sent
from .genotype import dense_ids


@dataclass
class Network:
    """Layers (weights, bias) of phi and rho with leaky rectifiers between; options of the score."""

    phi: list[tuple[np.ndarray, np.ndarray]]
    rho: list[tuple[np.ndarray, np.ndarray]]
    pool: str = "max"
    pad_to: int = 0
    negate: bool = False
    sigmoid: bool = True
    slope: float = 0.01
    heads: dict[str, np.ndarray] = field(default_factory=dict)

    def layers(self, x: np.ndarray, part: list[tuple[np.ndarray, np.ndarray]], last: bool) -> np.ndarray:
        for i, (w, b) in enumerate(part):
            x = x @ w + b
            if last or i < len(part) - 1:
                x = np.where(x > 0, x, self.slope * x)
        return x

    def embed(self, x: np.ndarray) -> np.ndarray:
        return self.layers(x, self.phi, True)

    def finish(self, pooled: np.ndarray) -> np.ndarray:
        s = self.layers(pooled, self.rho, False)[:, 0]
        s = -s if self.negate else s
        return 1 / (1 + np.exp(-s)) if self.sigmoid else s

    def empty_score(self) -> float:
        zero = self.embed(np.zeros((1, self.phi[0][0].shape[0])))
        return float(self.finish(zero * (self.pad_to if self.pool == "sum" else 1))[0])


def random_network(features: int, hidden: int = 20, deep: int = 2, wide: int = 10, seed: int = 0, **options) -> Network:
    """A network of random weights, scaled by the width of each layer."""
    rng = np.random.default_rng(seed)
    layer = lambda a, b: (rng.normal(0, 1 / np.sqrt(a), (a, b)), rng.normal(0, 0.1, b))
    phi = [layer(features if i == 0 else hidden, hidden) for i in range(deep)]
    rho = [layer(hidden if i == 0 else wide, wide) for i in range(deep)] + [layer(wide, 1)]
    return Network(phi, rho, **options)


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of batches again, cut between values of the first column only; equal values are neighbours."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column(0)
        last = ids[-1]
        cut = b.num_rows
        while cut and ids[cut - 1] == last:
            cut -= 1
        if cut:
            yield pa.Table.from_batches([*rest, b.slice(0, cut)])
            rest = [b.slice(cut)]
        elif rest and rest[-1].column(0)[0] != last:
            yield pa.Table.from_batches(rest)
            rest = [b]
        else:
            rest.append(b)
    if rest:
        yield pa.Table.from_batches(rest)


def codes(column: pa.ChunkedArray) -> np.ndarray:
    """A number for each distinct value; null is one of them."""
    return column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()


def score(rows: DataFrame, features: list[str], networks: dict[int, Network], keys: tuple[str, str] = ("sample", "gene")) -> DataFrame:
    """sample, gene, repeat, burden of carriers. rows: keys, gt, features; homozygous variants count twice in a sum.

    Calls are dealt and sorted by sample once. In Arrow batches of whole samples
    the distinct feature sets are embedded, pooled over each gene and finished, so
    nothing wider than a call is shuffled or joined.
    """
    spark = rows.sparkSession
    held, repeats = sent(spark, networks), sorted(networks)
    key_schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nets = held()
        zeros = {r: nets[r].embed(np.zeros((1, len(features)))) for r in repeats}
        for t in whole_groups(batches):
            one, two, gt = codes(t.column(0)), codes(t.column(1)), t.column(2).to_numpy().astype(np.float64)
            new = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))
            starts, n = np.flatnonzero(new), None
            x, at = np.unique(np.column_stack([t.column(i + 3).to_numpy() for i in range(len(features))]), axis=0, return_inverse=True)
            out = []
            for r in repeats:
                net, zero = nets[r], zeros[r]
                h = net.embed(x)[at.ravel()]
                if net.pool == "max":
                    pooled = np.maximum(np.maximum.reduceat(h, starts), zero)
                else:
                    n = np.add.reduceat(gt, starts) if n is None else n
                    pooled = np.add.reduceat(h * gt[:, None], starts) + np.maximum(0, net.pad_to - n)[:, None] * zero
                out.append(net.finish(pooled))
            kept = t.select([0, 1]).take(pa.array(starts)).combine_chunks()
            for r, burden in zip(repeats, out, strict=True):
                for b in kept.to_batches():
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(burden), r, np.int32)), pa.array(burden)], names=[*keys, "repeat", "burden"])

    calls = rows.select(*keys, F.col("gt").cast("int").alias("gt"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    # a fixed number of partitions: they are small in bytes and long in work
    dealt = calls.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), keys[0]).sortWithinPartitions(*keys)
    return dealt.mapInArrow(scored, f"{key_schema}, repeat int, burden double")


def dense(burdens: DataFrame, samples: DataFrame, genes: DataFrame, networks: dict[int, Network]) -> DataFrame:
    """All samples x genes x repeats, with the empty score where there is no carrier. On request only."""
    indexed = dense_ids(genes.select("gene").distinct(), ["gene"], "_g", 4)
    empty = F.explode(F.array(*[F.struct(F.lit(r).alias("repeat"), F.lit(n.empty_score()).alias("empty")) for r, n in sorted(networks.items())]))
    every = samples.select("sample").distinct().withColumn("_g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(indexed.count() - 1))))
    grid = every.join(indexed, "_g").select("sample", "gene", empty.alias("_e")).select("sample", "gene", "_e.repeat", F.col("_e.empty").alias("_empty"))
    return grid.join(burdens, ["sample", "gene", "repeat"], "left").select("sample", "gene", "repeat", F.coalesce("burden", "_empty").alias("burden"))


def linear_score(rows: DataFrame, weights: dict[str, float], bias: float = 0.0, pool: str = "max", negate: bool = False) -> DataFrame:
    """sample, gene, burden of a linear score of each variant, pooled with the zero row; column expressions only."""
    total: Column = F.lit(bias)
    for c, w in weights.items():
        total = total + F.lit(w) * F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    scored = rows.select("sample", "gene", "gt", total.alias("s"))
    how = F.greatest(F.max("s"), F.lit(bias)) if pool == "max" else F.sum(F.col("s") * F.col("gt"))
    return scored.groupBy("sample", "gene").agg((-how if negate else how).alias("burden"))


def linear_heads(rows: DataFrame, weights: dict[str, float], samples: DataFrame, heads: dict[str, tuple[DataFrame, dict[str, float], float]], bias: float = 0.0, **options) -> DataFrame:
    """phenotype, sample, prediction of a linear score under one head a phenotype: its gene weights, covariate weights and bias."""
    scores = linear_score(rows, weights, bias, **options)
    return reduce(DataFrame.unionByName, [phenotype_head(scores, samples, genes, covariates, b).withColumn("phenotype", F.lit(name)) for name, (genes, covariates, b) in heads.items()])


def average(burdens: DataFrame, repeats: list[int] | None = None, how: str = "mean") -> DataFrame:
    """sample, gene, burden: mean or max over the repeats."""
    if how not in ("mean", "max"):
        raise ValueError(f"unknown aggregation {how!r}")
    rows = burdens.where(F.col("repeat").isin(repeats)) if repeats else burdens
    return rows.groupBy("sample", "gene").agg((F.avg if how == "mean" else F.max)("burden").alias("burden"))


def average_models(scores: DataFrame) -> DataFrame:
    """Mean over the models of each repeat."""
    return scores.groupBy("sample", "gene", "repeat").agg(F.avg("burden").alias("burden"))


def phenotype_head(burdens: DataFrame, samples: DataFrame, gene_weights: DataFrame, covariates: dict[str, float], bias: float = 0.0) -> DataFrame:
    """sample, prediction = bias + covariates . weights + sum over genes of burden x weight."""
    genes = burdens.join(gene_weights, "gene").groupBy("sample").agg(F.sum(F.col("burden") * F.col("weight")).alias("_g"))
    total = F.lit(bias)
    for c, w in covariates.items():
        total = total + F.lit(w) * F.col(c)
    return samples.join(genes, "sample", "left").select("sample", (total + F.coalesce("_g", F.lit(0.0))).alias("prediction"))


def reversed_models(rows: DataFrame, features: list[str], plof: list[str], networks: dict[int, Network]) -> DataFrame:
    """repeat, mean_change, reverse: whether setting loss-of-function flags to zero raises the mean score of their carriers."""
    some = rows.where(F.greatest(*[F.col(c) for c in plof], F.lit(0)) > 0)
    kept = some.select("sample", "gene").distinct()
    with_flags = score(rows.join(kept, ["sample", "gene"], "left_semi"), features, networks)
    without = rows.join(kept, ["sample", "gene"], "left_semi").withColumns({c: F.lit(0.0) for c in plof})
    changed = score(without, features, networks).withColumnRenamed("burden", "without")
    both = with_flags.join(changed, ["sample", "gene", "repeat"])
    return both.groupBy("repeat").agg(F.avg(F.col("burden") - F.col("without")).alias("mean_change")).withColumn("reverse", F.col("mean_change") < 0)


def selected_models(models: DataFrame) -> DataFrame:
    """Models that aren't dropped, with sign -1 where reversed. models: repeat, model, dropped, reverse."""
    return models.where(~F.coalesce("dropped", F.lit(False))).withColumn("sign", F.when(F.col("reverse"), -1).otherwise(1)).select("repeat", "model", "sign")


def worst_bags_dropped(metrics: DataFrame, n: int, mode: str = "min") -> DataFrame:
    """metrics: repeat, bag, objective; without the n worst bags of each repeat."""
    from pyspark.sql import Window

    order = F.col("objective").desc() if mode == "min" else F.col("objective").asc()
    return metrics.withColumn("_n", F.row_number().over(Window.partitionBy("repeat").orderBy(order, "bag"))).where(F.col("_n") > n).drop("_n")
