"""Training and validation metrics as aggregates over predictions (p) and targets (y)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def r_squared(df: DataFrame, keys: list[str], p: str = "p", y: str = "y") -> DataFrame:
    """Null for a constant y."""
    return df.groupBy(*keys).agg((1 - F.sum((F.col(y) - F.col(p)) ** 2) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))).alias("r_squared"))


def abs_correlation(df: DataFrame, gene: str = "gene", x: str = "b", y: str = "y", how: str = "sum") -> DataFrame:
    """Sum or mean (or a row for each: "both") over genes of |Pearson correlation|; a constant gene counts 0."""
    vx, vy = F.var_pop(x), F.var_pop(y)
    r = F.when((vx > 0) & (vy > 0), F.abs((F.avg(F.col(x) * F.col(y)) - F.avg(x) * F.avg(y)) / F.sqrt(vx * vy))).otherwise(0.0)
    per_gene = df.groupBy(gene).agg(r.alias("r"))
    parts = {"sum": F.sum("r"), "mean": F.avg("r")}
    if how != "both":
        return per_gene.agg(parts[how].alias("correlation"))
    found = per_gene.agg(*[c.alias(n) for n, c in parts.items()])
    return found.select(F.expr("stack(2, 'sum', sum, 'mean', mean) as (how, correlation)"))


def standard_error(column: str = "error") -> Column:
    return F.stddev_samp(column) / F.sqrt(F.count(column))


# name -> error of one row from (prediction, target)
LOSSES = {
    "mse": lambda p, y: (p - y) * (p - y),
    "mae": lambda p, y: F.abs(p - y),
    "huber": lambda p, y: F.when(F.abs(p - y) < 1, 0.5 * (p - y) * (p - y)).otherwise(F.abs(p - y) - 0.5),
    "bce_with_logits": lambda p, y: F.greatest(p, F.lit(0.0)) - p * y + F.log1p(F.exp(-F.abs(p))),
}


def mean_losses(df: DataFrame, names: list[str], phenotype: str = "phenotype", p: str = "p", y: str = "y") -> DataFrame:
    """phenotype and the named losses, in one aggregation."""
    return df.groupBy(phenotype).agg(*[F.avg(LOSSES[n](F.col(p).cast("double"), F.col(y).cast("double"))).alias(n) for n in names])


def average_precision(df: DataFrame, keys: list[str], p: str = "p", y: str = "y") -> DataFrame:
    """Average precision by descending score; equal scores count together."""
    by_score = df.groupBy(*keys, F.col(p).alias("_p")).agg(F.sum(F.col(y).cast("long")).alias("_pos"), F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    down = w.orderBy(F.col("_p").desc())
    cum = by_score.select(*keys, "_pos", F.sum("_pos").over(down).alias("_tp"), F.sum("_n").over(down).alias("_seen"), F.sum("_pos").over(w).alias("_all"))
    return cum.groupBy(*keys).agg(F.sum(F.col("_pos") / F.nullif(F.col("_all"), F.lit(0)) * F.col("_tp") / F.col("_seen")).alias("average_precision"))


def precision_recall(df: DataFrame, keys: list[str], p: str = "p", y: str = "y", epsilon: float = 1e-7) -> DataFrame:
    """Precision and recall of clipped, rounded predictions, with an epsilon below the line."""
    hit = F.round(F.greatest(F.least(F.col(p), F.lit(1.0)), F.lit(0.0)))
    true, said, real = F.sum(hit * F.col(y)), F.sum(hit), F.sum(F.col(y).cast("double"))
    return df.groupBy(*keys).agg((true / (said + epsilon)).alias("precision"), (true / (real + epsilon)).alias("recall"))


def best_epoch(df: DataFrame, objective: str = "objective", mode: str = "min") -> DataFrame:
    return df.agg((F.min if mode == "min" else F.max)(objective).alias("best"), (F.min_by if mode == "min" else F.max_by)("epoch", objective).alias("epoch"))
