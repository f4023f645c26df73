"""Standardisation, rank transforms and permutation of sample-level columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import normal_quantile
from ..functions.shared import written
from .genotype import dense_ids


def mean_std(df: DataFrame, columns: list[str], ignore_zero: bool = False) -> dict[str, tuple[float, float]]:
    """(mean, population standard deviation) of each column, in one aggregation; nulls (and zeros) are left out."""
    value = lambda c: F.when(F.col(c) != 0, F.col(c)) if ignore_zero else F.col(c)
    row = df.agg(*[f(value(c)).alias(f"{c}_{n}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"{c}_m"], row[f"{c}_s"]) for c in columns}


def standardize(df: DataFrame, columns: list[str], params: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(x - mean) / std of the columns; a constant column becomes null."""
    params = params or mean_std(df, columns)
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.when(F.lit(s) != 0, F.lit(s)) for c, (m, s) in params.items()})


def standardize_nonzero(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    """Standardise by given parameters; zeros (and nulls) become 0."""
    return df.withColumns({c: F.when(F.col(c) != 0, (F.col(c) - m) / s).otherwise(0.0) for c, (m, s) in params.items()})


def quantile_ranks(df: DataFrame, column: str) -> DataFrame:
    """_v, _p of each distinct value that isn't null: its quantile from 0 to 1; ties take the mean of their first and last rank.

    Distinct values and their counts are numbered by sorted ranges, so no task
    sees all rows.
    """
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    parts = ranged_sums(values)
    total = F.lit(df.where(F.col(column).isNotNull()).count())
    first, last = F.col("_before"), F.col("_before") + F.col("_n") - 1
    low, high = first / (total - 1), last / (total - 1)
    q = F.when(F.col("_before") == 0, 0.0).when(F.col("_before") + F.col("_n") == total, 1.0).otherwise((low + high) / 2)
    return parts.select("_v", q.alias("_p"))


def quantile_transform(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Gaussian quantile transform (see ``quantile_ranks``); nulls stay null."""
    ranks = quantile_ranks(df, column).select("_v", normal_quantile(F.col("_p")).alias("_q"))
    joined = df.join(ranks, df[column] == ranks["_v"], "left")
    name = out or column
    return joined.select(*[df[c] for c in df.columns if c != name], F.col("_q").alias(name))


def ranged_sums(values: DataFrame) -> DataFrame:
    """``values`` (_v, _n) with the sum of _n of all smaller _v as _before, over sorted ranges."""
    ranged = written(values.repartitionByRange(64, "_v").withColumn("_part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_part").orderBy("_v")
    local = ranged.withColumn("_local", F.sum("_n").over(inside) - F.col("_n"))
    sums = local.groupBy("_part").agg(F.sum("_n").alias("_s"))
    before = sums.select("_part", (F.sum("_s").over(Window.orderBy("_part")) - F.col("_s")).alias("_b"))  # one row a range
    return local.join(F.broadcast(before), "_part").select("_v", "_n", (F.col("_local") + F.col("_b")).alias("_before"))


def is_binary(df: DataFrame, column: str) -> bool:
    return df.agg(F.count_distinct(column).alias("n")).first()["n"] == 2


def transform_y(df: DataFrame, column: str, how: str | None = None) -> DataFrame:
    """None, "standardize" or "quantile_transform" of a phenotype; a binary one stays as it is."""
    if how is None or is_binary(df, column):
        return df
    if how == "standardize":
        return standardize(df, [column])
    if how == "quantile_transform":
        return quantile_transform(df, column)
    raise ValueError(f"unknown transform {how!r}")


def permute(df: DataFrame, column: str, key: str, seed: int = 0) -> DataFrame:
    """``column`` dealt anew among the rows: the i-th row by key gets the value of the i-th by a seeded MD5 digest of the key."""
    order = dense_ids(df.select(key), [key], "_i")
    drawn = dense_ids(df.select(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))).alias("_h"), F.col(column).alias("_y"), F.col(key).alias("_k")), ["_h", "_k"], "_i").select("_i", "_y")
    return df.drop(column).join(order.join(drawn, "_i").select(key, F.col("_y").alias(column)), key)


def permuted_many(df: DataFrame, column: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """key and ``values``: the column as it is, then dealt anew n times as ``permute`` does with seeds from ``seed`` on; one sort for all of them. Keys are unique and not null."""
    indexed = dense_ids(df.select(key, F.col(column).alias("_y")), [key], "_i")
    every = indexed.select("*", F.explode(F.sequence(F.lit(seed), F.lit(seed + n - 1))).alias("_b")) if n else indexed.withColumn("_b", F.lit(0)).where("false")
    hashed = every.select("_b", "_y", F.col(key).alias("_k"), F.md5(F.concat(F.col("_b").cast("string"), F.lit(":"), F.col(key).cast("string"))).alias("_h"))
    # every permutation has as many rows, so the place in it follows from the place among all
    size = indexed.count()
    drawn = dense_ids(hashed, ["_b", "_h", "_k"], "_place").select("_b", "_y", (F.col("_place") - (F.col("_b") - seed) * size).alias("_i"))
    lists = drawn.groupBy("_i").agg(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_y"))), lambda x: x["_y"]).alias("_ys"))
    return indexed.join(lists, "_i", "left").select(key, F.concat(F.array("_y"), F.coalesce("_ys", F.array().cast(f"array<{df.schema[column].dataType.simpleString()}>"))).alias("values"))


def sample_mask(phenotypes: DataFrame, genotyped: DataFrame, keep: DataFrame | None, y: list[str], x: list[str], skip_y_na: bool = True) -> DataFrame:
    """Phenotype rows of genotyped (and listed) samples with all covariates, and with y unless that is kept missing."""
    rows = phenotypes.join(genotyped.select("sample").distinct(), "sample", "left_semi")
    if keep is not None:
        rows = rows.join(keep.select("sample").distinct(), "sample", "left_semi")
    return rows.na.drop(subset=[*x, *(y if skip_y_na else [])])


def levels(df: DataFrame, column: str, most: int = 1000) -> list:
    """All values of the column in order; an error above ``most``, since each becomes a column."""
    values = [r[0] for r in df.select(column).distinct().orderBy(column).limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{column} has more than {most} levels")
    return values


def one_hot_columns(column: str, values: list) -> list[Column]:
    return [(F.col(column) == v).cast("double").alias(f"{column}_{v}") for v in values]


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
