"""Joins and inputs that are checked while they run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CheckFailed(ValueError):
    """A table doesn't keep what an operator needs."""


def require_unique(df: DataFrame, keys: list[str], what: str = "table") -> DataFrame:
    """``df`` itself; raises if a key stands in two rows."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise CheckFailed(f"{what}: key {tuple(twice[0][k] for k in keys)} is not unique")
    return df


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise CheckFailed(f"{what}: no rows remain")
    return df


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", validate: str | None = None, equal_rows: bool = False) -> DataFrame:
    """Join that raises where ``validate`` ("1:1", "m:1", "1:m") or ``equal_rows`` (as many rows as ``left``) isn't kept."""
    one_left, one_right = (x == "1" for x in (validate or "m:m").split(":"))
    if one_left:
        require_unique(left, on, "left side")
    if one_right:
        require_unique(right, on, "right side")
    joined = left.join(right, on, how)
    if equal_rows:
        # a left join on a unique right side can't change the number of rows
        if not (how == "left" and one_right):
            before, after = left.count(), joined.count()
            if before != after:
                raise CheckFailed(f"{before} rows before the join and {after} after it")
    return joined


def require_same_rows(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-6) -> DataFrame:
    """``left``; raises unless both have the same keys and, within the tolerance, the same values (null equals null)."""
    other = right.select(*keys, *[F.col(v).alias(f"{v}__r") for v in values], F.lit(True).alias("in__r"))
    both = left.select(*keys, *values, F.lit(True).alias("in__l")).join(other, keys, "full")
    same = F.col("in__l").isNotNull() & F.col("in__r").isNotNull()
    for v in values:
        same = same & ((F.abs(F.col(v) - F.col(f"{v}__r")) < tolerance) | (F.col(v).isNull() & F.col(f"{v}__r").isNull()))
    if not both.where(~F.coalesce(same, F.lit(False))).isEmpty():
        raise CheckFailed("the tables differ in samples or covariates")
    return left
