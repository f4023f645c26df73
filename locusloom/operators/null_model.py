"""Null models of a phenotype on covariates, fitted once and shared by all genes.

Every fit is a few sums over the samples: a k x k system is solved on the driver.
With many covariates the sums are matrix products of Arrow batches, and least
squares takes the triangle of a QR decomposition of all rows, made by tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matrices import row_sums, triangle


@dataclass(frozen=True)
class NullModel:
    """Weighted residual model: coefficients of [1, x], (X'WX)^-1, the residual variance and whether it is logistic."""

    y: str
    x: tuple[str, ...]
    beta: tuple[float, ...]
    inverse: tuple[tuple[float, ...], ...]
    sigma2: float
    n: int
    logistic: bool
    #: False for a logistic model whose fit didn't settle, as where the classes can be separated.
    converged: bool = True
    #: A matrix whose product with its transpose is ``inverse``.
    root: tuple[tuple[float, ...], ...] = ()

    def linear(self) -> Column:
        eta = F.lit(self.beta[0])
        for b, c in zip(self.beta[1:], self.x, strict=True):
            eta = eta + F.lit(b) * F.col(c)
        return eta

    def fitted(self) -> Column:
        return logistic(self.linear()) if self.logistic else self.linear()

    def frame(self, samples: DataFrame) -> DataFrame:
        """sample, residual ``r``, weight ``w`` and the covariates of the samples with y and all x."""
        rows = complete(samples, self.y, self.x)
        mu = self.fitted()
        weight = mu * (1 - mu) if self.logistic else F.lit(1.0)
        return rows.select("sample", (F.col(self.y).cast("double") - mu).alias("r"), weight.alias("w"), *self.x)


#: Columns of a design whose sums are expressions; with more of them Arrow batches are multiplied.
FEW = 12
#: Least singular value of a design with unit columns, for each of its columns, that counts as one.
RANK = 1e-14
#: Linear predictors beyond this have a chance of 1 - 1e-13 and count as this.
MOST = 30.0


def logistic(eta: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(eta, F.lit(MOST)), F.lit(-MOST))))


def complete(samples: DataFrame, y: str, x: tuple[str, ...] | list[str]) -> DataFrame:
    return samples.na.drop(subset=[y, *x])


def products(rows: DataFrame, columns: list[Column], weight: Column | None = None) -> tuple[np.ndarray, int]:
    """Sums of (weighted) products of the columns, as a symmetric matrix, and the number of rows."""
    k = len(columns)
    if k > FEW:
        table = rows.select(*[c.cast("double").alias(f"_{i}") for i, c in enumerate(columns)], (weight if weight is not None else F.lit(1.0)).cast("double").alias("_w"))
        found = row_sums(table, lambda m: np.vstack([(m[:, :k] * m[:, k:]).T @ m[:, :k], np.append(len(m), np.zeros(k - 1))]))
        return (found[:-1], int(found[-1, 0])) if len(found) else (np.zeros((k, k)), 0)
    w = weight if weight is not None else F.lit(1.0)
    sums = [F.sum(w * columns[i] * columns[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]
    row = rows.agg(*sums, F.count("*").alias("n")).first()
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = row[f"s{i}_{j}"] or 0.0
    return m, row["n"]


def design(x: list[str] | tuple[str, ...]) -> list[Column]:
    return [F.lit(1.0), *[F.col(c).cast("double") for c in x]]


def fit_linear(samples: DataFrame, y: str, x: list[str], ddof: int | None = None) -> NullModel:
    """Ordinary least squares; the residual variance is divided by n - ddof (default: the number of coefficients)."""
    rows, k = complete(samples, y, x), len(x) + 1
    columns = [*design(x), F.col(y).cast("double")]
    if k < FEW:
        m, n = products(rows, columns)
        inverse = np.linalg.pinv(m[:k, :k])
        beta = inverse @ m[:k, k]
        rss, root = m[k, k] - beta @ m[:k, k], halved(inverse)
    else:
        r, n = triangle(rows.select(*[c.alias(f"_{i}") for i, c in enumerate(columns)]))
        beta, rss, root = solved(r)
        inverse = root @ root.T
    sigma2 = float(max(rss, 0.0) / max(1, n - (k if ddof is None else ddof)))
    return NullModel(y, tuple(x), tuple(map(float, beta)), tuple(map(tuple, inverse)), sigma2, n, False, root=tuple(map(tuple, root)))


def solved(r: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients, residual sum of squares and root of the inverse, from the triangle of [design, y]; columns that others make up take part in the shortest solution."""
    k = len(r) - 1
    scale = np.linalg.norm(r[:k, :k], axis=0)
    scale = np.where(scale > 0, scale, 1)
    u, s, vt = np.linalg.svd(r[:k, :k] / scale)
    use = s > RANK * k * s.max(initial=0.0)
    to_y = u.T @ r[:k, k]
    root = vt.T * np.where(use, 1 / np.where(use, s, 1), 0) / scale[:, None]
    return root @ to_y, float(r[k, k] ** 2 + (to_y[~use] ** 2).sum()), root


def halved(inverse: np.ndarray) -> np.ndarray:
    """A root of a symmetric matrix without negative eigenvalues."""
    values, vectors = np.linalg.eigh(inverse)
    return vectors * np.sqrt(np.maximum(values, 0))


def fit_logistic(samples: DataFrame, y: str, x: list[str], steps: int = 25, tolerance: float = 1e-8) -> NullModel:
    """Logistic regression by Newton steps, one small job a step over the rows read once.

    A step that doesn't raise the likelihood is halved. ``converged`` says whether
    the steps became small; where the classes can be separated they don't.
    """
    rows, k = complete(samples, y, x).select(*[F.col(c).cast("double").alias(c) for c in dict.fromkeys([y, *x])]).cache(), len(x) + 1
    beta, step, best, converged = np.zeros(k), np.zeros(k), -np.inf, False
    inverse, n = np.zeros((k, k)), 0
    for _ in range(steps):
        gradient, hessian, l, n = newton_sums(rows, y, x, beta + step)
        if not n:
            break
        if l < best - 1e-9 * abs(best):
            step = step / 2
            continue
        beta, best, inverse = beta + step, l, np.linalg.pinv(hessian)
        step = inverse @ gradient
        if np.abs(step).max() < tolerance * (1 + np.abs(beta).max()):
            beta, converged = beta + step, True
            break
    rows.unpersist()
    return NullModel(y, tuple(x), tuple(map(float, beta)), tuple(map(tuple, inverse)), 1.0, n, True, converged, tuple(map(tuple, halved(inverse))))


def newton_sums(rows: DataFrame, y: str, x: list[str], beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Gradient, Hessian, log-likelihood and number of rows at ``beta``: matrix products of Arrow batches, added up by Spark."""
    k, names = len(x) + 1, [*dict.fromkeys([y, *x])]
    at = [names.index(c) for c in x]

    def sums(m: np.ndarray) -> np.ndarray:
        z, t = np.column_stack([np.ones(len(m)), m[:, at]]), m[:, 0]
        eta = np.clip(z @ beta, -MOST, MOST)
        mu = 1 / (1 + np.exp(-eta))
        rest = np.zeros(max(k, 2))
        rest[:2] = t @ eta - np.log1p(np.exp(eta)).sum(), len(m)
        out = np.zeros((k + 2, max(k, 2)))
        out[:k, :k], out[k, :k], out[k + 1] = (z * (mu * (1 - mu))[:, None]).T @ z, z.T @ (t - mu), rest
        return out

    found = row_sums(rows.select(*names), sums)
    if not len(found):
        return np.zeros(k), np.zeros((k, k)), 0.0, 0
    return found[k, :k], found[:k, :k], float(found[k + 1, 0]), int(found[k + 1, 1])


def fit(samples: DataFrame, y: str, x: list[str]) -> NullModel:
    """Logistic if y has exactly two values, else linear."""
    two = samples.agg(F.count_distinct(y).alias("n")).first()["n"] == 2
    return fit_logistic(samples, y, x) if two else fit_linear(samples, y, x)
