"""Conditional score tests of genes whose windows hold too many common variants for a matrix in one task.

With covariates projected off, the variants of a window enter through K = Z'PZ, as in
``spectrum``. Conjugate gradients solve K a = Z'Py and K b = Z'P(burden) for many
genes at once; Spark multiplies K with both over the calls, and the driver holds a
few numbers for each gene of a bounded wave. Markers are scaled to unit length first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import chi2_1_sf
from ..functions.shared import discarded, sent, written
from .null_model import NullModel
from .spectrum import WAVE, by_gene, grams, multiplied, wide

#: Relative residual at which a solution stands, and most steps.
SETTLED, STEPS = 1e-9, 1000
COLUMNS = ("zx", "f", "a", "r", "p")


def solved(z: DataFrame, single: DataFrame, model: NullModel) -> dict[object, np.ndarray]:
    """f'K^-1 f of each gene of a wave, for the two columns of f. z: gene, sample, marker, value, w; single: gene, marker, zx, f."""
    inverse, spark = np.array(model.inverse), z.sparkSession
    kind, marker = (single.schema[c].dataType.simpleString() for c in ("gene", "marker"))
    schema = f"gene {kind}, marker {marker}, " + ", ".join(f"{c} array<double>" for c in COLUMNS)
    zero = F.array(F.lit(0.0), F.lit(0.0))
    state = single.select("gene", "marker", "zx", "f", zero.alias("a"), F.col("f").alias("r"), F.col("f").alias("p"))
    size = {g: np.diag(m[0]).copy() for g, m in grams(state, lambda _, b, r: [wide(b, "f", r).T @ wide(b, "f", r)]).items()}
    left, old = {g: s.copy() for g, s in size.items()}, []
    for _ in range(STEPS):
        if all((s <= SETTLED**2 * size[g]).all() for g, s in left.items()):
            break
        current = written(state, "directions")
        joined = written(current.join(multiplied(z, current.withColumnRenamed("p", "q"), 2), ["gene", "marker"], "left").withColumn("y", F.coalesce("y", zero)), "products")
        discarded(current, *old)
        found = grams(joined, lambda _, b, r: [wide(b, "zx", r).T @ wide(b, "p", r), wide(b, "p", r).T @ wide(b, "y", r)])
        c = {g: inverse @ m[0] for g, m in found.items()}
        along = {g: np.diag(m[1]) - np.einsum("ij,ij->j", m[0], c[g]) for g, m in found.items()}
        step = {g: np.where(left[g] > SETTLED**2 * size[g], left[g] / np.where(along[g] > 0, along[g], np.inf), 0.0) for g in found}
        held = sent(spark, (c, step))

        def rest(gene: object, b: pa.RecordBatch, r: np.ndarray, held=held) -> np.ndarray:
            c, step = held()
            return wide(b, "r", r) - (wide(b, "y", r) - wide(b, "zx", r) @ c[gene]) * step[gene]

        def squared(gene: object, b: pa.RecordBatch, r: np.ndarray, rest=rest) -> list[np.ndarray]:
            x = rest(gene, b, r)
            return [x.T @ x]

        after = {g: np.diag(m[0]).copy() for g, m in grams(joined, squared).items()}
        turn = {g: np.where(left[g] > 0, after[g] / np.where(left[g] > 0, left[g], 1), 0.0) for g in after}
        more = sent(spark, (step, turn))

        def moved(batches: Iterator[pa.RecordBatch], rest=rest, more=more) -> Iterator[pa.RecordBatch]:
            step, turn = more()
            for b in batches:
                for g, r in by_gene(b):
                    x, p = rest(g, b, r), wide(b, "p", r)
                    some = b.take(pa.array(r))
                    new = [wide(b, "a", r) + p * step[g], x, x + p * turn[g]]
                    yield pa.RecordBatch.from_arrays([*(some.column(n) for n in ("gene", "marker", "zx", "f")), *(pa.array(list(v)) for v in new)], names=["gene", "marker", *COLUMNS])

        left, old = after, [joined]
        state = joined.mapInArrow(moved, schema)
    found = {g: m[0] for g, m in grams(state, lambda _, b, r: [wide(b, "f", r).T @ wide(b, "a", r)]).items()}
    discarded(*old)
    return found


def large_tests(z: DataFrame, single: DataFrame, sums: DataFrame, products: DataFrame, model: NullModel, genes: DataFrame) -> DataFrame:
    """gene, beta, stat, pval of ``genes``.

    z, single (with zr): markers as in ``gene_test.skat_rows``; sums: gene, u, bpb of the burdens; products: gene, marker, zb,
    the sums of value x burden with the covariates projected off. Every marker takes a degree of freedom.
    """
    spark, kind = z.sparkSession, genes.schema["gene"].dataType.simpleString()
    some = lambda df, chosen: df.join(chosen, "gene", "left_semi")
    numbered = written(genes.select("gene", F.pmod(F.xxhash64("gene"), F.lit(-(-genes.count() // WAVE) or 1)).alias("wave")), "waves")
    unit = z.groupBy("gene", "marker").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_l")).where("_l > 0")
    scaled = written(z.join(unit, ["gene", "marker"]).withColumn("value", F.col("value") / F.col("_l")).drop("_l"), "scaled")
    parts = single.join(products, ["gene", "marker"], "left").join(unit, ["gene", "marker"])
    parts = written(parts.select("gene", "marker", F.transform("zx", lambda v: v / F.col("_l")).alias("zx"), F.array(F.col("zr") / F.col("_l"), F.coalesce("zb", F.lit(0.0)) / F.col("_l")).alias("f")), "right_sides")
    found: dict = {}
    for wave in [r["wave"] for r in numbered.select("wave").distinct().collect()]:
        own = numbered.where(F.col("wave") == wave).select("gene")
        found |= solved(some(scaled, own), some(parts, own), model)
    counts = {r["gene"]: r["n"] for r in some(single, numbered).groupBy("gene").agg(F.count("*").alias("n")).collect()}
    df0 = model.n - len(model.x) - 1
    rows = []
    for r in some(sums, numbered).collect():
        g, m = r["gene"], found.get(r["gene"], np.zeros((2, 2)))
        u, v = r["u"] - m[1, 0], r["bpb"] - m[1, 1]
        sigma2 = (model.sigma2 * df0 - m[0, 0]) / max(1, df0 - counts.get(g, 0))
        if v > 1e-9 * r["_bb"] and sigma2 > 0:
            stat = u * u / (sigma2 * v)
            rows.append((g, float(u / v), float(stat), chi2_1_sf(stat)))
    return spark.createDataFrame(rows, f"gene {kind}, beta double, stat double, pval double")
