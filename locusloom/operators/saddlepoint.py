"""Score tests of binary phenotypes by the saddlepoint, for all genes at once.

Under the null model a sample's phenotype is 1 with its fitted chance, so the
cumulant generating function of a gene's score is a sum over its carriers, whose
burdens are adjusted for the covariates; the adjusted burdens of the many other
samples are small and their part is taken as normal. Where classes are unbalanced or
carriers few, the tail of that distribution is far from a normal one's.

The two saddlepoints of every gene are found by Newton steps inside a bracket. A
step is one join of the carriers with the genes' current points and one sum a gene.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import chi2_1_sf
from ..functions.shared import discarded, written
from .null_model import NullModel, complete

#: Scores within so many standard deviations keep the plain p-value.
CUTOFF = 2.0
#: Most Newton steps, relative size of the last one, and the least part of the variance that counts as normal.
STEPS, SETTLED, LEAST_NORMAL = 60, 1e-9, 1e-9


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def adjusted(burdens: DataFrame, model: NullModel, samples: DataFrame) -> DataFrame:
    """gene, b adjusted for the covariates, eta and mu of every carrier."""
    rows = complete(samples, model.y, model.x)
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in model.x])
    frame = rows.select("sample", model.linear().alias("eta"), model.fitted().alias("mu"), x.alias("x"))
    carriers = burdens.where("b <> 0").select("gene", "sample", F.col("b").cast("double").alias("b")).join(frame, "sample")
    w = F.col("mu") * (1 - F.col("mu"))
    k = len(model.x) + 1
    own = carriers.groupBy("gene").agg(F.array(*[F.sum(w * F.col("b") * F.get("x", F.lit(i))) for i in range(k)]).alias("xb"))
    effect = [sum((F.lit(float(v)) * F.get("xb", F.lit(j)) for j, v in enumerate(row)), F.lit(0.0)) for row in model.inverse]
    taken = sum((F.get("x", F.lit(i)) * F.get("c", F.lit(i)) for i in range(k)), F.lit(0.0))
    return carriers.join(own.select("gene", F.array(*effect).alias("c")), "gene").select("gene", (F.col("b") - taken).alias("b"), "eta", "mu")


def saddlepoints(carriers: DataFrame, scores: DataFrame) -> DataFrame:
    """gene, side, q, t, k0, k2: the point t where the score's mean under the tilted null is q = side x |u|, for both sides; written.

    carriers: gene, b, eta, mu; scores: gene, u, variance. The bracket of t follows from the normal part, which bounds
    the slope of the mean from below.
    """
    sides = F.explode(F.array(F.lit(1.0), F.lit(-1.0)))
    own = carriers.groupBy("gene").agg(F.sum(F.col("b") * F.col("b") * F.col("mu") * (1 - F.col("mu"))).alias("_v"))
    rest = F.greatest(F.col("variance") - F.col("_v"), F.col("variance") * LEAST_NORMAL)
    q = F.col("side") * F.abs("u")
    state = scores.join(own, "gene").select("gene", "variance", rest.alias("rest"), "u", sides.alias("side")).select("gene", "side", q.alias("q"), "rest", (q / F.col("variance")).alias("t"), F.least(q / F.col("rest"), F.lit(0.0)).alias("low"), F.greatest(q / F.col("rest"), F.lit(0.0)).alias("high"))
    state = written(state.withColumns({"k0": F.lit(0.0), "k2": F.lit(0.0), "settled": F.lit(False)}), "points")
    for _ in range(STEPS):
        if state.where("not settled").isEmpty():
            break
        tilted = F.col("eta") + F.col("t") * F.col("b")
        p = 1 / (1 + F.exp(-tilted))
        sums = carriers.join(state.where("not settled").select("gene", "side", "t"), "gene").groupBy("gene", "side").agg(
            F.sum(softplus(tilted) - softplus(F.col("eta")) - F.col("t") * F.col("b") * F.col("mu")).alias("s0"), F.sum(F.col("b") * (p - F.col("mu"))).alias("s1"), F.sum(F.col("b") * F.col("b") * p * (1 - p)).alias("s2"))
        moved = state.where("not settled").drop("k0", "k2", "settled").join(sums, ["gene", "side"])
        t = F.col("t")
        moved = moved.withColumns({"k0": F.col("s0") + 0.5 * t * t * F.col("rest"), "k1": F.col("s1") + t * F.col("rest"), "k2": F.col("s2") + F.col("rest")})
        over = F.col("k1") > F.col("q")
        moved = moved.withColumns({"low": F.when(over, F.col("low")).otherwise(t), "high": F.when(over, t).otherwise(F.col("high")), "next": t - (F.col("k1") - F.col("q")) / F.col("k2")})
        inside = (F.col("next") >= F.col("low")) & (F.col("next") <= F.col("high"))
        after = F.when(inside, F.col("next")).otherwise((F.col("low") + F.col("high")) / 2)
        settled = F.abs(after - t) <= SETTLED * F.abs(t)
        moved = moved.withColumn("settled", settled).withColumn("t", F.when(settled, t).otherwise(after))
        before, state = state, written(state.where("settled").unionByName(moved.select(state.columns)), "points", 1)
        discarded(before)
    return state.select("gene", "side", "q", "t", "k0", "k2")


def tail(q: float, t: float, k0: float, k2: float) -> float:
    """P(score >= q) for q > 0 and P(score <= q) for q < 0, by Lugannani and Rice in Barndorff-Nielsen's form."""
    if t == 0 or q == 0:
        return 0.5
    w = math.copysign(math.sqrt(max(0.0, 2 * (t * q - k0))), t)
    v = t * math.sqrt(k2)
    if abs(w) < 1e-6:
        z = abs(q) / math.sqrt(k2)
    else:
        z = abs(w + math.log(v / w) / w)
        z = z if (w + math.log(v / w) / w) * t > 0 else -z
    return 0.5 * math.erfc(z / math.sqrt(2))


def saddlepoint_test(sums: DataFrame, burdens: DataFrame, model: NullModel, samples: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """gene, n_carriers, stat, pval, saddlepoint (whether p is of that kind) under a logistic model.

    sums: gene, n_carriers, u, bpb, with a positive bpb (see ``gene_test.gene_sums``).
    """
    scores = written(sums.select("gene", "n_carriers", "u", F.col("bpb").alias("variance")), "scores")
    far = scores.where(F.col("u") * F.col("u") > cutoff * cutoff * F.col("variance"))
    carriers = written(adjusted(burdens.join(far.select("gene"), "gene", "left_semi"), model, samples), "carriers")
    points = saddlepoints(carriers, far.select("gene", "u", "variance"))
    discarded(carriers)
    both = points.groupBy("gene").agg(F.collect_list(F.struct("q", "t", "k0", "k2")).alias("points"))
    kind = scores.schema["gene"].dataType.simpleString()

    def tested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            stat = b.u**2 / b.variance
            p = [chi2_1_sf(s) if x is None else min(1.0, sum(tail(y["q"], y["t"], y["k0"], y["k2"]) for y in x)) for s, x in zip(stat, b.points, strict=True)]
            yield pd.DataFrame({"gene": b.gene, "n_carriers": b.n_carriers, "stat": stat, "pval": np.array(p, float), "saddlepoint": [x is not None for x in b.points]})

    return scores.join(both, "gene", "left").mapInPandas(tested, f"gene {kind}, n_carriers long, stat double, pval double, saddlepoint boolean")
