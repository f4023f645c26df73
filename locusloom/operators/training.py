"""Training of a set network with a head for each phenotype, as sums over partitions.

A sample's predicted phenotype is its head's bias and covariates plus the scores of
its genes times the head's gene weights; a gene that a sample has no variant in
has the score of the empty set. Calls are dealt by sample and sorted once; every
step reads a seeded batch of samples, goes forward and backward through whole
samples in Arrow batches, and Spark adds the gradients up. A sample's calls are
consecutive rows, never one cell. The weights and the state of the optimiser, a few
thousand numbers, are on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import sent
from .deepset import Network, codes, score, whole_groups

LOSSES = ("mse", "bce")
#: Genes of the heads: their list is on the driver.
MOST_GENES = 100_000


@dataclass
class Heads:
    """Gene weights, covariate weights and a bias for each phenotype."""

    phenotypes: list[str]
    genes: list
    covariates: list[str]
    weights: np.ndarray
    effects: np.ndarray
    bias: np.ndarray

    @classmethod
    def start(cls, phenotypes: list[str], genes: list, covariates: list[str] = (), seed: int = 0) -> Heads:
        rng = np.random.default_rng(seed)
        n, g = len(phenotypes), max(1, len(genes))
        return cls([*phenotypes], [*genes], [*covariates], rng.normal(0, 1 / np.sqrt(g), (n, len(genes))), np.zeros((n, len(covariates))), np.zeros(n))


def linear_network(weights: list[float], bias: float = 0.0, pool: str = "max", negate: bool = False) -> Network:
    """A linear score of a variant, pooled: trainable like any network."""
    return Network([(np.array(weights, float)[:, None], np.array([float(bias)]))], [], pool, negate=negate, sigmoid=False, slope=1.0)


def arrays(net: Network, heads: Heads) -> list[tuple[str, np.ndarray]]:
    """Every weight array with the part that it belongs to."""
    return [*(("phi", a) for layer in net.phi for a in layer), *(("rho", a) for layer in net.rho for a in layer), *(("heads", a) for a in (heads.weights, heads.effects, heads.bias))]


def forward(net: Network, x: np.ndarray, part: list, last: bool) -> tuple[np.ndarray, list]:
    kept = []
    for i, (w, b) in enumerate(part):
        z = x @ w + b
        active = last or i < len(part) - 1
        kept.append((x, z, active))
        x = np.where(z > 0, z, net.slope * z) if active else z
    return x, kept


def backward(net: Network, d: np.ndarray, part: list, kept: list) -> tuple[np.ndarray, list[np.ndarray]]:
    out: list[np.ndarray] = []
    for (w, _), (x, z, active) in zip(reversed(part), reversed(kept), strict=True):
        d = d * np.where(z > 0, 1, net.slope) if active else d
        out = [x.T @ d, d.sum(0), *out]
        d = d @ w.T
    return d, out


def firsts(h: np.ndarray, top: np.ndarray, of_row: np.ndarray) -> np.ndarray:
    """For each set and unit the first row that has the set's maximum."""
    out = np.zeros(top.shape, np.int64)
    row, unit = np.nonzero((h == top[of_row])[::-1])
    row = len(h) - 1 - row
    out[of_row[row], unit] = row
    return out


def step(net: Network, heads: Heads, sample: np.ndarray, gene: np.ndarray, gt: np.ndarray, x: np.ndarray, y: np.ndarray, covariates: np.ndarray, loss: str, sizes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Sums of losses and numbers of values for each phenotype, and with ``sizes`` the gradient of the mean loss.

    Rows are whole samples in order of sample and gene (-1: a sample without a call);
    y and covariates repeat in each row of a sample. sizes: the values of each phenotype in the whole batch.
    """
    first = np.flatnonzero(np.append(True, sample[1:] != sample[:-1]))
    y, covariates = y[first], covariates[first]
    of_sample = np.cumsum(np.append(True, sample[1:] != sample[:-1])) - 1
    call = gene >= 0
    of_sample, gene, gt, x = of_sample[call], gene[call], gt[call], x[call]
    new = np.append(True, (of_sample[1:] != of_sample[:-1]) | (gene[1:] != gene[:-1]))[: len(gene)]
    starts = np.flatnonzero(new)
    of_set, set_sample, set_gene = np.cumsum(new) - 1, of_sample[starts], gene[starts]
    # the last row of h is the zero row, and the last set is the empty one
    h, kept_phi = forward(net, np.vstack([x, np.zeros((1, x.shape[1]))]), net.phi, True)
    zero, n = h[-1], len(gene)
    if net.pool == "max":
        top = np.maximum.reduceat(h[:-1], starts) if n else h[:0]
        chosen = np.where(top > zero, firsts(h[:-1], top, of_set), n) if n else np.zeros(top.shape, np.int64)
        pooled = np.vstack([np.maximum(top, zero), zero])
    else:
        alleles = np.bincount(of_set, gt, len(starts))
        pads = np.append(np.maximum(0, net.pad_to - alleles), net.pad_to)
        pooled = pads[:, None] * zero
        if n:
            pooled[:-1] += np.add.reduceat(h[:-1] * gt[:, None], starts)
    s, kept_rho = forward(net, pooled, net.rho, False)
    sign = -1.0 if net.negate else 1.0
    s = sign * s[:, 0]
    score = 1 / (1 + np.exp(-s)) if net.sigmoid else s
    empty, more = score[-1], score[:-1] - score[-1]
    w = heads.weights[:, set_gene]
    z = heads.bias + covariates @ heads.effects.T + empty * heads.weights.sum(1)
    for p in range(len(heads.phenotypes)):
        z[:, p] += np.bincount(set_sample, w[p] * more, len(first))
    there = ~np.isnan(y)
    t = np.where(there, y, 0)
    if loss == "mse":
        each, d = (z - t) ** 2, 2 * (z - t)
    else:
        each, d = np.logaddexp(0, z) - t * z, 1 / (1 + np.exp(-z)) - t
    sums, counts = (each * there).sum(0), there.sum(0)
    if sizes is None:
        return sums, counts, None
    d = d * there / np.maximum(sizes, 1) / len(sizes)
    at_set = d[set_sample].T
    g_weights = np.stack([np.bincount(set_gene, a * more, heads.weights.shape[1]) for a in at_set]) + empty * d.sum(0)[:, None]
    d_score = (at_set * w).sum(0)
    d_empty = (d.sum(0) * heads.weights.sum(1)).sum() - d_score.sum()
    d_s = np.append(d_score, d_empty) * (score * (1 - score) if net.sigmoid else 1.0) * sign
    d_pooled, g_rho = backward(net, d_s[:, None], net.rho, kept_rho)
    d_h = np.zeros_like(h)
    if net.pool == "max":
        np.add.at(d_h, (chosen, np.arange(h.shape[1])), d_pooled[:-1])
        d_h[-1] += d_pooled[-1]
    else:
        d_h[:-1] = gt[:, None] * d_pooled[of_set]
        d_h[-1] = pads @ d_pooled
    _, g_phi = backward(net, d_h, net.phi, kept_phi)
    return sums, counts, np.concatenate([a.ravel() for a in [*g_phi, *g_rho, g_weights, d.T @ covariates, d.sum(0)]])


def sums_of(table: DataFrame, net: Network, heads: Heads, n_features: int, loss: str, sizes: np.ndarray | None) -> np.ndarray:
    """Loss sums and counts of each phenotype, and the gradient where ``sizes`` are given, over the rows of a table of ``prepared``."""
    held = sent(table.sparkSession, (net, heads, sizes))
    n, c = len(heads.phenotypes), len(heads.covariates)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, heads, sizes = held()
        total = None
        for t in whole_groups(batches):
            column = lambda i, t=t: t.column(i).to_numpy().astype(np.float64)
            block = lambda i, k, column=column, t=t: np.column_stack([column(j) for j in range(i, i + k)]) if k else np.zeros((t.num_rows, 0))
            found = step(net, heads, codes(t.column(0)), t.column(1).to_numpy(), column(2), block(3, n_features), block(3 + n_features, n), block(3 + n_features + n, c), loss, sizes)
            part = np.concatenate([a for a in found if a is not None])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "v"])

    size = 2 * n + (0 if sizes is None else sum(a.size for _, a in arrays(net, heads)))
    out = np.zeros(size)
    for r in table.drop("split").mapInArrow(summed, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


def dealt(seed: str, parts: int) -> Column:
    """A seeded number from 0 to parts - 1 for each sample."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("sample").cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(parts)).cast("int")


def prepared(rows: DataFrame, samples: DataFrame, features: list[str], heads: Heads, validation: int, seed: int) -> DataFrame:
    """sample, gene index, gt, features, phenotypes, covariates, split (0: validation) of every call, a row with gene -1 for samples without one; whole samples in order in a partition."""
    spark = rows.sparkSession
    kind = rows.schema["gene"].dataType.simpleString()
    index = spark.createDataFrame([(g, i) for i, g in enumerate(heads.genes)], f"gene {kind}, _g int")
    calls = rows.join(index, "gene").select("sample", "_g", F.col("gt").cast("double").alias("_gt"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"_x{i}") for i, f in enumerate(features)])
    nan = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
    people = samples.na.drop(subset=["sample", *heads.covariates]).select("sample", *[nan(p).alias(f"_y{i}") for i, p in enumerate(heads.phenotypes)], *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(heads.covariates)])
    xs = [f"_x{i}" for i in range(len(features))]
    table = people.join(calls, "sample", "left").select(
        "sample", F.coalesce("_g", F.lit(-1)).alias("_g"), F.coalesce("_gt", F.lit(0.0)).alias("_gt"), *[F.coalesce(x, F.lit(0.0)).alias(x) for x in xs],
        *[f"_y{i}" for i in range(len(heads.phenotypes))], *[f"_c{i}" for i in range(len(heads.covariates))], (dealt(f"split {seed}", validation) if validation else F.lit(1)).alias("split"),
    )
    return table.repartition("sample").sortWithinPartitions("sample", "_g", *xs, "_gt")


def start_losses(rows: DataFrame, samples: DataFrame, features: list[str], networks: dict[int, Network], heads: Heads, loss: str = "mse", validation: int = 5, seed: int = 0) -> list[tuple[int, float | None, float | None]]:
    """(key, train_loss, val_loss) of each network under the same heads before any step, as ``fit`` has them in epoch 0; calls are dealt by sample once for all."""
    if loss not in LOSSES:
        raise ValueError(f"unknown loss {loss!r}")
    table, n = prepared(rows, samples, features, heads, validation, seed).persist(), len(heads.phenotypes)
    of = lambda part, net: mean_loss(sums_of(part, net, heads, len(features), loss, None), n)
    found = [(key, of(table.where("split > 0"), net), of(table.where("split = 0"), net) if validation else None) for key, net in networks.items()]
    table.unpersist()
    return found


def genes_of(rows: DataFrame) -> list:
    found = [r["gene"] for r in rows.select("gene").where("gene is not null").distinct().limit(MOST_GENES + 1).collect()]
    if len(found) > MOST_GENES:
        raise ValueError(f"more than {MOST_GENES} genes")
    return sorted(found)


def mean_loss(sums: np.ndarray, n: int) -> float | None:
    """The mean over phenotypes of their mean losses; None without a value."""
    counts = sums[n : 2 * n]
    return float((sums[:n] / np.maximum(counts, 1)).mean()) if counts.sum() else None


def fit(
    rows: DataFrame, samples: DataFrame, features: list[str], network: Network, heads: Heads, loss: str = "mse", epochs: int = 20, batches: int = 1, rate: float = 0.01, decay: float = 1e-4,
    validation: int = 5, patience: int = 5, frozen: tuple[str, ...] = (), seed: int = 0,
) -> tuple[Network, Heads, list[dict]]:
    """Network and heads of the best epoch, and a history of epoch, train_loss, val_loss; epoch 0 is before any step.

    rows: sample, gene, gt, features; samples: sample, phenotypes (null where
    unknown) and covariates (samples without one are left out). One of ``validation``
    samples, by a hash, is never learned from; training ends after ``patience``
    epochs without a better validation loss (without validation: after all). Each
    epoch deals the others anew over ``batches`` steps of AdamW. ``frozen`` parts (phi,
    rho, heads) keep their weights. The given arrays are not changed.
    """
    if loss not in LOSSES:
        raise ValueError(f"unknown loss {loss!r}")
    copy = lambda layers: [(w.copy(), b.copy()) for w, b in layers]
    clone = lambda net, h: (Network(copy(net.phi), copy(net.rho), net.pool, net.pad_to, net.negate, net.sigmoid, net.slope, dict(net.heads)), Heads(h.phenotypes, h.genes, h.covariates, h.weights.copy(), h.effects.copy(), h.bias.copy()))
    net, heads = clone(network, heads)
    n, k = len(heads.phenotypes), len(features)
    table = prepared(rows, samples, features, heads, validation, seed).persist()
    learned, checked = table.where("split > 0"), table.where("split = 0")
    losses = lambda part: mean_loss(sums_of(part, net, heads, k, loss, None), n)
    history = [{"epoch": 0, "train_loss": losses(learned), "val_loss": losses(checked) if validation else None}]
    flat = arrays(net, heads)
    moment, second = [np.zeros_like(a) for _, a in flat], [np.zeros_like(a) for _, a in flat]
    best, best_loss, waited, steps = clone(net, heads), history[0]["val_loss"], 0, 0
    for epoch in range(1, epochs + 1):
        batch = dealt(f"batch {seed} {epoch}", batches)
        # the samples of each batch that have each phenotype, so that a step's sums are of its mean loss
        per_sample = learned.groupBy("sample").agg(*[F.first(f"_y{i}").alias(f"_y{i}") for i in range(n)])
        counted = {r["_b"]: np.array(r[1:], float) for r in per_sample.groupBy(batch.alias("_b")).agg(*[F.count_if(~F.isnan(f"_y{i}")).alias(f"n{i}") for i in range(n)]).collect()}
        total = np.zeros(2 * n)
        for b in sorted(counted):
            got = sums_of(learned.where(batch == b), net, heads, k, loss, counted[b])
            total, steps, at = total + got[: 2 * n], steps + 1, 2 * n
            for i, (part, a) in enumerate(flat):
                g = got[at : at + a.size].reshape(a.shape)
                at += a.size
                if part in frozen:
                    continue
                moment[i] = 0.9 * moment[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                a -= rate * (moment[i] / (1 - 0.9**steps) / (np.sqrt(second[i] / (1 - 0.999**steps)) + 1e-8) + decay * a)
        val = losses(checked) if validation else None
        history.append({"epoch": epoch, "train_loss": mean_loss(total, n), "val_loss": val})
        if val is None or best_loss is None or val < best_loss:
            best, best_loss, waited = clone(net, heads), val, 0
        else:
            waited += 1
            if waited >= patience:
                break
    table.unpersist()
    return *best, history


def predict(rows: DataFrame, samples: DataFrame, features: list[str], network: Network, heads: Heads) -> DataFrame:
    """sample, phenotype, prediction of every sample with all covariates."""
    burdens = score(rows, features, {0: network})
    empty = network.empty_score()
    spark = rows.sparkSession
    kind = rows.schema["gene"].dataType.simpleString()
    weights = spark.createDataFrame([(g, [float(w) for w in heads.weights[:, i]]) for i, g in enumerate(heads.genes)], f"gene {kind}, w array<double>")
    summed = burdens.join(weights, "gene").groupBy("sample").agg(*[F.sum((F.col("burden") - empty) * F.get("w", F.lit(p))).alias(f"_g{p}") for p in range(len(heads.phenotypes))])
    people = samples.na.drop(subset=["sample", *heads.covariates]).join(summed, "sample", "left")
    total = lambda p: sum((F.lit(float(e)) * F.col(c).cast("double") for c, e in zip(heads.covariates, heads.effects[p], strict=True)), F.lit(float(heads.bias[p] + empty * heads.weights[p].sum()))) + F.coalesce(f"_g{p}", F.lit(0.0))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("phenotype"), total(p).alias("prediction")) for p, name in enumerate(heads.phenotypes)]))
    return people.select("sample", each.alias("_p")).select("sample", "_p.phenotype", "_p.prediction")
