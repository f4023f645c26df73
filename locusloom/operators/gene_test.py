"""Tests of gene burdens against a phenotype, as aggregates over carriers.

With an intercept in the null model a burden may be shifted by a constant, so rows
of samples that don't carry a variant are never made: b is 0 for them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.distributions import chi2_1_sf, chi2_sf, t_pvalue
from ..functions.mixture import mixture_tail
from ..functions.matrices import matrix_of
from ..functions.shared import sent, written
from . import conditional, saddlepoint, spectrum
from .null_model import FEW, MOST, NullModel, complete, design, fit_linear, products
from .transform import permuted_many


def collapse(rows: DataFrame, method: str = "sum", value: str = "value") -> DataFrame:
    """sample, gene, b: max, sum or binary burden of weighted variants."""
    return collapse_several(rows, {"b": method}, value)


def collapse_several(rows: DataFrame, methods: dict[str, str], value: str = "value") -> DataFrame:
    """sample, gene and one burden a method (name -> method), from one aggregation."""
    how = {"sum": F.sum(value), "max": F.max(value), "binary": (F.sum(value) > 0).cast("double")}
    if unknown := set(methods.values()) - set(how):
        raise ValueError(f"unknown collapse {unknown}")
    return rows.groupBy("sample", "gene").agg(*[how[m].alias(name) for name, m in methods.items()])


def quadratic(sums: list[Column], inverse: tuple[tuple[float, ...], ...]) -> Column:
    """s' inverse s for aggregated columns s."""
    total = F.lit(0.0)
    for i, a in enumerate(sums):
        for j, b in enumerate(sums):
            total = total + F.lit(float(inverse[i][j])) * a * b
    return total


def gene_sums(burdens: DataFrame, model: NullModel, samples: DataFrame) -> DataFrame:
    """gene, n_carriers, u = b'r, bpb = b'P b, _bb = b'W b of each gene."""
    if len(model.x) >= FEW:
        return wide_gene_sums(burdens, model, samples)
    frame = model.frame(samples)
    rows = burdens.join(frame, "sample")
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in model.x]]
    names = [f"_x{i}" for i in range(len(x))]
    sums = rows.groupBy("gene").agg(
        F.sum(F.col("b") * F.col("r")).alias("u"), F.sum(F.col("w") * F.col("b") * F.col("b")).alias("_bb"), F.count_if(F.col("b") != 0).alias("n_carriers"),
        *[F.sum(F.col("w") * F.col("b") * c).alias(n) for c, n in zip(x, names, strict=True)],
    )
    return sums.select("gene", "n_carriers", "u", (F.col("_bb") - quadratic([F.col(n) for n in names], model.inverse)).alias("bpb"), "_bb")


#: Numbers that a task holds of its genes' sums before it sends them.
HELD = 1 << 22


def wide_gene_sums(burdens: DataFrame, model: NullModel, samples: DataFrame) -> DataFrame:
    """``gene_sums`` for many covariates: samples get their design times the root of its inverse, so b'P b is b'W b less the squared sums of b w times that."""
    held = sent(samples.sparkSession, (np.array(model.beta), np.array(model.root), model.logistic))
    sample, gene = (t.schema[c].dataType.simpleString() for t, c in ((samples, "sample"), (burdens, "gene")))

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beta, root, logistic = held()
        for b in batches:
            # rows with a null go here: as a filter below a join it would meet every renamed column while Spark plans
            b = b.drop_null()
            if not b.num_rows:
                continue
            m = matrix_of(b.columns[1:])
            z = np.column_stack([np.ones(len(m)), m[:, 1:]])
            eta = z @ beta
            mu = 1 / (1 + np.exp(-np.clip(eta, -MOST, MOST))) if logistic else eta
            w = mu * (1 - mu) if logistic else np.ones(len(m))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m[:, 0] - mu), pa.array(w), pa.array(list(z @ root), pa.list_(pa.float64()))], names=["sample", "r", "w", "q"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}

        def out() -> pa.RecordBatch:
            n = len(next(iter(total.values())))
            genes = pa.array([g for g in total for _ in range(n)])
            batch = pa.RecordBatch.from_arrays([genes, pa.array(np.tile(np.arange(n, dtype=np.int32), len(total))), pa.array(np.concatenate(list(total.values())))], names=["gene", "i", "v"])
            total.clear()
            return batch

        for b in batches:
            if not b.num_rows:
                continue
            genes = b.column(0).dictionary_encode()
            codes, (value, r, w) = genes.indices.to_numpy(), (b.column(i).to_numpy() for i in (1, 2, 3))
            q = b.column(4).flatten().to_numpy().reshape(len(value), -1)
            parts = np.column_stack([value * r, w * value * value, value != 0, q * (w * value)[:, None]])
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(codes[order]) != 0))
            for code, sums in zip(codes[order][starts], np.add.reduceat(parts[order], starts), strict=True):
                g = genes.dictionary[int(code)].as_py()
                total[g] = total[g] + sums if g in total else sums
            if len(total) * parts.shape[1] > HELD:
                yield out()
        if total:
            yield out()

    frame = samples.select("sample", *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate((model.y, *model.x))]).mapInArrow(projected, f"sample {sample}, r double, w double, q array<double>")
    carried = burdens.select("sample", "gene", F.col("b").cast("double").alias("b")).join(frame, "sample").select("gene", "b", "r", "w", "q")
    each = carried.mapInArrow(summed, f"gene {gene}, i int, v double").groupBy("gene", "i").agg(F.sum("v").alias("v"))
    at = lambda k: F.sum(F.when(F.col("i") == k, F.col("v")))
    sums = each.groupBy("gene").agg(at(0).alias("u"), at(1).alias("_bb"), at(2).cast("long").alias("n_carriers"), F.sum(F.when(F.col("i") > 2, F.col("v") * F.col("v"))).alias("_taken"))
    return sums.select("gene", "n_carriers", "u", (F.col("_bb") - F.col("_taken")).alias("bpb"), "_bb")


def score_test(burdens: DataFrame, model: NullModel, samples: DataFrame) -> DataFrame:
    """gene, beta, beta_sd, stat, pval. Genes of constant burden are left out; effect sizes for linear models only."""
    sums = gene_sums(burdens, model, samples).where(F.col("bpb") > 1e-9 * F.col("_bb"))
    stat = F.col("u") * F.col("u") / (F.lit(model.sigma2) * F.col("bpb"))
    linear = F.lit(not model.logistic)
    out = sums.select("gene", "n_carriers", F.when(linear, F.col("u") / F.col("bpb")).alias("beta"), F.when(linear, F.sqrt(F.lit(model.sigma2) / F.col("bpb"))).alias("beta_sd"), stat.alias("stat"))
    return out.withColumn("pval", chi2_sf("stat"))


def saddlepoint_test(burdens: DataFrame, model: NullModel, samples: DataFrame, cutoff: float = saddlepoint.CUTOFF) -> DataFrame:
    """gene, n_carriers, stat, pval, saddlepoint: the score test of a binary phenotype, whose p-values come from the saddlepoint where the score lies beyond ``cutoff`` standard deviations."""
    if not model.logistic:
        raise ValueError("the saddlepoint test is for a logistic null model")
    return saddlepoint.saddlepoint_test(gene_sums(burdens, model, samples).where(F.col("bpb") > 1e-9 * F.col("_bb")), burdens, model, samples, cutoff)


def ols_test(burdens: DataFrame, model: NullModel, samples: DataFrame) -> DataFrame:
    """gene, beta, t, pval of least squares on [burden, 1, x], from the sums of the null model (Frisch-Waugh)."""
    rss0 = model.sigma2 * (model.n - len(model.x) - 1)
    df = model.n - len(model.x) - 2
    sums = gene_sums(burdens, model, samples).where(F.col("bpb") > 1e-9 * F.col("_bb"))
    beta = F.col("u") / F.col("bpb")
    rss = F.greatest(F.lit(rss0) - F.col("u") * F.col("u") / F.col("bpb"), F.lit(0.0))
    out = sums.select("gene", beta.alias("beta"), (beta / F.sqrt(rss / df / F.col("bpb"))).alias("t"))
    return out.withColumn("pval", t_pvalue(F.abs("t"), F.lit(float(df))))


def array_sums(rows: DataFrame) -> DataFrame:
    """gene, sums: the sum of b x values over a gene's rows, place by place. rows: gene, b, values of one length; Arrow batches are added up in tasks first."""
    kind = rows.schema["gene"].dataType.simpleString()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["gene", "v"])
            total.clear()
            return batch

        for batch in batches:
            if not batch.num_rows:
                continue
            genes = batch.column(0).dictionary_encode()
            codes, values = genes.indices.to_numpy(), batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(codes[order]) != 0))
            for code, sums in zip(codes[order][starts], np.add.reduceat((values * batch.column(1).to_numpy()[:, None])[order], starts), strict=True):
                g = genes.dictionary[int(code)].as_py()
                total[g] = total[g] + sums if g in total else sums
            if len(total) * values.shape[1] > HELD:
                yield out()
        if total:
            yield out()

    each = rows.select("gene", F.col("b").cast("double").alias("b"), "values").mapInArrow(summed, f"gene {kind}, v array<double>").select("gene", F.posexplode("v").alias("i", "v"))
    total = each.groupBy("gene", "i").agg(F.sum("v").alias("v"))
    return total.groupBy("gene").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("sums"))


def permutation_test(burdens: DataFrame, model: NullModel, samples: DataFrame, n: int = 200, seed: int = 0) -> DataFrame:
    """gene, stat, pval_empirical, null_mean: score statistics against ``n`` permutations of the residuals, all from one pass over the carriers.

    pval_empirical is (1 + permutations with as large a score) / (n + 1); null_mean is the mean of the permuted statistics, 1 where
    the plain test is calibrated. Genes of constant burden are left out.
    """
    values = permuted_many(model.frame(samples).select("sample", "r"), "r", "sample", n, seed)
    sums = gene_sums(burdens, model, samples).where(F.col("bpb") > 1e-9 * F.col("_bb")).select("gene", "bpb")
    scored = array_sums(burdens.join(values, "sample").select("gene", "b", "values")).join(sums, "gene")
    own, others = F.get("sums", F.lit(0)), F.slice("sums", 2, max(1, n))
    scale = F.lit(model.sigma2) * F.col("bpb")
    # equal scores may differ in their last digits
    beyond = F.size(F.filter(others, lambda v: F.abs(v) >= F.abs(own) * (1 - 1e-9)))
    mean = F.aggregate(others, F.lit(0.0), lambda t, v: t + v * v) / F.nullif(F.lit(float(n)), F.lit(0.0))
    return scored.select("gene", (own * own / scale).alias("stat"), ((1 + beyond) / F.lit(n + 1.0)).alias("pval_empirical"), (mean / scale).alias("null_mean"))


def expected_allele_count(rows: DataFrame, n_samples: int, n_cases: int, value: str = "gt") -> DataFrame:
    """gene, caf, eac: summed allele frequency of a gene's variants, times the number of cases."""
    caf = F.sum(value) / F.nullif(F.lit(2.0 * n_samples), F.lit(0.0))
    return rows.groupBy("gene").agg(caf.alias("caf")).withColumn("eac", F.col("caf") * F.lit(n_cases))


def case_count(samples: DataFrame, y: str) -> int:
    """Samples with y > 0 if y has two values, else all samples."""
    row = samples.agg(F.count_distinct(y).alias("v"), F.count_if(F.col(y).cast("double") > 0).alias("c"), F.count("*").alias("n")).first()
    return row["c"] if row["v"] == 2 else row["n"]


def variant_counters(rows: DataFrame, min_mac: int = 10) -> DataFrame:
    """Per gene: n_qv, max_var_count, max_var_count_wo_homoz, n_cluster (carriers), markers_after_mac_collapsing."""
    return counters_of_variants(rows, min_mac).join(rows.groupBy("gene").agg(F.count_distinct("sample").alias("n_cluster")), "gene")


def counters_of_variants(rows: DataFrame, min_mac: int = 10) -> DataFrame:
    """``variant_counters`` without the carriers, which have to be told apart."""
    by_variant = rows.groupBy("gene", "variant_id").agg(F.sum("gt").alias("mac"), F.count("*").alias("carriers"))
    return by_variant.groupBy("gene").agg(
        F.count("*").alias("n_qv"), F.max("mac").alias("max_var_count"), F.max("carriers").alias("max_var_count_wo_homoz"),
        (F.count_if(F.col("mac") > min_mac) + F.max((F.col("mac") <= min_mac).cast("long"))).alias("markers_after_mac_collapsing"),
    )


def collapse_ultra_rare(rows: DataFrame, min_mac: int = 10) -> DataFrame:
    """sample, gene, marker, value: variants of at most ``min_mac`` alleles of a gene become one marker, the carrier's largest value."""
    mac = rows.groupBy("gene", "variant_id").agg(F.sum("gt").alias("_mac"))
    marked = rows.join(mac, ["gene", "variant_id"]).withColumn("marker", F.when(F.col("_mac") <= min_mac, F.lit("collapsed")).otherwise(F.col("variant_id").cast("string")))
    return marked.groupBy("sample", "gene", "marker").agg(F.max("value").alias("value"))


def skat_statistic(rows: DataFrame, model: NullModel, samples: DataFrame) -> DataFrame:
    """gene, q, n_markers of ``skat``, from sums alone: no gene is gathered in a task."""
    z = rows.select("sample", "gene", "marker", "value").join(model.frame(samples), "sample")
    single = z.groupBy("gene", "marker").agg(F.sum(F.col("value") * F.col("r")).alias("zr"))
    return single.groupBy("gene").agg(F.sum(F.col("zr") * F.col("zr")).alias("q"), F.count("*").cast("int").alias("n_markers"))


#: Markers of a gene whose matrix is built in one task (8 MB); larger genes' spectra are found without it.
DENSE = 1000
#: Genes of more qualifying variants aren't seed-tested by default.
MAX_MARKERS = 5000


def skat_rows(rows: DataFrame, model: NullModel, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables: gene, sample, marker, value, w; and a row a marker with zr, zx, sums of value x residual and of w x value x [1, covariates]."""
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in model.x]]
    frame = model.frame(samples).select("sample", "r", "w", F.array(*x).alias("x"))
    z = written(rows.select("sample", "gene", F.col("marker").cast("string").alias("marker"), F.col("value").cast("double").alias("value")).join(frame, "sample"), "markers")
    sums = F.array(*[F.sum(F.col("w") * F.col("value") * F.get("x", F.lit(i))) for i in range(len(x))])
    return z, written(z.groupBy("gene", "marker").agg(F.sum(F.col("value") * F.col("r")).alias("zr"), sums.alias("zx")), "marker_sums")


def skat_moments(rows: DataFrame, model: NullModel, samples: DataFrame) -> DataFrame:
    """gene, trace, trace2 of the matrix of each gene's test statistic, without that matrix."""
    return spectrum.moments(*skat_rows(rows, model, samples), model)


def skat(rows: DataFrame, model: NullModel, samples: DataFrame, dense: int = DENSE, block: int = spectrum.BLOCK, steps: int = spectrum.STEPS) -> DataFrame:
    """gene, q, n_markers, pval: variance-component test of marker values z (sample, gene, marker, value).

    Cross products of markers come from a self join on (gene, sample), so only
    pairs that share a carrier exist. A gene of at most ``dense`` markers has its
    matrix and all eigenvalues in its group; larger ones go through ``spectrum``,
    which holds no gene in one task.
    """
    z, single = skat_rows(rows, model, samples)
    large = written(single.groupBy("gene").agg(F.count("*").alias("n")).where(F.col("n") > dense).select("gene"), "large_genes")
    found = None if large.isEmpty() else spectrum.spectra(z, single, model, large, block, steps)
    small, ones = (t.join(large, "gene", "left_anti") for t in (z, single))
    a = small.select("gene", "sample", F.col("marker").alias("m1"), F.col("value").alias("v1"), "w")
    b = small.select("gene", "sample", F.col("marker").alias("m2"), F.col("value").alias("v2"))
    cross = a.join(b, ["gene", "sample"]).where("m1 <= m2").groupBy(F.col("gene").alias("gene_"), "m1", "m2").agg(F.sum(F.col("w") * F.col("v1") * F.col("v2")).alias("zz"))
    inverse, sigma2 = np.array(model.inverse), model.sigma2

    def tested(key: tuple, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values("marker").reset_index(drop=True)
        at = {m: i for i, m in enumerate(one.marker)}
        zz = np.zeros((len(one), len(one)))
        i, j = two.m1.map(at).to_numpy(), two.m2.map(at).to_numpy()
        zz[i, j] = two.zz
        zz[j, i] = two.zz
        zx = np.stack(one.zx.to_list())
        q = float((one.zr**2).sum())
        values = np.linalg.eigvalsh(zz - zx @ inverse @ zx.T) * sigma2
        return pd.DataFrame({"gene": [key[0]], "q": [q], "n_markers": [len(one)], "pval": [mixture_tail(q, values)]})

    kind = rows.schema["gene"].dataType.simpleString()
    out = ones.groupBy("gene").cogroup(cross.groupBy("gene_")).applyInPandas(tested, f"gene {kind}, q double, n_markers int, pval double")
    return out if found is None else out.unionByName(found)


def ols_phenotypes(burdens: DataFrame, samples: DataFrame, phenotypes: list[str], x: list[str]) -> DataFrame:
    """phenotype, gene, beta, t, pval: ``ols_test`` of each of several phenotypes on the same burdens."""
    parts = [ols_test(burdens, fit_linear(samples, y, x), samples).withColumn("phenotype", F.lit(y)) for y in phenotypes]
    return reduce(DataFrame.unionByName, parts)


#: Burden tests of seed genes have effect sizes where p is smaller than this.
SEED_EFFECTS = 1e-3


def class_counts(rows: DataFrame, model: NullModel, n_cases: int, belongs: Column, least_weight: float, min_mac: int) -> DataFrame:
    """gene and the counters of a class of variants, as in ``seed_tests``."""
    eac = lambda some, name: expected_allele_count(some, model.n, n_cases).select("gene", F.col("eac").alias(name))
    of_class = rows.where(belongs)
    chosen = of_class.where(F.col("weight") >= least_weight)
    counters = counters_of_variants(chosen, min_mac).withColumnRenamed("n_qv", "n_QV")
    return eac(of_class, "EAC").join(eac(chosen, "EAC_filtered"), "gene", "left").join(counters, "gene", "left").fillna(0, ["n_QV"])


def seed_kinds(counts: DataFrame, name: str, n_cases: int, tested: Column, ttypes: tuple[str, ...]) -> DataFrame:
    """A row a gene and ttype of a class's counters."""
    return counts.withColumns({
        "ttype": F.explode(F.array(*map(F.lit, ttypes))), "vtype": F.lit(name), "n_cases": F.lit(n_cases).cast("long"), "n_cluster": F.when(tested, F.col("n_QV")),
    }).withColumn("markers_after_mac_collapsing", F.when(tested & (F.col("ttype") == "skat"), F.col("markers_after_mac_collapsing")).otherwise(F.col("n_QV")))


def is_tested(max_markers: int | None) -> Column:
    return (F.col("n_QV") > 0) & (F.lit(True) if max_markers is None else F.col("n_QV") < max_markers)


#: The two tests of a seed gene, and the counters beside them.
TTYPES = ("burden", "skat")
COUNTERS = ["EAC", "EAC_filtered", "n_cases", "n_QV", "n_cluster", "max_var_count", "max_var_count_wo_homoz", "markers_after_mac_collapsing"]


def seed_counters(rows: DataFrame, model: NullModel, samples: DataFrame, classes: dict[str, Column], least_weight: float = 0.0, min_mac: int = 10, max_markers: int | None = MAX_MARKERS, ttypes: tuple[str, ...] = TTYPES) -> DataFrame:
    """gene, vtype, ttype and the counters of ``seed_tests``, from sums alone."""
    n_cases = case_count(samples, model.y)
    parts = [seed_kinds(class_counts(rows, model, n_cases, belongs, least_weight, min_mac), name, n_cases, is_tested(max_markers), ttypes) for name, belongs in classes.items()]
    return reduce(DataFrame.unionByName, parts).select("gene", "vtype", "ttype", *COUNTERS)


def seed_tests(rows: DataFrame, model: NullModel, samples: DataFrame, classes: dict[str, Column], least_weight: float = 0.0, min_mac: int = 10, max_markers: int | None = MAX_MARKERS, collapse_method: str = "binary", homozygotes_once: bool = False, ttypes: tuple[str, ...] = TTYPES) -> DataFrame:
    """Burden and variance-component tests of each class of variants: a row a gene, vtype and ttype.

    rows: sample, gene, variant_id, gt, weight and what ``classes`` (name -> rows of
    it) reads. Variants qualify with at least ``least_weight``; a call counts as gt
    times the root of the weight. Genes of ``max_markers`` qualifying variants or
    more have null p-values and statistics (None: genes of any size are tested);
    variants of at most ``min_mac`` alleles are one marker of the variance-component
    test. Only tests in ``ttypes`` are run.

    Columns: stat, pval; EAC of all variants of the class and EAC_filtered of
    qualifying ones, n_cases, n_QV, n_cluster, max_var_count with homozygous calls and
    max_var_count_wo_homoz, markers_after_mac_collapsing (of the test); beta and
    beta_sd of burden tests with p below SEED_EFFECTS under a linear model.
    """
    if unknown := set(ttypes) - set(TTYPES):
        raise ValueError(f"unknown tests {unknown}")
    # read several times for each class, so made once
    rows, n_cases, out = written(rows, "calls"), case_count(samples, model.y), []
    for name, belongs in classes.items():
        counts = written(class_counts(rows, model, n_cases, belongs, least_weight, min_mac), "counts")
        chosen = rows.where(belongs).where(F.col("weight") >= least_weight)
        few = counts.where(is_tested(max_markers)).select("gene")
        gt = scalar.homozygotes_once("gt", homozygotes_once)
        valued = chosen.join(few, "gene", "left_semi").withColumn("value", gt * F.sqrt("weight"))
        nothing, tests = F.lit(None).cast("double"), []
        effect = lambda c: F.when(F.col("pval") < SEED_EFFECTS, F.col(c)).alias(c)
        if "burden" in ttypes:
            tests.append(score_test(collapse(valued, collapse_method), model, samples).select("gene", "stat", "pval", effect("beta"), effect("beta_sd"), F.lit("burden").alias("ttype")))
        if "skat" in ttypes:
            tests.append(skat(collapse_ultra_rare(valued, min_mac), model, samples).select("gene", F.col("q").alias("stat"), "pval", nothing.alias("beta"), nothing.alias("beta_sd"), F.lit("skat").alias("ttype")))
        kinds = seed_kinds(counts, name, n_cases, is_tested(max_markers), ttypes)
        out.append(kinds.join(reduce(DataFrame.unionByName, tests), ["gene", "ttype"], "left"))
    return reduce(DataFrame.unionByName, out).select("gene", "vtype", "ttype", "stat", "pval", *COUNTERS, "beta", "beta_sd")


def conditional_test(burdens: DataFrame, conditioning: DataFrame, samples: DataFrame, y: str, x: list[str], dense: int = DENSE) -> DataFrame:
    """gene, beta, stat, pval of the burden score test given x and the gene's own common variants.

    conditioning: gene, sample, marker, value in long form (absent: 0). All cross
    products of [1, x, burden, markers, y] are sums in Spark; a gene's group holds
    only its small matrix. Genes with more than ``dense`` markers are solved by
    conjugate gradients over their calls instead (``conditional``).
    """
    large = written(conditioning.select("gene", "marker").distinct().groupBy("gene").agg(F.count("*").alias("n")).where(F.col("n") > dense).select("gene"), "large_genes")
    if large.isEmpty():
        return dense_conditional_test(burdens, conditioning, samples, y, x)
    only = lambda df, how: df.join(large, "gene", how)
    model = fit_linear(samples, y, x)
    z, single = skat_rows(only(conditioning, "left_semi"), model, samples)
    b = only(burdens, "left_semi").select("gene", "sample", F.col("b").cast("double").alias("b"))
    design_ = complete(samples, y, x).select("sample", F.array(*design(x)).alias("x"))
    k = len(x) + 1
    xb = b.join(design_, "sample").groupBy("gene").agg(*[F.sum(F.col("b") * F.get("x", F.lit(i))).alias(f"_x{i}") for i in range(k)])
    effect = F.array(*[sum((F.lit(float(v)) * F.col(f"_x{j}") for j, v in enumerate(row)), F.lit(0.0)) for row in model.inverse])
    zb = z.join(b, ["gene", "sample"]).groupBy("gene", "marker").agg(F.sum(F.col("value") * F.col("b")).alias("_zb"))
    taken = sum((F.get("zx", F.lit(i)) * F.get("c", F.lit(i)) for i in range(k)), F.lit(0.0))
    products_ = single.join(xb.select("gene", effect.alias("c")), "gene").join(zb, ["gene", "marker"], "left").select("gene", "marker", (F.coalesce("_zb", F.lit(0.0)) - taken).alias("zb"))
    found = conditional.large_tests(z, single, gene_sums(b, model, samples), products_, model, large)
    return dense_conditional_test(only(burdens, "left_anti"), only(conditioning, "left_anti"), samples, y, x).unionByName(found)


def dense_conditional_test(burdens: DataFrame, conditioning: DataFrame, samples: DataFrame, y: str, x: list[str]) -> DataFrame:
    """``conditional_test`` with each gene's matrix in its group."""
    rows = complete(samples, y, x)
    base_columns = [*design(x), F.col(y).cast("double")]
    base, n = products(rows, base_columns)
    k = len(base_columns)
    names = [f"_c{i}" for i in range(k)]
    base_rows = rows.select("sample", *[c.alias(m) for c, m in zip(base_columns, names, strict=True)])
    own = F.lit("\x00burden")
    common = written(conditioning.select("gene", "sample", "marker", F.col("value").cast("double").alias("value")).join(base_rows, "sample"), "conditioning")
    # most rows are burdens: they are added up as they are and join only the calls of common variants
    carried = burdens.select("gene", "sample", F.col("b").cast("double").alias("value"))
    sums = F.array(*[F.sum(F.col("value") * F.col(m)) for m in names]).alias("zx")
    burden = written(carried.join(base_rows, "sample").groupBy("gene").agg(sums, F.sum(F.col("value") * F.col("value")).alias("zz")), "burden_sums")
    single = burden.select("gene", own.alias("marker"), "zx").unionByName(common.groupBy("gene", "marker").agg(sums))
    a = common.select("gene", "sample", F.col("marker").alias("m1"), F.col("value").alias("v1"))
    b = common.select("gene", "sample", F.col("marker").alias("m2"), F.col("value").alias("v2"))
    pairs = a.join(b, ["gene", "sample"]).where("m1 <= m2").groupBy("gene", "m1", "m2").agg(F.sum(F.col("v1") * F.col("v2")).alias("zz"))
    with_burden = b.join(carried, ["gene", "sample"]).groupBy("gene", own.alias("m1"), "m2").agg(F.sum(F.col("value") * F.col("v2")).alias("zz"))
    cross = burden.select("gene", own.alias("m1"), own.alias("m2"), "zz").unionByName(with_burden).unionByName(pairs).withColumnRenamed("gene", "gene_")

    def tested(key: tuple, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values("marker").reset_index(drop=True)
        if not len(one) or one.marker[0] != "\x00burden":
            return pd.DataFrame({"gene": [key[0]], "beta": [np.nan], "stat": [np.nan], "pval": [np.nan]})
        at = {m: i for i, m in enumerate(one.marker)}
        i, j = two.m1.map(at).to_numpy(), two.m2.map(at).to_numpy()
        zz = np.zeros((len(one), len(one)))
        zz[i, j] = two.zz
        zz[j, i] = two.zz
        zx = np.stack(one.zx.to_list())
        null = np.block([[base[:-1, :-1], zx[1:, :-1].T], [zx[1:, :-1], zz[1:, 1:]]])
        to_y, to_b = np.concatenate([base[:-1, -1], zx[1:, -1]]), np.concatenate([zx[0, :-1], zz[0, 1:]])
        inverse = np.linalg.pinv(null)
        rank = np.linalg.matrix_rank(null)
        sigma2 = (base[-1, -1] - to_y @ inverse @ to_y) / max(1, n - rank)
        u, v = zx[0, -1] - to_b @ inverse @ to_y, zz[0, 0] - to_b @ inverse @ to_b
        if v <= 1e-9 * zz[0, 0] or sigma2 <= 0:
            return pd.DataFrame({"gene": [key[0]], "beta": [np.nan], "stat": [np.nan], "pval": [np.nan]})
        stat = u * u / (sigma2 * v)
        return pd.DataFrame({"gene": [key[0]], "beta": [u / v], "stat": [stat], "pval": [chi2_1_sf(stat)]})

    kind = burdens.schema["gene"].dataType.simpleString()
    return single.groupBy("gene").cogroup(cross.groupBy("gene_")).applyInPandas(tested, f"gene {kind}, beta double, stat double, pval double").where("stat is not null and not isnan(stat)")
