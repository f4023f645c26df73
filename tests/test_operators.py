"""Operators on hand-made tables, with their failures, and numerics against plain numpy."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from locusloom.functions import distributions as dist
from locusloom.functions import mixture, scalar
from locusloom.operators import annotate, checks, deepset, evaluate, gene_test, genotype, masks, metrics, multitest, null_model, qc, spectrum, training, transform
from pyspark.sql import functions as F

SITE = "chrom string, pos long, ref string, alt string"


@pytest.fixture(scope="module")
def tables(spark):
    variants = spark.createDataFrame([("chr1", 10, "A", "T", 0), ("chr1", 20, "C", "G", 1), ("chr2", 10, "A", "T", 2)], f"{SITE}, id long")
    calls = spark.createDataFrame([("chr1", 10, "A", "T", "s1", 1), ("chr1", 20, "C", "G", "s1", 2), ("chr1", 10, "A", "T", "s2", 2), ("chr2", 10, "A", "T", "s3", 1), ("chr9", 1, "A", "T", "s3", 1)], f"{SITE}, sample string, gt int")
    samples = spark.createDataFrame([(f"s{i}",) for i in range(1, 5)], "sample string")
    return variants, calls, samples


def found(df):
    return sorted((r["sample"], r["variant_id"], r["gt"]) for r in df.collect())


def test_calls_scenarios(tables):
    v, c, s = tables
    every = [("s1", 0, 1), ("s1", 1, 2), ("s2", 0, 2), ("s3", 2, 1)]
    assert found(genotype.process_calls(c, v, s)) == every
    one = v.where("id = 0")
    assert found(genotype.process_calls(c, v, s, one)) == [r for r in every if r[1] != 0]
    assert found(genotype.process_calls(c, v, s, None, s.where("sample = 's1'"))) == every[2:]
    assert found(genotype.process_calls(c, v, s, None, None, c.where("sample = 's2'").drop("gt"))) == [every[0], every[1], every[3]]
    assert found(genotype.process_calls(c, v, s, one, s.where("sample = 's3'"), c.where("pos = 20").drop("gt"))) == []
    with pytest.raises(checks.CheckFailed):
        genotype.process_calls(c, v, s, v)
    with pytest.raises(checks.CheckFailed):
        genotype.process_calls(c, v, s, None, s)
    with pytest.raises(checks.CheckFailed):
        genotype.attach_ids(c, v.union(v)).count()


def test_sample_genotypes_and_parts(tables):
    v, c, s = tables
    calls = genotype.process_calls(c, v, s)
    rows = {r["sample"]: [(x["variant_id"], x["gt"]) for x in r["calls"]] for r in genotype.sample_genotypes(calls, s).collect()}
    assert rows == {"s1": [(0, 1), (1, 2)], "s2": [(0, 2)], "s3": [(2, 1)], "s4": []}
    parts = [genotype.sample_genotypes(calls.where(f"variant_id % 2 = {i}"), s) for i in (0, 1)]
    assert {r["sample"]: [(x["variant_id"], x["gt"]) for x in r["calls"]] for r in genotype.combine_genotypes(parts).collect()} == rows
    with pytest.raises(ValueError):
        genotype.combine_genotypes([parts[0], parts[1].where("sample <> 's1'")])
    af = {r["id"]: r["af"] for r in genotype.allele_frequency(calls, v, 4).collect()}
    assert af == {0: 3 / 8, 1: 2 / 8, 2: 1 / 8}
    assert {r["id"]: r["af"] for r in genotype.allele_frequency(calls, v, 4, skip_id_zero=True).collect()}[0] == 0


def test_variant_ids(spark):
    rows = spark.createDataFrame([("chr2", 5, "A", "T"), ("chr1", 7, "A", "T"), ("chr1", 7, "A", "T"), ("chr1", 3, "A", "C"), ("chr3", 1, "G", "T")], SITE)
    ids, twice = genotype.add_variant_ids(rows, chromosomes=["chr1", "chr2"])
    assert sorted((r["id"], r["chrom"], r["pos"]) for r in ids.collect()) == [(0, "chr1", 3), (1, "chr1", 7), (2, "chr2", 5)]
    assert [(r["chrom"], r["pos"]) for r in twice.collect()] == [("chr1", 7)]


def test_checked_join(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, v string")
    b = spark.createDataFrame([(1, 10), (2, 20)], "k int, w int")
    assert checks.checked_join(a, b, ["k"], "left", "m:1", equal_rows=True).count() == 3
    with pytest.raises(checks.CheckFailed):
        checks.checked_join(a, b, ["k"], "left", "1:1")
    with pytest.raises(checks.CheckFailed):
        checks.checked_join(b, a, ["k"], "left", None, equal_rows=True)
    checks.require_same_rows(b, b.withColumn("w", F.col("w") + 1e-9), ["k"], ["w"])
    with pytest.raises(checks.CheckFailed):
        checks.require_same_rows(b, b.where("k = 1"), ["k"], ["w"])


def test_individual_missingness(spark):
    sites = spark.createDataFrame([(100,), (100,)], "n_sites long")
    for bad, want in (([], []), ([("s1", 20)], ["s1"]), ([("s1", 15), ("s1", 5), ("s2", 30)], ["s1", "s2"])):
        rows = spark.createDataFrame([*bad, ("s9", 19)], "sample string, n_missing long")
        assert sorted(r["sample"] for r in qc.individual_missingness(rows, sites, 0.1).collect()) == want


def test_hwe():
    assert qc.hwe_exact(0, 0, 0) == 1 and abs(qc.hwe_exact(25, 50, 25) - 1) < 1e-9
    assert qc.hwe_exact(50, 0, 50) < 1e-15

    def plain(ref, het, alt):
        n, rare = ref + het + alt, 2 * min(ref, alt) + het
        logs = {h: h * math.log(2) - sum(math.lgamma(x + 1) for x in ((rare - h) // 2, h, n - h - (rare - h) // 2)) for h in range(rare % 2, rare + 1, 2)}
        top = max(logs.values())
        p = {h: math.exp(v - top) for h, v in logs.items()}
        return sum(v for v in p.values() if v <= p[het] * (1 + 1e-9)) / sum(p.values())

    for c in ((5, 3, 9), (40, 10, 2), (0, 7, 1), (3, 0, 8)):
        assert abs(qc.hwe_exact(*c) - plain(*c)) < 1e-9


def test_hwe_batches():
    """All small tables against plain sums, and cohorts of a million in the time of few terms."""
    counts = [(a, b, c) for a in range(0, 9) for b in range(0, 9) for c in range(0, 9)] + [(1000, 60, 3), (5000, 10, 40), (300, 700, 300), (12, 1999, 5)]
    got = qc.hwe_batch(*np.array(counts).T)
    for (ref, het, alt), p in zip(counts, got, strict=True):
        n, rare = ref + het + alt, 2 * min(ref, alt) + het
        logs = {h: h * math.log(2) - sum(math.lgamma(x + 1) for x in ((rare - h) // 2, h, n - h - (rare - h) // 2)) for h in range(rare % 2, rare + 1, 2)}
        top = max(logs.values())
        want = sum(math.exp(v - top) for v in logs.values() if v <= logs[het] + 1e-9) / sum(math.exp(v - top) for v in logs.values()) if n else 1.0
        assert abs(p - min(1.0, want)) < 1e-9 * max(want, 1e-3), (ref, het, alt)
    large = np.array([[250_000, 500_000, 250_000], [250_000, 498_500, 251_500], [999_000, 998, 2], [900_000, 90_000, 10_000]])
    p = qc.hwe_batch(*large.T)
    assert p[0] == 1 and 0.001 < p[1] < 0.01 and p[2] > 1e-3 and p[3] < 1e-300
    many = np.random.default_rng(1).multinomial(500_000, [0.49, 0.42, 0.09], 2000)
    u = np.sort(qc.hwe_batch(*many.T))
    assert np.abs(u - (np.arange(2000) + 0.5) / 2000).max() < 0.05  # in equilibrium p is uniform


def test_distributions():
    assert abs(dist.chi2_1_sf(3.841458820694124) - 0.05) < 1e-12
    assert abs(dist.t_sf2(2.2281388519649385, 10) - 0.05) < 1e-10
    assert abs(dist.beta_pdf(0.1, 1, 25) - 25 * 0.9**24) < 1e-9


def test_normal_quantile(spark):
    ps = [0.0, 1e-8, 1.1e-7, 1e-5, 0.01, 0.0749, 0.0751, 0.3, 0.5, 0.9, 0.9251, 0.99999, 1 - 1.1e-7, 1 - 1e-9, 1.0, None]
    got = [r["q"] for r in spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double").select("i", dist.normal_quantile(F.col("p")).alias("q")).orderBy("i").collect()]
    assert got[-1] is None
    for p, q in zip(ps[:-1], got[:-1], strict=True):
        plain = -dist.CLIP if p <= 1e-7 else dist.CLIP if p >= 1 - 1e-7 else NormalDist().inv_cdf(p)
        assert abs(q - plain) < 1e-12


def test_mixture_tail():
    rng = np.random.default_rng(0)
    for w in ([1.0], [1.0, 1.0], [3.0, 1.0, 0.5, 0.1], [1.0] * 20):
        w = np.array(w)
        draws = (rng.normal(size=(200_000, len(w))) ** 2) @ w
        for q in np.quantile(draws, [0.3, 0.5, 0.9, 0.99, 0.999]):
            want = (draws > q).mean()
            assert abs(gene_test.mixture_tail(q, w) - want) < 0.03 * want + 4 * math.sqrt(want / 200_000)
    assert abs(gene_test.mixture_tail(60.0, np.array([1.0, 1.0])) / math.exp(-30) - 1) < 0.08


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(1)
    n, genes = 300, 6
    x = rng.normal(size=(n, 2))
    g = (rng.random((n, genes, 4)) < 0.04) * rng.integers(1, 3, (n, genes, 4))
    y = 0.5 + x @ [1.0, -0.4] + 1.5 * g[:, 0].sum(1) + rng.normal(size=n)
    yb = (y > np.quantile(y, 0.7)).astype(int)
    samples = spark.createDataFrame([(int(i), float(y[i]), int(yb[i]), float(x[i, 0]), float(x[i, 1])) for i in range(n)], "sample long, y double, yb int, x1 double, x2 double").repartition(3)
    rows = spark.createDataFrame([(int(i), f"g{j}", f"v{j}_{k}", float(g[i, j, k])) for i, j, k in zip(*np.nonzero(g), strict=True)], "sample long, gene string, marker string, value double")
    return n, x, g, y, yb, samples, rows


def test_score_and_ols(study):
    n, x, g, y, yb, samples, rows = study
    model = null_model.fit_linear(samples, "y", ["x1", "x2"])
    design = np.column_stack([np.ones(n), x])
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    r = y - design @ beta
    assert np.allclose(model.beta, beta) and abs(model.sigma2 - r @ r / (n - 3)) < 1e-9
    burdens = gene_test.collapse(rows)
    score = {s["gene"]: s for s in gene_test.score_test(burdens, model, samples).collect()}
    ols = {s["gene"]: s for s in gene_test.ols_test(burdens, model, samples).collect()}
    proj = np.eye(n) - design @ np.linalg.pinv(design)
    for j in range(g.shape[1]):
        b = g[:, j].sum(1).astype(float)
        u, v = b @ r, b @ proj @ b
        assert abs(score[f"g{j}"]["stat"] - u * u / (model.sigma2 * v)) < 1e-8 and abs(score[f"g{j}"]["beta"] - u / v) < 1e-9
        full = np.column_stack([b, design])
        coef, *_ = np.linalg.lstsq(full, y, rcond=None)
        e = y - full @ coef
        t = coef[0] / math.sqrt(e @ e / (n - 4) * np.linalg.inv(full.T @ full)[0, 0])
        assert abs(ols[f"g{j}"]["t"] - t) < 1e-7 and abs(ols[f"g{j}"]["pval"] - dist.t_sf2(abs(t), n - 4)) < 1e-9
    assert score["g0"]["pval"] < 1e-6


def test_logistic(study):
    n, x, g, y, yb, samples, rows = study
    model = null_model.fit(samples, "yb", ["x1", "x2"])
    assert model.logistic
    design = np.column_stack([np.ones(n), x])
    p = 1 / (1 + np.exp(-design @ model.beta))
    assert np.abs(design.T @ (yb - p)).max() < 1e-6
    w = p * (1 - p)
    inner = np.linalg.inv(design.T @ (w[:, None] * design))
    got = {s["gene"]: s for s in gene_test.score_test(gene_test.collapse(rows), model, samples).collect()}
    for j in range(g.shape[1]):
        b = g[:, j].sum(1).astype(float)
        c = design.T @ (w * b)
        assert abs(got[f"g{j}"]["stat"] - (b @ (yb - p)) ** 2 / (b @ (w * b) - c @ inner @ c)) < 1e-6 and got[f"g{j}"]["beta"] is None


def test_skat(study):
    n, x, g, y, yb, samples, rows = study
    model = null_model.fit_linear(samples, "y", ["x1", "x2"])
    design = np.column_stack([np.ones(n), x])
    proj = np.eye(n) - design @ np.linalg.pinv(design)
    r = proj @ y
    got = {s["gene"]: s for s in gene_test.skat(rows, model, samples).collect()}
    for j in range(g.shape[1]):
        z = g[:, j].astype(float)
        z = z[:, z.sum(0) > 0]
        q = float(((z.T @ r) ** 2).sum())
        assert abs(got[f"g{j}"]["q"] - q) < 1e-6 * max(1, q)
        want = gene_test.mixture_tail(q, np.linalg.eigvalsh(z.T @ proj @ z) * model.sigma2)
        assert abs(got[f"g{j}"]["pval"] - want) < 1e-6
    one = rows.where("marker like '%_0'")
    burden = {s["gene"]: s["pval"] for s in gene_test.score_test(gene_test.collapse(one), model, samples).collect()}
    assert all(abs(s["pval"] - burden[s["gene"]]) < 1e-9 for s in gene_test.skat(one, model, samples).collect())


def test_saddlepoint(spark):
    """Against the exact distribution of the score of few carriers among unbalanced classes, where the plain p is far off."""
    rng = np.random.default_rng(12)
    n = 600
    x = rng.normal(size=n)
    y = (rng.random(n) < 1 / (1 + np.exp(4.2 - 0.5 * x))).astype(int)
    cases, controls = np.flatnonzero(y), np.flatnonzero(y == 0)
    # gene -> its carriers and their burdens
    genes = {"few": ([*cases[:3], *controls[:4]], 1.0), "mixed": ([*cases[3:5], *controls[10:20]], 0.7), "none": (controls[30:42], 1.0), "many": ([*cases[:2], *controls[:150]], 1.0), "plain": ([*controls[200:203]], 1.0)}
    samples = spark.createDataFrame([(i, int(y[i]), float(x[i])) for i in range(n)], "sample int, y int, x double")
    burdens = spark.createDataFrame([(g, int(i), b + 0.1 * (k % 3)) for g, (some, b) in genes.items() for k, i in enumerate(some)], "gene string, sample int, b double")
    model = null_model.fit_logistic(samples, "y", ["x"])
    mu, design = 1 / (1 + np.exp(-(model.beta[0] + model.beta[1] * x))), np.column_stack([np.ones(n), x])
    plain = {r["gene"]: r for r in gene_test.score_test(burdens, model, samples).collect()}
    every = {r["gene"]: r for r in gene_test.saddlepoint_test(burdens, model, samples, 0.0).collect()}
    some = {r["gene"]: r for r in gene_test.saddlepoint_test(burdens, model, samples).collect()}
    assert every.keys() == plain.keys() == some.keys() and all(np.isclose(every[g]["stat"], plain[g]["stat"]) and every[g]["saddlepoint"] for g in plain)
    for g, r in some.items():
        assert r["saddlepoint"] == (r["stat"] > 4) and np.isclose(r["pval"], (every if r["saddlepoint"] else plain)[g]["pval"])
    off = {}
    for g in ("few", "mixed"):
        who, b = map(np.array, zip(*[(r["sample"], r["b"]) for r in burdens.where(F.col("gene") == g).collect()], strict=True))
        full = np.zeros(n)
        full[who] = b
        w = mu * (1 - mu)
        adjusted = full - design @ np.linalg.solve(design.T @ (w[:, None] * design), design.T @ (w * full))
        u = float((adjusted * (y - mu)).sum())
        # carriers one by one, the others in many draws
        sums, chance = np.zeros(1), np.ones(1)
        for i in who:
            sums, chance = np.concatenate([sums + adjusted[i] * (1 - mu[i]), sums - adjusted[i] * mu[i]]), np.concatenate([chance * mu[i], chance * (1 - mu[i])])
        others = np.setdiff1d(np.arange(n), who)
        rest = np.sqrt((w[others] * adjusted[others] ** 2).sum())
        noise = rest * np.array([NormalDist().inv_cdf((k + 0.5) / 200) for k in range(200)])
        want = sum(float(chance[np.abs(sums + e) >= abs(u)].sum()) for e in noise) / len(noise)
        # the score has few distinct values, so its smooth tail is right but for a part of the one observed
        assert abs(math.log(every[g]["pval"] / want)) < math.log(2)
        off[g] = want / plain[g]["pval"]
    assert off["few"] > 10
    with pytest.raises(ValueError, match="logistic"):
        gene_test.saddlepoint_test(burdens, null_model.fit_linear(samples, "y", ["x"]), samples)
    assert gene_test.saddlepoint_test(burdens.where("false"), model, samples).count() == 0


def test_many_covariates(spark):
    """Hundreds of covariates, ill-conditioned and repeated columns among them, against numpy."""
    rng = np.random.default_rng(21)
    n, k = 900, 300
    x = rng.normal(size=(n, k))
    x[:, 1] = x[:, 0] + 1e-6 * x[:, 1]  # nearly the same column
    x[:, 2] = 1e5 + 1e-2 * x[:, 2]  # nearly constant
    x[:, 3] = x[:, 4]  # the same column
    y = x[:, :3] @ [1.0, -2.0, 3.0] + rng.normal(size=n)
    yb = (rng.random(n) < 1 / (1 + np.exp(-x[:, 5]))).astype(float)
    names = [f"x{i}" for i in range(k)]
    samples = spark.createDataFrame([(i, float(y[i]), float(yb[i]), *map(float, x[i])) for i in range(n)], "sample int, y double, yb double, " + ", ".join(f"{c} double" for c in names)).repartition(5)
    design = np.column_stack([np.ones(n), x])
    scale = np.linalg.norm(design, axis=0)
    want = np.linalg.lstsq(design / scale, y, rcond=1e-13)[0] / scale
    model = null_model.fit_linear(samples, "y", names)
    # of equal columns only the sum of coefficients is defined
    rest = [i for i in range(k + 1) if i not in (4, 5)]
    assert np.allclose(np.array(model.beta)[rest], want[rest], rtol=1e-5, atol=1e-7) and np.isclose(model.beta[4] + model.beta[5], want[4] + want[5]) and model.n == n
    assert np.isclose(model.sigma2, ((y - design @ want) ** 2).sum() / (n - k - 1), rtol=1e-8)
    burdens = spark.createDataFrame([(f"g{j}", int(i), float(1 + i % 2)) for j in range(3) for i in rng.choice(n, 40 + 10 * j, replace=False)], "gene string, sample int, b double")
    full = {g: np.zeros(n) for g in ("g0", "g1", "g2")}
    for r in burdens.collect():
        full[r["gene"]][r["sample"]] = r["b"]
    keep = np.delete(design, 4, 1)
    base, _ = np.linalg.qr(keep / np.linalg.norm(keep, axis=0))
    for r in gene_test.score_test(burdens, model, samples).collect():
        b = full[r["gene"]] - base @ (base.T @ full[r["gene"]])
        assert np.isclose(r["beta"], b @ y / (b @ b), rtol=1e-6)
    some = names[5:25]
    fitted = null_model.fit_logistic(samples, "yb", some)
    d, beta = np.column_stack([np.ones(n), x[:, 5:25]]), np.zeros(21)
    for _ in range(30):
        mu = 1 / (1 + np.exp(-d @ beta))
        beta += np.linalg.solve(d.T @ (d * (mu * (1 - mu))[:, None]), d.T @ (yb - mu))
    assert np.allclose(fitted.beta, beta, atol=1e-6)
    w = mu * (1 - mu)
    for r in gene_test.score_test(burdens, fitted, samples).collect():
        b = full[r["gene"]]
        v = b @ (w * b) - (d.T @ (w * b)) @ np.linalg.solve(d.T @ (d * w[:, None]), d.T @ (w * b))
        assert np.isclose(r["stat"], (b @ (yb - mu)) ** 2 / v)
    m, count = null_model.products(samples, null_model.design(some))
    assert count == n and np.allclose(m, d.T @ d)


def test_mixture_against_published_values():
    """Imhof's (1961) tails of 0.6, 0.3 and 0.1 chi-squared(1), and exact ones of chi-squared with an even number of degrees."""
    for q, want in ((0.1, 0.9458), (0.7, 0.5064), (2.0, 0.1240)):
        assert abs(mixture.mixture_tail(q, np.array([0.6, 0.3, 0.1])) - want) < 5e-5
    for q, d in ((3.0, 6), (20.0, 20), (45.0, 20)):
        want = math.exp(-q / 2) * sum((q / 2) ** i / math.factorial(i) for i in range(d // 2))
        assert abs(mixture.mixture_tail(q, np.ones(d)) / want - 1) < 1e-7
        assert abs(mixture.mixture_tail(q, np.array([1.0]), np.array([float(d)])) / want - 1) < 1e-7
    w, draws = np.array([3.0, 1.0, 0.5, 0.1]), np.random.default_rng(0).normal(size=(400_000, 4)) ** 2
    for q in (2.0, 8.0, 20.0):
        want = (draws @ w > q).mean()
        assert abs(mixture.mixture_tail(q, w) - want) < 4 * math.sqrt(want / 400_000)


def test_skat_without_a_gene_matrix(spark, monkeypatch):
    """Traces, whole spectra of genes that the blocks exhaust, leading values and p-values of larger ones, in several waves."""
    rng = np.random.default_rng(4)
    n, sizes = 250, {"a": 12, "b": 40, "c": 160}
    x, parts = rng.normal(size=(n, 1)), {g: (rng.random((n, m)) < 0.03) * rng.uniform(0.2, 2, m) for g, m in sizes.items()}
    parts["c"][:30, :20] += 1.5  # a few large eigenvalues
    y = x[:, 0] + parts["b"].sum(1) + rng.normal(size=n)
    samples = spark.createDataFrame([(i, float(y[i]), float(x[i, 0])) for i in range(n)], "sample long, y double, x double")
    rows = spark.createDataFrame([(int(i), g, f"v{k}", float(z[i, k])) for g, z in parts.items() for i, k in zip(*np.nonzero(z), strict=True)], "sample long, gene string, marker string, value double").repartition(3)
    model = null_model.fit_linear(samples, "y", ["x"])
    design = np.column_stack([np.ones(n), x])
    proj = np.eye(n) - design @ np.linalg.pinv(design)
    values = {g: np.linalg.eigvalsh(z.T @ proj @ z)[::-1] for g, z in parts.items()}
    traces = {r["gene"]: r for r in gene_test.skat_moments(rows, model, samples).collect()}
    assert all(np.isclose(traces[g]["trace"], v.sum()) and np.isclose(traces[g]["trace2"], (v**2).sum()) for g, v in values.items())
    monkeypatch.setattr(spectrum, "WAVE", 2)
    dense = {r["gene"]: r for r in gene_test.skat(rows, model, samples).collect()}
    free = {r["gene"]: r for r in gene_test.skat(rows, model, samples, dense=20, block=8, steps=6).collect()}
    assert free.keys() == dense.keys() and all(np.isclose(free[g]["q"], dense[g]["q"]) and free[g]["n_markers"] == dense[g]["n_markers"] for g in dense)
    assert free["a"]["pval"] == dense["a"]["pval"] and abs(free["b"]["pval"] - dense["b"]["pval"]) < 1e-6 and abs(free["c"]["pval"] - dense["c"]["pval"]) < 0.01 * dense["c"]["pval"]
    z, single = gene_test.skat_rows(rows.where("gene = 'c'"), model, samples)
    leading, rest, degrees = spectrum.lanczos(z, single, model, 8, 6)["c"]
    assert len(leading) and np.allclose(np.sort(leading)[::-1], values["c"][: len(leading)], rtol=1e-6)
    assert 0.5 < (degrees * rest).sum() / (values["c"].sum() - leading.sum()) < 2


def test_conditional(study):
    n, x, g, y, yb, samples, rows = study
    burdens = gene_test.collapse(rows.where("marker not like '%_3'"))
    common = rows.where("marker like '%_3'")
    got = {s["gene"]: s for s in gene_test.conditional_test(burdens, common, samples, "y", ["x1", "x2"]).collect()}
    for j in range(g.shape[1]):
        design = np.column_stack([np.ones(n), x, g[:, j, 3]]).astype(float)
        proj = np.eye(n) - design @ np.linalg.pinv(design)
        b, r = g[:, j, :3].sum(1).astype(float), proj @ y
        want = (b @ r) ** 2 / (r @ r / (n - 4) * (b @ proj @ b))
        assert abs(got[f"g{j}"]["stat"] - want) < 1e-6


def test_conditional_by_conjugate_gradients(study):
    """Genes beyond the bound, by steps over their calls, against the dense form; markers of very different frequency and a gene without a burden among them."""
    n, x, g, y, yb, samples, rows = study
    burdens = gene_test.collapse(rows.where("marker not like '%_3' and gene <> 'g5'"))
    few = rows.where("marker like '%_3'")
    others = rows.where("gene in ('g2', 'g3', 'g5')").selectExpr("sample", "'g1' gene", "concat('o', marker) marker", "value * 3 value")
    conditioning = few.unionByName(others).unionByName(rows.where("gene = 'g4'").selectExpr("sample", "'g5' gene", "marker", "value"))
    dense = {r["gene"]: r for r in gene_test.conditional_test(burdens, conditioning, samples, "y", ["x1", "x2"]).collect()}
    steps = {r["gene"]: r for r in gene_test.conditional_test(burdens, conditioning, samples, "y", ["x1", "x2"], dense=2).collect()}
    assert dense.keys() == steps.keys() and "g5" not in dense
    assert all(np.isclose(dense[k][c], steps[k][c], rtol=1e-6) for k in dense for c in ("beta", "stat", "pval"))


def test_null_calibration(spark, study):
    """Genes without an effect have p-values that aren't small more often than by chance."""
    n, x, g, y, yb, samples, rows = study
    rng = np.random.default_rng(9)
    b = spark.createDataFrame([(int(i), f"n{j}", 1.0) for j in range(200) for i in rng.choice(n, 12, replace=False)], "sample long, gene string, b double")
    model = null_model.fit_linear(samples, "y", ["x1", "x2"])
    p = np.array([r["pval"] for r in gene_test.score_test(b, model, samples).collect()])
    assert abs((p < 0.1).mean() - 0.1) < 0.07 and abs(p.mean() - 0.5) < 0.08


def test_permutations(spark, study):
    """Two hundred permutations in one pass: each one is ``permute``'s; under the null empirical p-values are uniform and statistics calibrated."""
    rng = np.random.default_rng(31)
    n = 240
    samples = spark.createDataFrame([(i, float(rng.normal()), float(rng.normal())) for i in range(n)], "sample int, y double, x double")
    model = null_model.fit_linear(samples, "y", ["x"])
    burdens = spark.createDataFrame([(f"g{j}", int(i), 1.0) for j in range(40) for i in rng.choice(n, 25, replace=False)], "gene string, sample int, b double").repartition(3)
    got = {r["gene"]: r for r in gene_test.permutation_test(burdens, model, samples, 200, 3).collect()}
    plain = {r["gene"]: r for r in gene_test.score_test(burdens, model, samples).collect()}
    assert got.keys() == plain.keys() and all(np.isclose(r["stat"], plain[g]["stat"]) for g, r in got.items())
    p = np.sort([r["pval_empirical"] for r in got.values()])
    assert np.abs(p - (np.arange(40) + 0.5) / 40).max() < 0.25 and max(abs(r["pval_empirical"] - plain[g]["pval"]) for g, r in got.items()) < 0.15
    assert abs(np.mean([r["null_mean"] for r in got.values()]) - 1) < 0.1
    many = {r["sample"]: r["values"] for r in transform.permuted_many(samples, "y", "sample", 3, 5).collect()}
    for k in range(3):
        one = {r["sample"]: r["y"] for r in transform.permute(samples.select("sample", "y"), "y", "sample", 5 + k).collect()}
        assert all(many[i][k + 1] == v for i, v in one.items())
    assert gene_test.permutation_test(burdens, model, samples, 0).count() == 40


def test_constant_burden_is_left_out(spark, study):
    samples = study[5]
    model = null_model.fit_linear(samples, "y", ["x1", "x2"])
    constant = samples.select("sample", F.lit("flat").alias("gene"), F.lit(2.0).alias("b"))
    assert gene_test.score_test(constant, model, samples).count() == 0


def test_quantile_transform(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([3.0, 1.0, 2.0, 2.0, None, 5.0])], "id int, y double")
    got = {r["id"]: r["y"] for r in transform.quantile_transform(df, "y").collect()}
    assert got[4] is None and got[1] == -dist.CLIP and got[5] == dist.CLIP
    assert abs(got[2] - NormalDist().inv_cdf((1 / 4 + 2 / 4) / 2)) < 1e-12 and got[2] == got[3] and abs(got[0] - NormalDist().inv_cdf(3 / 4)) < 1e-12


def test_transform_y_leaves_binary(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 1.0)], "id int, y double")
    assert sorted(r["y"] for r in transform.transform_y(df, "y", "standardize").collect()) == [0, 1, 1]
    with pytest.raises(ValueError):
        transform.transform_y(df.withColumn("y", F.col("id") * 1.5), "y", "other")


def test_corrections(spark):
    p = [0.01, 0.04, 0.03, 0.5, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, pval double")
    got = {r["i"]: r for r in multitest.correct(df, "FDR", 0.05).collect()}
    assert [round(got[i]["pval_corrected"], 10) for i in range(4)] == [0.04, 0.0533333333, 0.0533333333, 0.5]
    assert got[0]["significant"] and not got[4]["significant"]
    with pytest.raises(ValueError):
        multitest.correct(df, "none")
    one = spark.createDataFrame([("a", 1e-20), ("a", 0.5)], "g string, pval double")
    assert abs(multitest.combine(one, ["g"], "cct").first()["pval"] / 2e-20 - 1) < 1e-6


def test_ranged_corrections(spark, monkeypatch):
    """Ranks by ranges give what windows give, with ties, nulls and groups; no task sees all rows."""
    rng = np.random.default_rng(2)
    rows = [(i, None if i % 17 == 0 else float(min(1.0, rng.integers(1, 40) / 40) ** 3), None if i % 5 == 0 else f"m{i % 3}") for i in range(500)]
    df = spark.createDataFrame(rows, "k int, pval double, method string").repartition(3)
    monkeypatch.setattr(multitest, "RANGES", 7)
    for group in (None, ["method"]):
        plain = {r["k"]: r for r in multitest.fdr(df, 0.3, group).collect()}
        ranged = multitest.fdr(df, 0.3, group, ranged=True)
        assert set(ranged.columns) == {*df.columns, "pval_corrected", "significant"}
        found = {r["k"]: r for r in ranged.collect()}
        assert found.keys() == plain.keys()
        for k, r in plain.items():
            assert (r["pval_corrected"] is None) == (found[k]["pval_corrected"] is None) and (r["pval_corrected"] is None or np.isclose(r["pval_corrected"], found[k]["pval_corrected"])) and r["significant"] == found[k]["significant"]
    some = df.where("pval is not null")
    for group in (None, ["method"]):
        expected = [sorted(r["expected"] for r in multitest.qq_points(some, group, ranged=x).collect()) for x in (False, True)]
        assert np.allclose(*expected)
    assert multitest.fdr(df.where("false"), ranged=True).count() == 0
    placed = multitest.ranks(df, [], "pval")
    assert placed.select("_part").distinct().count() > 3
    plan = multitest.fdr(df, ranged=True)._jdf.queryExecution().executedPlan().toString()
    single = [x for x in plan.split("\n") if "SinglePartition" in x]
    assert "Window" in plan and len(single) <= 2  # the counts of ranges, a row each


def test_crowded_exons(spark):
    """Overlapping, nested and reversed exons, those beyond a bin, and the distance from each end, against all pairs."""
    rng = np.random.default_rng(9)
    exons = [(f"g{i % 3}", int(s), int(s + rng.integers(-20, 900))) for i, s in enumerate(rng.integers(0, 30_000, 120))] + [("g0", 5_000, 19_000), ("g1", None, 4)]
    variants = [(i, f"g{i % 4}", int(p)) for i, p in enumerate(rng.integers(-300, 33_000, 3000))] + [(9000, None, 5), (9001, "g0", None)]
    e, v = spark.createDataFrame(exons, "gene_id string, start long, end long"), spark.createDataFrame(variants, "id int, gene_id string, pos long")
    for dist in (0, 15, 300):
        got = {r["id"] for r in annotate.near_exons(v, e, dist, bin_size=1000).collect()}
        assert got == {i for i, g, p in variants if g and p is not None and any(g == h and (abs(p - b) <= dist or a is not None and (a <= p <= b or abs(p - a) <= dist)) for h, a, b in exons)}
    crowded = spark.range(100_000).selectExpr("'g' gene_id", "id % 5000 start", "id % 5000 + 40 end")
    assert annotate.islands(crowded, 10).count() == 1


def test_exons(spark):
    v = spark.createDataFrame([(1, 100, "g"), (2, 401, "g"), (3, 800, "g"), (4, 100, "h")], "id int, pos long, gene_id string")
    e = spark.createDataFrame([(50, 150, "g"), (60, 101, "g")], "start long, end long, gene_id string")
    assert sorted(r["id"] for r in annotate.near_exons(v, e, 300).collect()) == [1, 2]
    assert annotate.near_exons(v, e, keep_unmatched=True).count() == 4
    with pytest.raises(checks.CheckFailed):
        annotate.near_exons(v.where("gene_id = 'h'"), e)


def test_components(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double, e double")
    params, comps = annotate.fit_components(df, list("abcde"), 2)
    z = (x - x.mean(0)) / x.std(0)
    _, _, vt = np.linalg.svd(z, full_matrices=False)
    for got, want in zip(comps, vt, strict=False):
        assert min(np.abs(np.array(got) - want).max(), np.abs(np.array(got) + want).max()) < 1e-8
    out = annotate.project(df, params, comps).toPandas().to_numpy()
    assert np.allclose(np.sort(out[:, 0]), np.sort(z @ np.array(comps[0])))


def test_wide_components(spark):
    """Hundreds of columns with large means, nulls and a constant, against numpy; both forms of the projection agree."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 240)) + 0.1 * rng.normal(size=(300, 240)) + 1e6
    x[:, 7] = 3.0
    rows = [(i, *(None if (i + j) % 97 == 0 else float(v) for j, v in enumerate(r))) for i, r in enumerate(x)]
    columns = [f"c{j}" for j in range(240)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in columns)).repartition(5)
    x = np.array([[v or 0.0 for v in r[1:]] for r in rows])
    params, comps, covariance = annotate.component_analysis(df, columns, 6)
    assert np.allclose(covariance, np.cov(x.T, ddof=0), rtol=1e-8, atol=1e-3)
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    _, values, vt = np.linalg.svd(z, full_matrices=False)
    assert all(1 - abs(np.array(got) @ want) < 1e-8 for got, want in zip(comps[:4], vt, strict=False))
    few = annotate.project(df, params, comps[:4]).orderBy("id").toPandas().to_numpy()
    many = annotate.project(df, params, comps).orderBy("id").toPandas().to_numpy()
    assert len(columns) * 6 > annotate.MOST_TERMS >= len(columns) * 4 and np.allclose(few, many[:, :5]) and np.allclose(many[:, 1:], z @ np.array(comps).T, atol=1e-6)
    with pytest.raises(ValueError, match="columns"):
        annotate.fit_components(df, columns * 20, 2)
    none = annotate.fit_components(df.where("false"), columns, 2)
    assert annotate.project(df.where("false"), *none).count() == 0


def test_scalar(spark):
    df = spark.createDataFrame([("G|0.1|-|nan|0.7|9", "0/1", "missense_variant,stop_gained", "ENSG1.12", "acgN"), ("G|-|-|nan|-|9", "./1", "x", "ENSG2", "TTTT")], "s string, gt string, c string, g string, q string")
    flags = scalar.consequence_flags("c", ["stop_gained"])
    rows = df.select(scalar.splice_delta("s").alias("d"), scalar.dosage("gt").alias("gt"), *[c.alias(n) for n, c in flags.items()], scalar.strip_version("g").alias("g"), scalar.one_hot("q").alias("h"), scalar.substituted("q", F.lit("C"), F.lit("-")).alias("u")).collect()
    assert [r["d"] for r in rows] == [0.7, None] and [r["gt"] for r in rows] == [1, None]
    assert [r["Consequence_stop_gained"] for r in rows] == [1.0, 0.0] and rows[0]["g"] == "ENSG1"
    assert rows[0]["h"] == [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 0]] and rows[0]["u"] == "acCN"


def test_deepset(spark):
    rows = [(1, "g", 1, 0.5, 1.0), (1, "g", 2, -0.2, 0.0), (2, "g", 1, 0.1, 0.3), (2, "h", 1, 0.9, -1.0)]
    df = spark.createDataFrame(rows, "sample int, gene string, gt int, a double, b double")
    for pool, pad in (("max", 0), ("sum", 0), ("sum", 5)):
        net = deepset.random_network(2, seed=4, pool=pool, pad_to=pad, negate=True)
        got = {(r["sample"], r["gene"]): r["burden"] for r in deepset.score(df, ["a", "b"], {0: net}).collect()}
        for key in {(r[0], r[1]) for r in rows}:
            x = [r[3:] for r in rows if (r[0], r[1]) == key for _ in range(r[2])]
            x = np.array(x + [(0.0, 0.0)] * (1 if pool == "max" else max(0, pad - len(x))))
            h = net.embed(x)
            want = net.finish((h.max(0) if pool == "max" else h.sum(0))[None])[0]
            assert abs(got[key] - want) < 1e-12
    grid = deepset.dense(deepset.score(df, ["a", "b"], {0: net}), df, df, {0: net})
    assert grid.count() == 4 and abs(grid.where("sample = 1 and gene = 'h'").first()["burden"] - net.empty_score()) < 1e-12


@pytest.mark.parametrize("pool", ["max", "sum"])
@pytest.mark.parametrize("loss", ["mse", "bce"])
def test_gradients(pool, loss):
    """Finite differences of the mean loss of two phenotypes, one with a missing value, over every weight."""
    rng = np.random.default_rng(0)
    net = deepset.random_network(2, hidden=4, wide=3, seed=1, pool=pool, pad_to=3, sigmoid=pool == "max", negate=pool == "sum")
    heads = training.Heads.start(["a", "b"], ["g", "h", "i"], ["c"], seed=2)
    heads.effects[:], heads.bias[:] = 0.3, [0.2, -0.1]
    sample, gene, gt = np.array([0, 0, 0, 1, 2, 2, 3]), np.array([0, 0, 2, 1, 0, 1, -1]), np.array([1, 2, 1, 2, 1, 1, 0.0])
    x, y, c = rng.normal(size=(7, 2)), rng.integers(0, 2, (4, 2)).astype(float)[sample], rng.normal(size=(4, 1))[sample]
    y[sample == 2, 1] = np.nan
    sizes = np.array([4.0, 3.0])

    def mean():
        sums, counts, _ = training.step(net, heads, sample, gene, gt, x, y, c, loss, None)
        assert counts.tolist() == sizes.tolist()
        return float((sums / counts).mean())

    gradient, at = training.step(net, heads, sample, gene, gt, x, y, c, loss, sizes)[2], 0
    for _, a in training.arrays(net, heads):
        for i in np.ndindex(a.shape):
            a[i] += 1e-6
            up = mean()
            a[i] -= 2e-6
            down = mean()
            a[i] += 1e-6
            assert abs((up - down) / 2e-6 - gradient[at]) < 1e-6
            at += 1
    assert at == len(gradient)


def test_training(spark):
    """The same fit for 1 and 8 partitions; a signal is learned by both pools; frozen parts, early stopping, and predictions."""
    rng = np.random.default_rng(3)
    calls = [(s, f"g{g}", 1, float(rng.normal()), float(rng.normal())) for s in range(120) for g in rng.choice(4, rng.integers(0, 4), replace=False) for _ in range(2)]
    effect = {s: 0.0 for s in range(120)}
    for s, g, _, a, _ in calls:
        effect[s] += max(a, 0.0) if g in ("g0", "g1") else 0.0
    rows = spark.createDataFrame(calls, "sample int, gene string, gt int, a double, b double")
    people = spark.createDataFrame([(s, 0.5 * e + 0.2 * (s % 3), None if s % 10 == 0 else float(e > 1), float(s % 3)) for s, e in effect.items()], "sample int, y double, z double, c double")
    start = training.Heads.start(["y", "z"], training.genes_of(rows), ["c"], seed=1)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    for pool in ("max", "sum"):
        net, found = deepset.random_network(2, hidden=4, wide=3, seed=1, pool=pool, sigmoid=False), []
        for parts in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found.append(training.fit(rows.repartition(int(parts)), people, ["a", "b"], net, start, epochs=6, batches=2, rate=0.05))
        spark.conf.set("spark.sql.shuffle.partitions", old)
        one, eight = found
        assert all(np.allclose(a, b, rtol=1e-6, atol=1e-9) for (_, a), (_, b) in zip(training.arrays(*one[:2]), training.arrays(*eight[:2]), strict=True))
        history = one[2]
        assert history[-1]["train_loss"] < 0.7 * history[0]["train_loss"] and min(h["val_loss"] for h in history) < history[0]["val_loss"]
    net, heads, history = one
    predicted = {(r["sample"], r["phenotype"]): r["prediction"] for r in training.predict(rows, people, ["a", "b"], net, heads).collect()}
    truth = {(r["sample"], p): r[p] for r in people.collect() for p in "yz"}
    checked = {r["sample"] for r in people.where(training.dealt("split 0", 5) == 0).collect()}
    loss = np.mean([np.mean([(predicted[k] - v) ** 2 for k, v in truth.items() if k[1] == p and k[0] in checked and v is not None]) for p in "yz"])
    assert len(predicted) == 240 and np.isclose(loss, min(h["val_loss"] for h in history))
    linear = training.linear_network([0.1, -0.1], pool="sum")
    for frozen in ((), ("phi",)):
        net, heads, history = training.fit(rows, people, ["a", "b"], linear, start, epochs=2, frozen=frozen, rate=0.05)
        assert np.array_equal(net.phi[0][0], linear.phi[0][0]) == bool(frozen) and history[-1]["train_loss"] < history[0]["train_loss"]
    *_, history = training.fit(rows, people, ["a", "b"], linear, start, epochs=9, rate=50.0, patience=2)
    assert len(history) < 10 and min(range(len(history)), key=lambda i: history[i]["val_loss"]) == len(history) - 3
    *_, history = training.fit(rows.where("false"), people.where("false"), ["a", "b"], linear, start, epochs=1)
    assert history[0] == {"epoch": 0, "train_loss": None, "val_loss": None}


def test_samples_stay_whole():
    """A sample's rows come together whatever the batches are."""
    import pyarrow as pa

    ids = [0] * 3 + [1] * 8 + [2] + [3] * 2
    for size in (1, 2, 3, 5, 20):
        batches = [pa.RecordBatch.from_arrays([pa.array(ids[i : i + size])], ["s"]) for i in range(0, len(ids), size)]
        tables = [t.column(0).to_pylist() for t in deepset.whole_groups(iter(batches))]
        assert sum(tables, []) == ids and all(a[-1] != b[0] for a, b in zip(tables, tables[1:], strict=False))


def test_seed_genes(spark):
    df = spark.createDataFrame([("a", 1e-6, 60.0), ("a", 0.5, 60.0), ("b", 0.3, 10.0), ("c", 0.2, 70.0), ("d", 0.9, 80.0)], "gene string, pval double, EAC double")
    assert sorted(r["gene"] for r in evaluate.seed_genes(df).collect()) == ["a", "b", "c"]
    assert sorted(r["gene"] for r in evaluate.seed_genes(df, min_eac=50).collect()) == ["a", "c", "d"]
    assert [r["gene"] for r in evaluate.seed_genes(df, most=1).collect()] == ["a"]
    assert [r["gene"] for r in evaluate.seed_genes(df, least=1, below=0.5).collect()] == ["a"]


def test_results(spark):
    df = spark.createDataFrame([("p", "a", 1e-5, "repeat_0"), ("p", "b", 0.4, "repeat_0"), ("p", "a", 0.9, "repeat_1")], "phenotype string, gene string, pval double, model string")
    significant, every = evaluate.process_results(df, repeats=[0])
    assert [r["gene"] for r in significant.collect()] == ["a"] and every.count() == 2
    assert evaluate.process_results(df, repeats=[1])[1].count() == 1
    with pytest.raises(checks.CheckFailed):
        evaluate.process_results(df)
    base = spark.createDataFrame([("p", "a", 1e-6, "burden", "Baseline"), ("p", "a", 1e-7, "burden", "Baseline"), ("p", "c", 0.5, "burden", "Baseline")], "phenotype string, gene string, pval double, Method string, `Discovery type` string")
    rows = [(r["gene"], r["Method"], r["pval"]) for r in evaluate.process_results(df.where("model = 'repeat_0'"), [base], correction="Bonferroni")[0].collect()]
    assert rows == [("a", "burden", 1e-7), ("a", "combined baseline", 2e-7), ("a", "network", 1e-5)]


def test_bags(spark):
    s = spark.createDataFrame([(i, i % 4 == 0) for i in range(400)], "sample int, y boolean")
    train, held = evaluate.bagged(s, 0.7, 1)
    assert train.count() + held.count() == 400 and 230 < train.count() < 330 and train.join(held, "sample").count() == 0
    assert train.exceptAll(evaluate.bagged(s.repartition(5), 0.7, 1)[0]).count() == 0
    up = {r["y"]: r["count"] for r in evaluate.upsampled(s, "y").groupBy("y").count().collect()}
    assert up[True] == up[False] == 300


def test_bag_with_replacement(spark):
    """The same bag however rows are dealt; its size is exact, and counts are those of a multinomial."""
    samples = spark.range(900).withColumnRenamed("id", "sample")
    bags = [evaluate.bagged(samples.repartition(n), 1.5, 4, replace=True) for n in (1, 8)]
    rows = [sorted(r["sample"] for r in train.collect()) for train, _ in bags]
    assert rows[0] == rows[1] and len(rows[0]) == 1350
    held = {r["sample"] for r in bags[0][1].collect()}
    assert held == set(range(900)) - set(rows[0]) and abs(len(held) / 900 - math.exp(-1.5)) < 0.05
    counts = np.bincount(rows[0], minlength=900)
    assert abs(counts.var() - 1.5) < 0.3
    assert evaluate.bagged(samples.where("sample < 0"), 1.5, 4, replace=True)[0].count() == 0


def test_masks(spark):
    df = spark.createDataFrame([(1, 1e-4, 0.9), (2, 0.1, 0.95), (3, None, 0.99)], "id int, MAF double, cadd double")
    assert [r["id"] for r in df.where(masks.thresholds(["MAF < 1e-3", "cadd > 0.5"])).collect()] == [1]
    with pytest.raises(ValueError):
        masks.variant_type("other")
    genes = spark.createDataFrame([(1, ["a", "a", "b"]), (2, []), (3, None)], "id int, gene_ids array<string>")
    assert sorted((r["id"], r["gene"]) for r in masks.explode_genes(genes).collect()) == [(1, "a"), (1, "b")]


def test_order_and_partitions_do_not_matter(study):
    samples, rows = study[5], study[6]
    model = null_model.fit_linear(samples, "y", ["x1", "x2"])
    one = {r["gene"]: r["stat"] for r in gene_test.score_test(gene_test.collapse(rows), model, samples).collect()}
    two = {r["gene"]: r["stat"] for r in gene_test.score_test(gene_test.collapse(rows.repartition(13, "marker").orderBy(F.rand(1))), model, samples.coalesce(1)).collect()}
    assert all(abs(one[k] - two[k]) < 1e-9 * max(1, abs(one[k])) for k in one)


def test_logistic_codes_all_levels(spark, data, monkeypatch):
    from locusloom.plans import queries

    people = queries.study.samples(spark, data).withColumn("segment", F.concat(F.lit("s"), F.col("sample") % 70))
    seen = []
    monkeypatch.setattr(queries.study, "samples", lambda *_: people)
    monkeypatch.setattr(queries.null_model, "fit", lambda coded, y, x: seen.extend(x))
    monkeypatch.setattr(queries.gene_test, "score_test", lambda *_: None)
    queries.gene_logistic(spark, data)
    assert len(seen) == 70 and len(set(seen)) == 70
    with pytest.raises(ValueError, match="more than 69 levels"):
        transform.levels(people, "segment", 69)


def test_skat_statistic_gathers_no_gene(spark, data, study):
    from locusloom.plans import queries

    plan = queries.gene_skat_statistic(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "CoGroup" not in plan
    *_, samples, rows = study
    model = null_model.fit_linear(samples, "y", ["x1", "x2"])
    whole = {r["gene"]: r for r in gene_test.skat(rows, model, samples).collect()}
    sums = gene_test.skat_statistic(rows, model, samples).collect()
    assert {r["gene"] for r in sums} == whole.keys()
    assert all(abs(r["q"] - whole[r["gene"]]["q"]) < 1e-6 * max(1, r["q"]) and r["n_markers"] == whole[r["gene"]]["n_markers"] for r in sums)


def test_logistic_separable_and_plain(spark):
    """Classes that can be told apart by x have no finite fit: the steps end, and the model says so."""
    apart = spark.createDataFrame([(i, float(i), int(i >= 10)) for i in range(20)], "sample int, x double, y int")
    model = null_model.fit_logistic(apart, "y", ["x"])
    assert not model.converged and np.isfinite(model.beta).all()
    assert all(np.isfinite(r["r"]) for r in model.frame(apart).collect())
    rng = np.random.default_rng(3)
    x = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-(0.4 + 1.3 * x)))).astype(int)
    mixed = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "sample int, x double, y int")
    fitted = null_model.fit_logistic(mixed, "y", ["x"])
    beta, d = np.zeros(2), np.column_stack([np.ones(300), x])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-d @ beta))
        beta = beta + np.linalg.solve(d.T @ (d * (mu * (1 - mu))[:, None]), d.T @ (y - mu))
    assert fitted.converged and np.allclose(fitted.beta, beta, atol=1e-6)


def test_constant_targets_and_no_samples(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 2.0), ("b", 1.0, 1.0), ("b", 3.0, 2.0)], "k string, p double, y double")
    got = {r["k"]: r["r_squared"] for r in metrics.r_squared(df, ["k"]).collect()}
    assert got["a"] is None and got["b"] == 1 - 1.0 / 0.5
    calls = spark.createDataFrame([], "variant_id int, gt int")
    variants = spark.createDataFrame([(1,)], "id int")
    assert genotype.allele_frequency(calls, variants, 0).first()["af"] is None
    rows = spark.createDataFrame([("g", 1)], "gene string, gt int")
    assert gene_test.expected_allele_count(rows, 0, 0).first()["eac"] is None


def test_upsampled_is_exact(spark):
    s = spark.createDataFrame([(i, i % 3 == 0) for i in range(100)] + [(200, None)], "sample int, y boolean")
    rows = evaluate.upsampled(s, "y").collect()
    few = [r["sample"] for r in rows if r["y"]]
    assert len(few) == 66 and sum(r["y"] is False for r in rows) == 66 and sum(r["y"] is None for r in rows) == 1
    assert {few.count(i) for i in set(few)} <= {1, 2} and len(set(few)) == 34


def test_chunks(spark, tmp_path):
    from locusloom.sources import sinks

    rows = spark.createDataFrame([(c, i, f"{c}-{i}") for c, n in ((1, 2), (0, 3), (2, 1)) for i in range(n)], "chunk int, index int, name string")
    assert [r["name"] for r in sinks.combined_chunks(rows, 3).orderBy("row").collect()] == ["0-0", "0-1", "0-2", "1-0", "1-1", "2-0"]
    for bad, n in ((rows, 2), (rows, 4), (rows.where("chunk <> 1"), 3), (rows.where("name <> '0-1'"), 3), (rows.union(rows), 3)):
        with pytest.raises(checks.CheckFailed):
            sinks.combined_chunks(bad, n)
    sinks.written_chunks(rows, f"{tmp_path}/whole", 3)
    with pytest.raises(Exception, match="exists"):
        sinks.written_chunks(rows, f"{tmp_path}/whole", 3)
    sinks.written_chunks(rows.where("chunk < 1"), f"{tmp_path}/whole", 1, overwrite=True)
    assert spark.read.parquet(f"{tmp_path}/whole").count() == 3


def test_labelled_results(spark, tmp_path):
    from locusloom.sources import readers

    for kind, test in (("plof", "skat"), ("missense", "burden")):
        spark.createDataFrame([("g", 0.5)], "gene string, pval double").write.parquet(f"{tmp_path}/{kind}/{test}/eval/results.parquet")
    paths = [f"{tmp_path}/plof/skat/eval/results.parquet", f"{tmp_path}/missense/burden/eval/results.parquet"]
    assert sorted(r["method"] for r in readers.labelled_results(spark, paths).collect()) == ["missense-burden", "plof-skat"]
    spark.createDataFrame([("g", 0.5, 1)], "gene string, pval double, more int").write.parquet(f"{tmp_path}/a/b/eval/results.parquet")
    with pytest.raises(ValueError, match="more"):
        readers.labelled_results(spark, [*paths, f"{tmp_path}/a/b/eval/results.parquet"])


def test_folds_hold_the_same_samples(spark):
    x = spark.createDataFrame([(i, float(i)) for i in range(4)], "sample int, x double")
    y = spark.createDataFrame([(i, 2.0 * i) for i in range(4)], "sample int, y double")
    assert evaluate.combine_folds([[x.where("sample < 2"), y.where("sample < 2")], [x.where("sample >= 2"), y.where("sample >= 2")]], ["x"], "y").count() == 4
    for bad in ([x, y.where("sample > 0")], [x, y.union(y)]):
        with pytest.raises(checks.CheckFailed):
            evaluate.combine_folds([bad], ["x"], "y")
    with pytest.raises(checks.CheckFailed):
        evaluate.combine_folds([[x, y], [x, y]], ["x"], "y")


def test_seed_tests(spark):
    """Against the single tests, with a weight bound, a bound on markers and homozygous calls counted once."""
    rng = np.random.default_rng(8)
    people = spark.createDataFrame([(i, float(rng.normal())) for i in range(120)], "sample int, y double")
    calls = [(int(s), f"g{v % 2}", v, int(rng.integers(1, 3)), 0.2 + 0.1 * (v % 7)) for v in range(20) for s in rng.choice(120, 6, replace=False)]
    rows = spark.createDataFrame(calls, "sample int, gene string, variant_id int, gt int, weight double")
    model = null_model.fit_linear(people, "y", [])
    got = {(r["gene"], r["ttype"]): r for r in gene_test.seed_tests(rows, model, people, {"all": F.lit(True)}, 0.35, 3, homozygotes_once=True, collapse_method="max").collect()}
    chosen = rows.where("weight >= 0.35").withColumn("value", F.sqrt("weight"))
    burden = {r["gene"]: r for r in gene_test.score_test(gene_test.collapse(chosen, "max"), model, people).collect()}
    skat = {r["gene"]: r for r in gene_test.skat(gene_test.collapse_ultra_rare(chosen, 3), model, people).collect()}
    for g in ("g0", "g1"):
        assert np.isclose(got[g, "burden"]["stat"], burden[g]["stat"]) and np.isclose(got[g, "burden"]["pval"], burden[g]["pval"])
        assert np.isclose(got[g, "skat"]["stat"], skat[g]["q"]) and np.isclose(got[g, "skat"]["pval"], skat[g]["pval"])
        some = [(v, gt) for _, gene, v, gt, w in calls if gene == g and w >= 0.35]
        assert got[g, "skat"]["n_QV"] == len({v for v, _ in some}) and np.isclose(got[g, "burden"]["EAC_filtered"], sum(gt for _, gt in some) / 2)
        assert np.isclose(got[g, "burden"]["EAC"], sum(gt for _, gene, v, gt, w in calls if gene == g) / 2)
        mac = {v: sum(gt for u, gt in some if u == v) for v, _ in some}
        row = got[g, "skat"]
        assert (row["n_cases"], row["n_cluster"], row["max_var_count"], row["max_var_count_wo_homoz"]) == (120, len(mac), max(mac.values()), 6)
        assert row["markers_after_mac_collapsing"] == sum(m > 3 for m in mac.values()) + any(m <= 3 for m in mac.values()) and got[g, "burden"]["markers_after_mac_collapsing"] == len(mac)
        assert got[g, "burden"]["beta"] is None or got[g, "burden"]["pval"] < 1e-3
    none = gene_test.seed_tests(rows, model, people, {"all": F.lit(True)}, max_markers=3).collect()
    assert len(none) == 4 and all(r["pval"] is None and r["n_QV"] == 10 for r in none)


def test_reversed_models(spark):
    """Mean change of the carriers' scores when flags are set to zero, against numpy."""
    rng = np.random.default_rng(9)
    nets = {r: deepset.random_network(2, seed=r) for r in range(3)}
    data = [(s, "g", 1, float(rng.normal()), float(rng.integers(0, 2))) for s in range(30) for _ in range(2)]
    df = spark.createDataFrame(data, "sample int, gene string, gt int, a double, plof double")
    got = {r["repeat"]: r for r in deepset.reversed_models(df, ["a", "plof"], ["plof"], nets).collect()}
    for r, net in nets.items():
        change = []
        for s in range(30):
            x = np.array([d[3:] for d in data if d[0] == s])
            if x[:, 1].max() > 0:
                score = lambda x, net=net: net.finish(np.maximum(net.embed(x).max(0, keepdims=True), net.embed(np.zeros((1, 2)))))[0]
                change.append(score(x) - score(x * [1, 0]))
        assert np.isclose(got[r]["mean_change"], np.mean(change)) and got[r]["reverse"] == (np.mean(change) < 0)


def test_shared_folder_is_required_on_a_cluster(monkeypatch):
    from locusloom.functions.shared import shared_dir

    class Conf(dict):
        def set(self, key, value):
            self[key] = value

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Session())
    Session.conf["spark.master"] = "local[2]"
    assert shared_dir(Session()) == Session.conf["spark.checkpoint.dir"]


def test_executors_need_no_copy(run_elsewhere, tmp_path):
    """A network is scored where the executors' Python can't import this package."""
    run_elsewhere("score_deepset", tmp_path)
