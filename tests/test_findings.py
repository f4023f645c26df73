"""Tests of the reviewer's findings: ties, whole tables, genes of any size."""

from itertools import takewhile

import numpy as np
import pytest
from locusloom.operators import evaluate, gene_test, multitest, null_model, spectrum
from locusloom.plans import queries
from pyspark.sql import functions as F


@pytest.mark.parametrize("ranged", [False, True])
def test_quantile_points_of_equal_pvalues(spark, ranged):
    """Equal p-values have their places by k, however rows are dealt."""
    rows = [(k, (k % 4 + 1) / 8, f"m{k % 2}") for k in np.random.default_rng(0).permutation(200).tolist()]
    df = spark.createDataFrame(rows, "k int, pval double, method string").repartition(3)
    for group in ([], ["method"]):
        found = {r["k"]: r["expected"] for r in multitest.qq_points(df, group, ranged=ranged, ties=["k"]).collect()}
        for m in ({"m0", "m1"},) if not group else ({"m0"}, {"m1"}):
            own = sorted((p, k) for k, p, x in rows if x in m)
            assert all(abs(found[k] + np.log10((i + 1) / len(own))) < 1e-9 for i, (_, k) in enumerate(own))


def test_first_significant_genes_of_equal_pvalues(spark):
    names = [f"g{i:02d}" for i in np.random.default_rng(1).permutation(40)]
    results = spark.createDataFrame([(g, 1e-4) for g in names], "gene string, pval double").repartition(4)
    found = evaluate.significant_genes(results, results.select("gene"), "Bonferroni", 0.9, top=3).collect()
    assert [r["gene"] for r in found] == ["g00", "g01", "g02"]


def test_splice_scores_of_all_variants(spark, data):
    """Every variant with a call of a positive score has one, not those of a few keys."""
    called = spark.read.parquet(f"{data}/lineitem.parquet").where("l_discount > 0").select("l_partkey").distinct().count()
    assert queries.annotation_splice_merged(spark, data).where("score > 0").count() == called


def test_seed_statistics_of_large_genes(spark, data, monkeypatch):
    """Genes above the seed tests' bound keep their statistics and counters in the queries that SQL checks."""
    whole = [q(spark, data).toPandas().sort_values(["gene", "vtype"]).reset_index(drop=True) for q in (queries.gene_seed_statistics, queries.gene_seed_counters)]
    inputs = queries.seed_inputs(spark, data)
    bounded = gene_test.seed_tests(*inputs, max_markers=2, collapse_method="sum", ttypes=("burden",))
    assert bounded.where("n_QV >= 2 and stat is not null").count() == 0 and bounded.where("n_QV >= 2 and n_cluster is null").count() > 0
    every = gene_test.seed_tests(*inputs, max_markers=None, collapse_method="sum", ttypes=("burden",))
    assert every.where("n_cluster is null").count() == 0 and every.where("stat is not null").count() == whole[0].stat.notna().sum()
    monkeypatch.setattr(gene_test, "MAX_MARKERS", 2)
    monkeypatch.setattr(gene_test.seed_tests, "__defaults__", tuple(2 if d == 5000 else d for d in gene_test.seed_tests.__defaults__))
    assert queries.gene_seed_statistics(spark, data).where("stat is null").count() == 0
    assert queries.gene_seed_counters(spark, data).where("n_cluster is null").count() == 0
    with pytest.raises(ValueError, match="unknown tests"):
        gene_test.seed_tests(*inputs, ttypes=("other",))


def test_network_losses_deal_calls_once(spark, data, monkeypatch):
    """The losses of all networks come from one table of dealt calls and one of carriers."""
    dealt, carriers, prepared, rows = [], [], queries.training.prepared, queries.study.carriers
    monkeypatch.setattr(queries.training, "prepared", lambda *a: dealt.append(1) or prepared(*a))
    monkeypatch.setattr(queries.study, "carriers", lambda *a: carriers.append(1) or rows(*a))
    assert queries.network_losses(spark, data).count() == 3
    assert len(dealt) == 1 and len(carriers) == 1


def test_lanczos_writes_only_new_blocks(spark, monkeypatch):
    """A step writes one block a marker, not the whole basis; genes in many blocks and parts, with repeated calls, have the p-values of their matrices."""
    rng = np.random.default_rng(5)
    people = spark.createDataFrame([(i, float(rng.normal()), float(rng.normal())) for i in range(300)], "sample int, y double, x double")
    calls = [(int(s), g, f"m{m}", float(rng.uniform(0.5, 2))) for g, n in (("a", 60), ("b", 40)) for m in range(n) for s in rng.choice(300, 6)]
    rows = spark.createDataFrame(calls, "sample int, gene string, marker string, value double")
    model = null_model.fit_linear(people, "y", ["x"])
    dense = {r["gene"]: r for r in gene_test.skat(rows, model, people).collect()}
    sizes, write = [], spectrum.written

    def recorded(df, name, parts=None):
        table = write(df, name, parts)
        if name in ("basis", "multiplied"):
            lists = [f.name for f in table.schema if f.dataType.simpleString() == "array<double>" and f.name != "zx"]
            sizes.append(sum(table.select(*[F.sum(F.size(c)) for c in lists]).first()))
        return table

    monkeypatch.setattr(spectrum, "written", recorded)
    for name, value in (("MARKERS", 16), ("CALLS", 32), ("SHARE", 128)):
        monkeypatch.setattr(spectrum, name, value, raising=False)
    free = {r["gene"]: r for r in gene_test.skat(rows, model, people, dense=0, block=16, steps=4).collect()}
    assert sizes and max(sizes) <= 100 * 16
    for g, r in dense.items():
        assert free[g]["n_markers"] == r["n_markers"] and np.isclose(free[g]["q"], r["q"]) and np.isclose(free[g]["pval"], r["pval"], rtol=1e-3)


def test_conditional_test_joins_burdens_with_common_calls_only(spark):
    """Burdens are added up by gene; only common variants are joined with themselves. Genes with and without a window have their least squares."""
    rng = np.random.default_rng(6)
    n = 120
    x, common, b = rng.normal(size=n), rng.integers(0, 2, (n, 3)).astype(float), rng.uniform(0.5, 2, (n, 2)) * (rng.random((n, 2)) < 0.3)
    y = x + common[:, 0] + b[:, 0] + rng.normal(size=n)
    samples = spark.createDataFrame([(i, float(y[i]), float(x[i])) for i in range(n)], "sample int, y double, x double")
    burdens = spark.createDataFrame([(int(i), "ab"[k], float(b[i, k])) for i, k in zip(*np.nonzero(b), strict=True)], "sample int, gene string, b double")
    conditioning = spark.createDataFrame([("a", int(i), f"m{k}", float(common[i, k])) for i, k in zip(*np.nonzero(common), strict=True)], "gene string, sample int, marker string, value double")
    found = gene_test.dense_conditional_test(burdens, conditioning, samples, "y", ["x"])
    for r in found.collect():
        null = np.column_stack([np.ones(n), x, common] if r["gene"] == "a" else [np.ones(n), x])
        proj = np.eye(n) - null @ np.linalg.pinv(null)
        own = b[:, "ab".index(r["gene"])]
        u, v, s2 = own @ proj @ y, own @ proj @ own, y @ proj @ y / (n - null.shape[1])
        assert np.isclose(r["beta"], u / v) and np.isclose(r["stat"], u * u / s2 / v)
    assert found.count() == 2
    # burdens and common calls as one table were joined with themselves
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    named = [(len(line) - len(line.lstrip(" :+-")), line.lstrip(" :+-")) for line in lines]
    for i, (depth, name) in enumerate(named):
        if name.startswith("Join"):
            assert not any(below.startswith("Union") for _, below in takewhile(lambda x, depth=depth: x[0] > depth, named[i + 1 :]))


def test_seed_inputs_make_calls_once_and_counters_tell_no_carriers_apart(spark, data, monkeypatch):
    made, calls = [], queries.study.calls
    monkeypatch.setattr(queries.study, "calls", lambda *a: made.append(1) or calls(*a))
    rows, model, *_ = queries.seed_inputs(spark, data)
    assert len(made) == 1
    found = gene_test.class_counts(rows, model, 1, F.lit(True), 0.0, 10)
    assert "distinct" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    whole = {r["gene"]: r for r in gene_test.variant_counters(rows).collect()}
    assert {r["gene"]: r["n_QV"] for r in found.collect()} == {g: r["n_qv"] for g, r in whole.items()}
