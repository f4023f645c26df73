"""Tests of the reviewer's findings on the driver's memory."""

import numpy as np
from locusloom.llm import langid, topk
from locusloom.llm.queries import QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_language_vectors_stay_off_the_driver(spark, monkeypatch):
    """Pairs are fitted in tasks: the driver sees no array of vectors, and the weights are those of the plain form."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = []

    class Seen(langid.Hierarchy):
        def __init__(self, x, langs):
            given.append((x, x.table.orderBy("lang", "h").collect()))
            super().__init__(x, langs)

    monkeypatch.setattr(langid, "Hierarchy", Seen)
    model = langid.fit(docs)
    x, rows = given[0]
    assert not isinstance(x, np.ndarray) and len(x) == len(rows) > 50
    monkeypatch.undo()
    plain = langid.Hierarchy(np.array([np.frombuffer(r["x"], np.float16) for r in rows]), [r["lang"] for r in rows])
    assert plain.langs == model.langs and plain.groups == model.groups and np.allclose(plain.weights, model.weights, atol=1e-4)


def test_top_k_broadcasts_nothing(spark):
    """No side of a join that grows with the vectors goes through the driver."""
    plan = QUERIES["op10_top_k"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    reps = spark.createDataFrame([(1, [1, 2]), (2, [3, 4])], "rep long, vec array<long>")
    pairs = spark.createDataFrame([(1, 2)], "q long, c long")
    found = topk.scored(pairs, reps)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString() and found.select("score").first()[0] == 11
    assert found.where(F.col("score") == 11).count() == 1
