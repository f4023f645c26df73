"""Each stage of the corpus pipeline on its own input, and the whole."""

import corpus_pipeline as cp
from locusloom.llm import langid, linededup, quality
from locusloom.llm.common import table
from pyspark.sql import functions as F
from test_joins import brute_classes
from test_texts import check_packed, plain_ids

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = table(spark, SF, "documents").cache()
    columns = docs.columns
    before = {r["doc_id"]: r for r in docs.collect()}

    kept = cp.language_stage(spark, docs, SF).cache()
    scored = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert kept.columns == columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, r in scored.items() if r["lang_pred"] != "und" and r["lang_score"] >= cp.LEAST_LANGUAGE}

    good = cp.quality_stage(spark, kept, SF).cache()
    scores = {r["doc_id"]: r["quality_score"] for r in quality.score(kept, quality.fit(kept, table(spark, SF, "labels"))).collect()}
    assert good.columns == columns and {r["doc_id"] for r in good.collect()} == {d for d, s in scores.items() if s >= 0.3}
    labels = table(spark, SF, "labels").where("quality = 1").join(kept, "doc_id", "left_semi")
    assert good.join(labels, "doc_id", "left_semi").count() >= 0.97 * labels.count()

    lines = cp.line_stage(spark, good, SF).cache()
    after = {r["doc_id"]: r for r in lines.collect()}
    cut = {r["doc_id"]: r for r in linededup.dedup_lines(good).collect()}
    assert lines.columns == columns
    for d, r in cut.items():
        if r["n_removed"] == 0:
            assert after[d]["text"] == before[d]["text"]
        elif r["text"].strip():
            assert after[d]["text"] == r["text"] and after[d]["n_chars"] == len(r["text"])
        else:
            assert d not in after

    one = cp.near_duplicate_stage(spark, lines, SF).cache()
    want = brute_classes([(d, r["text"]) for d, r in after.items()])
    assert one.columns == columns and sorted(r["doc_id"] for r in one.collect()) == sorted(set(want.values()))

    packed = cp.packing_stage(spark, one, SF).collect()
    rows = one.collect()
    sizes = dict(zip([r["doc_id"] for r in rows], map(len, plain_ids([r["text"] for r in rows])), strict=True))
    got = {}
    for r in packed:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
        assert len(r["ids"]) == 4 * r["length"]
    assert got == sizes
    check_packed(packed, 1024)


def test_stages_odd(spark, odd_documents, no_documents):
    for name, stage in cp.STAGES:
        for docs in (odd_documents, no_documents):
            out = stage(spark, docs, SF)
            if name != "packing":
                assert out.columns == docs.columns
            out.collect()


def test_run(spark, data):
    out = cp.run(spark, data)
    assert out.count() > 0 and out.where(F.col("length") > 1024).count() == 0
