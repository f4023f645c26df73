"""Readers, sinks and the call stream on small files."""

from locusloom.functions import scalar
from locusloom.operators import annotate
from locusloom.sources import readers, sinks
from locusloom.streaming import ingest
from pyspark.sql import functions as F


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_calls_and_lists(spark, tmp_path):
    put(tmp_path / "c" / "a.tsv", "chr1\t10\tA\tT\ts1\t1\nchr1\t20\tC\tG\ts2\t2\n")
    put(tmp_path / "c" / "empty.tsv", "")
    assert readers.calls(spark, str(tmp_path / "c")).count() == 2
    put(tmp_path / "x" / "chr1" / "a.tsv", "chr1\t10\tA\tT\ts1\nchr1\t10\tA\tT\ts1\n")
    put(tmp_path / "x" / "chr2" / "b.tsv.txt", "")
    put(tmp_path / "x" / "chr2" / "b.tsv", "chr2\t10\tA\tT\ts1\n")
    assert readers.excluded_calls(spark, str(tmp_path / "x")).count() == 3
    assert readers.excluded_calls(spark, str(tmp_path / "x"), "chr2").count() == 1
    put(tmp_path / "s" / "one.csv", "s1\ns2\ns1\n")
    assert sorted(r["sample"] for r in readers.excluded_samples(spark, str(tmp_path / "s")).collect()) == ["s1", "s2"]
    stems = readers.calls(spark, str(tmp_path / "c")).select(readers.file_stem().alias("s")).distinct().collect()
    assert [r["s"] for r in stems] == ["a"]


def test_annotator_table(spark, tmp_path):
    path = put(tmp_path / "v.tsv", "## made by\n## more\n#Uploaded_variation\tGene\tConsequence\tSpliceAI_pred\nchr1_10_A/T\tG1.2\tmissense_variant,stop_gained\tG|0.1|-|0.3|-|1\nx\t-\tintron_variant\t-\n")
    rows = readers.annotator_table(spark, path)
    assert rows.where("Gene is null").count() == 1
    variants = spark.createDataFrame([("x", "2", 5, "C", "G")], "`#Uploaded_variation` string, chrom string, pos long, ref string, alt string")
    got = {r["pos"]: r for r in annotate.process_annotator(rows, variants, ["stop_gained"]).collect()}
    assert got[10]["chrom"] == "chr1" and got[10]["ref"] == "A" and got[10]["Consequence_stop_gained"] == 1 and got[10]["SpliceAI_delta_score"] == 0.3
    assert got[5]["chrom"] == "chr2" and got[5]["SpliceAI_delta_score"] is None


def test_gtf_and_genes(spark, tmp_path):
    lines = ["#!genome", *(f'chr1\tHAVANA\t{f}\t{s}\t{e}\t.\t+\t.\tgene_id "{g}"; gene_type "protein_coding"; gene_name "N{g}"; transcript_type "protein_coding";' for f, s, e, g in (("gene", 100, 200, "E1.1"), ("exon", 100, 150, "E1.1"), ("gene", 300, 400, "E2.3"), ("gene", 310, 400, "E2.4")))]
    gtf = readers.gtf(spark, put(tmp_path / "g.gtf", "\n".join(lines) + "\n"))
    assert gtf.where("feature = 'exon'").first()["start"] == 99
    assert annotate.coding_exons(gtf).count() == 1
    got = sorted((r["id"], r["gene"]) for r in annotate.gene_table(gtf).collect())
    assert got == [(0, "E1.1"), (1, "E2.3")]


def test_vcf(spark, tmp_path):
    text = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n1\t10\t.\tA\tT,G\t.\t.\t.\tGT:DP\t0/1:3\t1|2:9\n1\t20\t.\tC\tT\t.\t.\t.\tGT\t0/0\t./1\n"
    long = readers.vcf(spark, put(tmp_path / "a.vcf", text))
    split = readers.split_alleles(long)
    got = {(r["pos"], r["alt"], r["sample"]): r["gt"] for r in split.collect()}
    assert got == {(10, "T", "s1"): 1, (10, "G", "s1"): 0, (10, "T", "s2"): 1, (10, "G", "s2"): 1, (20, "T", "s1"): 0, (20, "T", "s2"): None}
    assert readers.carried_variants(split).count() == 2 and readers.nonref_calls(split).count() == 3
    assert readers.named_variants(readers.carried_variants(split)).where("name = '1_10_A_T'").count() == 1
    assert readers.bed(readers.carried_variants(split)).where("start = 9 and name = 'A/T'").count() == 1


def test_statistics_files(spark, tmp_path):
    sample = "FLT0\ts1" + "\t0" * 9 + "\t7\t0\t0\n"
    lines = spark.read.text(put(tmp_path / "s.tsv", sample))
    assert readers.missingness_samples(lines).first().asDict() == {"sample": "s1", "n_missing": 7}
    sites = spark.read.text(put(tmp_path / "t.tsv", "SITE0\t50\nFLT0\t3\n"))
    assert [r["n_sites"] for r in readers.missingness_sites(sites).collect()] == [50]


def test_sinks(spark, tmp_path):
    calls = spark.createDataFrame([("chr1", "s1", 0, 1), ("chr2", "s1", 1, 2)], "chrom string, sample string, variant_id long, gt int")
    sinks.genotypes_by_chromosome(calls, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g")).where("chrom = 'chr2'").count() == 1
    table = spark.createDataFrame([("s1", 1.5, None)], "sample string, x double, y double")
    sinks.text_table(sinks.covariate_table(table, ["x", "y"]), str(tmp_path / "t"))
    back = readers.space_separated(spark, str(tmp_path / "t"), "FID string, IID string, x double, y double").first()
    assert back["x"] == 1.5 and back["y"] is None
    every, some = sinks.combined_seed_results([spark.createDataFrame([("g", 0.1, 60.0), ("h", None, 90.0)], "gene string, pval double, EAC double")])
    assert every.count() == 2 and some.count() == 1
    assert sinks.combined_results([every, every], "m").where("model = 'm'").count() == 4
    sinks.saved_burdens(every, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == 2


def test_stream(spark, tmp_path):
    put(tmp_path / "in" / "a.tsv", "chr1\t10\tA\tT\ts1\t1\nchr1\t20\tC\tG\ts9\t2\n")
    variants = spark.createDataFrame([("chr1", 10, "A", "T", 0), ("chr1", 20, "C", "G", 1)], "chrom string, pos long, ref string, alt string, id long")
    samples = spark.createDataFrame([("s1",), ("s2",)], "sample string")

    def run():
        query = ingest.write(ingest.processed(ingest.call_stream(spark, str(tmp_path / "in")), variants, samples), str(tmp_path / "out"), str(tmp_path / "cp"))
        query.awaitTermination(120)
        return spark.read.parquet(str(tmp_path / "out"))

    assert run().count() == 1
    put(tmp_path / "in" / "b.tsv", "chr1\t20\tC\tG\ts2\t2\n")
    got = run()
    assert sorted((r["sample"], r["variant_id"], r["gt"]) for r in got.collect()) == [("s1", 0, 1), ("s2", 1, 2)]
    assert ingest.allele_counts(got).where("variant_id = 1").first()["ac"] == 2


def test_prefix(spark):
    df = spark.createDataFrame([("model_repeat_3",), ("repeat_12.pt",)], "m string")
    assert [r[0] for r in df.select(scalar.repeat_of("m")).collect()] == [3, 12]
    assert [r[0] for r in df.select(scalar.remove_prefix("m", "model_")).collect()] == ["repeat_3", "repeat_12.pt"]
    assert [r[0] for r in df.select(scalar.display("m", {"model_repeat_3": "M"})).collect()] == ["M", "repeat 12.pt"]
    assert [r[0] for r in df.select(scalar.replaced("m", "repeat_12.pt", "r")).collect()][1] == "r"
    assert df.select(F.round(scalar.sigmoid(F.lit(0.0)), 3)).first()[0] == 0.5
