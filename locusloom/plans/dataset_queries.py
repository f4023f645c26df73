"""Registered queries of dataset assembly, keyed merges and evaluation details."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import annotate, checks, dataset, deepset, evaluate, gene_test, masks, metrics, multitest, training, transform
from ..sources import readers, sinks
from . import study
from .queries import ANNO, AF, BURDENS, CALLS, N, PVALS, STUDY, pvals, query, rounded

RARE = f"{study.RARE_ALLELES} / (2.0 * (select n from n))"
PEOPLE = "people as (select c_custkey as sample, c_acctbal as y, c_nationkey as x from customer where c_acctbal >= 0 and c_custkey in (select sample from calls))"


@query("dataset_rows", f"""with {CALLS}, {N}, {AF}, {ANNO}, {PEOPLE}, m as (select avg(size) as m, stddev_pop(size) as s from anno where maf < {RARE} and size > 10 and gene <> 'Brand#11' and size <> 0)
select c.sample, c.variant_id, c.gt, gene, round((size - m) / s, 6) as size from calls c join anno on id = variant_id cross join m where maf < {RARE} and size > 10 and gene <> 'Brand#11' and sample in (select sample from people)""")
def dataset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an assembled dataset with standardised features."""
    d = assembled(spark, sf_dir)
    return rounded(d.rows, "size").select("sample", "variant_id", "gt", "gene", "size")


def assembled(spark: SparkSession, sf_dir: str) -> dataset.Dataset:
    v = study.annotated(spark, sf_dir).withColumn("gene", F.when(F.col("gene") != "Brand#11", F.col("gene")))
    people = study.samples(spark, sf_dir).withColumn("y", F.when(F.col("y") >= 0, F.col("y")))
    rare = F.col("MAF") < study.rare_bound(spark, sf_dir)
    return dataset.assemble(study.calls(spark, sf_dir), v, people, "y", ["nation"], ["size"], ["size > 10"], rare, y_transform="standardize", standardize_features=True)


@query("dataset_samples", f"with {CALLS}, {PEOPLE}, m as (select avg(y) as my, stddev_pop(y) as sy, avg(x) as mx, stddev_pop(x) as sx from people) select sample, round((y - my) / sy, 6) as y, round((x - mx) / sx, 6) as nation from people cross join m")
def dataset_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Y and x of the masked samples, transformed after the mask."""
    return rounded(assembled(spark, sf_dir).samples, "y", "nation")


@query("dataset_metadata", f"with {CALLS}, {N}, {AF}, {ANNO} select gene, count(*) as n_variants from anno where maf < {RARE} and size > 10 and gene <> 'Brand#11' group by 1")
def dataset_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept variants of each kept gene."""
    d = assembled(spark, sf_dir)
    return study.variants(spark, sf_dir).join(d.variants, "id", "left_semi").join(d.genes, "gene", "left_semi").groupBy("gene").agg(F.count("*").alias("n_variants"))


@query("dataset_variant_groups", "select p_size as id, string_agg(distinct p_brand, ',' order by p_brand) as genes from part group by 1")
def dataset_variant_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7."""
    rows = study.variants(spark, sf_dir).select(F.col("size").alias("id"), "gene")
    return dataset.variant_groups(rows).select("id", F.array_join("gene_ids", ",").alias("genes"))


@query("dataset_split_flags", "select p_partkey as id, case when p_partkey % 3 = 0 then 'train' when p_partkey % 3 = 1 then 'validation' end as split from part")
def dataset_split_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J26."""
    v = study.variants(spark, sf_dir)
    old = v.where("id % 3 < 2").select("id", F.when(F.col("id") % 3 == 0, "train").otherwise("validation").alias("split"))
    return dataset.split_flags(v.select("id"), old)


@query("filter_common_by_count", f"with {CALLS} select variant_id as id, cast(sum(gt) as bigint) as ac from calls group by 1 having sum(gt) between 40 and 2 * (select count(*) from customer) - 40")
def filter_common_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11."""
    n = 2 * study.table(spark, sf_dir, "customer").count()
    counts = study.calls(spark, sf_dir).groupBy(F.col("variant_id").alias("id")).agg(F.sum("gt").alias("ac"))
    return counts.where(masks.common_by_count("ac", 40, n))


@query("filter_variant_types", "select p_partkey as id, p_size % 2 = 0 as missense, p_size > 45 as plof from part where (p_size % 2 = 0 or p_size > 45) and p_type in ('ECONOMY', 'SMALL') and p_retailprice < 1900 and p_partkey in (select l_partkey from lineitem where l_quantity > 20)")
def filter_variant_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F8, F12, F13."""
    v = study.variants(spark, sf_dir).withColumns({"Consequence_missense_variant": (F.col("size") % 2 == 0).cast("int"), "is_plof": (F.col("size") > 45).cast("int"), "chrom": F.concat(F.lit("chr"), "chrom")})
    v = masks.chromosomes(v, ["ECONOMY", "chrSMALL"]).where(masks.variant_type("missense") | masks.variant_type("plof"))
    listed = study.table(spark, sf_dir, "lineitem").where("l_quantity > 20").select(F.col("l_partkey").alias("id"))
    kept = masks.max_pval(masks.keep_listed(v, listed, "id"), {"price": 1900})
    return kept.select("id", (F.col("Consequence_missense_variant") == 1).alias("missense"), (F.col("is_plof") == 1).alias("plof"))


@query("filter_coding_genes", "select p_partkey as id, 'ENSG' || p_partkey as gene from part where p_size <> 1")
def filter_coding_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F23."""
    rows = study.variants(spark, sf_dir).select("id", F.concat(F.lit("ENSG"), "id", F.lit(".3"), F.when(F.col("size") == 1, "_PAR_Y").otherwise("")).alias("gene"))
    return masks.coding_genes(rows)


@query("filter_first_samples", "select c_custkey as sample from customer order by 1 limit (select cast(round(count(*) * 0.3) as bigint) from customer)")
def filter_first_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first share of the samples, which is what the operator is for."""
    return masks.share_of_samples(study.samples(spark, sf_dir).select("sample"), 0.3)


@query("merge_checked_scores", "with s as (select ps as id, min(score) as score from (select l_suppkey * 20 as ps, l_discount as score from lineitem) group by 1) select p_partkey as id, p_brand as gene, score as score_clip from part left join s on id = p_partkey")
def merge_checked_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffixed scores, the least of each key, joined m:1."""
    scores = study.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 20).alias("id"), F.col("l_discount").alias("score"), F.lit("x").alias("junk"))
    return annotate.merge_scores(study.variants(spark, sf_dir).select("id", "gene"), scores.drop("junk"), "_clip", ["id"])


@query("merge_ids", "with s as (select p_brand, p_type, min(p_size) as score from part group by 1, 2), i as (select p_brand, p_type, row_number() over (order by p_brand, p_type) - 1 as id from (select distinct p_brand, p_type from part)) select p_brand as brand, p_type as type, score, id from s join i using (p_brand, p_type)")
def merge_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renamed score rows, the first of each key, with variant ids."""
    from ..operators.genotype import add_variant_ids

    part = study.table(spark, sf_dir, "part")
    ids = add_variant_ids(part.select(F.col("p_brand").alias("brand"), F.col("p_type").alias("type")), ["brand", "type"])[0]
    scores = part.select(F.col("p_brand").alias("#BRAND"), F.col("p_type").alias("#TYPE"), F.col("p_size").alias("score"))
    return annotate.add_ids(scores, ids, {"#BRAND": "brand", "#TYPE": "type"}, ["brand", "type"])


@query("merge_many", "with a as (select l_partkey as id, max(l_discount) as d, max(l_tax) as t from lineitem group by 1) select l_orderkey as row, l_linenumber as line, l_partkey as id, d, t from lineitem join a on a.id = l_partkey")
def merge_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotator rows m:1 variants, then two score tables."""
    lines = study.table(spark, sf_dir, "lineitem")
    key = F.col("l_partkey").alias("pos")
    rows = lines.select(key, F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("line"))
    scores = [lines.groupBy(key).agg(F.max("l_discount").alias("d")), lines.groupBy(key).agg(F.max("l_tax").alias("t"))]
    return annotate.merge_annotations(rows, study.variants(spark, sf_dir).select("pos", "id"), scores, ["pos"]).select("row", "line", "id", "d", "t")


@query("merge_components", "with r as (select distinct l_partkey as id, l_linenumber as line from lineitem), c as (select l_partkey as id, min({'a': l_discount, 'b': l_tax}) as p from lineitem group by 1) select id, line, p.a as pc_1, p.b as pc_2 from r left join c using (id)")
def merge_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component columns of the first row of each key, joined to distinct annotation rows."""
    lines = study.table(spark, sf_dir, "lineitem")
    components = lines.select(F.col("l_partkey").alias("id"), F.col("l_discount").alias("pc_1"), F.col("l_tax").alias("pc_2"), F.col("l_quantity").alias("other"))
    return annotate.merge_components(lines.select(F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("line")), components, ["id"], "pc_")


@query("annotations_concatenated", "select p_partkey as id, p_size as size, p_brand as gene from part union all select p_partkey, p_size, p_type from part")
def annotations_concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of the same columns in any order."""
    v = study.variants(spark, sf_dir)
    return readers.concat_same([v.select("id", "size", "gene"), v.select(F.col("chrom").alias("gene"), "id", "size")])


@query("chunks_combined", f"with {CALLS}, s as (select c_custkey as sample, c_custkey % 4 as chunk from customer) select sample, row_number() over (order by chunk, sample) - 1 as row from s")
def chunks_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of samples, each numbered on its own, in one order; raises if one is missing."""
    chunked = study.samples(spark, sf_dir).select("sample", (F.col("sample") % 4).cast("int").alias("chunk"))
    index = F.row_number().over(Window.partitionBy("chunk").orderBy("sample")) - 1
    return sinks.combined_chunks(chunked.withColumn("index", index), 4).select("sample", "row")


@query("results_labelled", "select p_partkey as k, p_brand || '-' || p_type as method from part")
def results_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The method of a result from the path of its file."""
    v = study.variants(spark, sf_dir)
    return v.select(F.col("id").alias("k"), scalar.method_of(F.concat_ws("/", F.lit("out"), "gene", "chrom", F.lit("eval"), F.lit("results.parquet"))).alias("method"))


@query("simulated_phenotype", "select c_custkey as sample, c_nationkey::double as nation, y from customer left join (select o_custkey, sum(o_totalprice) as y from orders group by 1) on o_custkey = c_custkey")
def simulated_phenotype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phenotype from another table; null for samples that it lacks."""
    simulated = study.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("sample")).agg(F.sum("o_totalprice").alias("y"))
    return evaluate.with_simulated(study.samples(spark, sf_dir).select("sample", "nation", "y"), simulated)


@query("same_covariates", """with o as (select o_custkey as sample, sum(o_totalprice) as spent, count(*) as n from orders group by 1), i as (select o_custkey as sample, sum(o_totalprice + 0.0) as spent, count(o_orderkey) as n from orders group by 1)
select case when (select count(*) from o full join i using (sample) where o.n is null or i.n is null or abs(o.spent - i.spent) >= 0.01 or o.n <> i.n) = 0 then 'same' else 'other' end as first,
       case when (select count(*) from o full join (select sample, spent + case when sample % 7 = 0 then 1 else 0 end as spent from i) j using (sample) where o.n is null or j.spent is null or abs(o.spent - j.spent) >= 0.01) = 0 then 'same' else 'other' end as second,
       case when (select count(*) from o full join (select c_custkey as sample from customer) c using (sample) where o.n is null or c.sample is null) = 0 then 'same' else 'other' end as third""")
def same_covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether covariates summed in two ways agree; with some of them moved; and with the samples of another table."""
    orders = study.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("sample"))
    one = orders.agg(F.sum("o_totalprice").alias("spent"), F.count("*").alias("n"))
    two = orders.agg((F.avg("o_totalprice") * F.count("*")).alias("spent"), F.count("o_orderkey").alias("n"))
    moved = two.withColumn("spent", F.col("spent") + (F.col("sample") % 7 == 0).cast("int"))
    people = study.samples(spark, sf_dir).select("sample")

    def said(other: DataFrame, columns: list[str]) -> str:
        try:
            checks.require_same_rows(one, other, ["sample"], columns, 0.01)
        except checks.CheckFailed:
            return "other"
        return "same"

    return spark.createDataFrame([(said(two, ["spent", "n"]), said(moved, ["spent"]), said(people, []))], "first string, second string, third string")


@query("first_genes_and_samples", "with g as (select distinct p_brand as gene from part order by 1 limit 5), s as (select c_custkey as sample from customer order by 1 limit 40), c as (select p_brand as gene, o_custkey as sample from lineitem join orders on o_orderkey = l_orderkey join part on p_partkey = l_partkey) select gene, count(*) as n_calls, count(distinct sample) as n_samples from c where gene in (select gene from g) and sample in (select sample from s) group by 1")
def first_genes_and_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a trial run on the first genes and samples, which is what the operator is for."""
    calls = study.table(spark, sf_dir, "lineitem").join(study.table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(study.variants(spark, sf_dir), F.col("id") == F.col("l_partkey"))
    # the first samples are those of the study, carriers or not
    people = masks.first_of(study.samples(spark, sf_dir).select("sample"), 40)
    rows = masks.first_of(calls.select("gene", F.col("o_custkey").alias("sample")), 5, "gene").join(people, "sample", "left_semi")
    return rows.groupBy("gene").agg(F.count("*").alias("n_calls"), F.count_distinct("sample").alias("n_samples"))


@query("dataset_of_genes", f"with {CALLS}, listed as (select p_brand as gene from part group by 1 having count(*) % 2 = 0) select sample, variant_id, gt, gene, size from calls join (select p_partkey as variant_id, p_brand as gene, p_size as size from part) p using (variant_id) where gene in (select gene from listed)")
def dataset_of_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a dataset of the listed genes only."""
    v = study.variants(spark, sf_dir)
    listed = v.groupBy("gene").agg(F.count("*").alias("n")).where("n % 2 = 0").select("gene")
    found = dataset.assemble(study.calls(spark, sf_dir), v.select("id", "gene", "size"), study.samples(spark, sf_dir), "y", [], ["size"], genes=listed)
    return found.rows.select("sample", "variant_id", "gt", "gene", "size")


@query("significant_genes_first", f"with {PVALS}, b as (select gene, min(pval) as pval from pv group by 1), s as (select gene, pval * count(*) over () as q from b) select gene, round(q, 9) as pval_corrected from s where q < 0.9 order by q, gene limit 3")
def significant_genes_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: the first few significant genes, which is what the option is for; equal p-values by gene."""
    best = pvals(spark, sf_dir).groupBy("gene").agg(F.min("pval").alias("pval"))
    genes = study.variants(spark, sf_dir).select("gene").distinct()
    return rounded(evaluate.significant_genes(best, genes, "Bonferroni", 0.9, top=3), "pval_corrected", digits=9)


@query("significant_gene_table", f"with {PVALS}, b as (select gene, min(pval) as pval from pv group by 1), s as (select gene, pval * count(*) over () as q from b) select s.gene, round(q, 9) as pval_corrected, n_variants from s join (select p_brand as gene, count(*) as n_variants from part group by 1) using (gene) where q < 0.5")
def significant_gene_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J21."""
    best = pvals(spark, sf_dir).groupBy("gene").agg(F.min("pval").alias("pval"))
    genes = study.variants(spark, sf_dir).groupBy("gene").agg(F.count("*").alias("n_variants"))
    return rounded(evaluate.significant_genes(best, genes, "Bonferroni", 0.5), "pval_corrected", digits=9)


@query("seed_gene_ids", f"with {PVALS}, b as (select gene, min(pval) * (select count(*) from pv) as q, min(pval) as pval from pv group by 1), o as (select *, row_number() over (order by q, pval, gene) as i from b), g as (select gene, row_number() over (order by gene) - 1 as id from (select distinct p_brand as gene from part)) select gene, id from o join g using (gene) where q < 2 and i <= 10")
def seed_gene_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes below a bound for the corrected p, with ids."""
    from ..operators.genotype import dense_ids

    seeds = evaluate.seed_genes(pvals(spark, sf_dir), least=0, most=10, below=2.0).select("gene")
    return evaluate.seed_genes_with_ids(seeds, dense_ids(study.variants(spark, sf_dir).select("gene").distinct(), ["gene"], "id", 4)).select("gene", "id")


@query("metric_precision_recall", "with d as (select p_type as phenotype, round(greatest(least(p_size / 25.0, 1), 0)) as hit, cast(p_retailprice > 1400 as int) as y from part) select phenotype, round(sum(hit * y) / (sum(hit) + 1e-7), 6) as precision, round(sum(hit * y) / (sum(y) + 1e-7), 6) as recall from d group by 1")
def metric_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A27."""
    d = study.table(spark, sf_dir, "part").select(F.col("p_type").alias("phenotype"), (F.col("p_size") / 25.0).alias("p"), (F.col("p_retailprice") > 1400).cast("int").alias("y"))
    return rounded(metrics.precision_recall(d, ["phenotype"]), "precision", "recall")


@query("metric_best_epoch", "select min(avg_tax) as best, arg_min(epoch, avg_tax) as epoch from (select l_linenumber as epoch, round(avg(l_tax), 9) as avg_tax from lineitem group by 1)")
def metric_best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M29."""
    epochs = study.table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("epoch")).agg(F.round(F.avg("l_tax"), 9).alias("objective"))
    return metrics.best_epoch(epochs)


@query("bags_dropped", "select repeat, bag from (select p_size % 5 as repeat, p_partkey as bag, row_number() over (partition by p_size % 5 order by p_retailprice desc, p_partkey) as i from part) where i > 3")
def bags_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M20."""
    bags = study.variants(spark, sf_dir).select((F.col("size") % 5).alias("repeat"), F.col("id").alias("bag"), F.col("price").alias("objective"))
    return deepset.worst_bags_dropped(bags, 3).select("repeat", "bag")


@query("models_selected", "select p_size % 5 as repeat, p_partkey as model, case when p_size % 3 = 0 then -1 else 1 end as sign from part where p_size % 7 <> 0")
def models_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M17."""
    m = study.variants(spark, sf_dir).select((F.col("size") % 5).alias("repeat"), F.col("id").alias("model"), (F.col("size") % 7 == 0).alias("dropped"), (F.col("size") % 3 == 0).alias("reverse"))
    return deepset.selected_models(m)


@query("bag_samples", f"select c_custkey as sample, case when ('0x' || substr(md5('5:' || c_custkey), 1, 8))::bigint < {int(0.7 * (1 << 32))} then 'train' else 'validation' end as part from customer")
def bag_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training and validation samples of a bag."""
    train, held = evaluate.bagged(study.samples(spark, sf_dir).select("sample"), 0.7, 5)
    return train.withColumn("part", F.lit("train")).unionByName(held.withColumn("part", F.lit("validation")))


@query("bag_samples_replaced", """with s as (select c_custkey as sample, row_number() over (order by c_custkey) - 1 as i, count(*) over () as n from customer),
d as (select ('0x' || substr(md5('5:' || j), 1, 8))::bigint % (select count(*) from customer) as i, count(*) as times from range((select cast(round(0.7 * count(*)) as bigint) from customer)) as r(j) group by 1)
select sample, coalesce(times, 0) as times from s left join d using (i)""")
def bag_samples_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bag drawn with replacement; how often each sample is in it."""
    train, held = evaluate.bagged(study.samples(spark, sf_dir).select("sample"), 0.7, 5, replace=True)
    return train.groupBy("sample").agg(F.count("*").alias("times")).unionByName(held.withColumn("times", F.lit(0).cast("long")))


@query("upsampled_classes", "with c as (select c_acctbal < 0 as y, count(*) as n from customer group by 1) select cast(y as int) as y_binary, (select max(n) from c) as n from c")
def upsampled_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A29."""
    return evaluate.upsampled(study.samples(spark, sf_dir), "y_binary").groupBy("y_binary").agg(F.count("*").alias("n"))


@query("shuffled_index", "select c_custkey as sample, row_number() over (partition by c_mktsegment order by substr(md5('0:' || c_custkey), 1, 8), c_custkey) - 1 as index from customer")
def shuffled_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W16."""
    return evaluate.shuffled_index(study.samples(spark, sf_dir).withColumnRenamed("segment", "phenotype")).select("sample", F.col("index").cast("long").alias("index"))


@query("results_combined", f"with {PVALS} select gene, k, pval, 'm1' as model from pv where k % 2 = 0 union all select gene, k, pval, 'm1' from pv where k % 2 = 1")
def results_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7, U1."""
    rows = pvals(spark, sf_dir).select("gene", "k", "pval")
    return sinks.combined_results([rows.where("k % 2 = 0"), rows.where("k % 2 = 1")], "m1")


@query("results_seed_filtered", f"with {PVALS} select gene, pval, k::double as EAC from pv where k > 50 and pval < 0.5")
def results_seed_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8, F18, F19."""
    rows = pvals(spark, sf_dir).select("gene", F.when(F.col("pval") < 0.5, F.col("pval")).alias("pval"), F.col("k").cast("double").alias("EAC"))
    return sinks.combined_seed_results([rows])[1]


@query("results_significant", f"""with {PVALS}, net as (select gene, min(pval) as pval from pv where method = 'ECONOMY' group by 1), base as (select gene, method, pval from pv where method <> 'ECONOMY'), comb as (select gene, min(pval) * count(*) as pval from base group by 1),
every as (select gene, 'network' as m, 'New discovery' as kind, pval from net union all select gene, method, 'Baseline', pval from base union all select gene, 'combined baseline', null, pval from comb),
c as (select *, pval * count(*) over (partition by m) as q from every), s as (select *, row_number() over (partition by gene, m order by pval) as i from c where q < 20)
select 'p' as phenotype, gene, m as "Method", kind as "Discovery type", round(pval, 9) as pval, round(q, 9) as pval_corrected from s where i = 1""")
def results_significant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Significant genes of a network and its baselines, the first row of each phenotype, gene and method."""
    rows = pvals(spark, sf_dir).withColumn("phenotype", F.lit("p"))
    network = rows.where("method = 'ECONOMY'").groupBy("phenotype", "gene").agg(F.min("pval").alias("pval"))
    base = rows.where("method <> 'ECONOMY'").select("phenotype", "gene", "pval", F.col("method").alias("Method"), F.lit(evaluate.BASELINE).alias("Discovery type"))
    found = evaluate.process_results(network, [base], 20.0, "Bonferroni")[0]
    return rounded(found, "pval", "pval_corrected", digits=9).select("phenotype", "gene", "Method", "Discovery type", "pval", "pval_corrected")


@query("results_display", f"with {PVALS} select k, case when method = 'ECONOMY' then 'The economy method' else replace(method, '_', ' ') end as label from pv")
def results_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X18."""
    return pvals(spark, sf_dir).select("k", scalar.display("method", {"ECONOMY": "The economy method"}).alias("label"))


@query("baseline_loaded", f"with {PVALS}, b as (select k, gene, pval from pv where k >= 50) select k, round(pval * count(*) over (), 6) as pval_corrected, 'Burden' as Method from b")
def baseline_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F18 (inclusive), M24: one baseline."""
    rows = evaluate.load_baseline(pvals(spark, sf_dir).withColumn("EAC", F.col("k")).drop("method"), "Burden", 50, correction="Bonferroni")
    return rounded(rows, "pval_corrected").select("k", "pval_corrected", "Method")


@query("seed_evaluation", f"with {PVALS}, s as (select method as phenotype, gene, pval, p_retailprice / 1000 as stat from pv join part on p_partkey = k where k > 50), b as (select *, pval * count(*) over (partition by phenotype) as q from s) select phenotype, count(*) filter (q < 0.9) as n_significant, count(distinct gene) filter (q < 0.9) as n_genes, round(median(stat) / 0.45493642311957283, 6) as lambda_gc from b group by 1")
def seed_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M26."""
    price = study.variants(spark, sf_dir).select(F.col("id").alias("k"), (F.col("price") / 1000).alias("stat"))
    rows = pvals(spark, sf_dir).join(price, "k").select(F.col("method").alias("phenotype"), "gene", "pval", "stat", F.col("k").cast("double").alias("EAC"))
    out = evaluate.evaluate_seed(rows, 0.9, 50).where("method = 'Bonferroni'").drop("method")
    return rounded(out, "lambda_gc")


@query("phenotype_joined", f"with {STUDY}, {BURDENS} select sample, gene, round(b, 6) as b, c_acctbal as y from burdens join customer on c_custkey = sample")
def phenotype_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J19, J18."""
    burdens = gene_test.collapse(study.weighted(study.carriers(spark, sf_dir)))
    return rounded(evaluate.with_phenotype(burdens, study.samples(spark, sf_dir).select("sample", "y")), "b").select("sample", "gene", "b", "y")


@query("covariate_export", "select c_custkey as FID, c_custkey as IID, c_nationkey::double as nation, c_acctbal as y from customer")
def covariate_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4."""
    return sinks.covariate_table(study.samples(spark, sf_dir), ["nation", "y"])


@query("alleles_split", "select p_partkey as pos, 'A' as ref, a.alt, p_brand as sample, case when p_size % 5 = 0 then -1 when a.k = 1 then cast(p_size % 2 = 0 as int) + cast(p_size % 3 = 0 as int) else cast(p_size % 2 = 1 as int) end as gt from part, (values (1, 'T'), (2, 'G')) a(k, alt)")
def alleles_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-allelic genotype strings to a dosage for each allele."""
    s = F.col("size")
    first = F.when(s % 2 == 0, "1").otherwise("2")
    second = F.when(s % 5 == 0, ".").when(s % 3 == 0, "1").otherwise("0")
    rows = study.variants(spark, sf_dir).select(F.lit("chr1").alias("chrom"), "pos", F.lit("A").alias("ref"), F.split(F.lit("T,G"), ",").alias("alts"), F.col("gene").alias("sample"), F.concat_ws("/", first, second).alias("genotype"))
    return readers.split_alleles(rows).select("pos", "ref", "alt", "sample", F.coalesce("gt", F.lit(-1)).alias("gt"))


@query("named_variants", "select p_partkey as id, p_type as chrom, p_type || '_' || p_partkey || '_A_T' as name from part")
def named_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S19."""
    rows = study.variants(spark, sf_dir).select("id", F.concat(F.lit("chr"), "chrom").alias("chrom"), "pos", F.lit("A").alias("ref"), F.lit("T").alias("alt"))
    return readers.named_variants(rows).select("id", "chrom", "name")


@query("y_transformed", "with m as (select avg(c_acctbal) as m, stddev_pop(c_acctbal) as s from customer) select c_custkey as sample, round((c_acctbal - m) / s, 6) as y, cast(c_acctbal < 0 as int) as y_binary from customer cross join m")
def y_transformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quantitative phenotype is transformed, a binary one isn't."""
    people = study.samples(spark, sf_dir).select("sample", "y", "y_binary")
    return rounded(transform.transform_y(transform.transform_y(people, "y", "standardize"), "y_binary", "standardize"), "y")


@query("network_trained")
def network_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A maximum-pooled network with heads for two phenotypes, fitted in seeded batches with a validation split; epoch and losses."""
    people = transform.standardize(study.samples(spark, sf_dir), ["y", "nation"])
    rows = study.carriers(spark, sf_dir).select("sample", "gene", "gt", "MAF", (F.col("size") / 50.0).alias("size"), (F.col("price") / 2000).alias("price"))
    net = deepset.random_network(3, hidden=4, wide=3, seed=1, sigmoid=False)
    heads = training.Heads.start(["y", "y_binary"], training.genes_of(rows), ["nation"])
    *_, history = training.fit(rows, people, ["MAF", "size", "price"], net, heads, epochs=3, batches=2)
    return spark.createDataFrame(history, "epoch int, train_loss double, val_loss double")


@query("correct_by_name", f"with {PVALS} select k, 'Bonferroni' as correction_method, round(pval * count(*) over (), 6) as pval_corrected from pv")
def correct_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3."""
    return rounded(multitest.correct(pvals(spark, sf_dir), "Bonferroni"), "pval_corrected").select("k", "correction_method", "pval_corrected")


