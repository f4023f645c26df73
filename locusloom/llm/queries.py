"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, chat, crosstoken, digest, exactdup, langid, licenses, linededup, neardup, packing, quality, subwords, topk
from .common import held_out, table

QUALITY_THRESHOLD = 0.3


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document and of its edited text, and their likeness."""
    return digest.with_next(table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, n_logged, chat_chars, chat_md5 of the maximal conversations."""
    chats = chat.format_chats(table(spark, sf_dir, "conversations"))
    return chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "n_logged", F.char_length("chat_text").cast("long").alias("chat_chars"), F.md5("chat_text").alias("chat_md5"))


OP3_SQL = """
with t as (select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
r as (select conv_id, turn, role, text, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) as part,
             md5(role) || md5(text) as mark from t),
p as (select conv_id, string_agg(mark, '') over w as prefix, string_agg(part, '') over w as chat,
             row_number() over w as k, count(*) over (partition by conv_id) as n
      from r window w as (partition by conv_id order by turn nulls first, role, text rows between unbounded preceding and current row)),
whole as (select prefix, min(conv_id) as conv_id, count(*) as n_logged, any_value(n) as n_turns, any_value(chat) as chat from p where k = n group by prefix)
select conv_id, cast(n_turns as bigint) as n_turns, n_logged, cast(length(chat) as bigint) as chat_chars, md5(chat) as chat_md5
from whole where prefix not in (select prefix from p where k < n)
"""


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and class_id (the least doc_id of its near-duplicate class) of every document."""
    return neardup.classes(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its digest and its place in a sequence."""
    pieces = packing.pieces(table(spark, sf_dir, "documents"))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op6_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_md5 and whether decoding gave back the text, for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = subwords.decode(subwords.encode(docs))
    return rows.select("doc_id", F.size("piece_ids").alias("n_pieces"), F.xxhash64("piece_ids").alias("ids_hash"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document, filed under <source>/p<n>/q<n>/; every seventh is a licence file of its directory."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    n = F.col("doc_id")
    upper = F.concat_ws("/", "source", F.concat(F.lit("p"), n % 50))
    path = F.when(n % 14 == 0, F.concat(upper, F.lit("/LICENSE-"), n)).when(n % 7 == 0, F.concat(upper, F.lit("/q"), n % 3, F.lit("/LICENSE-"), n))
    docs = docs.withColumn("path", path.otherwise(F.concat(upper, F.lit("/q"), n % 3, F.lit("/"), n, F.lit(".txt")))).drop("source")
    return licenses.scan(docs).select("doc_id", "own_licence", "cosine", "inherited_from", "licence")


def op7_sql() -> str:
    """The same by DuckDB: cosines of all runs of lines and of whole licence files, without a gate of tell-tale words, then the deepest directory above with a licence file."""
    quoted = lambda texts: ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(texts))
    words = "list_filter(regexp_split_to_array(lower({}), '" + licenses.NOT_WORD + "'), lambda w: w <> '')"

    def cosines(k: str, texts: list[tuple[str, str]], docs: str) -> str:
        """CTEs of {k}cos (header, licence, cosine): headers of {k}hw (header, word, tf) against the texts, with document frequencies of docs."""
        return f"""{k}t(template, licence, notice) as (values {quoted(texts)}),
{k}tw as (select template, word, count(*) as tf from (select template, unnest({words.format("notice")}) as word from {k}t) group by all),
{k}df as (select word, count(*) as df from (select distinct doc_id, unnest({words.format("text")}) as word from {docs}) where word in (select word from {k}tw) group by word),
{k}idf as (select word, ln(((select count(*) from {docs}) + 1) / (coalesce(df, 0) + 1)) + 1 as idf from (select distinct word from {k}tw) left join {k}df using (word)),
{k}tv as (select template, word, tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by template)) as y from {k}tw join {k}idf using (word)),
{k}w as (select header, word, tf * coalesce(idf, ln((select count(*) from {docs}) + 1) + 1) as w, idf is not null as inside from {k}hw left join {k}idf using (word)),
{k}v as (select header, word, w / norm as x from {k}w join (select header, sqrt(sum(w * w)) as norm from {k}w group by header) using (header) where inside),
{k}cos as (select header, licence, round(sum(x * y), 9) as cosine from {k}v join {k}tv using (word) join {k}t using (template) group by header, licence, template)"""

    return f"""
with d as (select doc_id, text, case when doc_id % 14 = 0 then source || '/p' || (doc_id % 50) || '/LICENSE-' || doc_id
        when doc_id % 7 = 0 then source || '/p' || (doc_id % 50) || '/q' || (doc_id % 3) || '/LICENSE-' || doc_id
        else source || '/p' || (doc_id % 50) || '/q' || (doc_id % 3) || '/' || doc_id || '.txt' end as path from documents),
f as (select doc_id, text, regexp_replace(path, '/?[^/]*$', '') as dir, regexp_matches(regexp_extract(path, '[^/]*$'), '{licenses.LICENCE_FILES}') as holder from d),
files as (select doc_id, text from f where holder),
l as (select doc_id, line, row_number() over (partition by doc_id order by spot) as i from (select doc_id, unnest(string_split(lower(text), chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as spot from d) where regexp_matches(line, '[a-z0-9]')),
lw as (select doc_id, i, word, count(*) as tf from (select doc_id, i, unnest({words.format("line")}) as word from l) group by all),
ln as (select doc_id, i, n, sum(n) over (partition by doc_id order by i) as upto from (select doc_id, i, sum(tf) as n from lw group by all)),
runs as (select {{'d': a.doc_id, 'a': a.i, 'b': b.i}} as header, a.doc_id as doc_id, a.i as a, b.i as b from ln a join ln b on a.doc_id = b.doc_id and b.i between a.i and a.i + {licenses.LONGEST} and (a.i = b.i or b.upto - a.upto + a.n <= {licenses.LONGEST})),
rhw as (select header, word, sum(tf) as tf from runs join lw on lw.doc_id = runs.doc_id and i between a and b group by all),
whw as (select doc_id, word, count(*) as tf from (select doc_id, unnest({words.format("text")}) as word from files) group by all),
shw as (select * from rhw union all select {{'d': doc_id, 'a': 0, 'b': 0}}, word, tf from whw),
fhw as (select doc_id as header, word, tf from whw),
{cosines("s", licenses.TEMPLATES, "d")},
{cosines("f", licenses.full_texts(), "files")},
own as (select doc_id, max({{'cosine': cosine, 'licence': licence}}) as o from (select header.d as doc_id, licence, cosine from scos union all select header, licence, cosine from fcos) where cosine >= {licenses.LEAST} group by doc_id),
held as (select dir as above, max(o) as lic from f join own using (doc_id) where holder group by dir),
near as (select f.doc_id, arg_max({{'above': above, 'licence': lic.licence}}, length(above)) as n from f join held on f.dir = above or starts_with(f.dir, above || '/') or above = '' group by f.doc_id)
select doc_id, o.licence as own_licence, o.cosine as cosine, case when o is null then n.above end as inherited_from, coalesce(o.licence, n.licence) as licence
from f left join own using (doc_id) left join near using (doc_id)
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_md5 of every document."""
    found = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.md5("text").alias("kept_md5"))


OP8_SQL = f"""
with a as (select doc_id, source, string_split(text, chr(10)) as ls from documents),
l as (select doc_id, source, unnest(ls) as line, generate_subscripts(ls, 1) as spot from a),
k as (select doc_id, source, line, spot, trim(line, ' ' || chr(9) || chr(13)) as t from l),
b as (select t, min({{'d': doc_id, 'p': spot}}) as first from k where t <> '' group by t having count(distinct source) >= {linededup.MIN_SITES}),
m as (select k.doc_id, k.spot, k.line, coalesce(b.first is not null and b.first <> {{'d': k.doc_id, 'p': k.spot}}, false) as gone from k left join b using (t))
select doc_id, count(*) as n_lines, cast(sum(gone::int) as bigint) as n_removed,
       md5(coalesce(string_agg(line, chr(10) order by spot) filter (where not gone), '')) as kept_md5
from m group by doc_id
"""


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: five best of each vector whose id is divisible by 50."""
    return topk.search(table(spark, sf_dir, "embeddings"), lambda id_: id_ % 50 == 0)


OP10_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as a from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.a, c.a), lambda z: z[1] * z[2])) as bigint) as score
      from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 5
"""


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, filter_order, step and what the step's filter keeps, removes, repeats and alone catches, for every order of five filters."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
with d as (select coalesce(source, '') as part, doc_id, coalesce(text, '') as t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from d),
f as (select part, doc_id, (len(ws) < 50)::int + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::int
             + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(min(doc_id) over (partition by t) < doc_id, false)::int as mask from w),
g as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
m as (select part, mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from f left join g using (doc_id) group by part, mask),
l as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) as v(name, bit)),
o as (select a.name || b.name || c.name || d.name || e.name as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
      from l a, l b, l c, l d, l e where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s as (select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::int as before from o, (select unnest([1, 2, 3, 4, 5]) as step)),
r as (select part, filter_order, step, bit,
             sum(case when mask & (before | bit) = 0 then n else 0 end) as kept, sum(case when mask & before = 0 and mask & bit <> 0 then n else 0 end) as removed,
             sum(case when mask & before <> 0 and mask & bit <> 0 then n else 0 end) as redundant, sum(case when mask = bit then n else 0 end) as unique_fails,
             sum(case when mask & before = 0 and mask & bit <> 0 then good else 0 end) as good_lost, sum(case when mask & before = 0 and mask & bit <> 0 then toxic else 0 end) as toxic_lost
      from m, s group by part, filter_order, step, bit)
select part, filter_order, cast(step as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
       cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, bit) as bigint) as shapley from r
"""


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document."""
    return exactdup.duplicates(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as t, length(coalesce(text, '')) as chars from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by t) as group_size, row_number() over w = 1 as kept, sha256(t) as text_sha256
from n window w as (partition by t order by chars desc, doc_id nulls last rows between unbounded preceding and unbounded following)
"""


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    return crosstoken.align(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_fingerprints": op2_fingerprints,
    "op3_chat": op3_chat,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_packing": op5_packing,
    "op6_subwords": op6_subwords,
    "op7_licenses": op7_licenses,
    "op8_line_dedup": op8_line_dedup,
    "op9_language_id": op9_language_id,
    "op10_top_k": op10_top_k,
    "op11_filter_audit": op11_filter_audit,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES: dict[str, str] = {"op3_chat": OP3_SQL, "op7_licenses": op7_sql(), "op8_line_dedup": OP8_SQL, "op10_top_k": OP10_SQL, "op11_filter_audit": OP11_SQL, "op12_exact_dedup": OP12_SQL}
