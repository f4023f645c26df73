"""Exact top-k inner-product search by a three-phase uniform threshold.

Vectors are cut into slices of dimensions; a slice ranks all vectors for a query
by its partial product, and the score is the sum of the partials.

1. Each block of a slice gives its longest partials and its least one (local
   score lists). Vectors on the merged lists are scored exactly; the k-th best
   score is a bound that the result can't fall below.
2. Above the slices' least partials, the bound's m-th part is a safe cutoff for
   each of the m slices: a vector that stays below it in all slices can't reach
   the bound. The cutoffs go out with the query blocks, and every block sends all
   its entries at or above them.
3. Entries known in all slices raise the bound; those whose best case (the cutoff
   in each slice where they weren't sent) reaches it are scored exactly.

Equal vectors are searched once: a distinct vector keeps its k+1 least ids, which
suffice for any query. Queries and candidates meet in blocks on an equi-join. No
table is broadcast, so what the driver holds doesn't grow with the vectors.

Edge cases: vectors that are null or hold null or non-finite components take no
part; shorter vectors count as padded with zeros; repeated rows count once, and
of several vectors of one id the least in array order counts. Partial
products beyond 2^61 are set to that bound. A null id takes no part. No vectors: no
rows. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SLICES = 2
#: Vectors in a block of candidates and of queries; entries in a local score list for each asked for.
CANDIDATES, QUERIES, LISTED = 2048, 512, 8
SALTS = 64
LONG = np.iinfo(np.int64)


def scaled(x: float = 256.0):
    """Each component x as floor(256 x), x as double."""
    return lambda column: F.transform(column, lambda v: F.floor(v.cast("double") * F.lit(x)))


def clean(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    """id, vec (array of long) of the vectors that take part, one row an id."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == F.lit(float("inf"))))
    rows = vectors.where(F.col(id_).isNotNull() & F.col(vector).isNotNull() & ~bad)
    return rows.select(F.col(id_).cast("long").alias("id"), scaled()(vector).alias("vec")).groupBy("id").agg(F.min("vec").alias("vec"))


def distinct(rows: DataFrame, k: int) -> DataFrame:
    """rep (the least id), vec, ids (the k+1 least ids) of each distinct vector; a salt first keeps groups small."""
    least = lambda c: F.slice(F.sort_array(c), 1, k + 1)
    salted = rows.groupBy("vec", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")).agg(least(F.collect_list("id")).alias("ids"))
    return salted.groupBy("vec").agg(least(F.flatten(F.collect_list("ids"))).alias("ids")).select(F.element_at("ids", 1).alias("rep"), "vec", "ids")


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact: in doubles where they are integers there, else in Python integers."""
    most = int(np.abs(q).max(initial=0, where=q != LONG.min)) * int(np.abs(c).max(initial=0, where=c != LONG.min)) * max(1, q.shape[1])
    if most < 2**53 and (q != LONG.min).all() and (c != LONG.min).all():
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    exact = q.astype(object) @ c.astype(object).T
    return np.clip(exact, LONG.min // 4, LONG.max // 4).astype(np.int64) if exact.size else np.zeros((len(q), len(c)), np.int64)


def matrix(column: pa.Array, i: int) -> np.ndarray:
    rows = column[i].values
    return np.asarray(rows.flatten()).reshape(len(rows), -1).astype(np.int64)


def blocked(rows: DataFrame, name: str, size: int, total: int, width: int, slices: int, others: int, other: str, extra: list[str]) -> DataFrame:
    """Blocks of about ``size`` rows, a row for each slice and block of the other side: ids, vectors of the slice, extra arrays."""
    blocks = max(1, -(-total // size))
    step = -(-width // slices)
    padded = F.concat("vec", F.array_repeat(F.lit(0).cast("long"), F.lit(step * slices) - F.size("vec")))
    dealt = rows.select(F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int").alias(name), "rep", padded.alias("vec"), *extra)
    dealt = dealt.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).withColumn("vec", F.slice("vec", F.col("s") * step + 1, F.lit(step)))
    packed = dealt.groupBy(name, "s").agg(F.collect_list(F.struct("rep", "vec", *extra)).alias("rows"))
    packed = packed.select(name, "s", *[F.col(f"rows.{c}").alias(f"{name}_{c}") for c in ("rep", "vec", *extra)])
    return packed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))


def local_lists(listed: int):
    """For each query of a block: the ``listed`` best candidates by partial product, and the least partial."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, c = np.asarray(batch.column("q_rep")[i].values), np.asarray(batch.column("c_rep")[i].values)
                scores = products(matrix(batch.column("q_vec"), i), matrix(batch.column("c_vec"), i))
                n = min(listed, len(c))
                top = np.argpartition(-scores, n - 1, axis=1)[:, :n]
                best = np.take_along_axis(scores, top, 1)
                whole = pa.ListArray.from_arrays(np.arange(0, n * len(q) + 1, n, dtype=np.int32), pa.StructArray.from_arrays([pa.array(best.ravel()), pa.array(c[top].ravel())], ["part", "rep"]))
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.full(len(q), batch.column("s")[i].as_py(), np.int32)), pa.array(scores.min(1)), whole], names=["q", "s", "least", "list"])

    return found


def sufficient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All entries of a block at or above their query's cutoff in the slice."""
    for batch in batches:
        for i in range(batch.num_rows):
            s = batch.column("s")[i].as_py()
            q, c = np.asarray(batch.column("q_rep")[i].values), np.asarray(batch.column("c_rep")[i].values)
            cutoffs = matrix(batch.column("q_cutoffs"), i)[:, s]
            scores = products(matrix(batch.column("q_vec"), i), matrix(batch.column("c_vec"), i))
            row, col = np.nonzero(scores >= cutoffs[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(q[row]), pa.array(c[col]), pa.array(np.full(len(row), s, np.int32)), pa.array(scores[row, col])], names=["q", "c", "s", "part"])


def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact scores of pairs of vectors."""
    for batch in batches:
        lengths = np.concatenate([np.diff(np.asarray(batch.column(k).offsets)) for k in (2, 3)])
        if len(lengths) and (lengths == lengths[0]).all() and lengths[0]:
            a, b = (np.asarray(batch.column(k).flatten()).reshape(-1, lengths[0]) for k in (2, 3))
            if (np.abs(a) < 2**31).all() and (np.abs(b) < 2**31).all() and float(np.abs(a).max()) * float(np.abs(b).max()) * lengths[0] < 2**62:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((a * b).sum(1))], names=["q", "c", "score"])
                continue
        scores = []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            n = min(len(a), len(b))
            scores += products(np.asarray(a.values)[None, :n].astype(np.int64), np.asarray(b.values)[None, :n].astype(np.int64)).ravel().tolist() if n else [0]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.int64())], names=["q", "c", "score"])


def shuffled(side: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast: it grows with the vectors, and its files are many times smaller than its rows are on the driver."""
    return side.hint("merge")


def scored(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """q, c, score of pairs of distinct vectors."""
    vec = lambda name, to: shuffled(reps.select(F.col("rep").alias(name), F.col("vec").alias(to)))
    return pairs.select("q", "c").join(vec("q", "_a"), "q").join(vec("c", "_b"), "c").select("q", "c", "_a", "_b").mapInArrow(resolved, "q long, c long, score long")


def best(scores: DataFrame, n: int) -> DataFrame:
    """The n best rows of each query, ties to the smaller candidate."""
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "c")
    return scores.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def search(vectors: DataFrame, is_query, k: int = 5, id_: str = "vec_id", vector: str = "embedding", slices: int = SLICES) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k other vectors of highest integer inner product."""
    rows = written(clean(vectors, id_, vector), "vectors")
    reps = written(distinct(rows, k), "distinct")
    asking = rows.where(is_query(F.col("id"))).select(F.col("id").alias("query_id"), "vec").join(shuffled(reps.select("vec", F.col("rep").alias("q"))), "vec").select("query_id", "q")
    asking = written(asking, "queries")
    queries = reps.join(shuffled(asking.select(F.col("q").alias("rep")).distinct()), "rep")
    size = reps.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width")).first()
    n, width, asked = size["n"], max(1, size["width"] or 1), queries.count()
    slices = max(1, min(slices, width, 62))  # a bit of a long for each
    n_c, n_q = max(1, -(-n // CANDIDATES)), max(1, -(-asked // QUERIES))
    need = k + 1

    against = blocked(reps, "c", CANDIDATES, n, width, slices, n_q, "q", [])
    meet = lambda ask: blocked(ask, "q", QUERIES, asked, width, slices, n_c, "c", [x for x in ask.columns if x == "cutoffs"]).join(shuffled(against), ["q", "c", "s"])
    entry = "array<struct<part:long,rep:long>>"
    lists = written(meet(queries).select("s", "q_rep", "q_vec", "c_rep", "c_vec").mapInArrow(local_lists(LISTED * need), f"q long, s int, least long, list {entry}"), "lists")
    merged = lists.groupBy("q", "s").agg(F.min("least").alias("least"), F.slice(F.sort_array(F.flatten(F.collect_list("list")), asc=False), 1, LISTED * need).alias("list"))
    merged = written(merged, "merged")
    seen = written(scored(merged.select("q", F.explode("list.rep").alias("c")).distinct(), reps), "seen")
    # no bound where a query has fewer than k+1 scored vectors
    bound = best(seen, need).groupBy("q").agg(F.when(F.count("*") >= need, F.min("score")).alias("bound"))
    least = merged.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("s", "least"))).alias("l")).select("q", F.col("l.least").alias("least"))
    total = F.aggregate("least", F.lit(0).cast("long"), lambda a, x: a + x)
    above = F.ceil((F.col("bound") - total) / F.lit(slices).cast("double")) - 1  # one less, in case the quotient was rounded
    cutoffs = written(least.join(shuffled(bound), "q").select("q", "least", F.transform("least", lambda x: F.when(F.col("bound").isNull(), x).otherwise(x + F.greatest(above, F.lit(0)))).alias("cutoffs")), "cutoffs")

    sent = meet(queries.join(shuffled(cutoffs.select(F.col("q").alias("rep"), "cutoffs")), "rep")).select("s", "q_rep", "q_vec", "q_cutoffs", "c_rep", "c_vec")
    sums = sent.mapInArrow(sufficient, "q long, c long, s int, part long").groupBy("q", "c").agg(F.sum("part").alias("part"), F.count("*").alias("n"), F.expr("bit_or(shiftleft(1L, s))").alias("mask"))
    entries = written(sums, "entries")
    full = entries.where(F.col("n") == slices).select("q", "c", F.col("part").alias("score"))
    exact = written(full.unionByName(seen).groupBy("q", "c").agg(F.max("score").alias("score")), "exact")
    raised = best(exact, need).groupBy("q").agg(F.when(F.count("*") >= need, F.min("score")).alias("raised"))
    missing = F.aggregate(F.transform("cutoffs", lambda x, i: F.when(F.getbit("mask", i) == 0, x - 1).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)
    open_ = entries.where(F.col("n") < slices).join(shuffled(cutoffs), "q").join(shuffled(raised), "q").where(F.col("raised").isNull() | (F.col("part") + missing >= F.col("raised")))
    rest = scored(open_.select("q", "c").join(shuffled(seen.select("q", "c")), ["q", "c"], "left_anti"), reps)

    top = best(exact.unionByName(rest), need).join(shuffled(reps.select(F.col("rep").alias("c"), "ids")), "c")
    top = top.groupBy("q").agg(F.collect_list(F.struct("score", "ids")).alias("top"))
    one = asking.join(shuffled(top), "q").select("query_id", F.explode("top").alias("t")).select("query_id", F.col("t.score").alias("score"), F.explode("t.ids").alias("vec_id")).where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return one.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
