"""Spectra of the variance-component test of genes too large for one task.

K = Z'PZ, with Z the samples' marker values and P the projection off the covariates,
is never built. Spark multiplies it with blocks of vectors over the carrier rows, which are packed once and
dealt by gene and sample: a step moves a gene's vectors to its calls and products back. Block Lanczos with complete
reorthogonalisation runs for many genes at once; all that the driver holds is a
few small matrices for each of a bounded wave of genes. The leading eigenvalues
are those whose residual is small. The start block is of random signs, so the other
Ritz values, with their weights in it as degrees of freedom, are a quadrature of the
rest of the spectrum; they are scaled to what is left of the exact traces of K and
K^2. A gene whose rank the blocks exhaust has its whole spectrum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mixture import mixture_tail
from ..functions.shared import discarded, sent, written
from .null_model import NullModel

#: Vectors of a block, blocks, and genes whose small matrices are on the driver at once.
BLOCK, STEPS, WAVE = 16, 8, 64
#: Relative residual of an eigenvalue that counts as found, and relative norm of a direction that counts as none.
FOUND, NONE = 1e-3, 1e-9
#: Markers of a block, calls of a packed row and calls of a gene in one task, about.
MARKERS, CALLS, SHARE = 4096, 1 << 16, 1 << 22

Small = dict[object, dict[str, np.ndarray]]


def moments(z: DataFrame, single: DataFrame, model: NullModel) -> DataFrame:
    """gene, trace, trace2: traces of K and K^2, from sums.

    z: gene, sample, marker, value, w. single: gene, marker, zx = sums of w x value x [1, covariates]. Only pairs of
    markers that share a carrier are made.
    """
    inverse, k = model.inverse, len(model.x) + 1
    form = lambda a: sum((F.lit(float(inverse[i][j])) * a(i) * a(j) for i in range(k) for j in range(k)), F.lit(0.0))
    a = z.select("gene", "sample", F.col("marker").alias("m1"), F.col("value").alias("v1"), "w")
    b = z.select("gene", "sample", F.col("marker").alias("m2"), F.col("value").alias("v2"))
    pairs = a.join(b, ["gene", "sample"]).where("m1 <= m2").groupBy("gene", "m1", "m2").agg(F.sum(F.col("w") * F.col("v1") * F.col("v2")).alias("zz"))
    squares = pairs.groupBy("gene").agg(F.sum(F.when(F.col("m1") == F.col("m2"), F.col("zz")).otherwise(0.0)).alias("_b"), F.sum(F.col("zz") * F.col("zz") * F.when(F.col("m1") == F.col("m2"), 1).otherwise(2)).alias("_bb"))
    # tr(inverse zx'B zx): for each sample the sum of its markers' zx
    walked = z.join(single.select("gene", "marker", "zx"), ["gene", "marker"]).groupBy("gene", "sample").agg(F.max("w").alias("w"), *[F.sum(F.col("value") * F.get("zx", F.lit(i))).alias(f"_t{i}") for i in range(k)])
    mixed = walked.groupBy("gene").agg(F.sum(F.col("w") * form(lambda i: F.col(f"_t{i}"))).alias("_bu"))
    sides = single.groupBy("gene").agg(*[F.sum(F.get("zx", F.lit(i)) * F.get("zx", F.lit(j))).alias(f"_u{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(i, k)])
    side = lambda i, j: F.col(f"_u{min(i, j)}_{max(i, j)}")
    u = sum((F.lit(float(inverse[i][j])) * side(i, j) for i in range(k) for j in range(k)), F.lit(0.0))
    # tr((inverse zx'zx)^2)
    product = lambda i, j: sum((F.lit(float(inverse[i][l])) * side(l, j) for l in range(k)), F.lit(0.0))
    uu = sum((product(i, j) * product(j, i) for i in range(k) for j in range(k)), F.lit(0.0))
    return squares.join(mixed, "gene").join(sides, "gene").select("gene", (F.col("_b") - u).alias("trace"), (F.col("_bb") - 2 * F.col("_bu") + uu).alias("trace2"))


def multiplied(z: DataFrame, vectors: DataFrame, block: int) -> DataFrame:
    """gene, marker, y = Z'WZ q of each marker's row. vectors: gene, marker, q."""
    parts = lambda weight, c: F.array(*[F.sum(weight * F.get(c, F.lit(i))) for i in range(block)])
    by_sample = z.join(vectors.select("gene", "marker", "q"), ["gene", "marker"]).groupBy("gene", "sample").agg(parts(F.col("value"), "q").alias("t"))
    return z.join(by_sample, ["gene", "sample"]).groupBy("gene", "marker").agg(parts(F.col("w") * F.col("value"), "t").alias("y"))


def wide(batch: pa.RecordBatch, name: str, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)[rows]


def by_gene(batch: pa.RecordBatch) -> Iterator[tuple[object, np.ndarray]]:
    genes = batch.column("gene").dictionary_encode()
    codes = genes.indices.to_numpy(zero_copy_only=False)
    for i, gene in enumerate(genes.dictionary.to_pylist()):
        yield gene, np.flatnonzero(codes == i)


def grams(table: DataFrame, products: Callable[[object, pa.RecordBatch, np.ndarray], list[np.ndarray]]) -> Small:
    """Sums over a gene's rows of small matrices, by gene; added up by Spark. products(gene, batch, rows) gives them for some rows."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for b in batches:
            for gene, rows in by_gene(b):
                for name, m in enumerate(products(gene, b, rows)):
                    total[gene, name, m.shape] = total.get((gene, name, m.shape), 0) + m
        for (gene, name, shape), m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([gene] * m.size), pa.array(np.full(m.size, name, np.int32)), pa.array(np.full(m.size, shape[1], np.int32)), pa.array(np.arange(m.size, dtype=np.int32)), pa.array(m.ravel())], names=["gene", "name", "width", "i", "v"])

    kind = table.schema["gene"].dataType.simpleString()
    found = table.mapInArrow(summed, f"gene {kind}, name int, width int, i int, v double").groupBy("gene", "name", "width", "i").agg(F.sum("v").alias("v")).toPandas()
    return {gene: {name: m.sort_values("i").v.to_numpy().reshape(-1, m.width.iloc[0]) for name, m in own.groupby("name")} for gene, own in found.groupby("gene")}


def root_inverse(gram: np.ndarray, scale: float) -> np.ndarray:
    """R with q = w R orthonormal for w'w = gram; columns of directions that are none are zero."""
    values, vectors = np.linalg.eigh(gram)
    use = values > (NONE * scale) ** 2
    return vectors * np.where(use, 1 / np.sqrt(np.where(use, values, 1)), 0)


def as_matrix(batch: pa.RecordBatch | pa.Table, name: str, row: int) -> np.ndarray:
    """A packed matrix of a row, with as many rows as the block has markers."""
    return batch.column(name)[row].values.to_numpy().reshape(batch.column("n")[row].as_py(), -1)


def kept(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by keys and held on the executors' disks: tables dealt alike are joined without a shuffle."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).persist(StorageLevel.DISK_ONLY)


class Packed:
    """A wave's markers and calls as rows of arrays: ``markers`` a row a (gene, block), ``calls`` some rows a (gene, part) of samples, ``parts`` a row a gene."""

    def __init__(self, z: DataFrame, single: DataFrame, block: int) -> None:
        kind = single.schema["gene"].dataType.simpleString()
        start = F.transform(F.sequence(F.lit(1), F.lit(block)), lambda i: F.when(F.xxhash64("marker", i) % 2 == 0, 1.0).otherwise(-1.0))
        size = single.groupBy("gene").agg(F.ceil(F.count("*") / MARKERS).alias("_blocks"))
        dealt = single.join(F.broadcast(size), "gene").select("gene", "marker", "zx", F.pmod(F.xxhash64("marker", F.lit("block")), F.col("_blocks")).cast("int").alias("block"))
        within = Window.partitionBy("gene", "block").orderBy("marker")
        self.numbered = written(dealt.withColumn("i", F.row_number().over(within) - 1), "numbered")
        blocks = self.numbered.groupBy("gene", "block").agg(F.count("*").cast("int").alias("n"))
        blocks = blocks.withColumn("first", (F.sum("n").over(Window.partitionBy("gene").orderBy("block")) - F.col("n")).cast("int"))
        placed = self.numbered.join(blocks.select("gene", "block", "first"), ["gene", "block"])

        def together(key: tuple, t: pa.Table) -> pa.Table:
            t = t.sort_by("i")
            flat = {c: [t.column(c).combine_chunks().flatten()] for c in ("zx", "w")}
            lists = {c: pa.ListArray.from_arrays(pa.array([0, len(v[0])], pa.int32()), v[0]) for c, v in flat.items()}
            return pa.table({"gene": t.column("gene")[:1], "block": t.column("block")[:1], "first": t.column("first")[:1], "n": pa.array([len(t)], pa.int32()), **lists})

        packed = placed.select("gene", "block", "first", "i", "zx", start.alias("w")).groupBy("gene", "block").applyInArrow(together, f"gene {kind}, block int, first int, n int, zx array<double>, w array<double>")
        self.markers = kept(packed, "gene", "block")
        # a gene's calls are dealt by sample: by number, and so that all cores have some
        calls = F.count("*")
        least = F.ceil(F.lit(2.0 * z.sparkSession.sparkContext.defaultParallelism) / F.count("*").over(Window.partitionBy()))
        counted = z.groupBy("gene").agg(calls.alias("_c")).withColumn("parts", F.greatest(F.ceil(F.col("_c") / SHARE), F.least(least, F.ceil(F.col("_c") / CALLS))).cast("int"))
        self.parts = written(counted.select("gene", "parts"), "parts")
        rows = z.join(placed.select("gene", "marker", (F.col("first") + F.col("i")).alias("place")), ["gene", "marker"]).join(F.broadcast(self.parts), "gene")
        rows = rows.select("gene", F.pmod(F.xxhash64("sample"), F.col("parts")).cast("int").alias("part"), "sample", "place", (F.col("value") * F.sqrt("w")).alias("v"))

        def dealt_out(key: tuple, t: pa.Table) -> pa.Table:
            sample = t.column("sample").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            place, v = t.column("place").to_numpy(), t.column("v").to_numpy()
            order = np.lexsort((place, sample))
            sample, place, v = sample[order], place[order], v[order]
            # calls of one sample and marker count as their sum
            own = np.flatnonzero(np.append(True, (np.diff(sample) != 0) | (np.diff(place) != 0)))
            sample, place, v = sample[own], place[own].astype(np.int32), np.add.reduceat(v, own)
            starts = np.flatnonzero(np.append(True, np.diff(sample) != 0))
            cuts = np.flatnonzero(np.append(True, np.diff(starts // CALLS) != 0))
            ends = np.append(cuts[1:], len(starts))
            out = {"starts": [], "place": [], "v": []}
            for a, e in zip(cuts, ends, strict=True):
                low, high = starts[a], starts[e] if e < len(starts) else len(place)
                out["starts"].append((starts[a:e] - low).astype(np.int64).tobytes())
                out["place"].append(place[low:high].tobytes())
                out["v"].append(v[low:high].tobytes())
            some = pa.array(np.zeros(len(cuts), np.int64))
            return pa.table({"gene": t.column("gene").take(some), "part": t.column("part").take(some), **{c: pa.array(x, pa.binary()) for c, x in out.items()}})

        self.calls = kept(rows.groupBy("gene", "part").applyInArrow(dealt_out, f"gene {kind}, part int, starts binary, place binary, v binary"), "gene", "part")

    def dropped(self) -> None:
        self.calls.unpersist()
        self.markers.unpersist()
        discarded(self.numbered, self.parts)


def calls_of(chunks: pa.Table | pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each sample's calls start, their markers' places and values; by place within a sample."""
    return tuple(np.frombuffer(chunks.column(c)[row].as_buffer(), kind) for c, kind in (("starts", np.int64), ("place", np.int32), ("v", np.float64)))


def packed_product(packed: Packed, vectors: DataFrame, diagonal: bool = False) -> DataFrame:
    """gene, block, y: the parts that add up to Z'WZ [q, zx] of the markers of a block, zx only if vectors have it, and the diagonal of Z'WZ as a last column if wanted. vectors: gene, block, first, n, q.

    A task has a gene's vectors, that is a number a marker and column, and the calls of a part of its samples.
    """
    kind, columns = vectors.schema["gene"].dataType.simpleString(), [c for c in ("q", "zx") if c in vectors.columns]

    def product(key: tuple, chunks: pa.Table, blocks: pa.Table) -> pa.Table:
        first, n = blocks.column("first").to_pylist(), blocks.column("n").to_pylist()
        parts = [np.hstack([as_matrix(blocks, c, r) for c in columns]) for r in range(len(n))]
        q = np.empty((sum(n), parts[0].shape[1] if parts else 0))
        for f, m in zip(first, parts, strict=True):
            q[f : f + len(m)] = m
        y = np.zeros((len(q), q.shape[1] + diagonal))
        for row in range(chunks.num_rows):
            starts, place, v = calls_of(chunks, row)
            by_sample = np.add.reduceat(q[place] * v[:, None], starts, axis=0)
            t = np.repeat(by_sample, np.diff(np.append(starts, len(place))), axis=0)
            if diagonal:
                t = np.column_stack([t, v])
            order = np.argsort(place, kind="stable")
            t, place = t[order] * v[order, None], place[order]
            own = np.flatnonzero(np.append(True, np.diff(place) != 0))
            y[place[own]] += np.add.reduceat(t, own, axis=0)
        return pa.table({"gene": blocks.column("gene"), "block": blocks.column("block"), "y": pa.array([y[f : f + k].ravel() for f, k in zip(first, n, strict=True)], pa.list_(pa.float64()))})

    to = vectors.join(F.broadcast(packed.parts), "gene").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("gene", "part", "block", "first", "n", *columns)
    return packed.calls.groupBy("gene", "part").cogroup(to.groupBy("gene", "part")).applyInArrow(product, f"gene {kind}, block int, y array<double>")


def off_diagonal(calls: DataFrame) -> dict[object, float]:
    """The sum of squares of Z'WZ above its diagonal, by gene. Only pairs of markers that share a carrier are made."""
    kind = calls.schema["gene"].dataType.simpleString()

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                starts, place, v = calls_of(b, row)
                # the calls that have a further one of their sample, lag by lag
                ends = np.repeat(np.append(starts[1:], len(place)), np.diff(np.append(starts, len(place))))
                at, lag = np.arange(len(place)), 1
                while len(at := at[at + lag < ends[at]]):
                    pair = place[at].astype(np.int64) << 32 | place[at + lag]
                    yield pa.RecordBatch.from_arrays([b.column("gene").take(pa.array(np.full(len(at), row))), pa.array(pair), pa.array(v[at] * v[at + lag])], names=["gene", "pair", "zz"])
                    lag += 1

    pairs = calls.select("gene", "starts", "place", "v").mapInArrow(paired, f"gene {kind}, pair long, zz double").groupBy("gene", "pair").agg(F.sum("zz").alias("zz"))
    return {r["gene"]: r["s"] for r in pairs.groupBy("gene").agg(F.sum(F.col("zz") * F.col("zz")).alias("s")).collect()}


def lanczos(z: DataFrame, single: DataFrame, model: NullModel, block: int = BLOCK, steps: int = STEPS) -> dict[object, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Leading eigenvalues of K, and values and degrees of freedom for the rest, of each gene of a wave."""
    return {gene: found[:3] for gene, found in lanczos_and_traces(z, single, model, block, steps).items()}


def lanczos_and_traces(z: DataFrame, single: DataFrame, model: NullModel, block: int = BLOCK, steps: int = STEPS) -> dict[object, tuple[np.ndarray, np.ndarray, np.ndarray, float, float]]:
    """``lanczos``, and the traces of K and K^2 by the formula of ``moments``.

    Of the basis only new blocks move between executors; the tables of a step are dealt by block and stay where they are.
    """
    inverse, spark, packed = np.array(model.inverse), z.sparkSession, Packed(z, single, block)
    kind, k = single.schema["gene"].dataType.simpleString(), len(inverse)
    markers, basis, files = packed.markers, [], []

    def over(products: Callable[[object, pa.RecordBatch, int], list[np.ndarray]]) -> Callable:
        return lambda gene, b, rows: [sum(m) for m in zip(*(products(gene, b, int(r)) for r in rows), strict=True)]

    def new_block(table: DataFrame, made: Callable[[object, pa.RecordBatch, int], np.ndarray]) -> DataFrame:
        def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                genes = b.column("gene").to_pylist()
                for r, gene in enumerate(genes):
                    q = pa.array([made(gene, b, r).ravel()], pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([b.column("gene").slice(r, 1), b.column("block").slice(r, 1), q], names=["gene", "block", name])

        name = f"q{len(basis)}"
        # written, since each block's plan would hold those of all before it
        files.append(written(table.mapInArrow(mapped, f"gene {kind}, block int, {name} array<double>"), "basis"))
        return kept(files[-1], "gene", "block")

    found = grams(markers, over(lambda _, b, r: [as_matrix(b, "w", r).T @ as_matrix(b, "w", r)]))
    roots = {gene: root_inverse(m[0], 1e-300) for gene, m in found.items()}
    first = {gene: np.linalg.pinv(r) for gene, r in roots.items()}
    size = {gene: 0.0 for gene in found}
    t = {gene: np.zeros((block * steps, block * steps)) for gene in found}
    traces, residual, old = {}, {}, []
    held = sent(spark, roots)
    basis.append(new_block(markers, lambda gene, b, r, held=held: as_matrix(b, "w", r) @ held()[gene]))
    for step in range(steps):
        vectors = markers.join(basis[-1], ["gene", "block"])
        # the covariates' sums go along once, for the traces
        y = packed_product(packed, vectors.select("gene", "block", "first", "n", F.col(f"q{step}").alias("q"), *(["zx"] if not step else [])), diagonal=not step)
        y = kept(y, "gene", "block")
        joined = markers.drop("w", "first")
        for v in basis:
            joined = joined.join(v, ["gene", "block"])
        joined = joined.join(y.groupBy("gene", "block").agg(F.collect_list("y").alias("ys")), ["gene", "block"])

        def so_far(b: pa.RecordBatch, r: int, step=step) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            y = b.column("ys")[r].values
            return np.hstack([as_matrix(b, f"q{i}", r) for i in range(step + 1)]), y.flatten().to_numpy().reshape(len(y), b.column("n")[r].as_py(), -1).sum(0), as_matrix(b, "zx", r)

        def projected(_: object, b: pa.RecordBatch, r: int, so_far=so_far, step=step) -> list[np.ndarray]:
            all_, y, zx = so_far(b, r)
            sums = [all_.T @ y[:, :block], all_.T @ zx, zx.T @ all_[:, -block:]]
            return sums if step else [*sums, zx.T @ y[:, block:-1], zx.T @ zx, np.array([[y[:, -1].sum(), (y[:, -1] ** 2).sum()]])]

        found = grams(joined, over(projected))
        if not step:
            above = off_diagonal(packed.calls)
            for gene, m in found.items():
                own = inverse @ m[4]
                traces[gene] = m[5][0, 0] - np.trace(own), m[5][0, 1] + 2 * above.get(gene, 0.0) - 2 * (inverse * m[3]).sum() + (own * own.T).sum()
        c = {gene: inverse @ m[2] for gene, m in found.items()}
        h = {gene: m[0] - m[1] @ c[gene] for gene, m in found.items()}
        for gene, m in h.items():
            t[gene][: len(m), step * block : (step + 1) * block] = m
            t[gene][step * block : (step + 1) * block, : len(m)] = m.T
            size[gene] = max(size[gene], float(np.abs(m).sum(0).max()))
        held = sent(spark, (c, h))

        def left(gene: object, b: pa.RecordBatch, r: int, held=held, so_far=so_far) -> list[np.ndarray]:
            (c, h), (all_, y, zx) = held(), so_far(b, r)
            w = y[:, :block] - zx @ c[gene] - all_ @ h[gene]
            return [w.T @ w, all_.T @ w]

        found = grams(joined, over(left))
        again = {gene: h[gene] + m[1] for gene, m in found.items()}
        residual = {gene: m[0] - m[1].T @ m[1] for gene, m in found.items()}
        roots = {gene: root_inverse(m, size[gene]) for gene, m in residual.items()}
        if step + 1 == steps or all(not np.any(r) for r in roots.values()):
            old.append(y)
            break
        held = sent(spark, (c, again, roots))

        def remaining(gene: object, b: pa.RecordBatch, r: int, held=held, so_far=so_far) -> np.ndarray:
            (c, h, roots), (all_, y, zx) = held(), so_far(b, r)
            return (y[:, :block] - zx @ c[gene] - all_ @ h[gene]) @ roots[gene]

        basis.append(new_block(joined, remaining))
        old.append(y)
    for table in (*basis, *old):
        table.unpersist()
    discarded(*files)
    packed.dropped()
    out = {}
    for gene, m in t.items():
        values, vectors = np.linalg.eigh(m)
        last = vectors[step * block : (step + 1) * block]
        gap = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", last, residual[gene], last), 0))
        degrees = ((first[gene].T @ vectors[:block]) ** 2).sum(0) / block
        some, leading = values > NONE * size[gene], gap <= FOUND * values
        out[gene] = values[some & leading], values[some & ~leading], degrees[some & ~leading], *map(float, traces[gene])
    return out


def spectra(z: DataFrame, single: DataFrame, model: NullModel, genes: DataFrame, block: int = BLOCK, steps: int = STEPS) -> DataFrame:
    """gene, q, n_markers, pval of ``genes`` from leading eigenvalues and traces.

    z and single as in ``moments``, single with zr = sums of value x residual.
    """
    numbered = written(genes.select("gene", F.pmod(F.xxhash64("gene"), F.lit(-(-genes.count() // WAVE) or 1)).alias("wave")), "waves")
    waves = [r["wave"] for r in numbered.select("wave").distinct().collect()]
    kind = genes.schema["gene"].dataType.simpleString()
    some = lambda df, chosen: df.join(chosen, "gene", "left_semi")
    found: dict = {}
    for wave in waves:
        own = numbered.where(F.col("wave") == wave).select("gene")
        found |= lanczos_and_traces(some(z, own), some(single, own), model, block, steps)
    held, sigma2 = sent(z.sparkSession, found), model.sigma2

    def tested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leading = held()
        for b in batches:
            p = []
            for gene, q in zip(b.gene, b.q, strict=True):
                w, rest, degrees, trace, trace2 = leading.get(gene, (*(np.zeros(0),) * 3, 0.0, 0.0))
                first, second = trace - w.sum(), trace2 - (w**2).sum()
                if first <= 1e-9 * trace or second <= 0:
                    rest, degrees = rest[:0], degrees[:0]
                elif not (degrees * rest).sum() > 0:
                    rest, degrees = np.array([second / first]), np.array([first * first / second])
                else:
                    times = second / first / ((degrees * rest**2).sum() / (degrees * rest).sum())
                    rest, degrees = rest * times, degrees * first / (times * (degrees * rest).sum())
                p.append(mixture_tail(q, np.append(w, rest) * sigma2, np.append(np.ones(len(w)), degrees)))
            yield b[["gene", "q", "n_markers"]].assign(pval=np.array(p, float))

    q = some(single, numbered).groupBy("gene").agg(F.sum(F.col("zr") * F.col("zr")).alias("q"), F.count("*").cast("int").alias("n_markers"))
    return q.mapInPandas(tested, f"gene {kind}, q double, n_markers int, pval double")
