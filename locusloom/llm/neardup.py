"""Near-duplicate classes by BagMinHash signatures of multisets of word shingles.

The five-word shingles of a text (lower case, split at white space) form a bag;
two texts are near duplicates if the weighted Jaccard similarity of their bags is
0.8 or more. A class is a connected component of such links.

* Signatures: each shingle runs Poisson processes of points over discretised
  weight levels: one for each interval (0,1], (1,2], (2,4], (4,8] ... below its
  count, so equal shingles of other texts see the same points whatever their
  count. A point falls into a random slot; each slot keeps its earliest point. A
  text's processes stop once no later point can win a slot. Slots of two texts
  agree with a chance equal to the weighted Jaccard similarity.
* Candidates: texts whose signatures agree in a whole band. Each bucket is
  compared with its most central member only, never all pairs with each other.
* Texts of buckets that then still hold several classes are joined exactly by
  prefix filtering: in any common order of shingles, two bags at the similarity
  share one of the first (1 - similarity) of their elements. Shingles are ordered
  by a sketch of their counts, rarest first, so texts that agree in common
  passages only don't meet. Size and position in the prefix bound a pair's overlap.
* Every candidate pair is verified on its exact bags.

Texts with the same bag are one class from the start (copies), so only one text
of a bag is compared. A text of one to four words is one shingle of all its words.

Edge cases: all texts without words, null ones too, are copies of each other.
A row with a null doc_id can only be a copy: it has the class of an equal bag with
an id, else a null class. Repeated rows are copies; rows of one doc_id are one
document. Very long texts go through a batch of their own. No documents: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside, discarded, sent, slices, small_batches, written

WORDS, SIMILARITY = 5, 0.8
#: Slots of a signature, and the chance that two texts just at the similarity may have to agree in no band.
SLOTS, MISSED = 125, 1e-4
#: Words whose hashes a worker keeps; texts and characters taken at once.
CACHED, TEXTS, CHARS = 1 << 17, 128, 1 << 20
#: Cells of the sketch of shingle counts: at most so many numbers reach the driver and go out again.
CELL_BITS = 18
SALTS = 8
U = np.uint64
MIX_A, MIX_B, STEP = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)


def banded(similarity: float) -> tuple[int, int]:
    """Bands and slots of a band: the longest bands that miss few enough pairs. At 0.8 25 of 5, which miss 5e-5 of them (4e-10 at 0.9)."""
    for rows in range(SLOTS, 1, -1):
        if (1 - similarity**rows) ** (SLOTS // rows) <= MISSED:
            return SLOTS // rows, rows
    return SLOTS, 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * MIX_A
    x = (x ^ (x >> U(27))) * MIX_B
    return x ^ (x >> U(31))


def shingles(text: str | None, known: dict[str, int], words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the shingles of a whole text, repeats included."""
    parts = (text or "").lower().split()
    if not parts:
        return np.zeros(0, U)
    if len(known) > CACHED:
        known.clear()
    try:
        ids = np.fromiter(map(known.__getitem__, parts), U, len(parts))
    except KeyError:
        for w in set(parts).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        ids = np.fromiter(map(known.__getitem__, parts), U, len(parts))
    n = max(1, len(ids) - words + 1)
    h = np.zeros(n, U)
    for k in range(min(words, len(ids))):
        h = mixed(h + ids[k : k + n] + STEP)
    h.sort()
    return h


def copies(h: np.ndarray) -> np.ndarray:
    """Sorted hashes of a bag's shingles, each repeat with a hash of its own: sets of them intersect as the bags do."""
    if len(h) < 2:
        return h
    same = np.concatenate([[False], h[1:] == h[:-1]])
    if not same.any():
        return h
    at = np.arange(len(h))
    nth = at - np.maximum.accumulate(np.where(same, 0, at))
    return np.sort(np.where(nth > 0, mixed(h + nth.astype(U) * MIX_A), h))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags given by ``copies``; 1 for two empty ones."""
    both = np.sort(np.concatenate([a, b]))
    shared = int((both[1:] == both[:-1]).sum()) if len(both) else 0
    return shared / (len(both) - shared) if len(both) else 1.0


def uniform(state: np.ndarray) -> np.ndarray:
    """Doubles in (0, 1] of hashed states."""
    return ((state >> U(11)) + U(1)).astype(np.float64) * 2.0**-53


def signatures(bags: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """BagMinHash signatures (32-bit) of bags (sorted shingle hashes with repeats), all in one go; an empty bag has zeros."""
    sizes = [len(b) for b in bags]
    found = np.zeros((len(bags), slots), np.uint32)
    h = np.concatenate(bags) if bags else np.zeros(0, U)
    if not len(h):
        return found
    doc = np.repeat(np.arange(len(bags)), sizes)
    first = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
    starts = np.flatnonzero(first)
    h, doc, count = h[starts], doc[starts], np.diff(np.append(starts, len(h)))
    # one process for each interval of levels below the count: (0,1], then (2^(i-1), 2^i]
    levels = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, 1)
    owner = np.repeat(np.arange(len(h)), levels)
    level = np.arange(len(owner)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    width = np.where(level > 0, low, 1.0)
    state = mixed(h[owner] + level.astype(U) * STEP + STEP)
    doc, top = doc[owner], count[owner].astype(np.float64)
    time = np.zeros(len(owner))
    best = np.full(len(bags) * slots, np.inf)
    mark = np.zeros(len(bags) * slots, np.uint32)
    while len(state):
        state = mixed(state + STEP)
        time = time - np.log(uniform(state)) / width
        at = low + width * uniform(mixed(state ^ MIX_A))
        point = mixed(state ^ MIX_B)
        slot = doc * slots + ((point >> U(32)) % U(slots)).astype(np.int64)
        live = np.flatnonzero((np.ceil(at) <= top) & (time < best[slot]))
        if len(live):
            order = live[np.argsort(time[live], kind="stable")[::-1]]  # the earliest point of a slot is written last
            best[slot[order]] = time[order]
            mark[slot[order]] = point[order].astype(np.uint32)
        latest = best.reshape(-1, slots).max(1)
        keep = time < latest[doc]
        state, time, doc, low, width, top = (x[keep] for x in (state, time, doc, low, width, top))
    found[:] = mark.reshape(-1, slots)
    found[[n == 0 for n in sizes]] = 0
    return found


def signed(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, bag (a 128-bit hash of the whole bag), size, bands (a 64-bit key for each band)."""
    n, rows = banded(similarity)

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        seeds = mixed(np.arange(1, n + 1).astype(U) * STEP)
        for whole in batches:
            for batch, texts in slices(whole, 1, TEXTS, CHARS):
                bags = [shingles(t, known) for t in texts]
                sig = signatures(bags, n * rows).reshape(len(bags), n, rows).astype(U)
                keys = np.broadcast_to(seeds, (len(bags), n))
                for k in range(rows):
                    keys = mixed(keys + sig[:, :, k] + STEP)
                flat = pa.array(keys.astype(np.int64).ravel())
                bands = pa.ListArray.from_arrays(np.arange(0, len(bags) * n + 1, n, dtype=np.int32), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh3_128_digest(b.tobytes()) for b in bags], pa.binary()), pa.array([len(b) for b in bags], pa.int32()), bands], names=["doc_id", "bag", "size", "bands"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(taken, "doc_id long, bag binary, size int, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``pairs`` (a, b: representatives) whose bags have at least that similarity. ``texts``: rep, text."""
    rows = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for whole in batches:
            for batch, texts in slices(whole, 2, TEXTS, CHARS):
                alike, last, bag = [], None, None
                for ta, tb in zip(texts, batch.column(3), strict=True):
                    if ta != last:  # many rows in a row share their first text
                        last, bag = ta, copies(shingles(ta, known))
                    alike.append(jaccard(bag, copies(shingles(tb.as_py(), known))) >= similarity)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return small_batches(rows).select("a", "b", "ta", "tb").mapInArrow(checked, "a long, b long")


def cells(bag: np.ndarray) -> np.ndarray:
    return (bag >> U(64 - CELL_BITS)).astype(np.int64)


def sketch(texts: DataFrame) -> np.ndarray:
    """How many elements of all bags of ``texts`` (a column text) fall into each of 2^CELL_BITS cells of their hash."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        counts = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            for _, held in slices(batch, 0, TEXTS, CHARS):
                counts += np.bincount(cells(np.concatenate([copies(shingles(t, known)) for t in held])), minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["cell", "n"])

    rows = small_batches(texts).select("text").mapInArrow(counted, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = np.zeros(1 << CELL_BITS, np.int64)
    for r in rows.collect():
        counts[r["cell"]] = r["n"]
    return counts


def prefixes(texts: DataFrame, similarity: float) -> DataFrame:
    """token, rep, size, root, at: for each text (rep, root, text) the elements of its prefix with their place in it."""
    rarity = sent(texts.sparkSession, sketch(texts))

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        counts = rarity()
        for whole in batches:
            for batch, held in slices(whole, 2, TEXTS, CHARS):
                bags, found = [copies(shingles(t, known)) for t in held], []
                for bag in bags:
                    n = len(bag) - math.ceil(similarity * len(bag) - 1e-9) + 1
                    order = np.lexsort((bag, counts[cells(bag)]))  # the same order of elements in every text
                    found.append(bag[order[:n]].astype(np.int64))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                sizes = pa.array([len(b) for b in bags], pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], sizes, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found)))], names=["rep", "root", "size", "tokens"])

    rows = small_batches(texts).select("rep", "root", "text").mapInArrow(taken, "rep long, root long, size int, tokens array<long>")
    return rows.select("rep", "size", "root", F.posexplode("tokens").alias("at", "token"))


def across(left: DataFrame, texts: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The prefixes, written, and a, b: pairs of different classes that may have the similarity. ``left``: rep, root; ``texts``: rep, text."""
    tokens = written(prefixes(left.join(texts, "rep"), similarity), "tokens")
    several = tokens.groupBy("token").agg((F.min("root") != F.max("root")).alias("several")).where("several").select("token")
    some = tokens.join(several, "token")
    other = some.select("token", F.col("rep").alias("rep_b"), F.col("size").alias("size_b"), F.col("root").alias("root_b"), F.col("at").alias("at_b"))
    # what two bags at the similarity share at least, and what these can share at most (this element and all that follow it)
    shared = F.ceil(similarity / (1 + similarity) * (F.col("size") + F.col("size_b")) - 1e-9)
    rest = F.least(F.col("size") - F.col("at"), F.col("size_b") - F.col("at_b"))
    found = some.join(other, "token").where((F.col("root") < F.col("root_b")) & (F.least("size", "size_b") >= shared) & (rest >= shared))
    return tokens, found.select(F.least("rep", "rep_b").alias("a"), F.greatest("rep", "rep_b").alias("b")).distinct()


def looked_up(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """``rows`` left-joined with ``table`` on ``key``; a key that many rows share is dealt over SALTS tasks.

    Spark broadcasts ``table`` up to its own threshold, by the size before it is repeated: at most SALTS times that much.
    """
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    return dealt.join(table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "salt"], "left").drop("salt")


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for the nodes of ``links`` (a, b).

    Each round every node takes the least label next to it, and labels jump to
    their own label; stars end after two rounds, a chain of n after about log n.
    """
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        least = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        # a root whose members found a lower label follows them
        hooked = least.where("low < root").groupBy("root").agg(F.min("low").alias("to"))
        moved = written(looked_up(least, "root", hooked).select("node", "root", F.least("low", F.coalesce("to", "low")).alias("next")), "moved")
        jumps = moved.select("next").distinct().join(moved.select(F.col("node").alias("next"), F.col("next").alias("jump")), "next")
        after = written(looked_up(moved, "next", jumps).select("node", F.col("jump").alias("root"), (F.col("jump") != F.col("root")).alias("changed")), "labels")
        done = after.where("changed").isEmpty()
        discarded(labels, moved)
        if done:
            discarded(edges)
            return after.select("node", "root")
        labels = after


def classes(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and class_id (the least doc_id of the class) of every document. A lower ``similarity`` takes shorter bands and catches copies with more edits."""
    signs = written(signed(docs, text, similarity), "signatures")
    reps = written(signs.groupBy("bag").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("bands").alias("bands")), "bags")
    compared = reps.where(F.col("rep").isNotNull() & (F.col("size") > 0))
    bands = written(compared.select("rep", "size", F.explode("bands").alias("band")), "bands")
    full = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = written(bands.join(full, "band"), "members")
    discarded(bands)
    # the most central member of a bucket: the one whose buckets are the fullest
    weight = members.groupBy("rep").agg(F.sum("n").alias("weight"))
    weighed = members.join(weight, "rep")
    stars = weighed.groupBy("band").agg(F.max_by(F.struct("rep", "size"), F.struct(F.col("weight"), -F.col("rep"))).alias("star"))
    fits = F.least("size", "star.size") >= similarity * F.greatest("size", "star.size")
    first = members.join(stars, "band").where((F.col("rep") != F.col("star.rep")) & fits)
    first = written(first.select(F.col("star.rep").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    wanted = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col(text).cast("string").alias("text")).where("rep is not null")
    links = written(verified(first, wanted, similarity), "links")
    roots = components(links)
    # buckets that still hold several classes: different texts that agree in a band
    rooted = members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("band", "rep", "size", F.coalesce("root", "rep").alias("root"))
    several = rooted.groupBy("band").agg((F.min("root") != F.max("root")).alias("several")).where("several").select("band")
    left = written(rooted.join(several, "band").select("rep", "root").distinct(), "left")
    if not left.isEmpty():
        tokens, pairs = across(left, wanted, similarity)
        tested = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        rest = written(pairs.join(tested, ["a", "b"], "left_anti"), "rest")
        more = written(verified(rest, wanted, similarity), "links")
        roots = components(links.unionByName(more)) if not more.isEmpty() else roots
        discarded(tokens, rest, more)
    discarded(members, first, links, left)
    final = reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("bag", F.coalesce("root", "rep").alias("class_id"))
    return signs.select("doc_id", "bag").join(final, "bag").select("doc_id", "class_id")


def dedup(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the class id: one document of each class.

    Of several rows with one doc_id and equal texts, the one with the least hash of all its columns stays.
    """
    docs, names, back = aside(docs)
    text = names.get(text, text)
    kept = classes(docs, text, similarity).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]), "left_semi")
    whole = F.xxhash64(*[c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()])
    one = rows.groupBy("doc_id", F.xxhash64(text).alias("_text")).agg(F.min_by(F.struct(*docs.columns), whole).alias("_row"))
    return back(one.select("_row.*"))
