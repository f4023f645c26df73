"""Sampled segmentation over a SentencePiece lattice, and lossless decoding.

Pieces never run over a space or line end, so a text falls into units (spaces and
the word after them). For each distinct unit the lattice of its pieces is
forward-filtered once (log-sum of all paths to each position) and kept in a bounded
table; each occurrence then samples its pieces backward, all occurrences of a batch
at once. The random numbers are hashes of the seed, the row key, the unit's place and the step, so a
row's segmentation is the same wherever and whenever it is made.

The log-probability of a piece is -alpha log(2 + rank), with its merge rank from
the model. A character without a piece, and the space mark itself where it stands
in a text, is encoded by its UTF-8 bytes; so decoding gives back the exact text.

Edge cases: a null text counts as empty and has no pieces; a null key is a key
like any other; repeated rows (equal key and text) have equal segmentations. Very
long texts are handled as a batch of their own. No documents: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import sent, slices, small_batches

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Code points beyond Unicode that stand for the space mark in a text.
LITERAL_MARK = 0x110000
CHARS_A_BATCH = 1 << 19
#: Edges of lattices that a worker keeps: 17 bytes each.
KEPT_EDGES = 1 << 20
#: Ids decoded at once.
IDS_A_BATCH = 1 << 18
TABLE_BITS = 18
U = np.uint64
MIX_A, MIX_B, STEP = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * MIX_A
    x = (x ^ (x >> U(27))) * MIX_B
    return x ^ (x >> U(31))


class Pieces:
    """The pieces of a model: hash tables of all their prefixes, log-probabilities, and the bytes that each id decodes to.

    Made once on the driver and broadcast, so only the driver reads the model file.
    A prefix stands in the first table, or in the next one where its slot is taken.
    """

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes_of = [b""] * size
        self.byte_ids = np.zeros(256, np.int64)
        plain = []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
                plain.append((i, piece))
        ids, lengths = np.array([i for i, _ in plain]), np.array([len(x) for _, x in plain])
        points = np.zeros((len(plain), lengths.max()), U)
        for row, (_, piece) in enumerate(plain):
            points[row, : len(piece)] = np.frombuffer(piece.encode("utf-32-le"), np.uint32)
        keys, values, h = [], [], np.zeros(len(plain), U)
        for k in range(points.shape[1]):
            on = lengths > k
            h = mixed(h + points[:, k] + STEP)
            keys.append(h[on])
            values.append(np.where(lengths[on] == k + 1, ids[on], -1))
        keys, values = np.concatenate(keys), np.concatenate(values)
        order = np.lexsort((-values, keys))  # a whole piece before a mere prefix of the same hash
        keys, values = keys[order], values[order]
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        keys, values = keys[first], values[first].astype(np.int32)
        self.tables = []
        while len(keys):
            slots = self.slot(keys, len(self.tables))
            table, value = np.zeros(1 << TABLE_BITS, U), np.full(1 << TABLE_BITS, -1, np.int32)
            table[slots], value[slots] = keys, values
            self.tables.append((table, value))
            left = table[slots] != keys
            keys, values = keys[left], values[left]
        rank = np.array([-model.get_score(i) if self.bytes_of[i] else 0 for i in range(size)])
        self.log_p = -alpha * np.log(2 + np.maximum(rank, 0))
        self.log_byte = -alpha * np.log(2 + size)

    @staticmethod
    def slot(h: np.ndarray, table: int) -> np.ndarray:
        return ((h * (MIX_A + U(2 * table))) >> U(64 - TABLE_BITS)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is a prefix of a piece, and the id if it is a whole one (else -1)."""
        at = self.slot(h, 0)
        table, value = self.tables[0]
        there = table[at]
        known = there == h
        ids = np.where(known, value[at], np.int32(-1))
        miss = np.flatnonzero(~known & (there != 0))
        for k, (table, value) in enumerate(self.tables[1:], 1):
            if not len(miss):
                break
            at = self.slot(h[miss], k)
            there = table[at]
            hit = there == h[miss]
            known[miss[hit]], ids[miss[hit]] = True, value[at[hit]]
            miss = miss[~hit & (there != 0)]
        return known, ids


def units(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the units of concatenated texts begin: at texts, before spaces after another character, and around line ends."""
    space, line = points == ord(MARK), points == 10
    begins = np.zeros(len(points), bool)
    begins[starts] = True
    begins[1:] |= (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    return np.flatnonzero(begins)


def lattice(points: np.ndarray, begins: np.ndarray, sizes: np.ndarray, pieces: Pieces) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, the edges (source, target, id or -1 - code point for bytes) of the concatenated units.

    There is a node before each character and one at the end of each unit; a
    target has one edge of a length at most.
    """
    node = np.arange(len(points)) + np.repeat(np.arange(len(begins)), sizes)
    ends = np.repeat(begins + sizes, sizes)
    active, h, edges = np.arange(len(points)), np.zeros(len(points), U), []
    wide = points.astype(U) + STEP
    length = 0
    while len(active):
        h = mixed(h + wide[active + length])
        length += 1
        known, ids = pieces.find(h)
        if length == 1:
            edges.append((node, node + 1, np.where(ids >= 0, ids, -1 - points.astype(np.int64))))
        else:
            whole = np.flatnonzero(ids >= 0)
            source = node[active[whole]]
            edges.append((source, source + length, ids[whole]))
        go = np.flatnonzero(known & (active + length < ends[active]))
        active, h = active[go], h[go]
    return edges


def utf8_size(points: np.ndarray) -> np.ndarray:
    points = np.where(points == LITERAL_MARK, ord(MARK), points)
    return 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)


def filtered(points: np.ndarray, begins: np.ndarray, sizes: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, ...]:
    """The forward-filtered lattice of concatenated units: first edge of each node, and of the edges (together by target) source, id, chance and number of ids."""
    passes = lattice(points, begins, sizes, pieces)
    nodes = len(points) + len(begins)
    depth = np.arange(nodes) - np.repeat(begins + np.arange(len(begins)), sizes + 1)
    # edges in order of the target's position inside its unit, those of a target together
    degree = np.zeros(nodes, np.int64)
    for _, target, _ in passes:
        degree[target] += 1
    by_depth = np.argsort(depth.astype(np.int16) if depth.max() < 2**15 else depth, kind="stable")
    runs = degree[by_depth]
    first = np.empty(nodes, np.int64)
    first[by_depth] = np.cumsum(runs) - runs
    target = np.repeat(by_depth, runs)
    source, ids, place = np.empty(len(target), np.int64), np.empty(len(target), np.int64), first.copy()
    for source_, target_, ids_ in passes:
        to = place[target_]
        source[to], ids[to] = source_, ids_
        place[target_] += 1
    rare = np.flatnonzero(ids < 0)
    n_bytes = np.ones(len(ids), np.int64)
    n_bytes[rare] = utf8_size(-1 - ids[rare])
    log_p = pieces.log_p[np.maximum(ids, 0)]
    log_p[rare] = pieces.log_byte * n_bytes[rare]
    # forward: log-sums in order of the position inside the unit
    alpha = np.zeros(nodes)
    cut = np.cumsum(np.bincount(depth, degree).astype(np.int64))
    chance = np.empty(len(ids))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        value, to = alpha[source[a:b]] + log_p[a:b], target[a:b]
        seg = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        most = np.maximum.reduceat(value, seg)
        run = np.diff(np.append(seg, b - a))
        part = np.exp(value - np.repeat(most, run))
        total = np.add.reduceat(part, seg)
        alpha[to[seg]] = most + np.log(total)
        chance[a:b] = part / np.repeat(total, run)
        chance[a + np.append(seg[1:], b - a) - 1] = np.inf  # what is left falls to a node's last edge
    return first, source, ids, chance, n_bytes


class Sampler:
    """Samples texts; the filtered lattices of units that it has met stay in a table of at most KEPT_EDGES edges and one batch's.

    A unit's lattice depends on the unit alone, so what is kept changes no result.
    """

    def __init__(self, pieces: Pieces, seed: int):
        self.pieces, self.seed = pieces, seed
        self.clear()

    def clear(self) -> None:
        self.known, self.end = np.zeros(0, U), np.zeros(0, np.int32)  # hashes of units in order; the last node of each
        self.nodes = self.edges = 0
        self.first, self.source, self.ids = (np.zeros(0, np.int32) for _ in range(3))
        self.chance, self.n_bytes = np.zeros(0), np.zeros(0, np.int8)

    @staticmethod
    def extended(held: np.ndarray, n: int, new: np.ndarray) -> np.ndarray:
        if n + len(new) > len(held):
            held = np.concatenate([held[:n], np.empty(max(n, len(new)), held.dtype)])
        held[n : n + len(new)] = new
        return held

    def learn(self, flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Adds the lattices of the units at those places of ``flat``; the last node of each."""
        if not len(begins):
            return np.zeros(0, np.int32)
        starts = np.cumsum(sizes) - sizes
        points = flat[np.repeat(begins - starts, sizes) + np.arange(sizes.sum())]
        first, source, ids, chance, n_bytes = filtered(points, starts, sizes, self.pieces)
        end = self.nodes + starts + np.arange(len(starts)) + sizes
        self.first = self.extended(self.first, self.nodes, first + self.edges)
        self.source = self.extended(self.source, self.edges, source + self.nodes)
        self.ids, self.chance, self.n_bytes = self.extended(self.ids, self.edges, ids), self.extended(self.chance, self.edges, chance), self.extended(self.n_bytes, self.edges, n_bytes)
        self.nodes, self.edges = self.nodes + len(first), self.edges + len(ids)
        return end.astype(np.int32)

    def sample(self, texts: list[str], keys: list[str]) -> list[np.ndarray]:
        """Sampled piece ids of each text."""
        points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        sizes = np.array([len(p) for p in points])
        flat = np.concatenate(points) if points else np.zeros(0, np.uint32)
        if not len(flat):
            return [np.zeros(0, np.int32) for _ in texts]
        flat = np.where(flat == ord(MARK), np.uint32(LITERAL_MARK), np.where(flat == 32, np.uint32(ord(MARK)), flat))
        starts = np.cumsum(sizes) - sizes
        begins = units(flat, starts[sizes > 0])
        lengths = np.diff(np.append(begins, len(flat)))
        text_of = np.flatnonzero(sizes > 0)[np.searchsorted(starts[sizes > 0], begins, "right") - 1]
        # distinct units by a 64-bit hash of their characters and places
        inside = np.arange(len(flat)) - np.repeat(begins, lengths)
        ident = np.add.reduceat(mixed(flat.astype(U) + (inside.astype(U) + U(1)) * STEP), begins)
        if self.edges > KEPT_EDGES:
            self.clear()
        order = np.argsort(ident)
        ordered = ident[order]
        chosen = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        times = np.diff(np.append(chosen, len(order)))
        place = np.searchsorted(self.known, ordered[chosen])
        old = np.zeros(len(chosen), bool)
        old[place < len(self.known)] = self.known[place[place < len(self.known)]] == ordered[chosen[place < len(self.known)]]
        ends = np.empty(len(chosen), np.int32)
        ends[old] = self.end[place[old]]
        # units that a batch has once only, most of which never come again, stay for this batch only
        often, once = np.flatnonzero(~old & (times > 1)), np.flatnonzero(~old & (times == 1))
        ends[often] = self.learn(flat, begins[order[chosen[often]]], lengths[order[chosen[often]]])
        self.known, self.end = np.insert(self.known, place[often], ordered[chosen[often]]), np.insert(self.end, place[often], ends[often])
        kept = self.nodes, self.edges
        ends[once] = self.learn(flat, begins[order[chosen[once]]], lengths[order[chosen[once]]])
        self.nodes, self.edges = kept
        at = np.empty(len(begins), np.int32)
        at[order] = np.repeat(ends, times)
        # backward: every occurrence of a unit at once
        place = np.arange(len(begins)) - np.searchsorted(text_of, text_of)
        row = np.array([xxhash.xxh3_64_intdigest(f"{self.seed}:{k}") for k in keys], U)
        state = mixed(row[text_of] + place.astype(U) * STEP)
        occurrence, floor = np.arange(len(begins)), at - lengths.astype(np.int32)
        width, taken = np.zeros(len(begins), np.int64), []
        while len(at):
            state = mixed(state + STEP)
            u = (state >> U(11)).astype(np.float64) * 2.0**-53
            edge = self.first[at]
            more = np.flatnonzero(self.chance[edge] <= u)
            while len(more):
                u[more] -= self.chance[edge[more]]
                edge[more] += 1
                more = more[self.chance[edge[more]] <= u[more]]
            count = self.n_bytes[edge]
            width[occurrence] += count
            taken.append((occurrence, self.ids[edge], count))
            at = self.source[edge]
            go = np.flatnonzero(at > floor)
            at, occurrence, state, floor = at[go], occurrence[go], state[go], floor[go]
        back = np.cumsum(width)
        out = np.zeros(int(back[-1]), np.int32)
        for occ, ids, count in taken:
            back[occ] -= count
            out[back[occ]] = ids  # the bytes of a character without a piece follow
            for k in np.flatnonzero(ids < 0).tolist():
                point, to = -1 - int(ids[k]), int(back[occ[k]])
                raw = MARK.encode() if point == LITERAL_MARK else chr(point).encode("utf-8", "surrogatepass")
                out[to : to + len(raw)] = self.pieces.byte_ids[list(raw)]
        per_text = np.zeros(len(texts), np.int64)
        np.add.at(per_text, text_of, width)
        return np.split(out, np.cumsum(per_text)[:-1])


def sample(texts: list[str], keys: list[str], pieces: Pieces, seed: int) -> list[np.ndarray]:
    """Sampled piece ids of each text."""
    return Sampler(pieces, seed).sample(texts, keys)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", alpha: float = 1.0, seed: int = 0, model: str | None = None) -> DataFrame:
    """``docs`` with the sampled ids of ``text`` added as piece_ids (a column of that name is replaced)."""
    docs = small_batches(docs.drop("piece_ids"))
    at, by = docs.columns.index(text), docs.columns.index(key)
    pieces = sent(docs.sparkSession, Pieces(model or public_tokenizers.path(MODEL), alpha))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(pieces(), seed)
        for whole in batches:
            for batch, texts in slices(whole, at, whole.num_rows, CHARS_A_BATCH):
                ids = sampler.sample([t or "" for t in texts], [str(k) for k in batch.column(by).to_pylist()])
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))], names=[*batch.schema.names, "piece_ids"])

    return docs.mapInArrow(encoded, T.StructType([*docs.schema.fields, T.StructField("piece_ids", T.ArrayType(T.IntegerType()))]))


def joined(ids: np.ndarray, sizes: np.ndarray, flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> list[str]:
    """The texts of so many ids each; piece i is the ``lengths[i]`` bytes of ``flat`` from ``begins[i]`` on."""
    n = lengths[ids]
    stops = np.cumsum(n)
    raw = flat[np.repeat(begins[ids] - stops + n, n) + np.arange(int(stops[-1]) if len(n) else 0)].tobytes()
    bounds = np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:], strict=False)]


def decode(rows: DataFrame, ids: str = "piece_ids", model: str | None = None) -> DataFrame:
    """``rows`` with the exact text of ``ids`` added as decoded (a column of that name is replaced); null for null."""
    rows = small_batches(rows.drop("decoded"))
    at = rows.columns.index(ids)
    parts = Pieces(model or public_tokenizers.path(MODEL), 1.0).bytes_of
    lengths = np.array([len(x) for x in parts])
    table = sent(rows.sparkSession, (np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lengths) - lengths, lengths))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = table()
        for whole in batches:
            sizes, start = whole.column(at).value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0
            while start < whole.num_rows:
                stop = max(start + 1, start + int(np.searchsorted(np.cumsum(sizes[start:]), IDS_A_BATCH, "right")))
                batch = whole.slice(start, stop - start)
                texts = joined(batch.column(at).flatten().to_numpy(zero_copy_only=False), sizes[start:stop], *held)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string(), mask=batch.column(at).is_null().to_numpy(zero_copy_only=False))], names=[*batch.schema.names, "decoded"])
                start = stop

    return rows.mapInArrow(decoded, T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))
