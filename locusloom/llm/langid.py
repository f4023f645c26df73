"""Language identification: family first, then one-versus-one linear SVMs inside the family.

Features are hashed byte trigrams of the whole lower-cased text, with digits and
ASCII symbols turned into spaces. The models are fitted on a bounded sample of
labelled rows (``max_rows``); every text is scored in Arrow batches. The score is
the product of the least chances of the winner against another family and against
another language of its family. Every language of the labelled rows is learned;
many that no listed family has are put into families of ``ODD`` each, so their
pairs grow slower than the square of their number.

Edge cases: a tie of votes goes to the greater sum of chances, then to the first
name. A null text, and one without a letter, is ``und`` with score 0.
Without a learnable row every text is ``und``. Repeated rows are scored alike.
Very long texts are counted in chunks. No documents: no rows. Columns of the input
other than the text are never read for a prediction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discarded, learnable, sent, slices, small_batches, written

# Language codes by family (public classification of languages).
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "lb", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
}

UNDETERMINED = "und"
#: Languages without a listed family that are families of their own; more of them are put together, so many in one.
ODD = 16
#: Pairs of classes that have an SVM: 16 KB each at the default dimensions. More are an error, and no language is left out.
MOST_PAIRS = 1 << 14
DIMS = 4096
CHUNK = 1 << 20
TEXTS = 512
LETTER = regex.compile(r"\p{L}")
#: Bytes that aren't ASCII letters or part of a longer character become spaces.
LETTERS_ONLY = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
BLANK = 0x202020


def family_of(lang: str) -> str:
    """The family of a language code; an unlisted code is a family of its own."""
    return next((name for name, codes in FAMILIES.items() if lang in codes), lang)


def families_of(langs: list[str]) -> dict[str, str]:
    """The family of each of ``langs``; where more than ODD are unlisted, neighbours in order share one."""
    out = {x: family_of(x) for x in langs}
    odd = sorted(x for x, f in out.items() if f not in FAMILIES)
    return out | {x: f"unlisted-{i // ODD:04d}" for i, x in enumerate(odd)} if len(odd) > ODD else out


def trigram_vector(text: str, dims: int = DIMS) -> np.ndarray:
    """Unit vector of square-rooted hashed trigram counts; long texts are counted in chunks."""
    raw = (" " + text.lower() + " ").encode("utf-8", "replace").translate(LETTERS_ONLY)
    counts = np.zeros(dims, np.int64)
    for at in range(0, max(1, len(raw) - 2), CHUNK):
        b = np.frombuffer(raw[at : at + CHUNK + 2], np.uint8).astype(np.uint32)
        code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        code = code[code != BLANK]
        counts += np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=dims)[:dims]
    x = np.sqrt(counts).astype(np.float32)
    norm = float(np.linalg.norm(x))
    return x / norm if norm else x


def fit_svm(x: np.ndarray, y: np.ndarray, ridge: float = 2e-4, steps: int = 120) -> np.ndarray:
    """Squared-hinge linear SVM by accelerated gradient steps; classes weigh alike. The last weight is the bias."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1] + 1, np.float32)
    rate, momentum = 1 / (4 + ridge), 1.0
    for _ in range(steps):
        pull = weight * y * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1]))
        grad = ridge * v - 2 * np.append(pull @ x, pull.sum())
        new = v - rate * grad
        after = (1 + math.sqrt(1 + 4 * momentum**2)) / 2  # Python floats keep the arrays in single precision
        v, w, momentum = new + (momentum - 1) / after * (new - w), new, after
    return w


def fitted(vectors: np.ndarray, langs: list[str], sides: list[dict[str, int]]) -> np.ndarray:
    """A column of weights for each pair of classes, whose languages ``sides`` names with their sign."""
    columns = []
    for side in sides:
        rows = [i for i, x in enumerate(langs) if x in side]
        columns.append(fit_svm(vectors[rows].astype(np.float32), np.array([side[langs[i]] for i in rows], np.float32)))
    return np.array(columns, np.float32).reshape(len(columns), vectors.shape[1] + 1).T


class Drawn:
    """The drawn rows' vectors as a table (lang, h, x): each pair of classes is fitted in a task, and only weights reach the driver."""

    def __init__(self, table: DataFrame, dims: int):
        self.table, self.dims = table, dims
        self.counts = {r["lang"]: r["count"] for r in table.groupBy("lang").count().collect()}

    def __len__(self) -> int:
        return sum(self.counts.values())

    def fitted(self, sides: list[dict[str, int]]) -> np.ndarray:
        dims = self.dims

        def one(pair: pa.Table) -> pa.Table:
            # rows are put into an order of their own, whatever way they came
            order = np.lexsort((pair.column("h").to_numpy(), pair.column("lang").to_numpy()))
            x = np.empty((len(order), dims), np.float32)
            at = np.empty(len(order), np.int64)
            at[order] = np.arange(len(order))
            start = 0
            for chunk in pair.column("x").chunks:
                for v in chunk:
                    x[at[start]] = np.frombuffer(v.as_buffer(), np.float16)
                    start += 1
            weights = fit_svm(x, pair.column("side").to_numpy()[order].astype(np.float32))
            return pa.table({"pair": pair.column("pair").slice(0, 1), "w": pa.array([weights.tobytes()], pa.binary())})

        roles = self.table.sparkSession.createDataFrame([(x, k, y) for k, side in enumerate(sides) for x, y in side.items()], "lang string, pair int, side int")
        found = self.table.join(F.broadcast(roles), "lang").groupBy("pair").applyInArrow(one, "pair int, w binary").collect() if sides else []
        out = np.zeros((dims + 1, len(sides)), np.float32)
        for r in found:
            out[:, r["pair"]] = np.frombuffer(r["w"], np.float32)
        return out


class Hierarchy:
    """Pairs of classes with their SVMs: one set between families, one inside each family."""

    def __init__(self, vectors: np.ndarray | Drawn, langs: list[str]):
        self.langs = sorted(set(langs))
        family = families_of(self.langs)
        self.families = sorted(set(family.values()))
        members = [[x for x in self.langs if family[x] == f] for f in self.families]
        if (n := sum(math.comb(len(x), 2) for x in (self.families, *members))) > MOST_PAIRS:
            raise ValueError(f"{len(self.langs)} languages need {n} pairs of classes, at most {MOST_PAIRS} are allowed")
        self.groups, sides = [], []
        sets = [(self.families, lambda x: family[x])] + [(x, lambda x: x) for x in members]
        for names, truth in sets:
            pairs = []
            for i, a in enumerate(names):
                for j in range(i + 1, len(names)):
                    pairs.append((i, j, len(sides)))
                    sides.append({x: 1 if truth(x) == a else -1 for x in self.langs if truth(x) in (a, names[j])})
            self.groups.append((names, pairs))
        self.weights = vectors.fitted(sides) if isinstance(vectors, Drawn) else fitted(vectors, langs, sides)

    @staticmethod
    def choose(margins: np.ndarray, names: list[str], pairs: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Winner of the pairwise votes (ties by summed chance) and its least chance against another class."""
        votes = np.zeros((len(margins), len(names)))
        least = np.ones((len(margins), len(names)))
        for a, b, k in pairs:
            chance = 1 / (1 + np.exp(-np.clip(4 * margins[:, k], -40, 40)))
            votes[:, a] += (chance >= 0.5) + 1e-3 * chance
            votes[:, b] += (chance < 0.5) + 1e-3 * (1 - chance)
            least[:, a] = np.minimum(least[:, a], chance)
            least[:, b] = np.minimum(least[:, b], 1 - chance)
        best = votes.argmax(1)
        return best, least[np.arange(len(best)), best]

    def predict(self, vectors: np.ndarray) -> tuple[list[str], np.ndarray]:
        margins = vectors @ self.weights[:-1] + self.weights[-1]
        family, sure = self.choose(margins, *self.groups[0])
        langs = np.empty(len(vectors), dtype=object)
        for k in range(len(self.families)):
            rows = np.flatnonzero(family == k)
            if len(rows):
                names, pairs = self.groups[k + 1]
                best, chance = self.choose(margins[rows], names, pairs)
                langs[rows] = np.array(names, dtype=object)[best]
                sure[rows] *= chance
        return list(langs), sure


def fit(docs: DataFrame, max_rows: int = 6000, dims: int = DIMS) -> Hierarchy | None:
    """Fit on about ``max_rows`` learnable rows in all, as many of each language; None without any.

    Rows are drawn by a hash of doc_id and text, and equal vectors count once. The
    vectors stay in a table; a pair of classes, of ``max_rows`` rows or so at most (2
    bytes a dimension: 48 MB at the default), is fitted in a task, and its weights
    reach the driver. Every value of lang is learned; more of them than MOST_PAIRS
    allows are an error.
    """
    known = docs.where(learnable(F.col("doc_id")) & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_PAIRS + 1).collect()}
    if not counts:
        return None
    if len(counts) > MOST_PAIRS:
        raise ValueError(f"more than {MOST_PAIRS} languages")
    each = max_rows / len(counts)
    rate = F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(1.0, each / n))])
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit("langid")), F.lit(1 << 24)) / float(1 << 24) < rate[F.col("lang")]
    sample = known.where(drawn & F.col("text").rlike(r"\p{L}")).select("lang", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in slices(whole, 1, TEXTS, CHUNK):
                rows = [trigram_vector(t, dims).astype(np.float16).tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["lang", "x"])

    table = written(small_batches(sample).mapInArrow(vectors, "lang string, x binary").distinct().select("lang", F.xxhash64("x").alias("h"), "x"), "language_vectors")
    drawn = Drawn(table, dims)
    model = Hierarchy(drawn, list(drawn.counts)) if len(drawn) else None
    discarded(table)
    return model


def predict(docs: DataFrame, model: Hierarchy | None, dims: int = DIMS, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and lang_score added (columns of these names are replaced)."""
    docs = small_batches(docs.drop("lang_pred", "lang_score"))
    at, schema = docs.columns.index(text), T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    held = sent(docs.sparkSession, model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = held()
        for whole in batches:
            for batch, texts in slices(whole, at, TEXTS, CHUNK):
                langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
                rows = [i for i, t in enumerate(texts) if fitted and t and LETTER.search(t)]
                if rows:
                    names, sure = fitted.predict(np.array([trigram_vector(texts[i], dims) for i in rows]))
                    for i, name in zip(rows, names, strict=True):
                        langs[i] = name
                    scores[rows] = sure
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "lang_score"])

    return docs.mapInArrow(scored, schema)


def identify(docs: DataFrame, max_rows: int = 6000) -> DataFrame:
    """Fit on ``docs`` and predict every row of it."""
    return predict(docs, fit(docs, max_rows))
