"""Digests, packing, subwords and line dedup against plain forms of them."""

import functools
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from locusloom.llm import digest, linededup, packing, subwords
from locusloom.llm.common import table
from locusloom.llm.queries import ORACLES, QUERIES
from pyspark.sql import functions as F


def test_digest_query_against_plain_order(spark, data):
    got = {r["doc_id"]: r for r in QUERIES["op2_fingerprints"](spark, data).collect()}
    docs = sorted(((r["doc_id"], r["text"] or "") for r in table(spark, data, "documents").collect()), reverse=True)
    assert len(got) == len(docs)
    for (doc_id, text), (_, following) in zip(docs, [*docs[1:], docs[0]], strict=True):
        new = digest.edited(text, following)
        r = got[doc_id]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["fingerprint"] == digest.fingerprint(text) and r["edited_fingerprint"] == digest.fingerprint(new)
        assert r["near_edited"] == digest.likeness(r["fingerprint"], r["edited_fingerprint"])
        assert r["near_next"] == digest.likeness(r["fingerprint"], digest.fingerprint(following))
    longer = [r for r in got.values() if r["n_chars"] > 300]
    assert np.mean([r["near_edited"] for r in longer]) > np.mean([r["near_next"] for r in longer]) + 0.1


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=300), st.text(max_size=300))
def test_likeness_is_bounded(a, b):
    x, y = digest.fingerprint(a), digest.fingerprint(b)
    assert 0 <= digest.likeness(x, y) <= 1 and digest.likeness(x, x) == 1 and digest.likeness(x, y) == digest.likeness(y, x)


def test_digest_chunks(monkeypatch):
    text = "some words in a row " * 500
    whole = digest.fingerprint(text)
    monkeypatch.setattr(digest, "CHUNK", 1001)
    assert digest.fingerprint(text) == whole


def test_digest_odd(spark, odd_documents, no_documents):
    rows = digest.with_next(odd_documents).collect()
    assert len(rows) == 10 and all(0 <= r["near_next"] <= 1 for r in rows)
    assert {r["fingerprint"] for r in rows if r["n_chars"] == 0} == {digest.fingerprint("")}
    assert digest.with_next(no_documents).count() == 0
    one = digest.with_next(odd_documents.limit(1)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1
    assert digest.fingerprints(odd_documents).where(F.col("fingerprint") == "x").count() == 0


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@functools.cache
def fast_tokenizer():
    return packing.encoder(public_tokenizers.path(packing.VOCABULARY), packing.added_tokens(public_tokenizers.path(packing.TOKENIZER)))


def plain_ids(texts):
    return [[*e.ids, packing.END] for e in tokenizer().encode_batch(texts, add_special_tokens=False)]


def check_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def test_packing_query(spark, data):
    rows = QUERIES["op5_packing"](spark, data).collect()
    docs = [(r["doc_id"], r["text"] or "") for r in table(spark, data, "documents").collect()]
    want = dict(zip([d for d, _ in docs], plain_ids([t for _, t in docs]), strict=True))
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by.keys() == want.keys()
    for doc_id, pieces in by.items():
        pieces.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert all(r["length"] == 1024 for r in pieces[1:])
        ids, at = want[doc_id], 0
        for r in pieces:
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(part)
            at += r["length"]
        assert at == len(ids)
    n, total = check_packed(rows, 1024), sum(map(len, want.values()))
    assert n <= 1.02 * total / 1024 + 2


def test_token_ids_of_blanks():
    """A million blanks, more than the encoder's pattern bears, with text and special tokens around; the other way of splitting gives the same ids."""
    tokens = fast_tokenizer()
    with pytest.raises(ValueError, match="stack"):
        tokens.encode_to_numpy(" " * 1_000_000)
    ids = packing.token_ids(tokens, "a<|endoftext|>" + " " * 1_000_000 + "b")
    assert tokens.decode(ids.tolist()) == "a<|endoftext|>" + " " * 1_000_000 + "b" and 50256 in ids

    class Refusing:
        def __getattr__(self, name):
            return getattr(tokens, name)

        def encode_to_numpy(self, *_, **__):
            raise ValueError

    for text in ("a <|endoftext|> b  c\n\n d's 12 漢字 🙂", "", "   ", "<|endoftext|><|endoftext|>", " x" * 50 + "\t\t y"):
        assert packing.token_ids(Refusing(), text).tolist() == packing.token_ids(tokens, text).tolist() == tokenizer().encode(text, add_special_tokens=False).ids


def test_packing_special_tokens(spark, tmp_path):
    """The query's and the pipeline's ids equal those of the unmodified tokenizer where texts hold special tokens."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\ny  <|endoftext|>  z", "<|endoftext |> <|end|> <|ENDOFTEXT|>", "漢字 <|endoftext|>é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: np.array([*tokens.encode(t, add_special_tokens=False).ids, packing.END], "<u4").tobytes() for i, t in enumerate(texts)}
    assert 50256 in np.frombuffer(want[0], "<u4")
    assert {r["doc_id"]: bytes(r["ids"]) for r in corpus_pipeline.packing_stage(spark, docs, "").collect()} == want
    assert {r["doc_id"]: r["ids_crc32"] for r in QUERIES["op5_packing"](spark, str(tmp_path)).collect()} == {i: zlib.crc32(b) for i, b in want.items()}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=80) | st.text(alphabet="<|endoftxT> \n'é漢1", max_size=40) | st.sampled_from(["<|endoftext|>", " <|endoftext|>", "<|endoftext|"]), max_size=5))
def test_fast_ids_are_the_tokenizers(parts):
    """Added tokens included; the tokenizer is the file's, unmodified."""
    text = "".join(parts)
    assert [*fast_tokenizer().encode(text, allowed_special="all"), packing.END] == plain_ids([text])[0]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 50), min_size=1))
def test_plan_fits(counts):
    slots = packing.plan(counts, 40)
    ranks, rows = {}, []
    for length, first, n, sequence, offset in slots:
        assert ranks.get(length, 0) == first
        ranks[length] = first + n
        rows += [{"sequence_id": sequence + i, "offset": offset, "length": length} for i in range(n)]
    assert ranks == counts
    n = check_packed(rows, 40)
    room = []  # best fit, a piece at a time
    for length in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= length]
        if fits:
            room[min(fits)[1]] -= length
        else:
            room.append(40 - length)
    assert n == len(room)


def test_packing_odd(spark, odd_documents, no_documents):
    kept = packing.pack(odd_documents.withColumn("length", F.lit(5)))
    assert kept.columns == [*[c for c in odd_documents.columns if c not in ("length", "offset")], "length", "sequence_id", "offset"] or set(kept.columns) == {*odd_documents.columns, "sequence_id"}
    assert kept.count() == 10 and {r["_row"] for r in kept.collect()} == {"x"}
    rows = packing.pack_documents(odd_documents).collect()
    check_packed(rows, 1024)
    assert sum(r["doc_id"] == 1 for r in rows) == 2
    assert {r["length"] for r in rows if r["doc_id"] in (2, 3)} == {1}
    assert sum(r["length"] for r in rows if r["doc_id"] == 9) == len(plain_ids(["▁ é 漢字 <|endoftext|> \U0001f642\tx"])[0])
    assert packing.pack_documents(no_documents).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text(alphabet=" ▁ab\n\té漢", max_size=60), min_size=1, max_size=5))
def test_subwords_round_trip(texts):
    pieces = subwords_pieces()
    for text, ids in zip(texts, subwords.sample(texts, [str(i) for i in range(len(texts))], pieces, 0), strict=True):
        raw = b"".join(pieces.bytes_of[i] for i in ids.tolist())
        assert raw.decode("utf-8", "surrogatepass") == text


def subwords_pieces(alpha=1.0, kept={}):  # noqa: B006
    if alpha not in kept:
        kept[alpha] = subwords.Pieces(public_tokenizers.path(subwords.MODEL), alpha)
    return kept[alpha]


def test_sampling_follows_the_lattice():
    """Frequencies of segmentations of one word against all its paths."""
    pieces = subwords_pieces()
    word = "there"
    by_bytes = {b: i for i, b in enumerate(pieces.bytes_of) if b}

    def paths(rest):
        if not rest:
            return [((), 0.0)]
        out = []
        for n in range(1, len(rest) + 1):
            i = by_bytes.get(rest[:n].encode())
            if i is not None:
                out += [((i, *tail), pieces.log_p[i] + lp) for tail, lp in paths(rest[n:])]
        return out

    every = dict(paths(word))
    total = np.logaddexp.reduce(list(every.values()))
    n = 20_000
    seen = subwords.sample([word] * n, [str(i) for i in range(n)], pieces, 3)
    counts = {}
    for ids in seen:
        counts[tuple(ids.tolist())] = counts.get(tuple(ids.tolist()), 0) + 1
    assert set(counts) <= set(every)
    for path, lp in every.items():
        p = np.exp(lp - total)
        assert abs(counts.get(path, 0) / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-3


def plain_sample(text, key, seed, pieces, by_text):
    """One text's segmentation, a unit and a character at a time, with the same random numbers."""
    low = 2**64 - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & low
        x = (x ^ x >> 27) * 0x94D049BB133111EB & low
        return x ^ x >> 31

    step, out = 0x9E3779B97F4A7C15, []
    for place, unit in enumerate(re.findall(r"\n| +[^ \n]*|[^ \n]+", text)):
        edges = []  # of each position: (length, ids, log-probability)
        for end in range(1, len(unit) + 1):
            here = []
            for n in range(1, end + 1):
                part = unit[end - n : end]
                raw = part.encode()
                if part in by_text and "▁" not in part:
                    here.append((n, [by_text[part]], pieces.log_p[by_text[part]]))
                elif n == 1:
                    here.append((1, [int(pieces.byte_ids[b]) for b in raw], pieces.log_byte * len(raw)))
            edges.append(here)
        alpha = [0.0]
        for end, here in enumerate(edges, 1):
            alpha.append(np.logaddexp.reduce([alpha[end - n] + lp for n, _, lp in here]))
        state, at, ids = mix((xxhash.xxh3_64_intdigest(f"{seed}:{key}") + place * step) & low), len(unit), []
        while at:
            state = mix((state + step) & low)
            u, here = (state >> 11) * 2.0**-53, edges[at - 1]
            for k, (n, part, lp) in enumerate(here):
                chance = np.exp(alpha[at - n] + lp - alpha[at])
                if u < chance or k == len(here) - 1:
                    break
                u -= chance
            ids, at = part + ids, at - n
        out += ids
    return out


def test_subwords_query_against_a_plain_form(spark, data):
    pieces = subwords_pieces()
    by_text = {b.decode(): i for i, b in enumerate(pieces.bytes_of) if b and i not in set(pieces.byte_ids.tolist())}
    docs = [(r["doc_id"], r["text"]) for r in table(spark, data, "documents").collect() if len(r["text"]) < 1500]
    docs += [(-1, "▁ é 漢字 \U0001f642\tx  y\n\n z"), (-2, "")]
    got = subwords.sample([t for _, t in docs], [str(d) for d, _ in docs], pieces, 0)
    want = [plain_sample(t, d, 0, pieces, by_text) for d, t in docs]
    assert [x.tolist() for x in got] == want
    plain = spark.createDataFrame([(d, ids) for (d, _), ids in zip(docs, want, strict=True) if d >= 0], "doc_id long, piece_ids array<int>")
    plain = {r["doc_id"]: (r["n"], r["h"]) for r in plain.select("doc_id", F.size("piece_ids").alias("n"), F.xxhash64("piece_ids").alias("h")).collect()}
    rows = {r["doc_id"]: (r["n_pieces"], r["ids_hash"]) for r in QUERIES["op6_subwords"](spark, data).collect()}
    assert len(plain) > 50 and all(rows[d] == v for d, v in plain.items())


def test_kept_lattices_change_nothing(monkeypatch):
    """A table that is emptied again and again, and one that keeps all, give the same pieces."""
    texts = [f"the words number {i % 7} and some others{i}" for i in range(60)]
    keys = [str(i) for i in range(60)]
    pieces = subwords_pieces()
    whole = subwords.sample(texts, keys, pieces, 5)
    for kept in (0, 1 << 20):
        monkeypatch.setattr(subwords, "KEPT_EDGES", kept)
        sampler = subwords.Sampler(pieces, 5)
        parts = [x for i in range(0, 60, 7) for x in sampler.sample(texts[i : i + 7], keys[i : i + 7])]
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, parts, strict=True))


def test_subwords_do_not_depend_on_batches(spark, data):
    docs = table(spark, data, "documents").select("doc_id", "text")
    one = {r["doc_id"]: r["piece_ids"] for r in subwords.encode(docs.repartition(7, "doc_id")).collect()}
    two = {r["doc_id"]: r["piece_ids"] for r in subwords.encode(docs.coalesce(1)).collect()}
    other = {r["doc_id"]: r["piece_ids"] for r in subwords.encode(docs, seed=1).collect()}
    assert one == two and one != other


def test_subwords_odd(spark, odd_documents, no_documents):
    rows = subwords.decode(subwords.encode(odd_documents)).collect()
    assert len(rows) == 10 and all(r["decoded"] == (r["text"] or "") for r in rows)
    assert subwords.decode(subwords.encode(no_documents)).count() == 0
    assert QUERIES["op6_subwords"](spark, "/root/testdata/sf0.001").where("not lossless").count() == 0


def test_line_dedup_oracle(spark, data, duck, same):
    same(QUERIES["op8_line_dedup"](spark, data).toPandas(), duck.sql(ORACLES["op8_line_dedup"]).df())


def test_line_dedup_keeps_first(spark):
    rows = [(i, f"unique {i}\n common line \nend {i}", f"s{i % 12}") for i in range(24)] + [(100, "few\nfew again", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in linededup.dedup_lines(docs).collect()}
    assert got[0]["text"] == rows[0][1] and got[0]["n_removed"] == 0
    assert all(got[i]["text"] == f"unique {i}\nend {i}" and got[i]["n_removed"] == 1 for i in range(1, 24))
    assert got[100]["text"] == rows[-1][1]


@pytest.mark.parametrize("bound", [200_000, 0])
def test_line_dedup_near_threshold(spark, monkeypatch, bound):
    """Spreads just below and at the threshold are told apart exactly, by a broadcast and by the join beyond it."""
    monkeypatch.setattr(linededup, "SENT", bound)
    rows = [(i, "four sites", f"s{i}") for i in range(4)] + [(100 + i, "five sites", f"s{i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["n_removed"] for r in linededup.dedup_lines(docs).collect()}
    assert [d for d, n in sorted(got.items()) if n] == list(range(101, 105))


def test_line_dedup_long_text(spark):
    """A log of 40,000 lines, half of which stand on every site, in time in proportion to its length."""
    log = [f"entry {i // 2}" if i % 2 else f"common {i % 4000}" for i in range(40_000)]
    rows = [(i, "\n".join(f"common {k}" for k in range(0, 4000, 2)), f"s{i}") for i in range(6)] + [(50, "\n".join(log), "s1")]
    got = {r["doc_id"]: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[50]["n_removed"] == 20_000 and got[50]["text"] == "\n".join(x for x in log if x.startswith("entry"))


def test_line_dedup_odd(spark, odd_documents, no_documents):
    assert linededup.dedup_lines(odd_documents).columns == [*[c for c in odd_documents.columns if c != "n_removed"], "n_lines", "n_removed"]
    rows = linededup.dedup_lines(odd_documents, min_sites=1).collect()
    assert len(rows) == 10
    assert {r["text"] for r in rows if r["doc_id"] == 2} == {None} and {r["text"] for r in rows if r["doc_id"] == 7} == {"\n\n \n"}
    assert linededup.dedup_lines(no_documents).count() == 0
