"""The filter audit, exact duplicates by recipes and the alignment of tokenizers against plain forms."""

import collections
import functools
import hashlib
import itertools
import re
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from locusloom.llm import audit, crosstoken, exactdup
from locusloom.llm.common import table
from locusloom.llm.queries import ORACLES, QUERIES
from pyspark.sql import functions as F


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_exact_dedup"])
def test_sql(name, spark, data, duck, same):
    same(QUERIES[name](spark, data).toPandas(), duck.sql(ORACLES[name]).df())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=200))
def test_positional_popcount(words):
    assert audit.positional_popcount(np.array(words, np.uint32)).tolist() == [sum(w >> i & 1 for w in words) for i in range(32)]


def plain_audit(docs, labels):
    """Rows of the report from the texts, order by order."""
    good, toxic = ({r["doc_id"] for r in labels if r[c] == 1 and r["doc_id"] is not None} for c in ("quality", "toxic"))
    first = {}
    for r in docs:
        if r["doc_id"] is not None:
            first[r["text"] or ""] = min(first.get(r["text"] or "", r["doc_id"]), r["doc_id"])
    rows = []
    for r in docs:
        t = r["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), r["doc_id"] is not None and first[t] < r["doc_id"]]
        rows.append((r["source"] or "", {n for n, f in zip("ABCDE", fails, strict=True) if f}, r["doc_id"] in good, r["doc_id"] in toxic))
    out, shapley = {}, collections.Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            for step, x in enumerate(order):
                left = [r for r in own if not r[1] & set(order[:step])]
                gone = [r for r in left if x in r[1]]
                shapley[part, x] += len(gone)
                out[part, "".join(order), step + 1] = [len(left) - len(gone), len(gone), sum(x in r[1] for r in own) - len(gone), sum(r[1] == {x} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_odd(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 1, None), (3, None, 1), (None, 1, 1), (8, 0, 0)], "doc_id long, quality int, toxic int")
    hot = spark.range(20, 60).selectExpr("id doc_id", "'One text for all, 100 % EQUAL' text", "'en' lang", "cast(if(id % 3 = 0, null, 'a') as string) source", "1L n_chars")
    docs = odd_documents.select("doc_id", "text", "lang", "source", "n_chars").union(hot)
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in columns) for r in audit.audit(docs, labels).collect()}
    assert got == plain_audit(docs.collect(), labels.collect())
    assert audit.audit(odd_documents, labels).count() == 600 * 5
    assert audit.audit(no_documents, labels).count() == 0


def test_audit_batches(spark, monkeypatch):
    """Counts don't depend on when a task adds up or sends its words."""
    rows = spark.range(3000).selectExpr("cast(id % 7 as string) part", "id % 2 = 0 good", "id % 3 = 0 toxic", "cast(id * 31 % 32 as int) failed").repartition(3)
    want = sorted(map(tuple, audit.survivors(rows).collect()))
    monkeypatch.setattr(audit, "WAITING", 10)
    monkeypatch.setattr(audit, "KEYS", 3)
    assert sorted(map(tuple, audit.survivors(rows).collect())) == want
    total = np.array([r[3] for r in want]).sum(0)
    assert total[0] == 3000 and total.tolist() == [sum(not (i * 31 % 32) & s for i in range(3000)) for s in range(32)]


def plain_duplicates(rows):
    groups = collections.defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id))
    out = []
    for t, members in groups.items():
        members.sort(key=lambda m: (m[0], m[1], m[2] or 0))
        out += [(m[2], members[0][2], len(members), i == 0, hashlib.sha256(t.encode()).hexdigest()) for i, m in enumerate(members)]
    return sorted(out, key=str)


def test_exact_odd(spark, odd_documents, no_documents):
    hot = spark.range(20, 80).selectExpr("id doc_id", "concat('The same. ', repeat('text! ', 400), repeat(' ', cast(id % 5 as int))) text", "'en' lang", "'a' source", "1L n_chars")
    docs = odd_documents.select("doc_id", "text", "lang", "source", "n_chars").union(hot)
    got = sorted(map(tuple, exactdup.duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)
    assert got == plain_duplicates([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert exactdup.duplicates(no_documents).count() == 0
    clashing = odd_documents.withColumn("kept", F.lit("x")).withColumn("keep_id", F.lit(5))
    stay = exactdup.dedup(clashing)
    assert stay.columns == clashing.columns and stay.count() == 7 and stay.where("kept = 'x' and keep_id = 5 and _row = 'x'").count() == 7


def test_identifiers_are_verified(spark):
    """Identifiers that clash are drawn anew; without that, texts of the same two identifiers would be one."""
    weak = lambda chunk, seed: F.array(F.pmod(F.xxhash64(chunk), F.lit(2))) if seed < 2 else exactdup.identifier(chunk, seed)
    docs = spark.range(40).selectExpr("id doc_id", "concat('text ', id div 2) text")
    rows = exactdup.duplicates(docs, identify=weak).collect()
    assert {r["group_size"] for r in rows} == {2} and all(r["keep_id"] == r["doc_id"] // 2 * 2 for r in rows)
    chunks = spark.createDataFrame([([1], "a"), ([1], "a"), ([2], "b"), ([1], "c")], "_id array<long>, _chunk string")
    assert [r["_id"] for r in exactdup.clashes(chunks).collect()] == [[1]]


def test_chunks(spark):
    """Chunks joined are the text, within their bounds, and an edit changes those around it only."""
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("abcdefgh.!漢🙂"), 30_000))
    edited = text[:9000] + "XYZ" + text[9010:]
    a, b, c = (r[0] for r in spark.createDataFrame([(text,), (edited,), ("x" * 5000,)], "t string").select(exactdup.chunks_of(F.col("t"))).collect())
    assert "".join(a) == text and "".join(b) == edited and "".join(c) == "x" * 5000
    assert max(map(len, a + c)) <= exactdup.MOST and min(map(len, a[:-1])) >= exactdup.LEAST
    assert len(set(b) - set(a)) <= 6


@functools.cache
def both():
    from tokenizers import Tokenizer

    import sentencepiece

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), decoder()


def decoder():
    """Bytes of the characters by which a byte-level vocabulary writes them."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def plain_alignment(rows):
    """Output rows and groups by the unmodified tokenizers, text by text."""
    a_model, b_model, bytes_of = both()
    found, links = [], collections.Counter()
    for doc_id, text in rows:
        whole = (" " + (text or "")).encode()
        a, b = a_model.encode(" " + (text or ""), add_special_tokens=False).ids, b_model.encode(text or "")
        byte_a = [bytes(bytes_of[c] for c in a_model.id_to_token(i)) for i in a]
        byte_b = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_model.id_to_piece(i)) for i in b)]
        if not text or b"".join(byte_a) != whole or b"".join(byte_b) != whole:
            found.append((doc_id, 0, 0, [], []))
            continue
        end_a, end_b = np.cumsum([len(x) for x in byte_a]).tolist(), np.cumsum([len(x) for x in byte_b]).tolist()
        groups, own, i, j = [], [], 0, 0
        for end in sorted(set(end_a) & set(end_b)):
            k, m = end_a.index(end, i) + 1, end_b.index(end, j) + 1
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            own.append((a[k - 1], b[m - 1]))
            i, j = k, m
        links.update(own)
        found.append((doc_id, len(a), len(b), groups, own))
    best = collections.Counter()
    for (_, b), n in links.items():
        best[b] = max(best[b], n)
    out = []
    for doc_id, n_a, n_b, groups, own in found:
        text = ";".join(groups)
        out.append((doc_id, n_a, n_b, len(groups), len(own), sum(links[p] == best[p[1]] for p in own), sum(links[p] for p in own), hashlib.sha256(text.encode()).hexdigest() if groups else "", text))
    return sorted(out, key=str)


def test_alignment_query(spark, data):
    got = sorted(map(tuple, QUERIES["op13_token_alignment"](spark, data).collect()), key=str)
    assert got == [r[:-1] for r in plain_alignment([(r["doc_id"], r["text"]) for r in table(spark, data, "documents").collect()])]


@pytest.mark.parametrize(("size", "fan"), [(7, 2), (100, 3), (1 << 16, 16)])
def test_alignment_odd(spark, odd_documents, size, fan):
    """Every size of the ranges gives the same; texts with the space mark have no tokens, other long ones are composed of ranges."""
    words = "Zwölf Boxkämpfer jagen Viktor, quer über den großen Sylter Deich <s> <0x41>\n\n  if (x == 10):\treturn '漢字 🙂' don't 12345 " * 6
    extra = [(20, words, "de", "a", 1), (21, "x" * 500, "en", "a", 1), (22, words + "▁", "de", "a", 1), (None, words[40:], "de", "a", 1), (23, " ", "en", "a", 1), (23, "a  b   c", "en", "a", 1), (24, "漢字" * 100 + " a b c d", "zh", "a", 1), (25, " leading and trailing ", "en", "b", 1)]
    docs = odd_documents.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(extra, odd_documents.select("doc_id", "text", "lang", "source", "n_chars").schema))
    if size < 100:
        docs = docs.where("length(text) < 2000 or text is null")
    got = sorted(map(tuple, crosstoken.align(docs, size=size, fan=fan, keep=True).collect()), key=str)
    assert got == plain_alignment([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_alignment_no_documents(spark, no_documents, odd_documents):
    assert crosstoken.align(no_documents).count() == 0
    assert crosstoken.align(odd_documents).count() == odd_documents.count()


@functools.cache
def tokenizers():
    return crosstoken.Tokenizers(*(Path(public_tokenizers.path(f)).read_bytes() for f in (crosstoken.VOCABULARY, crosstoken.MODEL)))


ids = st.text("0123456789", min_size=1, max_size=2)
lists = st.lists(ids, max_size=3).map(",".join)
some = st.lists(ids, min_size=1, max_size=3).map(",".join)
fragments = st.one_of(st.builds(crosstoken.Fragment, lists, lists), st.builds(crosstoken.Fragment, some, some, st.sampled_from(["", "1|2", "1,2|3;4|5"]), lists, lists))


@settings(max_examples=100, deadline=None)
@given(fragments, fragments, fragments)
def test_fragments_are_a_monoid(x, y, z):
    assert crosstoken.compose(crosstoken.compose(x, y), z) == crosstoken.compose(x, crosstoken.compose(y, z))
    assert crosstoken.compose(x, crosstoken.Fragment()) == x == crosstoken.compose(crosstoken.Fragment(), x)


@settings(max_examples=60, deadline=None)
@given(st.text("ab cdé.漢\n1'", max_size=200), st.integers(1, 40))
def test_ranges(text, size):
    """Stretches hold their ranges, begin with a space, and are tokenized as in the whole text."""
    data, t = (" " + text).encode(), tokenizers()
    found = crosstoken.ranges_of(text, size)
    assert [k for k, *_ in found] == [0, *[to for _, to, *_ in found]][:-1] and found[-1][1] == -(-len(data) // size)
    whole = t.encode([" " + text])[0]
    if whole is None:
        return
    ends = [np.cumsum(t.long_a[whole[0]]), np.cumsum(t.long_b[whole[1]])]
    for k, to, at, part in found:
        assert part.startswith(" ") and data[at:].startswith(part.encode()) and at <= k * size and at + len(part.encode()) >= min(to * size, len(data))
        for x, long, all_ids, all_ends in zip(t.encode([part])[0], (t.long_a, t.long_b), whole, ends, strict=True):
            own = at + np.cumsum(long[x])
            inside = lambda e, k=k, to=to: (e > k * size) & (e <= to * size)
            assert x[inside(own)].tolist() == all_ids[inside(all_ends)].tolist() and own[inside(own)].tolist() == all_ends[inside(all_ends)].tolist()
