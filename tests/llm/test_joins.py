"""Chats, top-k, licences and near duplicates against SQL or brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from locusloom.llm import chat, licenses, neardup, topk
from locusloom.llm.common import table
from locusloom.llm.queries import ORACLES, QUERIES
from pyspark.sql import functions as F


def test_chat_oracle(spark, data, duck, same):
    same(QUERIES["op3_chat"](spark, data).toPandas(), duck.sql(ORACLES["op3_chat"]).df())


def test_chat_collapse(spark):
    a = [("user", "hi"), ("assistant", "hello"), ("user", "more")]
    convs = {1: a[:1], 2: a[:2], 3: a, 4: a, 5: [("user", "hi"), ("assistant", "other")], 6: [("assistant", "hi")], 7: [("userhi", "")]}
    rows = [(c, i, *t) for c, ts in convs.items() for i, t in enumerate(ts)]
    rows += [(8, 0, None, None), (8, None, "user", "first"), (None, 0, "user", "hi"), (5, 0, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("whole", F.lit("x")).withColumn("turns", F.lit(1))
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert sorted(got) == [3, 5, 6, 7, 8]
    assert got[3]["n_logged"] == 2
    assert got[3]["chat_text"] == "<|user|>\nhi\n<|end|>\n<|assistant|>\nhello\n<|end|>\n<|user|>\nmore\n<|end|>\n"
    assert got[8]["chat_text"].startswith("<|user|>\nfirst\n")
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_long_conversation(spark):
    """3000 turns, logged twice more as it grew."""
    turns = [("user" if i % 2 else "assistant", f"turn {i} " + "x" * 50) for i in range(3000)]
    df = spark.createDataFrame([(c, i, *t) for c, n in ((1, 3000), (2, 2999), (3, 1)) for i, t in enumerate(turns[:n])], "conv_id long, turn long, role string, text string")
    (kept,) = chat.format_chats(df).collect()
    assert kept["conv_id"] == 1 and len(kept["turns"]) == 3000 and kept["chat_text"].count("<|end|>") == 3000


def brute_top(vectors, queries, k):
    out = {}
    for q in queries:
        scored = sorted((-sum(a * b for a, b in zip(vectors[q], v, strict=False)), i) for i, v in vectors.items() if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def search(df, k=5, every=5, **options):
    got = defaultdict(list)
    for r in sorted(topk.search(df, lambda i: i % every == 0, k, **options).collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(got[r["query_id"]]) + 1
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    return got


def test_top_k_oracle(spark, data, duck, same):
    same(QUERIES["op10_top_k"](spark, data).toPandas(), duck.sql(ORACLES["op10_top_k"]).df())


def test_top_k_brute(spark, monkeypatch):
    """Blocks, ties, repeated vectors and a hot one, for several numbers of slices."""
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "QUERIES", 16)
    rng = random.Random(2)
    hot = [rng.uniform(-1, 1) for _ in range(7)]
    rows = {i: hot if i % 3 == 0 else [rng.choice([-0.5, 0.0, 0.25, 1.0]) if i % 2 else rng.uniform(-1, 1) for _ in range(7)] for i in range(300)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    want = brute_top({i: [math.floor(256 * x) for x in v] for i, v in rows.items()}, [i for i in rows if i % 5 == 0], 5)
    for slices in (1, 2, 3):
        assert search(df, slices=slices) == want


def test_top_k_odd(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0]), (2, None), (3, [None, 1.0]), (5, [float("nan"), 0.0]), (None, [1.0, 1.0]), (10, []), (4, [3.0, float("inf")]), (6, [-1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rep", F.lit("x")).withColumn("score", F.lit("x"))
    got = search(df)
    assert got == {0: [(1, 65536), (10, 0), (6, -65536 * 3)], 10: [(0, 0), (1, 0), (6, 0)]}
    assert search(df.limit(0)) == {} and search(df.where("vec_id = 0")) == {}
    large = spark.createDataFrame([(0, [1e15, 1.0]), (1, [1e15, 2.0]), (2, [-1e30, 0.0])], "vec_id long, embedding array<double>")
    assert [i for i, _ in search(large)[0]] == [1, 2]


def test_licence_oracle(spark, data, duck, same):
    same(QUERIES["op7_licenses"](spark, data).toPandas(), duck.sql(ORACLES["op7_licenses"]).df())


def test_licence_oracle_on_runs(spark, same, tmp_path):
    """The SQL, which compares all runs without a gate, on wrapped and commented notices and whole licence files."""
    import duckdb

    mit = "Permission is hereby granted, free of charge, to any person\n# obtaining a copy of this software, to deal in the Software\n#\n# without restriction"
    gpl = "// This program is free software: you can redistribute it and/or\n// modify it under the terms of the GNU General Public License,\n// version 3."
    texts = [t for _, t in licenses.full_texts()] + [mit, gpl, mit + "\n" + gpl, "x\n\n" + gpl.replace(" ", "\n") + "\ny", "Released under\nthe MIT License.", "", None, "no licence of any kind\nto be found"]
    rows = [(i, t, f"s{i % 2}") for i, t in enumerate(texts * 3)] + [(100 + i, f"plain words of document {i} in the order of the day", "s0") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES["op7_licenses"](spark, str(tmp_path)).toPandas()
    assert got["own_licence"].nunique() >= 3
    same(got, con.sql(ORACLES["op7_licenses"]).df())


def test_licence_inheritance(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [
        ("r/LICENSE", mit), ("r/a/b/x.py", "code"), ("r/a/COPYING.txt", apache), ("r/a/y.py", "code"), ("r/z.py", apache + "\ncode"), ("q/x.py", "code"), (None, "code"), ("r/w.py", None),
        ("r/license_notes.py", "We met to talk about a driving licence and many other things that day."), ("top.py", ""), ("s/LICENSE", "no notice"), ("s/x.py", mit.upper()),
    ]
    df = spark.createDataFrame(rows, "path string, text string").withColumn("word", F.lit("x")).withColumn("cosine", F.lit("x")).withColumn("_k", F.lit(1)).drop("_k")
    got = {r["path"]: r for r in licenses.scan(df).collect()}
    assert len(got) == len(rows)
    assert got["r/LICENSE"]["own_licence"] == "MIT" and got["r/z.py"]["licence"] == "Apache-2.0"
    assert (got["r/a/b/x.py"]["licence"], got["r/a/b/x.py"]["inherited_from"]) == ("Apache-2.0", "r/a")
    assert got["r/a/y.py"]["licence"] == "Apache-2.0" and got["r/w.py"]["licence"] == "MIT"
    assert got["q/x.py"]["licence"] is None and got[None]["licence"] is None and got["top.py"]["licence"] is None
    assert got["r/license_notes.py"]["own_licence"] is None and got["s/x.py"]["own_licence"] == "MIT"
    assert licenses.scan(df.limit(0)).count() == 0


def test_licence_runs_and_whole_files(spark):
    """Notices without an anchor word, wrapped and commented notices, and whole licences with other names and wrapping."""
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"
    bsd = ["Redistribution and use in source and binary forms, with or without", "modification, are permitted provided that the following conditions", "are met:"]
    gpl = ["This program is free software: you can redistribute it and/or", "modify it under the terms of the GNU General Public License,", "version 3."]
    texts = dict(licenses.full_texts())
    rows = [("a/one.py", f"code\n{mit}\nmore code"), ("b/wrapped.py", "\n".join(["# Some file", "#", *[f"# {x}" for x in bsd], "", "import os"])), ("c/comment.c", "\n//\n".join(f"// {x}" for x in gpl)), ("d/words.py", gpl[0].replace(" ", "\n") + "\n" + "\n".join(gpl[1:]).replace(" ", "\n")), ("e/none.py", "We deal with software of any person\nfree of charge")]
    rows += [(f"full/{n}/LICENSE", "Copyright (c) 2020 Somebody Else\n\n" + re.sub(r"((?:\S+\s+){14})", r"\1\n", " ".join(t.split()))) for n, t in texts.items()] + [("full/MIT/x.py", "code"), ("g/LICENSE", "Minutes of the meeting\n" * 20)]
    rows += [(f"p/{i}.txt", f"plain words of document {i} in the usual order of the day and of the night") for i in range(60)]
    got = {r["path"]: r for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {p: got[p]["own_licence"] for p in ("a/one.py", "b/wrapped.py", "c/comment.c", "d/words.py", "e/none.py", "g/LICENSE")} == {"a/one.py": "MIT", "b/wrapped.py": "BSD-3-Clause", "c/comment.c": "GPL-3.0", "d/words.py": "GPL-3.0", "e/none.py": None, "g/LICENSE": None}
    assert {n: got[f"full/{n}/LICENSE"]["own_licence"] for n in texts} == {n: n for n in texts}
    assert got["full/MIT/x.py"]["inherited_from"] == "full/MIT" and got["full/MIT/x.py"]["licence"] == "MIT"


def test_licence_odd(spark, odd_documents):
    """Clashing names, repeated rows, and a very long text that is a licence file."""
    path = F.when(F.col("doc_id") == 8, "a/LICENSE").when(F.col("doc_id") == 4, "b/LICENSE").otherwise(F.concat(F.lit("a/b/"), "doc_id"))
    docs = odd_documents.withColumn("path", path)
    got = licenses.scan(docs).collect()
    assert len(got) == 10 and licenses.scan(docs).columns == [*[c for c in docs.columns if c != "licence"], "own_licence", "cosine", "inherited_from", "licence"]
    by = {(r["doc_id"], r["_key"]): r for r in got}
    assert by[8, "x"]["own_licence"] == "MIT" and by[1, "x"]["inherited_from"] == "a" and by[4, "x"]["licence"] is None
    text = "word " * 40_000 + "\nReleased under the MIT License.\n" + "more " * 40_000
    long = spark.createDataFrame([("x.py", text), ("x.py", text)], "path string, text string")
    assert [r["licence"] for r in licenses.scan(long).collect()] == ["MIT", "MIT"]


def test_licence_plan_is_native(spark, data):
    plan = QUERIES["op7_licenses"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_classes(docs, similarity=0.8):
    """Classes by exact multiset Jaccard of all pairs that share a shingle."""

    def bag(text):
        w = (text or "").lower().split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    bags = {d: bag(t) for d, t in docs}
    parent = {d: d for d in bags}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(set)
    for d, b in bags.items():
        for s in b or [()]:
            holders[s].add(d)
    for a, b in {(a, b) for ds in holders.values() for a in ds for b in ds if a < b}:
        x, y = bags[a], bags[b]
        if sum((x & y).values()) >= similarity * sum((x | y).values()):
            ra, rb = sorted((root(a), root(b)))
            parent[rb] = ra
    return {d: root(d) for d in bags}


def test_near_duplicates_brute(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, data, "documents").collect()]
    got = {r["doc_id"]: r["class_id"] for r in QUERIES["op4_near_duplicates"](spark, data).collect()}
    assert got == brute_classes(docs)


def test_near_duplicates_chains_and_groups(spark):
    """A large group of near copies of one text, a chain whose ends aren't alike, and pairs around the threshold."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    fresh = lambda n: [rng.choice(words) for _ in range(n)]
    docs, base = {}, fresh(200)
    for i in range(60):
        t = list(base)
        t[rng.randrange(200)] = f"x{i}"
        docs[i] = t
    chain = fresh(150)
    for i in range(100, 112):
        docs[i] = list(chain)
        chain[(i - 100) * 9 + 4] = f"y{i}"
        chain[(i - 100) * 9 + 8] = f"z{i}"
    for i in range(200, 240, 2):
        t = fresh(120)
        docs[i] = t
        docs[i + 1] = t[: 120 - (i - 200)] + fresh(i - 200)
    passages = [fresh(70) for _ in range(3)]
    for i in range(300, 400):  # unlike texts around common passages, which agree in bands, and near copies of every fifth
        docs[i] = fresh(40) + passages[i % 3] + passages[(i + 1) % 3] + fresh(40)
        if i % 5 == 0:
            docs[i + 200] = [*docs[i][:-6], *fresh(6)]
    rows = [(i, " ".join(t)) for i, t in docs.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(df).collect()}
    want = brute_classes(rows)
    assert got == want
    assert all(got[i] == got[i + 200] == i for i in range(300, 400, 5)) and len({got[i] for i in range(300, 400)}) == 100
    assert len({want[i] for i in range(60)}) == 1 and len({want[i] for i in range(100, 112)}) == 1


def test_signature_agreement_is_weighted_jaccard():
    """Shares of equal slots over many pairs against the exact weighted Jaccard similarity."""
    rng = np.random.default_rng(4)
    for weights in (1, 4, 9):
        errors, want = [], []
        for _ in range(30):
            x = rng.integers(0, weights + 1, 60)
            y = np.where(rng.random(60) < 0.3, rng.integers(0, weights + 1, 60), x)
            x[0] = y[0] = 1
            ids = rng.integers(0, 2**63, 60).astype(np.uint64)
            bags = [np.sort(np.repeat(ids, c)) for c in (x, y)]
            exact = np.minimum(x, y).sum() / np.maximum(x, y).sum()
            assert abs(neardup.jaccard(*map(neardup.copies, bags)) - exact) < 1e-12
            a, b = neardup.signatures(bags, 512)
            errors.append((a == b).mean() - exact)
            want.append(exact)
        assert abs(np.mean(errors)) < 4 * np.sqrt(0.25 / 512 / 30) and np.std(errors) < 2 * np.sqrt(0.25 / 512)


def test_signatures_do_not_depend_on_the_batch():
    rng = np.random.default_rng(3)
    bags = [np.sort(rng.integers(0, 1000, n).astype(np.uint64)) for n in (0, 1, 5, 40, 400)]
    together = neardup.signatures(bags)
    for b, s in zip(bags, together, strict=True):
        assert (neardup.signatures([b])[0] == s).all()


def test_prefixes_of_similar_bags_meet():
    """Bags at the similarity share an element of their prefixes in any order of elements, and none is lost by size or place."""
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = neardup.copies(np.sort(rng.integers(0, max(2, n), n).astype(np.uint64)))
        b = neardup.copies(np.sort(np.where(rng.random(n) < 0.1, rng.integers(0, max(2, n), n), a % np.uint64(max(2, n))).astype(np.uint64)))
        order = dict(zip(np.unique(np.concatenate([a, b])).tolist(), rng.permutation(len(np.unique(np.concatenate([a, b])))).tolist(), strict=True))
        x, y = (sorted(v.tolist(), key=order.get) for v in (a, b))
        if neardup.jaccard(a, b) >= 0.8:
            least = math.ceil(0.8 / 1.8 * (len(x) + len(y)) - 1e-9)
            px, py = (v[: len(v) - math.ceil(0.8 * len(v) - 1e-9) + 1] for v in (x, y))
            assert any(min(len(x) - i, len(y) - py.index(e)) >= least for i, e in enumerate(px) if e in py)


def test_near_duplicates_odd(spark, odd_documents, no_documents):
    rows = neardup.classes(odd_documents).collect()
    assert len(rows) == 10
    got = {r["doc_id"]: r["class_id"] for r in rows}
    assert got[2] == got[3] == got[7] == 2 and got[1] == 1 and got[4] == 4
    kept = neardup.dedup(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "4", "5", "8", "9", "None"]
    assert neardup.classes(no_documents).count() == 0 and neardup.dedup(no_documents).count() == 0
    twice = odd_documents.where("doc_id = 1").withColumn("source", F.lit("z")).unionByName(odd_documents.where("doc_id = 1"))
    assert len({tuple(neardup.dedup(twice.repartition(n)).collect()[0]) for n in (1, 2, 3)}) == 1


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 105), (105, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in neardup.components(links).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100, 105: 100}


def test_recall_by_edits(spark):
    """Copies with 1, 3, 5 and 10 % of their words changed: every pair at the similarity is caught, at the default and at a lower one, and nothing else."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(5000)]
    docs, pairs = [], []
    for k in range(120):
        text = rng.choice(words, int(rng.integers(60, 300)))
        copy, share = text.copy(), (0.01, 0.03, 0.05, 0.10)[k % 4]
        copy[rng.random(len(copy)) < share] = "changed"
        docs += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(copy))]
        pairs.append((2 * k, share))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    caught = {}
    for similarity in (0.8, 0.4):
        got = {r["doc_id"]: r["class_id"] for r in neardup.classes(df, similarity=similarity).collect()}
        assert got == brute_classes(docs, similarity)
        for share in (0.01, 0.03, 0.05, 0.10):
            caught[similarity, share] = np.mean([got[a] == got[a + 1] for a, s in pairs if s == share])
    assert caught[0.8, 0.01] > 0.9 and caught[0.8, 0.10] < 0.1
    assert np.mean([caught[0.4, s] for s in (0.01, 0.03, 0.05)]) > 0.9
    assert neardup.banded(0.8) == (25, 5) and neardup.banded(0.4) == (62, 2)
