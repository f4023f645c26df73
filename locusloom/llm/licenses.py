"""Licence scans: sparse TF-IDF cosine to notice templates, then inheritance from the nearest directory.

Headers are lines, runs of neighbouring lines (a notice may be wrapped and stand
behind comment marks, which hold no word) and whole licence files (LICENSE, COPYING
...). Each distinct header is compared with the short notices by the cosine of
TF-IDF vectors over the notices' vocabulary; a word outside it only lengthens the
header's vector, at the weight of a word that no document has. Document frequencies
come from the whole texts of all documents. Licence files are also compared, as
whole texts, with whole licences (``licence_texts``), with document frequencies from
the licence files. Only texts with a tell-tale word are compared: of each template,
its rarest words are taken until a text without them can't reach the threshold.
Runs have at most twice the words of the longest notice over the squared threshold.

A file's own licence is its best header at or above the threshold; a file without
one inherits that of the nearest directory, its own or one above, that holds a
licence file.

DataFrame and SQL functions only. Edge cases: a null text has no header; a null
path has no directory and inherits nothing; several licence files of a directory
count by (cosine, then the name of the licence); repeated rows are alike. Of a very
long text, only the runs around tell-tale words are compared, and as a licence file
the whole. No documents: no rows. Extra columns are passed through, whatever their
names.
"""

from __future__ import annotations

import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, written

# Public short notices by SPDX identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
LICENCE_FILES = r"^(LICEN[SC]E|COPYING|NOTICE|UNLICENSE)([-._].*)?$"
LEAST = 0.8
NOT_WORD = "[^a-z0-9]+"


def longest_run(least: float) -> int:
    """Words of a run at most: twice those of the longest notice over the squared threshold."""
    return math.ceil(2 * max(len([w for w in re.split(NOT_WORD, t.lower()) if w]) for _, t in TEMPLATES) / max(least, 0.1) ** 2)


LONGEST = longest_run(LEAST)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def vocabulary(templates: list[tuple[str, str]]) -> list[str]:
    return sorted({w for _, t in templates for w in re.split(NOT_WORD, t.lower()) if w})


def full_texts() -> list[tuple[str, str]]:
    """Licence and text of the whole licences in ``licence_texts``, read on the driver."""
    return [(f.stem, f.read_text(encoding="utf-8")) for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]


def idf(docs: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """word, idf for the listed words and, under a null word, for any other; over whole texts of all ``docs``."""
    spark = docs.sparkSession
    listed = F.array(*[F.lit(w) for w in terms])
    found = docs.select(F.explode(F.array_intersect(F.split(F.lower(F.col(text)), NOT_WORD), listed)).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    weight = F.log((F.lit(docs.count()) + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    names = spark.createDataFrame([(w,) for w in [*terms, None]], "word string")
    return names.join(found, "word", "left").select("word", weight.alias("idf"))


def weighed(counts: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """key, word, x: unit TF-IDF vectors from key, word, tf. Words outside the vocabulary count for the length."""
    other = F.lit(weights.where("word is null").first()["idf"])
    rows = counts.join(F.broadcast(weights), "word", "left")
    rows = rows.select(key, "word", (F.col("tf") * F.coalesce("idf", other)).alias("w"), F.col("idf").isNotNull().alias("inside"))
    return rows.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.when(F.col("inside"), F.struct("word", "w"))).alias("ws")).select(key, F.explode("ws").alias("t"), "norm").select(key, F.col("t.word").alias("word"), (F.col("t.w") / F.col("norm")).alias("x"))


def counted(rows: DataFrame, key: str, text: str) -> DataFrame:
    return rows.select(key, F.explode(words(F.col(text))).alias("word")).groupBy(key, "word").agg(F.count("*").alias("tf"))


class Notices:
    """Templates with the weights of their words over ``docs``: what can match them, and their cosines."""

    def __init__(self, docs: DataFrame, text: str, templates: list[tuple[str, str]], least: float):
        self.least, self.weights = least, written(idf(docs, text, vocabulary(templates)), "idf", 1)
        named = docs.sparkSession.createDataFrame([(i, n, t) for i, (n, t) in enumerate(templates)], "template int, licence string, notice string")
        self.vectors = written(weighed(counted(named, "template", "notice"), self.weights, "template").join(named.select("template", "licence"), "template"), "templates", 1)

    def tells(self) -> list[str]:
        """Words of which any text at or above ``least`` holds one: without a template's, too little of its vector is left to reach it."""
        idfs, by, out = {r["word"]: r["idf"] for r in self.weights.collect()}, {}, set()
        for r in self.vectors.collect():
            by.setdefault(r["template"], []).append((idfs[r["word"]], r["x"], r["word"]))
        for rarest in by.values():
            lost = 0.0
            for _, x, word in sorted(rarest, reverse=True):
                if lost > 1 - self.least**2 + 1e-6:
                    break
                out.add(word)
                lost += x * x
        return sorted(out)

    def matched(self, lines: DataFrame) -> DataFrame:
        """header, licence, cosine: the best template of each distinct header at or above ``least``."""
        found = weighed(counted(lines, "header", "line"), self.weights, "header").join(F.broadcast(self.vectors.withColumnRenamed("x", "y")), "word")
        cosines = found.groupBy("header", "template", "licence").agg(F.round(F.sum(F.col("x") * F.col("y")), 9).alias("cosine"))
        best = cosines.groupBy("header").agg(F.max(F.struct("cosine", "licence")).alias("b")).where(F.col("b.cosine") >= self.least)
        return best.select("header", F.col("b.licence").alias("licence"), F.col("b.cosine").alias("cosine"))


def holds(text: Column, tells: list[str]) -> Column:
    return F.lower(text).rlike("(?<![a-z0-9])(?:" + "|".join(tells) + ")(?![a-z0-9])")


def joined(lines: Column, longest: int, tells: list[str] | None = None) -> Column:
    """The first 0, 1, 2 ... lines in one, each with its number of words, as long as that is at most ``longest``.

    With ``tells``, lines go backward and end at one with a tell, so that a run is made from its first tell only.
    """
    nothing = F.struct(F.lit("").alias("s"), F.lit(0).alias("n"))
    start = F.struct(F.array(nothing).alias("runs"), F.lit("").alias("s"), F.lit(0).alias("n"))

    def longer(run: Column, line: Column) -> Column:
        s, n = F.concat_ws(" ", *([line, run["s"]] if tells else [run["s"], line])), run["n"] + F.size(words(line))
        n = F.when(holds(line, tells), longest + 1).otherwise(n) if tells else n
        return F.struct(F.when(n <= longest, F.concat(run["runs"], F.array(F.struct(s.alias("s"), n.alias("n"))))).otherwise(run["runs"]).alias("runs"), s.alias("s"), n.alias("n"))

    return F.aggregate(lines, start, longer, lambda run: run["runs"])


def runs(docs: DataFrame, text: str, tells: list[str], longest: int, *keys: str) -> DataFrame:
    """Keys and line: each line with one of ``tells``, alone and in all runs with its neighbours of up to ``longest`` words.

    Lines without a word (blank, or only a comment mark) are skipped; texts without a tell aren't split.
    """
    lines = F.filter(F.split(F.lower(F.col(text)), "\n"), lambda line: line.rlike("[a-z0-9]"))
    some = docs.where(holds(F.col(text), tells)).select(*keys, lines.alias("_lines"))

    def around(line: Column, at: Column) -> Column:
        before = F.reverse(F.slice("_lines", F.greatest(at - longest + 1, F.lit(1)), F.least(at, F.lit(longest))))
        return F.when(holds(line, tells), F.struct(before.alias("before"), line.alias("line"), F.slice("_lines", at + 2, F.lit(longest)).alias("after")))

    found = some.select(*keys, F.explode(F.filter(F.transform("_lines", around), lambda x: x.isNotNull())).alias("_at"))
    found = found.select(*keys, F.col("_at.line").alias("_line"), F.size(words(F.col("_at.line"))).alias("_n"), F.explode(joined(F.col("_at.before"), longest, tells)).alias("_b"), joined(F.col("_at.after"), longest).alias("_as"))
    found = found.select(*keys, "_line", "_n", "_b", F.explode("_as").alias("_a"))
    size = F.col("_b.n") + F.col("_a.n")
    return found.where((size == 0) | (size + F.col("_n") <= longest)).select(*keys, F.concat_ws(" ", "_b.s", "_line", "_a.s").alias("line"))


def spots(keyed: DataFrame, text: str, short: Notices, full: Notices) -> DataFrame:
    """_key, _path, header (hash), line, whole: the runs of all files, and the whole texts of licence files, that may match."""
    tells = short.tells()
    longest = longest_run(short.least)
    parts = runs(keyed, text, tells, longest, "_key", "_path").withColumn("whole", F.lit(False))
    either = sorted({*tells, *full.tells()})
    files = keyed.where(is_holder(F.col("_path")) & holds(F.col(text), either)).select("_key", "_path", F.lower(F.col(text)).alias("line"), F.lit(True).alias("whole"))
    return parts.unionByName(files).select("_key", "_path", F.unhex(F.md5("line")).alias("header"), "line", "whole")


def is_holder(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0).rlike(LICENCE_FILES)


def above(directory: Column) -> Column:
    """The directory and all above it, the root ('') included."""
    parts = F.split(directory, "/")
    return F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))


def scan(docs: DataFrame, path: str = "path", text: str = "text", least: float = LEAST) -> DataFrame:
    """``docs`` with own_licence, cosine, inherited_from, licence added (columns of these names are replaced)."""
    docs, names, back = aside(docs.drop("own_licence", "cosine", "inherited_from", "licence"))
    path, text = names.get(path, path), names.get(text, text)
    keyed = docs.withColumn("_key", F.xxhash64(path, text))
    filed = keyed.withColumn("_path", F.col(path))
    short, full = Notices(docs, text, TEMPLATES, least), Notices(docs.where(is_holder(F.col(path))), text, full_texts(), least)
    found = written(spots(filed, text, short, full), "spots")
    known = short.matched(found.select("header", "line").distinct()).unionByName(full.matched(found.where("whole").select("header", "line").distinct()))
    hits = found.select("_key", "_path", "header").join(written(known, "headers"), "header")
    own = written(hits.groupBy("_key", "_path").agg(F.max(F.struct("cosine", "licence")).alias("_own")), "own")
    holder = F.regexp_replace("_path", "/?[^/]*$", "")
    holders = own.where(is_holder(F.col("_path"))).groupBy(holder.alias("_above")).agg(F.max("_own").alias("_lic"))
    directory = F.regexp_replace(path, "/?[^/]*$", "")
    distinct = docs.select(directory.alias("_dir")).where("_dir is not null").distinct()
    chain = distinct.select("_dir", F.posexplode(F.when(F.col("_dir") == "", F.array(F.lit(""))).otherwise(above(F.col("_dir")))).alias("_depth", "_above"))
    nearest = chain.join(holders, "_above").groupBy("_dir").agg(F.max_by(F.struct("_above", "_lic"), "_depth").alias("_near"))
    out = keyed.join(own.withColumnRenamed("_key", "_k"), (F.col("_key") == F.col("_k")) & keyed[path].eqNullSafe(F.col("_path")), "left").join(nearest, directory == F.col("_dir"), "left")
    mine = F.col("_own.licence")
    out = out.select(
        *[docs[c] for c in docs.columns], mine.alias("own_licence"), F.col("_own.cosine").alias("cosine"),
        F.when(mine.isNull(), F.col("_near._above")).alias("inherited_from"), F.coalesce(mine, F.col("_near._lic.licence")).alias("licence"),
    )
    return back(out)
