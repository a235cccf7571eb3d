"""Licence scans by sparse TF-IDF cosine and nearest-ancestor inheritance, by DataFrame operations alone.

The templates' words are the vocabulary; its document frequencies come from all texts, and any other
word weighs like one that no text holds. Each line, and each paragraph of several lines, is a sparse
vector, and one whose cosine with a template reaches ``threshold`` carries that licence, so a notice may
wrap over lines. What holds too few of a template's heaviest words to reach it is not compared, however
frequent those words are. A document of which a tenth or more is licence text is a licence file: it
covers its directory and all below, and a document without a licence of its own inherits from the
nearest directory above.

Paths are joined directory by directory, not file by file; the rows of a directory that holds a large
part of all are dealt to many tasks. The templates are a fixed list, so their vocabulary may be broadcast.

A null text or path has no licence and inherits none. Rows that repeat an id are merged for finding
and keep a row each; of several licences of a text the best score counts, ties by name. A very long text
is scanned whole. Without rows the result is empty. Other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm._store import materialize, spread_join

# Short notices by which licences are known, from the licences' own texts.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, all copyright and related rights are waived under CC0 1.0."),
)
_MARKS = ".,;:()[]\"'/-*#\t\r"


def _tokens(text: Column) -> Column:
    plain = F.translate(F.lower(text), _MARKS, " " * len(_MARKS))
    return F.array_remove(F.split(plain, "[ \n]+"), "")


def document_path(source: str = "source", doc_id: str = "doc_id") -> Column:
    """A path for tables without one: the source, for most rows a folder, and the id."""
    folder = F.when(F.col(doc_id) % 8 != 0, F.concat(F.lit("part-"), (F.col(doc_id) % 61).cast("string"), F.lit("/")))
    return F.concat(F.col(source), F.lit("/"), F.coalesce(folder, F.lit("")), F.col(doc_id).cast("string"))


def _vocabulary(spark, templates) -> DataFrame:
    rows = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(templates)], "template int, licence string, notice string")
    return rows.select("template", "licence", F.explode(_tokens(F.col("notice"))).alias("word"))


def _heaviest(weights: dict[str, float], threshold: float) -> tuple[list[str], int]:
    """The fewest words of a template of which a line has to hold two (or one, the number returned) to reach ``threshold``.

    By Cauchy and Schwarz the squared cosine is at most the share of the template's squared norm that
    the line's words hold, so what it lacks may be a share of 1 - threshold^2 at most. Scores are
    rounded to six places before they are compared.
    """
    order = sorted(weights, key=lambda w: (-weights[w], w))
    squares = [weights[w] ** 2 for w in order]
    may_lack = (1 - max(threshold - 1e-6, 0.0) ** 2) * sum(squares) * (1 + 1e-9)
    for k in (2, 1):
        lacked = 0.0
        # A line with k - 1 of the words may hold the heaviest.
        for i, x in enumerate(squares[k - 1 :], k):
            lacked += x
            if lacked > may_lack:
                return order[:i], k
    return order, 1


def _units(text: Column) -> Column:
    """The lines of a text, and its paragraphs of several lines."""
    unit = lambda kind: lambda content, at: F.struct(F.lit(kind).alias("kind"), at.alias("at"), content.alias("content"))
    paragraphs = F.filter(F.split(text, "\n[ \t\r]*\n"), lambda p: F.instr(p, "\n") > 0)
    return F.concat(F.transform(F.split(text, "\n"), unit("line")), F.transform(paragraphs, unit("paragraph")))


def detect(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.7) -> DataFrame:
    """(doc_id, licence, score, part) of the documents that carry a licence; part is its share of the text's words."""
    spark = docs.sparkSession
    # Bounded by the fixed list of templates.
    words = [r[0] for r in _vocabulary(spark, templates).select("word").distinct().orderBy("word").collect()]
    vocabulary = F.array(*(F.lit(w) for w in words))
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    held = texts.select(F.explode(F.array_intersect(_tokens(F.col("text")), vocabulary)).alias("word"))
    df = held.groupBy("word").agg(F.count("*").alias("df"))
    known = spark.createDataFrame([(w,) for w in words], "word string").join(df, "word", "left").fillna(0, ["df"])
    n = docs.count()
    # A word of all texts weighs as if half a text lacked it, so that a template of such words has a norm.
    idf = known.select("word", F.log((F.lit(n) + 1.0) / F.least(F.col("df") + 1.0, F.lit(n) + 0.5)).alias("idf"))
    idf = materialize(idf, "idf")
    most = math.log(n + 1.0)
    t = _vocabulary(spark, templates).groupBy("template", "licence", "word").agg(F.count("*").alias("tf")).join(idf, "word").withColumn("y", F.col("tf") * F.col("idf"))
    norms = t.groupBy("template", "licence").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("t_norm"))
    t = materialize(t.select("template", "licence", "word", "y").join(norms, ["template", "licence"]), "templates")
    weights: dict[int, dict[str, float]] = {}
    for r in t.select("template", "word", "y").collect():
        weights.setdefault(r["template"], {})[r["word"]] = r["y"]
    needs = [_heaviest(w, threshold) for w in weights.values()]
    least = min((k for _, k in needs), default=1)
    array = lambda ws: F.array(*(F.lit(w) for w in ws)).cast("array<string>")
    heavy = array(sorted({w for ws, _ in needs for w in ws}))

    def may_reach(tokens: Column) -> Column:
        held = F.array_intersect(tokens, heavy)
        enough = lambda h: reduce(or_, (F.size(F.array_intersect(h, array(ws))) >= k for ws, k in needs), F.lit(False))
        # The one-element array binds what is held once for all templates.
        return (F.size(held) >= least) & F.exists(F.array(held), enough)

    lines = (
        texts.where(may_reach(_tokens(F.col("text"))))
        .select("doc_id", F.size(_tokens(F.col("text"))).alias("words"), F.explode(_units(F.col("text"))).alias("u"))
        .select("doc_id", "words", F.struct("u.kind", "u.at").alias("line"), _tokens(F.col("u.content")).alias("tokens"))
        .where(may_reach(F.col("tokens")))
    )
    weight = F.col("tf") * F.coalesce("idf", F.lit(most))
    cells = (
        lines.select("doc_id", "words", "line", F.size("tokens").alias("length"), F.explode("tokens").alias("word"))
        .groupBy("doc_id", "words", "line", "length", "word").agg(F.count("*").alias("tf"))
        .join(F.broadcast(idf), "word", "left").withColumn("x", weight)
    )
    by_line = ["doc_id", "words", "line", "length"]
    cells = materialize(cells, "cells")
    length = cells.groupBy(*by_line).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = cells.join(F.broadcast(t), "word").groupBy(*by_line, "template", "licence", "t_norm").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    scores = dots.join(length, by_line).withColumn("score", F.round(F.try_divide("dot", F.col("norm") * F.col("t_norm")), 6))
    good = scores.where(F.col("score") >= threshold)
    per_line = good.groupBy("doc_id", "words", "line", "length").agg(F.min_by(F.struct("licence", "score"), F.struct(-F.col("score"), "licence")).alias("b"))
    of = lambda kind: F.sum(F.when(F.col("line.kind") == kind, F.col("length")).otherwise(0))
    return per_line.groupBy("doc_id").agg(
        F.min_by(F.struct("b.licence", "b.score"), F.struct(-F.col("b.score"), "b.licence")).alias("b"),
        F.least(F.greatest(of("line"), of("paragraph")) / F.max("words"), F.lit(1.0)).alias("part"),
    ).select("doc_id", "b.licence", "b.score", "part")


def _parent(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def inherit(paths: DataFrame, found: DataFrame, whole: float = 0.1) -> DataFrame:
    """(doc_id, path, licence, score, origin) of all rows of ``paths`` (doc_id, path); origin is own, inherited or none."""
    own = paths.join(found, "doc_id", "left").withColumn("directory", _parent(F.col("path")))
    own = materialize(own, "own-licences")
    files = own.where(F.col("part") >= whole).where(F.col("path").isNotNull()).groupBy("directory").agg(
        F.min_by(F.struct("licence", "score"), F.struct(-F.col("part"), "path")).alias("given")
    )
    directories = own.where(F.col("directory").isNotNull()).select("directory").distinct()
    depth = F.size(F.split("directory", "/"))
    above = directories.select(
        "directory",
        F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), depth), lambda k: F.array_join(F.slice(F.split("directory", "/"), 1, k), "/")))).alias("ancestor"),
    )
    nearest = (
        above.join(files.withColumnRenamed("directory", "ancestor"), "ancestor")
        .groupBy("directory").agg(F.max_by("given", F.length("ancestor")).alias("given"))
    )
    origin = F.when(F.col("licence").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited").otherwise("none")
    return spread_join(own, nearest, "directory", "doc_id").select(
        "doc_id", "path", F.coalesce("licence", "given.licence").alias("licence"),
        F.coalesce("score", "given.score").alias("score"), origin.alias("origin"),
    )
