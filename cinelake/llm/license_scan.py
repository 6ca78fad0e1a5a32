"""License scans: TF-IDF cosine to templates, then inheritance from directories.

A file's header is made of its lines that speak of licensing. Header lines, runs
of adjacent lines around them (a notice wrapped over lines), and a licence file's
text as a whole, become sparse vectors of term counts times inverse document
frequency; the frequencies count all header lines of all files. The cosine to
each template comes from an equi-join on terms with the templates' postings, a
table bounded by the stated templates. The best template at or above a limit is
the text's licence, the best text's the file's own. Runs that by their bounds
cannot reach the limit, or a line of their own, are not sent to the join.

A licence file is one whose name says so, or whose header lines make up most of
it. It states the licence of its directory; a file without a licence of its own
takes the one of the nearest directory above it: each distinct directory is
joined, by path, with its ancestors' licences, and files join directories.

Only header lines, runs and licence files are exploded, never other texts; a directory with a third of all
files is one row on the other side of a plain equi-join, which adaptive execution
may split or broadcast by its size.

Defined results: a null or empty text has no header; a null path has no directory
and inherits nothing; ties go to the higher cosine, then the first licence by
name, then the first path; repeated files each get a row; empty tables give no
rows. Other columns are dropped.
"""

from __future__ import annotations

import re
from collections import Counter
from math import sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import staged

#: Short public statements and first sentences of the licences' texts.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to the public domain, CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

HEADER_LINE = r"(?i)licen[cs]|copyright|spdx-|public domain|permission is|permission to|redistribut"
LICENSE_NAME = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-][^/]*)?$"
#: The same where a line may end between two words.
WRAPPED = r"(?i)licen[cs]|copyright|spdx-|public[^A-Za-z0-9]+domain|permission[^A-Za-z0-9]+(is|to)|redistribut"
MIN_COSINE = 0.6
#: Words of a run of lines, in those of the longest template.
LONGEST = 3
#: Share of a file's words in header lines from which it is a licence file.
MOSTLY = 0.5


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), 1)


def directory(path: Column) -> Column:
    """Up to the last slash, without it; '' is the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def header_lines(files: DataFrame) -> DataFrame:
    """``file`` (path and key), ``line``, ``words`` of each header line."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(HEADER_LINE))
    return (
        files.filter(F.col("text").rlike(HEADER_LINE))
        .select("path", "key", F.posexplode(lines).alias("no", "line"))
        .withColumn("terms", terms(F.col("line")))
        .filter(F.size("terms") > 0)
    )


def _weighted(rows: DataFrame, by: list[str], idf: DataFrame) -> DataFrame:
    """Term weights of each ``by``, scaled to length one."""
    counts = rows.select(*by, F.explode("terms").alias("term")).groupBy(*by, "term").agg(F.count("*").alias("tf"))
    w = counts.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = w.groupBy(*by).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, by).select(*by, "term", (F.col("w") / F.col("norm")).alias("w"))


def _frequencies(lines: DataFrame, given: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """``term``, ``idf`` of the terms of header lines, templates and ``more``."""
    total = lines.agg(F.count("*").alias("total"))
    distinct = lines.groupBy("terms").agg(F.count("*").alias("n"))
    seen = distinct.select(F.explode(F.array_distinct("terms")).alias("term"), "n").groupBy("term").agg(F.sum("n").alias("df"))
    known = given.select(F.explode("terms").alias("term"))
    if more is not None:
        known = known.unionByName(more.select(F.explode("terms").alias("term")))
    known = known.distinct().join(seen, "term", "full")
    return known.crossJoin(F.broadcast(total)).select("term", (F.log((F.col("total") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1).alias("idf"))


def _templates(spark: SparkSession, templates) -> DataFrame:
    given = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(templates)], "template int, license string, statement string")
    return given.select("template", "license", terms(F.col("statement")).alias("terms"))


def classify_lines(lines: DataFrame, templates=TEMPLATES, more: DataFrame | None = None) -> DataFrame:
    """The best licence of each distinct header text: ``text``, ``license``, ``cosine``.

    Texts are compared as term sequences, each once however often it occurs; the
    frequencies count every occurrence. ``more`` has the ``terms`` of texts that are
    classified too, but not counted.
    """
    given = _templates(lines.sparkSession, templates)
    idf = _frequencies(lines, given, more)
    texts = lines.select("terms") if more is None else lines.select("terms").unionByName(more.select("terms"))
    a = _weighted(texts.distinct().withColumn("text", F.array_join("terms", " ")), ["text"], idf)
    b = _weighted(given, ["template", "license"], idf).withColumnRenamed("w", "v")
    cosine = a.join(F.broadcast(b), "term").groupBy("text", "template", "license").agg(F.sum(F.col("w") * F.col("v")).alias("cosine"))
    best = cosine.groupBy("text").agg(F.min(F.struct((-F.round("cosine", 9)).alias("c"), "license")).alias("b"))
    return best.select("text", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine")).filter(F.col("cosine") >= MIN_COSINE)


def _runs(path: str | None, text: str, vectors: list[dict[str, float]], idf: dict[str, float], most: float, longest: int) -> list[list[str]]:
    """Terms of the runs of lines of a file, and of a licence file's whole text, that
    may have a licence none of their lines has. ``idf`` has the templates' terms,
    ``most`` is the largest of any term; the least is 1."""

    def bounds(words):
        tf = Counter(words)
        own = sum((n * idf[w]) ** 2 for w, n in tf.items() if w in idf)
        rest = sum(n * n for w, n in tf.items() if w not in idf)
        dot = max(sum(n * idf[w] * v[w] for w, n in tf.items() if w in v) for v in vectors)
        return dot / sqrt(own + rest * most * most), dot / sqrt(own + rest)

    lines = text.split("\n")
    words = [re.findall("[a-z0-9]+", x.lower()) for x in lines]
    ends, at = [], -1
    for x in lines:
        at += len(x) + 1
        ends.append(at)
    marked, k = set(), 0
    for m in re.finditer(WRAPPED, text):
        while ends[k] < m.start():
            k += 1
        last = k
        while ends[last] < m.end() - 1:
            last += 1
        marked |= set(range(k, last + 1))
    alone = {k: bounds(words[k])[0] if words[k] and re.search(HEADER_LINE, lines[k]) else 0.0 for k in marked}
    found = {}
    for k in sorted(marked):
        first, before = k, 0
        while True:
            last, size, best = first, 0, 0.0
            while last < len(lines) and words[last]:
                size += len(words[last])
                best = max(best, alone.get(last, 0.0))
                if last > first and size > longest:
                    break
                if last >= k and last > first and (first, last) not in found:
                    run = [w for x in words[first : last + 1] for w in x]
                    high = bounds(run)[1] + 1e-9
                    found[first, last] = run if high >= MIN_COSINE and high > best + 2e-9 else None
                last += 1
            first -= 1
            if first < 0 or not words[first]:
                break
            before += len(words[first])
            if before > longest:
                break
    out = [x for x in found.values() if x]
    whole = [w for x in words for w in x]
    named = path is not None and re.search(LICENSE_NAME, path.rsplit("/", 1)[-1])
    if sum(map(bool, words)) > 1 and (named or sum(len(words[k]) for k in marked) >= MOSTLY * len(whole)) and bounds(whole)[1] >= MIN_COSINE - 1e-9:
        out.append(whole)
    return out


def header_runs(files: DataFrame, lines: DataFrame, templates=TEMPLATES) -> DataFrame:
    """``path``, ``key``, ``terms`` of runs of lines and of whole licence files."""
    spark = files.sparkSession
    given = _templates(spark, templates)
    idf = {r.term: r.idf for r in _frequencies(lines, given).join(F.broadcast(given.select(F.explode("terms").alias("term")).distinct()), "term").collect()}
    most = lines.agg((F.log(F.count("*") + 1) + 1).alias("m")).first().m
    vectors, longest = [], 0
    for r in given.collect():
        v = {w: n * idf[w] for w, n in Counter(r.terms).items()}
        norm = sqrt(sum(x * x for x in v.values()))
        vectors.append({w: x / norm for w, x in v.items()})
        longest = max(longest, LONGEST * len(r.terms))

    def run(batches):
        for batch in batches:
            at, out = [], []
            for i, (path, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for x in _runs(path, text, vectors, idf, most, longest):
                    at.append(i)
                    out.append(x)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(out, pa.list_(pa.string()))], names=["path", "key", "terms"])

    schema = T.StructType([files.schema["path"], files.schema["key"], T.StructField("terms", T.ArrayType(T.StringType()))])
    return files.filter(F.col("text").rlike(WRAPPED)).select("path", "key", "text").mapInArrow(run, schema)


def scan(files: DataFrame, templates=TEMPLATES) -> DataFrame:
    """``path``, ``key``, ``own_license``, ``cosine``, ``license`` and
    ``inherited_from`` (a directory, or null) of every file.

    ``files`` has ``path``, ``key`` (any id, distinct for distinct files) and
    ``text``; it is read three times, for header lines, runs and the result.
    """
    lines = staged(header_lines(files), "headers")  # a few lines a file, used several times
    runs = staged(header_runs(files, lines, templates), "runs")
    texts = lines.select("path", "key", "terms", "no").unionByName(runs.withColumn("no", F.lit(None).cast("int")))
    found = texts.withColumn("statement", F.array_join("terms", " ")).join(
        classify_lines(lines, templates, runs).withColumnRenamed("text", "statement"), "statement"
    )
    size = F.size("terms")
    own = found.groupBy("path", "key").agg(
        F.min(F.struct((-F.col("cosine")).alias("c"), "license", F.coalesce("no", F.lit(2**31 - 1)).alias("no"), size.alias("size"))).alias("b"),
        F.sum(F.when(F.col("no").isNotNull(), size)).alias("line_words"),
    )
    own = own.select("path", "key", F.col("b.license").alias("own_license"), (-F.col("b.c")).alias("cosine"), F.greatest("line_words", "b.size").alias("header_words"))
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != ""))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    every = files.select("path", "key", words.alias("words"), directory(F.col("path")).alias("dir"))
    held = every.select("path", "key", "words", "dir").join(own, (every.path.eqNullSafe(own.path)) & (every.key.eqNullSafe(own.key)), "left").select(
        every.path, every.key, "words", "dir", "own_license", "cosine", "header_words"
    )
    states = held.filter(F.col("own_license").isNotNull() & F.col("dir").isNotNull() & (name.rlike(LICENSE_NAME) | (F.col("header_words") >= MOSTLY * F.col("words"))))
    stated = states.groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "own_license", "path")).alias("s")).select(F.col("dir").alias("above"), F.col("s.own_license").alias("dir_license"))
    parts = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    dirs = every.filter("dir is not null").select("dir").distinct()
    near = (
        dirs.select("dir", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), ups))).alias("above"))
        .join(stated, "above")
        .groupBy("dir")
        .agg(F.max(F.struct(F.length("above").alias("n"), "above", "dir_license")).alias("s"))
        .select("dir", F.col("s.above").alias("above"), F.col("s.dir_license").alias("dir_license"))
    )
    return held.join(near, "dir", "left").select(
        "path", "key", "own_license", F.round("cosine", 6).alias("cosine"),
        F.coalesce("own_license", "dir_license").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("above")).alias("inherited_from"),
    )


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as files: a document's path is /source/lang/doc_id.txt."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat(F.lit("/"), F.coalesce("source", F.lit("unknown")), F.lit("/"), F.coalesce("lang", F.lit("unknown")), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("unknown")), F.lit(".txt"))
    return scan(docs.select(path.alias("path"), F.col("doc_id").alias("key"), "text")).withColumnRenamed("key", "doc_id")


def _op5_sql() -> str:
    """The query in DuckDB's SQL, with the same templates and limits."""
    given = ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(TEMPLATES))
    return rf"""
WITH f AS (SELECT doc_id, '/' || coalesce(source, 'unknown') || '/' || coalesce(lang, 'unknown') || '/' || coalesce(CAST(doc_id AS VARCHAR), 'unknown') || '.txt' AS path, text FROM documents),
p AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS dir, len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS words FROM f),
ln AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{HEADER_LINE}'))) AS line FROM f WHERE regexp_matches(text, '{HEADER_LINE}')),
h AS (SELECT doc_id, regexp_extract_all(lower(line), '[a-z0-9]+') AS terms FROM ln),
d AS (SELECT array_to_string(terms, ' ') AS st, any_value(terms) AS terms, count(*) AS n FROM h WHERE len(terms) > 0 GROUP BY 1),
t AS (SELECT i, license, regexp_extract_all(lower(s), '[a-z0-9]+') AS terms FROM (VALUES {given}) v(i, license, s)),
df AS (SELECT term, sum(n) AS df FROM (SELECT unnest(list_distinct(terms)) AS term, n FROM d) GROUP BY term),
idf AS (
  SELECT term, ln(((SELECT coalesce(sum(n), 0) FROM d) + 1) / (coalesce(df, 0) + 1)) + 1 AS idf
  FROM (SELECT DISTINCT unnest(terms) AS term FROM t) FULL JOIN df USING (term)),
ta AS (SELECT st, term, count(*) * any_value(idf) AS w FROM (SELECT st, unnest(terms) AS term FROM d) JOIN idf USING (term) GROUP BY ALL),
tb AS (SELECT i, license, term, count(*) * any_value(idf) AS w FROM (SELECT i, license, unnest(terms) AS term FROM t) JOIN idf USING (term) GROUP BY ALL),
na AS (SELECT st, sqrt(sum(w * w)) AS n FROM ta GROUP BY st),
nb AS (SELECT i, sqrt(sum(w * w)) AS n FROM tb GROUP BY i),
cs AS (SELECT st, i, license, sum(ta.w / na.n * tb.w / nb.n) AS c FROM ta JOIN tb USING (term) JOIN na USING (st) JOIN nb USING (i) GROUP BY ALL),
best AS (SELECT st, min((-round(c, 9), license)) AS b FROM cs GROUP BY st),
cl AS (SELECT st, b[2] AS license, -b[1] AS cosine FROM best WHERE -b[1] >= {MIN_COSINE}),
own AS (
  SELECT doc_id, min((-cosine, license)) AS b, sum(len(terms)) AS header_words
  FROM h JOIN cl ON st = array_to_string(terms, ' ') GROUP BY doc_id),
held AS (SELECT path, doc_id, dir, words, b[2] AS own_license, -b[1] AS cosine, header_words FROM p LEFT JOIN own USING (doc_id)),
st AS (SELECT dir AS above, min((-cosine, own_license, path))[2] AS dir_license FROM held WHERE own_license IS NOT NULL AND header_words >= {MOSTLY} * words GROUP BY dir),
up AS (
  SELECT DISTINCT dir, unnest(['', regexp_extract(dir, '^/[^/]*'), dir]) AS above FROM p),
near AS (SELECT dir, max((length(above), above, dir_license)) AS s FROM up JOIN st USING (above) GROUP BY dir)
SELECT path, doc_id, own_license, round(cosine, 6) AS cosine, coalesce(own_license, s[3]) AS license, CASE WHEN own_license IS NULL THEN s[2] END AS inherited_from
FROM held LEFT JOIN near USING (dir)
"""


OP5_SQL = _op5_sql()
