"""Operator 8: licence statements by Dice coefficient over word bigrams, in DataFrame operations only.

Every line of a text is normalised (lower case, letters, digits and dots inside words kept) and compared to licence templates.  With
A and B the bigram multisets of line and template as sets, the coefficient is 2 |A & B| / (|A| + |B|).  It can reach ``LEAST`` only if
the sizes are within the factor LEAST / (2 - LEAST), so most lines are dropped by their length before any bigram is made, and a line
meets only the templates of fitting size.

Templates are a fixed list of short statements; it can be replaced.  The join of lines and templates goes through shared bigrams,
never through all pairs.

Nulls and odd input: a null or empty text has no lines; a line of one word is the single bigram of that word; equal lines of a text
are each reported; repeated rows each report; a tie goes to the first template in the list; an empty table has no rows; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcast.llm.common import table

LEAST = 0.8

#: Customary statements that name a licence.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("proprietary", "All rights reserved."),
)


def words_of(line: Column) -> Column:
    """Words of a line: runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(line), F.lit(r"[\p{L}\p{N}]+"), 0)


def bigrams(words: Column) -> Column:
    """Bigrams in order, repeats included; the word itself where there is only one."""
    pairs = F.transform(F.slice(words, F.lit(1), F.size(words) - 1), lambda w, i: F.concat_ws(" ", w, F.element_at(words, i + 2)))
    return F.when(F.size(words) > 1, pairs).otherwise(words)


def templates(spark: SparkSession, given=TEMPLATES) -> list[tuple[int, str, list[str]]]:
    """``(number, license, bigrams)`` of the given list, taken apart by the same expressions as the texts."""
    rows = [F.struct(F.lit(i).alias("number"), F.lit(name).alias("license"), F.lit(text).alias("line")) for i, (name, text) in enumerate(given)]
    each = spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*")
    found = each.select("number", "license", bigrams(words_of(F.col("line"))).alias("grams"))
    return [tuple(r) for r in found.collect()]  # one row a template


def literal(grams: list[str]) -> Column:
    return F.array(*(F.lit(g) for g in grams))


def shared(a: Column, b: Column) -> Column:
    """Size of the intersection of two multisets."""
    def count(x: Column, g: Column) -> Column:
        return F.size(F.filter(x, lambda y: y == g))

    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, g: n + F.least(count(a, g), count(b, g)))


def once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` with a costly column as the output of a generator, so that the optimiser does not repeat it at each use."""
    return df.select("doc_id", "line_no", F.explode(F.array(value)).alias(name))


def scan(docs: DataFrame, given=TEMPLATES, least: float = LEAST) -> DataFrame:
    """``doc_id, line_no, license, dice`` of every line that matches a template, with the best template of the line."""
    known = templates(docs.sparkSession, given)
    wide = least / (2 - least)
    low, high = min(len(g) for *_, g in known) * wide, max(len(g) for *_, g in known) / wide
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    worded = once(lines.where(F.length("line") > 0), words_of(F.col("line")), "words")
    fitting = worded.where((F.size("words") > 0) & F.greatest(F.lit(1), F.size("words") - 1).between(low, high))
    grams = once(fitting, bigrams(F.col("words")), "grams")
    some = grams.where(F.arrays_overlap("grams", literal(sorted({g for *_, own in known for g in own}))))
    size = F.size("grams")
    scores = []
    for number, name, own in known:
        dice = F.lit(2.0) * shared(F.col("grams"), literal(own)) / (size + len(own))
        fits = size.between(len(own) * wide, len(own) / wide)
        scores.append(F.when(fits, F.struct(dice.alias("dice"), F.lit(-number).alias("turn"), F.lit(name).alias("license"))))
    best = some.withColumn("best", F.array_max(F.array(*scores)))
    return best.where(F.col("best.dice") >= least).select("doc_id", "line_no", F.col("best.license").alias("license"), F.col("best.dice").alias("dice"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence statements in all documents."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP8_SQL = rf"""
WITH given AS (SELECT * FROM (VALUES {", ".join(f"({i}, {_quoted(n)}, {_quoted(t)})" for i, (n, t) in enumerate(TEMPLATES))}) AS t(number, license, line)),
lines AS (
  SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)),
line_words AS (SELECT doc_id, line_no, regexp_extract_all(lower(line), '[\p{{L}}\p{{N}}]+') AS w FROM lines),
own_words AS (SELECT number, license, regexp_extract_all(lower(line), '[\p{{L}}\p{{N}}]+') AS w FROM given),
line_grams AS (
  SELECT doc_id, line_no, greatest(1, len(w) - 1) AS size, CASE WHEN len(w) = 1 THEN w ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END AS g
  FROM line_words WHERE len(w) BETWEEN 1 AND 64),
own_grams AS (
  SELECT number, license, greatest(1, len(w) - 1) AS size, CASE WHEN len(w) = 1 THEN w ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END AS g FROM own_words),
a AS (SELECT doc_id, line_no, size, gram, count(*) AS n FROM (SELECT doc_id, line_no, size, unnest(g) AS gram FROM line_grams) GROUP BY ALL),
b AS (SELECT number, license, size, gram, count(*) AS n FROM (SELECT number, license, size, unnest(g) AS gram FROM own_grams) GROUP BY ALL),
dices AS (
  SELECT doc_id, line_no, number, license, 2.0::DOUBLE * sum(least(a.n, b.n)) / (max(a.size) + max(b.size)) AS dice
  FROM a JOIN b USING (gram) GROUP BY doc_id, line_no, number, license)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, license, CAST(dice AS DOUBLE) AS dice
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY dice DESC, number) AS r FROM dices WHERE dice >= 0.8) WHERE r = 1
"""
