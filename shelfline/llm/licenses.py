"""License scans with a positional index of rare words.

Method. The document frequency of every word of the license templates is counted over all documents. Of each phrase
that a license must contain (its key phrase), the two words of highest IDF are looked up in a file. Each place of
such a word gives a begin of the phrase by its relative position; begins on which both words agree are verified word
by word. A license whose key phrase stands is scored by the share of its template's words found at their relative
positions around it, and is labelled from SHARE on. Base phrases are templates of their own.

Every file is one row throughout: nothing is shuffled but the counts of template words. Only DataFrame functions are
used. Defined results: null and empty texts have no words, labels or places and score 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARE = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and labels of the base scan.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Label, words of the license's notice, key phrase within it.
TEMPLATES = [
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("apache", "licensed under the apache license version 2 0", "licensed under the apache license"),
    ("artistic", "the artistic license 2 0", "artistic license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("boost", "boost software license version 1 0", "boost software license"),
    ("cc-by-nc", "cc by nc", "cc by nc"),
    ("cc-by-nd", "cc by nd", "cc by nd"),
    ("cc-by-sa", "cc by sa", "cc by sa"),
    ("cc-by", "creative commons attribution 4 0 international", "creative commons attribution"),
    ("cc0", "cc0 1 0 universal", "cc0 1 0"),
    ("epl", "eclipse public license v 2 0", "eclipse public license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", "terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("mpl", "mozilla public license version 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("zlib", "this software is provided as is without any express or implied warranty", "provided as is without any express"),
]


def words(text: str = "text") -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), F.lit(f"({WORD})"), F.lit(1))


def _offset(whole: list[str], part: list[str]) -> int:
    return next(i for i in range(len(whole)) if whole[i : i + len(part)] == part)


def document_frequency(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, int]:
    """Documents that hold each of the given words; the vocabulary bounds what comes to the driver."""
    held = docs.select(F.explode(F.array_intersect(words(text), F.lit(vocabulary))).alias("word"))
    return {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}


def _begins(phrase: list[str], frequency: dict[str, int]) -> Column:
    """All begins of a phrase in `words`, by its two rarest words and then by all of its words."""
    rare = sorted(range(len(phrase)), key=lambda i: (frequency.get(phrase[i], 0), i))[:2]
    lists = [_moved(phrase[o], o) for o in rare]
    both = F.array_intersect(*lists) if len(lists) > 1 else lists[0]
    return F.filter(both, lambda b: (b >= 0) & (F.slice("words", b + 1, len(phrase)) == F.lit(phrase)))


def _moved(word: str, offset: int) -> Column:
    """Begins that the places of a looked-up word stand for."""
    return F.transform(F.filter("rare_at", lambda p: F.get("words", p) == F.lit(word)), lambda p: p - F.lit(offset))


def _share(begins: Column, template: list[str], at: int) -> Column:
    """Largest share of a template's words found around begins of its key phrase, `at` words into the template."""

    def share(b):
        hits = [F.when(F.get("words", b + F.lit(j - at)) == F.lit(w), 1).otherwise(0) for j, w in enumerate(template)]
        return reduce(lambda x, y: x + y, hits) / F.lit(float(len(template)))

    return F.coalesce(F.array_max(F.transform(begins, share)), F.lit(0.0))


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    base = {p: p.split() for p in BASE}
    templates = [(label, t.split(), k.split()) for label, t, k in TEMPLATES]
    phrases = [*base.values(), *(k for _, _, k in templates)]
    vocabulary = sorted({w for p in phrases for w in p})
    frequency = document_frequency(docs, vocabulary, text)
    looked_up = sorted({w for p in phrases for w in sorted(p, key=lambda w, p=p: (frequency.get(w, 0), p.index(w)))[:2]})
    rows = docs.select("doc_id", words(text).alias("words"))
    rows = rows.withColumn("n_words", F.size("words").cast("bigint"))
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda p: F.array_contains(F.lit(looked_up), F.get("words", p)))
    none = F.array().cast("array<int>")
    rows = rows.withColumn("rare_at", F.when(F.arrays_overlap("words", F.lit(looked_up)), places).otherwise(none))
    rare = F.size("rare_at") > 0

    found = F.array(*[F.struct(F.lit(BASE[p]).alias("label"), _begins(w, frequency).alias("begins")) for p, w in base.items()])
    scores = []
    for label, template, key in templates:
        share = _share(_begins(key, frequency), template, _offset(template, key))
        scores.append(F.struct(F.lit(label).alias("label"), share.alias("share")))
    rows = rows.withColumn("base", F.when(rare, found)).withColumn("method", F.when(rare, F.array(*scores)))
    rows = rows.withColumn("base", F.filter("base", lambda s: F.size(s["begins"]) > 0)).withColumn("method", F.filter("method", lambda s: s["share"] >= SHARE))
    begins = F.coalesce(F.flatten(F.col("base.begins")), none)
    empty = F.array().cast("array<string>")
    base_labels = F.coalesce(F.array_sort(F.array_distinct(F.col("base.label"))), empty)
    labels = F.array_sort(F.array_union(base_labels, F.coalesce(F.col("method.label"), empty)))
    return rows.select(
        "doc_id",
        "n_words",
        F.size(begins).cast("bigint").alias("n_base"),
        F.array_min(begins).cast("bigint").alias("first_word"),
        F.array_max(begins).cast("bigint").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size(begins) > 0, 1.0).otherwise(F.coalesce(F.array_max(F.col("method.share")), F.lit(0.0))).alias("score"),
    )


def sql(table: str = "documents") -> str:
    """The same scan for DuckDB, without an index: every place of every text is tried."""
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    at = lambda ws: f"list_filter(range(len(w)), lambda i: w[i + 1:i + {len(ws)}] = {quoted(ws)})"
    base = ", ".join(f"{{'label': '{label}', 'begins': {at(p.split())}}}" for p, label in BASE.items())
    method = []
    for label, t, k in TEMPLATES:
        template, key = t.split(), k.split()
        o = _offset(template, key)
        hits = " + ".join(f"(CASE WHEN i + {j - o} >= 0 AND w[i + {j - o + 1}] = '{x}' THEN 1 ELSE 0 END)" for j, x in enumerate(template))
        method.append(f"{{'label': '{label}', 'share': coalesce(list_max(list_transform({at(key)}, lambda i: ({hits}) / {len(template)}.0)), 0.0)}}")
    return f"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM {table}
), f AS (
  SELECT doc_id, len(w) AS n,
    list_filter([{base}], lambda s: len(s.begins) > 0) AS b,
    list_filter([{", ".join(method)}], lambda s: s.share >= {SHARE}) AS m
  FROM t
), g AS (
  SELECT *, flatten(list_transform(b, lambda s: s.begins)) AS places, list_transform(b, lambda s: s.label) AS bl, list_transform(m, lambda s: s.label) AS ml FROM f
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base,
  CAST(list_min(places) AS BIGINT) AS first_word, CAST(list_max(places) AS BIGINT) AS last_word,
  array_to_string(list_sort(list_distinct(bl)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(bl, ml))), ',') AS labels,
  CAST(CASE WHEN len(places) > 0 THEN 1.0 ELSE coalesce(list_max(list_transform(m, lambda s: s.share)), 0.0) END AS DOUBLE) AS score
FROM g"""
