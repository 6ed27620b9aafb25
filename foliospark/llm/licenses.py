"""Licence scan by a positional index of rare words.

The templates' rare words are indexed: word to (template, position). A pass over all documents counts in how
many of them each indexed word stands. Then each document's indexed words are looked up, all of them; a posting votes
with its IDF for (template, place of the template's start), and a template's coverage is its best place's share of what
its own words could give. A template is found at coverage LEAST or more if its mandatory phrase stands in the text.

Everything is column expressions; texts without an indexed word, which no template can match, are not taken apart.
Null and empty texts have no words and no labels. Rows are treated one by one. A column of the result's name is
replaced.
"""

from __future__ import annotations

import re
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: openings of public licence texts and notices, each with the phrase that must stand in a file
TEMPLATES = {
    "mit-text": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    "mit-notice": ("Released under the MIT License", "mit license"),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0", "apache license version 2 0"),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3", "gnu general public license version 3"),
    "lgpl": ("licensed under the GNU Lesser General Public License", "gnu lesser general public license"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License", "mozilla public license"),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0", "cc by nc 4 0"),
    "cc-by-4.0": ("Licensed under CC BY 4.0", "cc by 4 0"),
    "unlicense": ("This is free and unencumbered software released into the public domain", "free and unencumbered software"),
    "all-rights-reserved": ("All rights reserved", "all rights reserved"),
}
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
#: Words of the templates that are indexed: those that other texts seldom hold. The rest is left to the phrases.
INDEXED = "apache binary documentation gnu granted hereby lesser license licensed modification mozilla permission redistribution released reserved rights software unencumbered version".split()
#: What every indexed word holds one of: texts without any are not taken apart.
NEEDLES = "apache binary documentation gnu granted hereby lesser licens modification mozilla permission redistribution released reserved rights software unencumbered version".split()

LEAST = 0.75

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def _words(text: str) -> list[str]:
    return re.findall(WORD + "+", text.lower())


#: word -> [(template number, position)], of the indexed words
POSTINGS: dict[str, list[tuple[int, int]]] = {}
for _n, (_text, _) in enumerate(TEMPLATES.values()):
    for _at, _word in enumerate(_words(_text)):
        if _word in INDEXED:
            POSTINGS.setdefault(_word, []).append((_n, _at))

def phrase(words: str) -> str:
    """A pattern of words that stand one after the other."""
    return f"(?<!{WORD}){(GAP + '++').join(words.split())}(?!{WORD})"


def _holds(lowered: Column) -> Column:
    """Whether a lower-cased text can hold an indexed word."""
    out = F.contains(lowered, F.lit(NEEDLES[0]))
    for n in NEEDLES[1:]:
        out = out | F.contains(lowered, F.lit(n))
    return out


def _hits(text: Column) -> Column:
    """Indexed words of a text and their positions, in order."""
    # ASCII capitals only are lower-cased: lower() also turns other letters into ASCII ones
    every = F.transform(F.regexp_extract_all(text, F.lit(WORD + "+"), F.lit(0)), lambda w, i: F.struct(w.alias("word"), i.alias("at")))
    some = F.filter(every, lambda h: F.lower(h["word"]).isin(list(POSTINGS)) & (F.octet_length(h["word"]) == F.length(h["word"])))
    return F.transform(some, lambda h: F.struct(F.lower(h["word"]).alias("word"), h["at"].alias("at")))


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, dict[str, int]]:
    """How many documents there are, and in how many each indexed word stands: as many rows as there are such words."""
    column = F.coalesce(F.col(text).cast("string"), F.lit(""))
    present = F.when(_holds(F.lower(column)), F.array_distinct(F.transform(_hits(column), lambda h: h["word"]))).otherwise(F.expr("cast(array() as array<string>)"))
    rows = docs.select(F.explode(F.concat(F.array(F.lit("")), present)).alias("word")).groupBy("word").count().collect()
    counts = {r["word"]: r["count"] for r in rows}
    return counts.pop("", 0), counts


def scan(docs: DataFrame, *, text: str = "text", into: str = "license") -> DataFrame:
    """docs with a struct column `into`: n_words, starts of base phrases, base and method labels, score (0 to 1)."""
    total, seen = document_frequencies(docs, text)
    idf = {w: log((total + 1) / (seen.get(w, 0) + 1)) + 1 for w in POSTINGS}
    column = F.coalesce(F.col(text).cast("string"), F.lit(""))

    lowered = docs.withColumn("__text", column).withColumn("__lower", F.lower("__text"))
    asked = lowered.withColumn("__holds", _holds(F.col("__lower"))).withColumn("__license", F.contains("__lower", F.lit("license"))).drop("__lower")
    column = F.col("__text")

    # base phrases: the text is parted before each; words of the parts add up to the phrases' positions
    any_base = "(?i)(?:" + "|".join(phrase(p) for p in BASE.values()) + ")"
    count = lambda c: F.regexp_count(c, F.lit(WORD + "+"))
    parts = F.transform(F.split(F.concat(F.lit("\n"), column), f"(?i)(?={'|'.join(phrase(p) for p in BASE.values())})", -1), count)
    starts = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), F.expr("cast(array() as array<int>)"), lambda a, n: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + n)))
    starts = F.when(F.col("__license") & column.rlike(any_base), starts).otherwise(F.expr("cast(array() as array<int>)"))
    base = F.filter(F.array(*(F.when(column.rlike(f"(?i){phrase(p)}"), F.lit(label)) for label, p in BASE.items())), lambda x: x.isNotNull())

    # votes: every indexed word of the text, each posting for (template, start)
    weights = F.create_map(*(x for w in POSTINGS for x in (F.lit(w), F.lit(idf[w]))))
    postings = F.create_map(*(x for w, p in POSTINGS.items() for x in (F.lit(w), F.array(*(F.struct(F.lit(t).alias("t"), F.lit(at).alias("at")) for t, at in p)))))
    asked = asked.withColumn("__hits", F.when(F.col("__holds"), _hits(column)).otherwise(F.expr("cast(array() as array<struct<word:string,at:int>>)")))
    hits = F.col("__hits")
    votes = F.flatten(F.transform(hits, lambda h: F.transform(postings[h["word"]], lambda p: F.struct(p["t"].alias("t"), (h["at"] - p["at"]).alias("start"), weights[h["word"]].alias("w")))))
    zeros = F.array(*(F.lit(0.0) for _ in TEMPLATES))
    zero = F.struct(F.lit(-1).alias("t"), F.lit(0).alias("start"), F.lit(0.0).alias("sum"), zeros.alias("best"))

    def step(acc: Column, v: Column) -> Column:
        """Votes come sorted: those for one place are neighbours."""
        total = F.when((acc["t"] == v["t"]) & (acc["start"] == v["start"]), acc["sum"]).otherwise(0.0) + v["w"]
        return F.struct(v["t"].alias("t"), v["start"].alias("start"), total.alias("sum"), F.transform(acc["best"], lambda b, i: F.when(i == v["t"], F.greatest(b, total)).otherwise(b)).alias("best"))

    best = F.aggregate(F.array_sort(votes), zero, step, lambda acc: acc["best"])
    full = [sum(idf[w] for w, p in POSTINGS.items() for t, _ in p if t == n) for n in range(len(TEMPLATES))]
    found = F.transform(best, lambda b, i: F.least(F.lit(1.0), F.round(b / F.array(*map(F.lit, full))[i], 6)))
    coverage = F.when(F.size(hits) > 0, found).otherwise(zeros)
    own = [F.when((F.get(F.col("__coverage"), F.lit(n)) >= LEAST) & column.rlike(f"(?i){phrase(key)}"), F.struct(F.lit(label).alias("label"), F.get(F.col("__coverage"), F.lit(n)).alias("coverage"))) for n, (label, (_, key)) in enumerate(TEMPLATES.items())]
    matched = F.when(F.array_max(F.col("__coverage")) >= LEAST, F.filter(F.array(*own), lambda x: x.isNotNull())).otherwise(F.expr("cast(array() as array<struct<label:string,coverage:double>>)"))
    out = asked.withColumn("__coverage", coverage).withColumn("__own", matched).withColumn("__starts", starts)
    bases = F.when(F.size("__starts") > 0, base).otherwise(F.expr("cast(array() as array<string>)"))
    return out.withColumn(
        into,
        F.struct(
            count(column).cast("long").alias("n_words"),
            F.col("__starts").alias("starts"),
            F.array_sort(bases).alias("base"),
            F.array_sort(F.array_union(bases, F.transform("__own", lambda x: x["label"]))).alias("labels"),
            F.greatest(F.when(F.size("__starts") > 0, 0.5).otherwise(0.0), F.coalesce(F.array_max(F.transform("__own", lambda x: x["coverage"])), F.lit(0.0))).alias("score"),
            F.col("__own").alias("templates"),
        ),
    ).drop("__coverage", "__own", "__starts", "__text", "__holds", "__license", "__hits")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = F.col("license")
    return scan(docs).select(
        "doc_id",
        out["n_words"].alias("n_words"),
        F.size(out["starts"]).cast("long").alias("n_base"),
        F.get(out["starts"], F.lit(0)).cast("long").alias("first_word"),
        F.get(out["starts"], F.size(out["starts"]) - 1).cast("long").alias("last_word"),
        F.array_join(out["base"], ",").alias("base_labels"),
        F.array_join(out["labels"], ",").alias("labels"),
        out["score"].alias("score"),
    )
