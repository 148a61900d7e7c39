"""Licence scans over whole texts, in DataFrame operations only.

Base: places where a short licence phrase's words stand in a row. Method: a positional index of
licence notices. The words of all notices form a bounded vocabulary, whose inverse document
frequencies are counted over all documents. Each text is read and normalised once; what is kept of it are
its base columns, which of the vocabulary it has, and its words where it has all that the mandatory phrases of
some notice need. The rare words are the highest of each notice
without all of which no file can hold `share` of its weight. A file that has one is looked up in
the postings (notice, position); hits that agree on the relative position of notice and file are
summed, and where a rare word is among them, `share` of the notice's weight is reached and its
mandatory phrases are complete, the notice's label is given. Nothing is lost by skipping the rest.

Null and empty texts have no words, no labels and score 0. Texts with equal doc_id are told apart by
their words; repeated rows get equal results, one for each row. An empty table gives no rows. Very long
texts are scanned whole. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ethogrid.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words, after lower-casing.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Base phrases and their labels (fixed values).
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Licence notices: label, words, mandatory phrases (fixed values, from the licences' own texts).
NOTICES = (
    ("agpl", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("in compliance with the license", "apache org licenses license 2 0")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "conditions are met")),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "free software foundation")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("lgpl", "licensed under the gnu lesser general public license version 3", ("gnu lesser general public license",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("free of charge to any person obtaining a copy",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)


@dataclass(frozen=True)
class Params:
    #: A notice matches where so much of its weight stands at its places.
    share: float = 0.6


def _vocabulary() -> list[str]:
    return sorted({w for _, text, _ in NOTICES for w in text.split()})


def normalised(text: Column) -> Column:
    """The words of a text, each after one blank, and a last blank; ' ' without words."""
    spaced = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP, " ")
    return F.when(F.trim(spaced) == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), F.trim(spaced), F.lit(" ")))


def _words(w: Column) -> Column:
    return F.split(F.trim(w), " ")


def scanned(documents: DataFrame) -> DataFrame:
    """doc_id, key, the base columns, present (the notices' words that a file has) and w of every file, by one look at each text.

    w, the words themselves, is kept for files that have all words of the mandatory phrases of a notice; others fit none.
    """
    vocabulary = F.array(*[F.lit(w) for w in _vocabulary()])
    files = documents.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("w"))
    files = _base(files.withColumn("present", F.array_intersect(_words(F.col("w")), vocabulary)))
    needed = {tuple(sorted({w for phrase in phrases for w in phrase.split()})) for _, _, phrases in NOTICES}
    has = lambda words: F.size(F.array_except(F.array(*[F.lit(w) for w in words]), "present")) == 0
    able = reduce(lambda x, y: x | y, [has(words) for words in sorted(needed)])
    return files.withColumn("key", F.xxhash64("w")).withColumn("w", F.when(able, F.col("w")))


def idf(files: DataFrame) -> dict[str, float]:
    """The inverse document frequency of each word of the notices, over all files; a bounded result."""
    counted = files.select(F.explode(F.array_append("present", F.lit(""))).alias("word")).groupBy("word").count()
    n = {r["word"]: r["count"] for r in counted.collect()}
    return {w: math.log(1 + n.get("", 0) / (1 + n.get(w, 0))) for w in _vocabulary()}


def _base(files: DataFrame) -> DataFrame:
    """The base columns of every file."""
    w = F.col("w")
    spaces = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" ")))
    out = {"n_words": spaces(w).cast("long") - 1}
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE.items():
        size = len(phrase.split())
        has = F.contains(w, F.lit(f" {phrase} "))
        pattern = f"(?<= ){phrase}(?= )"
        counts.append(F.when(has, F.regexp_count(w, F.lit(pattern))).otherwise(0))
        firsts.append(F.when(has, spaces(F.left(w, F.locate(f" {phrase} ", w))) - 1))
        # the words before a phrase are those before the rest of the text, less the phrase's own
        lasts.append(F.when(has, spaces(w) - spaces(F.element_at(F.split(w, pattern), -1)) - size))
        labels.append(F.when(has, F.lit(label)))
    out["n_base"] = sum(counts, F.lit(0)).cast("long")
    out["first_word"] = F.least(*firsts).cast("long")
    out["last_word"] = F.greatest(*lasts).cast("long")
    out["base"] = F.array_compact(F.array(*labels))
    return files.withColumns(out)


def _matches(files: DataFrame, weights: dict[str, float], p: Params) -> DataFrame:
    """doc_id, key, found (labels of the notices that fit) and best (the highest share) of the files that a notice fits."""
    spark = files.sparkSession
    postings, notices, rarest = [], [], set()
    for k, (label, text, phrases) in enumerate(NOTICES):
        words = text.split()
        postings += [(w, k, i, weights[w]) for i, w in enumerate(words)]
        places = set()
        for phrase in phrases:
            begin = f" {text} ".split(f" {phrase} ")[0].count(" ")
            places |= set(range(begin, begin + len(phrase.split())))
        mass = left = sum(weights[w] for w in words)
        notices.append((k, label, sorted(places), mass))
        for w in sorted(set(words), key=lambda w: (-weights[w], w)):  # without all of these, a file stays below the share
            if left < p.share * mass:
                break
            rarest.add(w)
            left -= weights[w] * words.count(w)
    # both sides have a row or two for each word of the notices, whatever the input
    index = F.broadcast(spark.createDataFrame(postings, "word string, notice int, place int, weight double"))
    known = F.broadcast(spark.createDataFrame(notices, "notice int, label string, places array<int>, mass double"))
    able = files.where(F.col("w").isNotNull() & F.arrays_overlap("present", F.array(*[F.lit(w) for w in sorted(rarest)])))
    spots = able.select("doc_id", "key", "w").dropDuplicates(["doc_id", "key"]).select("doc_id", "key", F.posexplode(_words(F.col("w"))).alias("at", "word"))
    return (
        spots.where(F.col("word").isin(_vocabulary()))
        .join(index, "word")
        .groupBy("doc_id", "key", "notice", (F.col("at") - F.col("place")).alias("offset"))
        .agg(F.sum("weight").alias("weight"), F.collect_set("place").alias("have"), F.max(F.col("word").isin(sorted(rarest))).alias("voted"))
        .join(known, "notice")
        .where(F.col("voted") & (F.col("weight") >= p.share * F.col("mass")) & (F.size(F.array_except("places", "have")) == 0))
        .groupBy("doc_id", "key")
        .agg(F.collect_set("label").alias("found"), F.max(F.least(F.col("weight") / F.col("mass"), F.lit(1.0))).alias("best"))
    )


def license_scan(documents: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    score is 1 where a base phrase stands, else the highest share of a notice's weight that stands
    in place with its mandatory phrases, else 0.
    """
    files = cut(scanned(documents))
    matches = _matches(files, idf(files), p).alias("m")
    rows = files.drop("w", "present").alias("r")
    joined = rows.join(matches, F.col("r.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("r.key") == F.col("m.key")), "left")
    found = F.coalesce("found", F.array().cast("array<string>"))
    return joined.select(
        "r.doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", found)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
