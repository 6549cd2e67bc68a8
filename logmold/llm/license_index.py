"""License scan by a positional index of rare words, in DataFrame operations only.

1. Words of all texts that occur in a license template, but for function words
   and single characters, make the positional index ``(file, word, place)``.
2. Document frequencies over all files give the rarity of these words. For each
   file and template the ``SEEDS`` rarest words that they share are looked up
   in the template's postings.
3. A place in the file minus the place in the template is where the template
   would begin. Seeds that agree on that (in bands of ``BAND`` words, each place
   in two of them, so that a changed word or two doesn't part them) intersect
   to a candidate.
4. A candidate stands if the file has the template's mandatory phrases, and
   ``SHARE`` of the template's indexed words lie at their places in the band.

Only index rows move, never texts. Every group is that of one file, one
template and one band; the templates are a table of fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logmold.llm.common import row_key, stash
from logmold.session import ensure_checkpoint_dir

SEEDS, AGREE, BAND, SHARE = 4, 2, 8, 0.6
#: Score of a file that has a base phrase and no template.
BASE_SCORE = 0.5

WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases that always count, with their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# Opening words of public license notices (label, text, mandatory phrase).
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache license version 2 0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
     "with the License. You may obtain a copy of the License at", "apache license version 2 0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met", "redistribution and use in source and binary forms"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
     "creative commons attribution 4 0 international"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0.", "cc by sa 4 0"),
    ("cc0-1.0", "CC0 1.0 Universal Public Domain Dedication", "cc0 1 0 universal"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2.", "gnu general public license version 2"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu general public license version 3"),
    ("gpl-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation; either version", "gnu general public license as published"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
     "for any purpose with or without fee is hereby granted"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
     "Public License as published by the Free Software Foundation", "gnu lesser general public license"),
    ("mit", "Released under the MIT License.", "mit license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction", "permission is hereby granted free of charge"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla public license v 2 0"),
    ("unlicense", "This is free and unencumbered software released into the public domain.", "free and unencumbered software"),
]

# Words too common in any text to point at a license.
FUNCTION_WORDS = frozenset(
    "and any are as at by can for form in into is it may not of or that the this to under use with without work you".split())


def template_words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def postings() -> list[tuple[int, str, int]]:
    """(template, word, place) of each indexed word."""
    return [(i, w, k) for i, (_, text, _) in enumerate(TEMPLATES) for k, w in enumerate(template_words(text))
            if len(w) > 1 and w not in FUNCTION_WORDS]


def _before(joined: Column, phrase: str, last: bool) -> Column:
    """Number of the word at which the first or last place of a phrase begins;
    ``joined`` has one space before and after each word."""
    lead = F.substring_index(joined, f" {phrase} ", -1 if last else 1)
    if last:
        lead = F.left(joined, F.length(joined) - F.length(lead) - F.lit(len(phrase) + 2))
    return (F.length(lead) - F.length(F.replace(lead, F.lit(" "), F.lit("")))).cast("long")


def _files(docs: DataFrame) -> DataFrame:
    """``k1, k2, doc_id, joined``: the words of each text between single spaces."""
    k1, k2 = row_key(F.col("doc_id"), F.col("text"))
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    return docs.select(k1, k2, F.col("doc_id").cast("long").alias("doc_id"),
                       F.concat(F.lit(" "), F.btrim(F.regexp_replace(text, WORD_GAP, " "), F.lit(" ")), F.lit(" ")).alias("joined"))


def _facts(files: DataFrame) -> DataFrame:
    """What each file's own words tell: counts, base phrases, mandatory phrases."""
    joined = F.col("joined")
    count = [F.when(joined.contains(f" {p} "), F.regexp_count(joined, F.lit(f" {p}(?= )"))).otherwise(0) for p, _ in BASE]
    first = [F.when(joined.contains(f" {p} "), _before(joined, p, False)) for p, _ in BASE]
    last = [F.when(joined.contains(f" {p} "), _before(joined, p, True)) for p, _ in BASE]
    n_words = F.length(joined) - F.length(F.replace(joined, F.lit(" "), F.lit(""))) - 1
    return files.select(
        "k1", "k2", "doc_id", F.when(joined == "  ", 0).otherwise(n_words).cast("long").alias("n_words"),
        sum(count[1:], count[0]).cast("long").alias("n_base"), F.least(*first).alias("first_word"), F.greatest(*last).alias("last_word"),
        F.array_compact(F.array(*[F.when(joined.contains(f" {p} "), F.lit(label)) for p, label in BASE])).alias("base"),
        F.array_compact(F.array(*[F.when(joined.contains(f" {phrase} "), F.lit(i)) for i, (_, _, phrase) in enumerate(TEMPLATES)])).alias("having"))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score`` of each row of ``docs (doc_id, text)``.

    Null and empty texts have no words and no labels. ``score`` is the largest
    share of a standing template's indexed words, ``BASE_SCORE`` where only a
    base phrase is there, 0 without either. Equal document frequencies are
    ranked by the word. Rows written twice each get the same result. An empty
    table gives no rows. Texts of any length are read whole.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    facts = _facts(_files(docs))
    table = postings()
    size = {i: sum(t == i for t, _, _ in table) for i in range(len(TEMPLATES))}
    listed = spark.createDataFrame(table, "template int, word string, at int")
    named = spark.createDataFrame([(i, label, size[i]) for i, (label, _, _) in enumerate(TEMPLATES)], "template int, label string, size int")
    known = spark.createDataFrame([(w,) for w in sorted({w for _, w, _ in table})], "word string")

    index = stash(_files(docs).select("k1", "k2", F.posexplode(F.split(F.btrim("joined", F.lit(" ")), " ")).alias("pos", "word"))
                  .join(F.broadcast(known), "word").select("k1", "k2", "word", "pos"), "license-words")
    of_file = index.select("k1", "k2", "word").distinct()
    rarity = of_file.groupBy("word").agg(F.count("*").alias("df"))  # at most the templates' words
    by_rarity = Window.partitionBy("k1", "k2", "template").orderBy("df", "word")  # at most a template's words
    seeds = (of_file.join(F.broadcast(rarity), "word").join(F.broadcast(listed.select("template", "word").distinct()), "word")
             .withColumn("r", F.row_number().over(by_rarity)).where(F.col("r") <= SEEDS).select("k1", "k2", "template", "word"))

    hits = index.join(F.broadcast(listed), "word").withColumn("begin", F.col("pos") - F.col("at"))
    banded = hits.withColumn("band", F.explode(F.array(
        2 * F.floor(F.col("begin") / BAND), 2 * F.floor((F.col("begin") + BAND // 2) / BAND) + 1)))
    place = ["k1", "k2", "template", "band"]
    near = banded.join(seeds, ["k1", "k2", "template", "word"]).select(*place, "at").distinct().groupBy(*place).agg(
        F.count("*").alias("agreeing")).where(F.col("agreeing") >= AGREE)
    covered = banded.join(near.select(*place), place).select(*place, "at").distinct().groupBy(*place).agg(F.count("*").alias("matched"))
    found = (covered.join(F.broadcast(named), "template").withColumn("share", F.col("matched") / F.col("size")).where(F.col("share") >= SHARE)
             .groupBy("k1", "k2", "template", "label").agg(F.max("share").alias("share"))
             .groupBy("k1", "k2").agg(F.collect_list(F.struct("template", "label", "share")).alias("found")))  # a row for each template at most
    stand = F.filter("found", lambda x: F.array_contains("having", x["template"]))
    labels = F.concat("base", F.transform(stand, lambda x: x["label"]))
    best = F.coalesce(F.array_max(F.transform(stand, lambda x: x["share"])), F.lit(0.0))
    joined = facts.join(found, ["k1", "k2"], "left").withColumn("found", F.coalesce("found", F.expr("cast(array() as array<struct<template: int, label: string, share: double>>)")))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("labels"),
        F.greatest(best, F.when(F.col("n_base") > 0, F.lit(BASE_SCORE)).otherwise(0.0)).alias("score"))
