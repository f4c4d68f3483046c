"""License scans by diagonal voting (operator 9), in DataFrame functions only.

All rolling word k-gram hashes of every text are joined with the positions of
the same hashes in license templates.  Hits of one template on one diagonal
(text position less template position) vote together, neighbouring diagonals
are merged so that an inserted or dropped word does no harm, and a merged span
is verified by the share of the template that it covers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

K = 3
#: Diagonals so far apart still belong to one span.
SHIFT = 2
#: The share of a template's k-grams that a verified span covers.
COVER = 0.75

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: (label, words): the base phrases.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

#: (label, words): notices as their licenses print them, with common short references.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "licensed under the gnu general public license version"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
]


def _grams(words: list[str]) -> list[list[str]]:
    return [words[i : i + K] for i in range(len(words) - K + 1)]


def template_grams(spark: SparkSession, phrases: list[tuple[str, str]], templates: list[tuple[str, str]]) -> DataFrame:
    """(gram, template, base, label, at, n): a row for each position of each template; as large as those lists."""
    rows = []
    for i, (base, label, text) in enumerate([(True, *p) for p in phrases] + [(False, *t) for t in templates]):
        grams = _grams(text.split())
        if not grams:
            raise ValueError(f"a phrase has fewer than {K} words: {text}")
        rows += [(g, i, base, label, j, len(grams)) for j, g in enumerate(grams)]
    table = spark.createDataFrame(rows, "g array<string>, template int, base boolean, label string, at int, n int")
    return table.withColumn("gram", F.xxhash64(*(F.xxhash64(F.col("g")[j]) for j in range(K)))).drop("g")


def scanned(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of docs(doc_id, text).

    Base: all places where a phrase stands word for word.  labels: those and
    the labels of verified template spans.  score: the largest share of a
    template that a text covers, 1 for a base place.  A null or empty text has
    no words and no labels.  Rows alike in doc_id and text get alike results;
    other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, UPPER.lower()).alias("text"))
    docs = docs.withColumn("key", F.xxhash64("text"))
    split = F.transform(F.filter(F.split("text", WORD_GAP), lambda w: w != ""), lambda w: F.xxhash64(w))
    words = docs.withColumn("w", split)
    rows = words.select("doc_id", "key", F.size("w").cast("long").alias("n_words"))

    n = F.size("w")
    grams = F.when(n >= K, F.transform(F.sequence(F.lit(1), n - K + 1), lambda i: F.xxhash64(*(F.element_at("w", i + j) for j in range(K)))))
    # the outer form: the other one filters by the array first, which would be made again for each use in that filter
    each = words.withColumn("grams", grams).select("doc_id", "key", F.posexplode_outer("grams").alias("pos", "gram"))
    hits = each.join(F.broadcast(template_grams(spark, phrases, templates)), "gram")  # the templates' size is fixed
    hits = hits.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), "key", "template", "base", "label", "n", "pos", "at").withColumn("diagonal", F.col("pos") - F.col("at"))

    votes = hits.groupBy("doc", "key", "template", "base", "label", "n", "diagonal").agg(F.collect_set("at").alias("ats")).withColumn("votes", F.size("ats"))
    own = ["doc", "key", "template"]
    by = Window.partitionBy(*own).orderBy("diagonal")
    votes = votes.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(by) > SHIFT).cast("int"))
    votes = votes.withColumn("span", F.sum(F.coalesce("new", F.lit(0))).over(by))
    spans = votes.where("not base").groupBy(*own, "label", "n", "span").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("covered"))
    spans = spans.groupBy("doc", "key").agg(F.array_sort(F.collect_set(F.when(F.col("covered") >= COVER * F.col("n"), F.col("label")))).alias("more"), F.max(F.col("covered") / F.col("n")).alias("share"))
    base = votes.where("base and votes = n").groupBy("doc", "key").agg(F.count("*").alias("n_base"), F.min("diagonal").cast("long").alias("first_word"), F.max("diagonal").cast("long").alias("last_word"), F.array_sort(F.collect_set("label")).alias("base_set"))

    found = base.join(spans, ["doc", "key"], "full")
    out = rows.withColumn("doc", F.coalesce("doc_id", F.lit(-(1 << 63)))).join(found, ["doc", "key"], "left")
    none = F.array().cast("array<string>")
    base_set, more = F.coalesce("base_set", none), F.coalesce("more", none)
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(base_set, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_set, more)), ",").alias("labels"),
        F.when(F.size(base_set) > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
