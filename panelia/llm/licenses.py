"""License scans by diagonal voting, with DataFrame functions only.

All rolling word K-gram hashes of the texts are joined with the K-grams of the templates (a broadcast table of
the templates' words, whose size does not depend on the data).  A hit, its K words compared, votes for the
diagonal (document place minus template place); diagonals of a document that lie within GAP merge into a span.
A span is verified word by word: its share is the number of words that template and document have in common over
the longer of template and span, so that inserted words count against it as much as missing ones; and the words
that tell licenses apart (numbers, and KEYWORDS) must be the template's, in its order.  Of spans that overlap, the
one with the most words in common counts.  A share of MIN_SHARE or more gives the template's label; ``score`` is
the largest share of a document, halved where the words that tell licenses apart differ.

Defined cases: a null text is empty and has no label; a text shorter than K words has base places only;
a very long text is one row of words like any other; repeated rows get equal results; columns besides doc_id and
text are left alone.  Case is folded before words are split, which for these ASCII phrases is the same as folding
A-Z.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K, GAP, MIN_SHARE = 3, 2, 0.85

# The phrases of the base rule, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Public license notices, and the labels of the method.
TEMPLATES = [
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nd-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-nc-sa-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-nc-nd-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
]

# Words that tell licenses of one family apart.
KEYWORDS = ["affero", "apache", "bsd", "lesser", "library", "mit", "mozilla", "nc", "nd", "noncommercial", "noderivatives", "sa", "sharealike"]
KEY = f"^({'|'.join(KEYWORDS)}|[0-9]+)$"


def template_words(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, text.lower()) if w]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def gram(w: Column, i: Column) -> Column:
    """Hash of the words i to i + K - 1 (from 0)."""
    return F.xxhash64(*(F.get(w, i + j) for j in range(K)))


def places(w: Column) -> Column:
    """Where a base phrase starts, as structs (at, label); no two phrases share their first word."""

    def label(i: Column) -> Column:
        out = F.lit(None).cast("string")
        for phrase, name in PHRASES.items():
            parts = phrase.split()
            hit = F.get(w, i) == parts[0]
            for j, part in enumerate(parts[1:], 1):
                hit = hit & F.coalesce(F.get(w, i + j) == part, F.lit(False))
            out = F.when(hit, F.lit(name)).otherwise(out)
        return out

    found = F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.struct(i.cast("long").alias("at"), label(i).alias("label")))
    return F.filter(found, lambda x: x["label"].isNotNull())


def base(docs: DataFrame) -> DataFrame:
    """doc_id, the text's key, and the base columns."""
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    # every phrase holds one of these strings
    likely = F.contains(low, F.lit("license")) | (F.contains(low, F.lit("cc")) & F.contains(low, F.lit("by")))
    empty = F.array().cast("array<struct<at: bigint, label: string>>")
    split = docs.select("doc_id", F.xxhash64("text").alias("key"), words(F.col("text")).alias("w"), likely.alias("likely"))
    found = split.select("doc_id", "key", F.size("w").cast("long").alias("n_words"), F.when(F.col("likely") & (F.size("w") > 0), places(F.col("w"))).otherwise(empty).alias("p"))
    at = F.transform("p", lambda x: x["at"])
    labels = F.array_sort(F.array_distinct(F.transform("p", lambda x: x["label"])))
    return found.select("doc_id", "key", "n_words", F.size("p").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), labels.alias("base"))


def template_grams(spark: SparkSession) -> DataFrame:
    """(template, label, size, keys, t, tw, h): every K-gram of every template."""
    rows = [(n, label, len(w), [x for x in w if re.match(KEY, x)], i, w[i : i + K]) for n, (label, text) in enumerate(TEMPLATES) for w in [template_words(text)] for i in range(len(w) - K + 1)]
    frame = spark.createDataFrame(rows, "template int, label string, size int, keys array<string>, t int, tw array<string>")
    return frame.withColumn("h", gram(F.col("tw"), F.lit(0)))


def votes(docs: DataFrame) -> DataFrame:
    """(doc_id, key, template, label, size, keys, at, t, near): hits of document K-grams on template places, with the document's words about them."""
    split = docs.select("doc_id", F.xxhash64("text").alias("key"), words(F.col("text")).alias("w")).where(F.size("w") >= K)
    grams = split.select("doc_id", "key", "w", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("w") - K), lambda i: gram(F.col("w"), i))).alias("at", "h"))
    # broadcast: the fixed templates
    hits = grams.join(F.broadcast(template_grams(docs.sparkSession)), "h")
    about = F.sequence(F.greatest(F.col("at") - GAP, F.lit(0)), F.least(F.col("at") + K + GAP, F.size("w")) - 1)
    near = F.transform(about, lambda p: F.struct(p.alias("p"), F.get("w", p).alias("word")))
    return hits.where(F.slice("w", F.col("at") + 1, F.lit(K)) == F.col("tw")).select("doc_id", "key", "template", "label", "size", "keys", "at", "t", near.alias("near"))


def matches(docs: DataFrame) -> DataFrame:
    """(doc_id, key, template, label, start, end, common, share, agrees): spans of merged diagonals, verified."""
    by = ["doc_id", "key", "template"]
    told = F.filter("near", lambda x: x["word"].rlike(KEY))
    diagonals = votes(docs).groupBy(*by, "label", "size", "keys", (F.col("at") - F.col("t")).alias("d")).agg(F.collect_set("t").alias("ts"), F.flatten(F.collect_list(told)).alias("told"))
    in_order = Window.partitionBy(*by).orderBy("d")
    apart = (F.col("d") - F.lag("d").over(in_order) > GAP).cast("int")
    islands = diagonals.withColumn("i", F.sum(F.coalesce(apart, F.lit(1))).over(in_order))
    places = lambda shift: F.flatten(F.collect_list(F.flatten(F.transform("ts", lambda t: F.sequence(t + shift, t + shift + K - 1)))))
    merged = islands.groupBy(*by, "label", "size", "keys", "i").agg(F.array_distinct(places(F.lit(0))).alias("in_template"), F.array_distinct(places(F.col("d"))).alias("in_text"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("told")))).alias("told"))
    start, end = F.array_min("in_text"), F.array_max("in_text") + 1
    common = F.least(F.size("in_template"), F.size("in_text"))
    own = F.transform(F.filter("told", lambda x: (x["p"] >= F.col("start")) & (x["p"] < F.col("end"))), lambda x: x["word"])
    return merged.withColumns({"start": start, "end": end, "common": common}).select(*by, "label", "start", "end", "common", (F.col("common") / F.greatest("size", F.col("end") - F.col("start"))).alias("share"), (own == F.col("keys")).alias("agrees"))


def best_spans(found: DataFrame) -> DataFrame:
    """Of overlapping spans, the one with the most words in common (the smaller span, the earlier template), and those that don't overlap it."""
    by = ["doc_id", "key"]
    before = Window.partitionBy(*by).orderBy("start", "end", "template").rowsBetween(Window.unboundedPreceding, -1)
    until_now = Window.partitionBy(*by).orderBy("start", "end", "template")
    new = (F.col("start") >= F.coalesce(F.max("end").over(before), F.lit(0))).cast("int")
    grouped = found.withColumn("new", new).withColumn("g", F.sum("new").over(until_now))
    order = F.struct(F.col("common"), F.col("start") - F.col("end"), -F.col("template"))
    top = F.max_by(F.struct("start", "end", "template"), order).over(Window.partitionBy(*by, "g"))
    keep = (F.col("template") == F.col("top.template")) & (F.col("start") == F.col("top.start")) | (F.col("start") >= F.col("top.end")) | (F.col("end") <= F.col("top.start"))
    return grouped.withColumn("top", top).where(keep).drop("new", "g", "top")


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document."""
    value = F.when(F.col("agrees"), F.col("share")).otherwise(F.col("share") / 2)
    fits = F.col("agrees") & (F.col("share") >= MIN_SHARE)
    # a span that doesn't fit rules no other out
    spans = best_spans(matches(docs).withColumns({"value": value, "common": F.when(fits, F.col("common")).otherwise(0)}))
    named = spans.groupBy("doc_id", "key").agg(F.collect_set(F.when(F.col("common") > 0, F.col("label"))).alias("own"), F.max("value").alias("best"))
    left, right = base(docs).alias("l"), named.alias("r")
    joined = left.join(right, F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.key") == F.col("r.key")), "left")
    own = F.coalesce("own", F.array().cast("array<string>"))
    return joined.select(
        "l.doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", own))), ",").alias("labels"),
        F.coalesce("best", F.lit(0.0)).alias("score"),
    )
