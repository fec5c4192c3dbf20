"""License scan: base phrases, and an exact set-similarity join of text blocks with templates.

DataFrame functions only. A text's words are cut into blocks of ``BLOCK`` words, each half
over the next, so a passage of up to half a block lies whole in one of them. A template is found in a block that
contains at least ``CONTAINMENT`` of its different words. Template words are ordered by
their frequency in the whole corpus, rarest first. A block that reaches the threshold must
have one of a template's first ``size - needed + 1`` words (prefix filter), enough template words at
all (length filter), and enough of them from the shared word on (positional filter). What
passes is verified exactly, and must have the words that tell the template's license from others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxmix.session import materialize

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Well-known notices by the method's labels.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "mit": "released under the mit license",
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license",
    "public-domain": "this work has been released into the public domain",
}
#: Words that tell a template's license from others: a block without one of them has another license.
NAMES = {
    "apache-2.0": "apache 2", "bsd": "redistribution forms", "cc-by-nc": "cc by nc", "gpl-3.0": "gnu", "gpl-notice": "gnu",
    "mit": "mit", "mit-notice": "free charge", "mpl-2.0": "mozilla", "public-domain": "public domain",
}
#: Words that a block with the word "version" must have (a notice cut off before its version has neither).
VERSIONS = {"gpl-3.0": "3"}
CONTAINMENT, BLOCK = 0.8, 64
#: Templates of fewer different words, and without names, are found only whole.
SHORT = 10
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; none for null."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, _BETWEEN), "")


def needed(size: int, containment: float = CONTAINMENT) -> int:
    return math.ceil(size * containment - 1e-9)


def _starts(w: Column, line: Column, phrase: str) -> Column:
    """Where a phrase's words stand in a row, looked for only in texts that have the phrase."""
    parts = phrase.split()
    at = F.filter(F.sequence(F.lit(0), F.size(w) - 1),
                  lambda i: F.forall(F.array(*[F.get(w, i + k).eqNullSafe(F.lit(p)) for k, p in enumerate(parts)]), lambda x: x))
    return F.when(F.contains(line, F.lit(f" {phrase} ")), at).otherwise(F.array().cast("array<int>"))


def template_index(frequency: dict[str, int], templates: dict[str, str], containment: float) -> tuple[list[str], list[tuple]]:
    """Template words, rarest first, and a row (word, place in its template, label, size, needed) for each prefix word."""
    order = sorted({t for text in templates.values() for t in text.split()}, key=lambda t: (frequency.get(t, 0), t))
    rank = {t: i for i, t in enumerate(order)}
    rows = []
    for label, text in templates.items():
        own = sorted(set(text.split()), key=rank.__getitem__)
        need = needed(len(own), containment)
        rows += [(t, i, label, len(own), need) for i, t in enumerate(own[:len(own) - need + 1])]
    return order, rows


def license_scan(documents: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT,
                 block: int | None = BLOCK, names: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for every row.

    ``score`` is the largest containment of a template found, 1 with a base phrase, else 0. Null and empty
    texts have no words. Repeated rows get the same result each; other columns are not read.
    Templates must not be longer than half a block; with ``block`` None, blocks are twice as long as the longest
    template (``BLOCK`` at least), so whole notices and license bodies can be given. ``names`` are words
    that a block must have for a label; by default ``NAMES``, and for given templates all
    words of those with fewer than ``SHORT``.
    """
    spark = documents.sparkSession
    names = (NAMES if templates is None else {}) if names is None else names
    versions = VERSIONS if templates is None else {}
    templates = TEMPLATES if templates is None else templates
    if block is None:
        block = max(BLOCK, 2 * max((len(t.split()) for t in templates.values()), default=0))
    if any(len(t.split()) > block // 2 for t in templates.values()):
        raise ValueError("a template is longer than half a block")
    texts = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    vocabulary = sorted({t for text in templates.values() for t in text.split()})
    seen = (texts.select(F.explode(F.filter("w", lambda x: x.isin(vocabulary))).alias("word"))
            .groupBy("word").count().collect())  # a row for each template word at most
    order, rows = template_index({r["word"]: r["count"] for r in seen}, templates, containment)
    prefix = sorted({r[0] for r in rows})

    # blocks with a prefix word, reduced to their template words, rarest first
    half = block // 2
    hits = F.filter(F.transform("w", lambda x, i: F.when(x.isin(prefix), F.floor(i / half))), lambda b: b.isNotNull())
    blocks = F.filter(F.array_distinct(F.concat(hits, F.transform(hits, lambda b: b - 1))), lambda b: b >= 0)
    found = (texts.select("doc_id", "text_hash", "w", F.explode(blocks).alias("block"))
             .select("doc_id", "text_hash", "block", F.array_intersect(
                 F.lit(order), F.slice("w", (F.col("block") * half + 1).cast("int"), F.lit(block))).alias("own")))
    index = spark.createDataFrame(rows, "word string, place int, label string, size int, needed int")
    whole = spark.createDataFrame([(k, own, names[k].split() if k in names else own if len(own) < SHORT else [], versions.get(k, "").split())
                                   for k, t in templates.items() for own in [sorted(set(t.split()))]],
                                  "label string, template array<string>, names array<string>, version array<string>")
    pairs = (found.select("*", F.posexplode("own").alias("at", "word")).join(F.broadcast(index), "word")
             .where((F.size("own") >= F.col("needed"))
                    & (F.least(F.size("own") - F.col("at"), F.col("size") - F.col("place")) >= F.col("needed") - F.least("at", "place")))
             .join(F.broadcast(whole), "label")
             .withColumn("containment", F.size(F.array_intersect("own", "template")) / F.col("size"))
             .where((F.size(F.array_intersect("own", "template")) >= F.col("needed")) & (F.size(F.array_except("names", "own")) == 0)
                    & (~F.array_contains("own", "version") | (F.size(F.array_except("version", "own")) == 0))))
    matched = materialize(pairs.groupBy("doc_id", "text_hash").agg(
        F.collect_set("label").alias("found"), F.max("containment").alias("containment")), "licenses")  # labels are few

    line = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    places = {label: f"at_{i}" for i, label in enumerate(PHRASES.values())}
    base = texts.select("doc_id", "text_hash", "w", line.alias("line"))
    base = base.select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"),
                       *[_starts(F.col("w"), F.col("line"), p).alias(places[label]) for p, label in PHRASES.items()])
    every = F.concat(*places.values())
    base = base.select("doc_id", "text_hash", "n_words", F.size(every).cast("long").alias("n_base"),
                       F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
                       F.array_sort(F.array_compact(F.array(*[F.when(F.size(c) > 0, F.lit(label)) for label, c in places.items()]))).alias("base"))
    # documents with a template are few beside all; a shuffle by id and text, split where it is skewed
    joined = base.alias("b").join(matched.alias("m"), F.col("b.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("b.text_hash") == F.col("m.text_hash")), "left")
    return joined.select(
        "b.doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).cast(T.DoubleType()).alias("score"))
