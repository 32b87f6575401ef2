"""License scan by diagonal voting.

All rolling word k-grams of all texts are hashed (numpy, a batch of texts at a time) and joined by Spark with the gram
positions of the templates.  A hit at word ``p`` of template word ``t`` votes for the diagonal ``p - t``: an undisturbed
copy of a template has all its grams on one diagonal.  Votes are summed by diagonal; diagonals that lie close together
(words put in or left out) are merged into one span; a span is kept if the share of the template's grams that it covers
is high enough and it isn't much longer than the template.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from appfacts.llm.bytehash import ALNUM_WORD, second, shingle_hashes, word_hashes
from appfacts.llm.tables import map_batches, text_key
from appfacts.session import local_table

#: Phrases whose places are counted, and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Wording of well-known license notices, and labels of the method's own.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2.0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    (
        "apache",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed"
        " on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    ("mit", "released under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the"
        " following conditions are met",
    ),
    ("gnu", "this work is licensed under the gnu general public license version 3"),
    (
        "gnu",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the"
        " free software foundation either version 3 of the license or at your option any later version",
    ),
    ("creative-commons", "licensed under cc by nc 4.0"),
    ("creative-commons", "this work is licensed under a creative commons attribution 4.0 international license"),
    (
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not"
        " distributed with this file you can obtain one at",
    ),
]

GRAM = 2
#: Diagonals of one span differ by at most this many words from one to the next.
DRIFT = 3
#: Share of a template's grams that a span has to cover.
COVER = 0.7
#: A span has at most so many times the words of its template.
STRETCH = 1.5


def template_rows(templates: list[tuple[str, str, bool]], k: int) -> list[tuple]:
    """(gram, check, template, at, n_grams, label, base) of every gram of every template."""
    rows = []
    for number, (label, text, base) in enumerate(templates):
        words, _ = word_hashes([text], ALNUM_WORD)
        if len(words) < k:
            raise ValueError(f"template {text!r} has fewer than {k} words")
        grams = shingle_hashes(words, k)
        for at, (g, c) in enumerate(zip(grams.view(np.int64), second(words[: len(grams)] ^ grams).view(np.int64), strict=True)):
            rows.append((int(g), int(c), number, at, len(grams), label, base))
    return rows


def _grams(batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """A row for each gram, and one without a gram for each text, which has its number of words as position."""
    words, at = word_hashes(batch.column("text").to_pylist(), ALNUM_WORD)
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    grams = shingle_hashes(words, k)
    inside = row[: len(grams)] == row[k - 1 :] if len(grams) else np.zeros(0, bool)
    checks = second(words[: len(grams)] ^ grams)[inside]
    rows = np.concatenate((np.arange(len(n)), row[: len(grams)][inside]))
    place = np.concatenate((n, (np.arange(len(grams)) - at[row[: len(grams)]])[inside]))
    none = np.arange(len(rows)) < len(n)
    pad = np.zeros(len(n), np.int64)
    take = pa.array(rows)
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id").take(take),
            batch.column("key").take(take),
            pa.array(np.concatenate((pad, grams[inside].view(np.int64))), mask=none),
            pa.array(np.concatenate((pad, checks.view(np.int64)))),
            pa.array(place),
        ],
        names=["doc_id", "key", "gram", "check", "pos"],
    )


def license_spans(
    documents: DataFrame, templates: list[tuple[str, str, bool]], k: int = GRAM, drift: int = DRIFT, cover: float = COVER
) -> DataFrame:
    """Spans of templates in texts, and one row for every text.

    ``templates`` are (label, text, exact): exact ones count only where all their words stand consecutively.  Result:
    doc_id, key, n_words, and label, exact, first_word, last_word, cover (all null in a text's own row).  Null texts are
    empty and have no span; repeated rows count once.  The templates are a list of the caller's, broadcast while small
    (``local_table``).
    """
    grams = map_batches(
        documents.select("doc_id", text_key().alias("key"), "text"),
        lambda b: _grams(b, k),
        "doc_id bigint, key bigint, gram bigint, check bigint, pos bigint",
    )
    places = local_table(
        documents.sparkSession,
        template_rows(templates, k),
        "gram bigint, check bigint, template int, at int, n_grams int, label string, exact boolean",
    )
    # A left join, so that the texts' own rows, which match nothing, stay; other rows without a template go.
    hits = grams.join(places, ["gram", "check"], "left").where(F.col("gram").isNull() | F.col("template").isNotNull())
    diagonals = hits.groupBy("doc_id", "key", "template", (F.col("pos") - F.coalesce("at", F.lit(0))).alias("diagonal")).agg(
        F.first("label").alias("label"),
        F.first("exact").alias("exact"),
        F.first("n_grams").alias("n_grams"),
        F.min("pos").alias("first_word"),
        (F.max("pos") + F.lit(k - 1)).alias("last_word"),
        F.collect_set("at").alias("covered"),  # at most the template's length
    )
    # Neighbouring diagonals that overlap or nearly touch become one span; exact templates keep single diagonals.
    order = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    apart = (
        F.col("exact")
        | F.col("template").isNull()
        | (F.col("diagonal") - F.lag("diagonal").over(order) > drift)
        | (F.col("first_word") - F.lag("last_word").over(order) > F.col("n_grams"))
        | F.lag("diagonal").over(order).isNull()
    )
    merged = (
        diagonals.withColumn("span", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(order))
        .groupBy("doc_id", "key", "template", "span")
        .agg(
            F.first("label").alias("label"),
            F.first("exact").alias("exact"),
            F.first("n_grams").alias("n_grams"),
            F.min("first_word").alias("first_word"),
            F.max("last_word").alias("last_word"),
            F.max("diagonal").alias("diagonal"),
            F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("covered"),
            F.max(F.struct(F.size("covered").alias("n"), (-F.col("first_word")).alias("before"), "last_word")).alias("best"),
        )
        .withColumn("cover", F.col("covered") / F.col("n_grams"))
    )
    longest = (F.col("n_grams") + k - 1) * STRETCH
    fits = (F.col("cover") >= cover) & (F.col("last_word") - F.col("first_word") + 1 <= longest)
    # Stray places near a full match can stretch the span too far: then its best diagonal is looked at alone.
    alone = ~F.col("exact") & ~fits
    best = F.col("best")
    merged = merged.withColumns(
        {
            "first_word": F.when(alone, -best["before"]).otherwise(F.col("first_word")),
            "last_word": F.when(alone, best["last_word"]).otherwise(F.col("last_word")),
            "covered": F.when(alone, best["n"]).otherwise(F.col("covered")),
            "cover": F.when(alone, best["n"] / F.col("n_grams")).otherwise(F.col("cover")),
        }
    )
    verified = F.when(F.col("exact"), F.col("covered") == F.col("n_grams")).otherwise(
        (F.col("cover") >= cover) & (F.col("last_word") - F.col("first_word") + 1 <= longest)
    )
    own = F.col("template").isNull()
    return merged.where(own | verified).select(
        "doc_id",
        "key",
        F.when(own, F.col("diagonal")).alias("n_words"),
        "label",
        "exact",
        F.when(~own, F.col("first_word")).alias("first_word"),
        F.when(~own, F.col("last_word")).alias("last_word"),
        F.when(~own, F.col("cover")).alias("cover"),
    )


def scan_licenses(documents: DataFrame) -> DataFrame:
    """Per document: words, places of base phrases, labels, and the best cover as score (see ``license_spans``)."""
    templates = [(label, text, True) for text, label in BASE_PHRASES.items()] + [(a, b, False) for a, b in TEMPLATES]
    spans = license_spans(documents, templates)

    def labels(which):
        return F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")

    exact = F.coalesce(F.col("exact"), F.lit(False))
    return spans.groupBy("doc_id", "key").agg(
        F.max("n_words").cast("bigint").alias("n_words"),
        F.count(F.when(exact, 1)).cast("bigint").alias("n_base"),
        F.min(F.when(exact, F.col("first_word"))).alias("first_word"),
        F.max(F.when(exact, F.col("first_word"))).alias("last_word"),
        labels(exact).alias("base_labels"),
        labels(F.col("label").isNotNull()).alias("labels"),
        F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
    ).drop("key")
