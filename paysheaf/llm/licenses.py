"""Licence notices in document texts: stated phrases, and blocks that contain most of a template."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: base phrases and their labels
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# fixed values: notices, by label
TEMPLATES = (
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license version 3"),
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)

#: Share of a template's distinct words that a block must contain.
CONTAINMENT = 0.85
#: Blocks have this many words at least, and twice those of the longest template: one begins at every half block, so a template lies whole in one.
LEAST_BLOCK_WORDS = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _phrase(*phrases: str) -> str:
    return f"(?<![^ ])(?:{'|'.join(phrases)})(?![^ ])"


def words_of(document_text: DataFrame) -> DataFrame:
    """``doc_id, line, words``: the words of each text with one space between, and as an array."""
    line = F.trim(F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), _BETWEEN, " "))
    docs = document_text.select("doc_id", line.alias("line"))
    return docs.withColumn("words", F.when(F.col("line") == "", F.array().cast("array<string>")).otherwise(F.split("line", " ")))


def _words_before(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, " ", ""))).cast("bigint")


def stated(worded: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels``: places where a base phrase stands. Places are word numbers from 0."""
    found = worded.withColumn("n_base", F.regexp_count("line", F.lit(_phrase(*PHRASES))).cast("bigint"))
    some = F.col("n_base") > 0
    head = F.split("line", _phrase(*PHRASES), 2)[0]
    most = F.regexp_extract("line", "(?s)^(.*)" + _phrase(*PHRASES), 1)
    labels = F.array_compact(F.array(*[F.when(F.col("line").rlike(_phrase(p)), F.lit(label)) for p, label in PHRASES.items()]))
    return found.select(
        "doc_id", F.size("words").cast("bigint").alias("n_words"), "n_base",
        F.when(some, _words_before(head)).alias("first_word"), F.when(some, _words_before(most)).alias("last_word"),
        F.when(some, labels).otherwise(F.array().cast("array<string>")).alias("base_labels"),
    )


def token_frequencies(worded: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> dict[str, int]:
    """In how many texts each template word stands. One number per template word reaches the driver."""
    tokens = sorted({w for _, t in templates for w in t.split()})
    seen = worded.select(F.explode(F.array_intersect("words", F.array(*map(F.lit, tokens)))).alias("token"))
    return dict.fromkeys(tokens, 0) | {r["token"]: r["n"] for r in seen.groupBy("token").agg(F.count("*").alias("n")).collect()}


def block_words(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> int:
    """Even number of words of a block."""
    return max(LEAST_BLOCK_WORDS, 2 * max((len(text.split()) for _, text in templates), default=0))


def needed(n_tokens: int, containment: float = CONTAINMENT) -> int:
    return math.ceil(n_tokens * containment - 1e-9)


def template_blocks(
    worded: DataFrame, frequencies: dict[str, int], templates: tuple[tuple[str, str], ...] = TEMPLATES, containment: float = CONTAINMENT
) -> DataFrame:
    """``doc_id, block, label, containment``: every block of words that contains enough of a template.

    Blocks are runs of ``block_words`` words, one from every half of that. Words are ordered by frequency over all texts,
    rarest first. A block with ``o`` words of a template of ``n`` has one of the template's first ``n - o + 1`` words, so only equal words
    of those prefixes are joined; blocks that are too short (length) or whose match stands too late to leave
    ``o`` common words (position) go before the common words are counted.
    """
    order = {t: i for i, t in enumerate(sorted(frequencies, key=lambda t: (frequencies[t], t)))}
    sets = [sorted(set(text.split()), key=order.get) for _, text in templates]
    prefixes = [s[: len(s) - needed(len(s), containment) + 1] for s in sets]
    rows = [
        (k, templates[k][0], token, i, len(s), needed(len(s), containment), s)
        for k, s in enumerate(sets) for i, token in enumerate(prefixes[k])
    ]
    spark = worded.sparkSession
    # one row per prefix word of the given templates: a table whose size the caller sets
    table = F.broadcast(spark.createDataFrame(rows, "template int, label string, token string, place int, n_tokens int, least int, tokens array<string>"))
    rare = F.array(*map(F.lit, sorted({t for p in prefixes for t in p})))
    ranks = F.create_map(*[x for t, i in order.items() for x in (F.lit(t), F.lit(i))])
    near = worded.where(F.arrays_overlap("words", rare))
    width = block_words(templates)
    starts = F.sequence(F.lit(0), F.size("words") - 1, F.lit(width // 2))
    blocks = near.select("doc_id", "words", F.explode(starts).alias("block"))
    blocks = blocks.select("doc_id", "block", F.array_distinct(F.slice("words", F.col("block") + 1, F.lit(width))).alias("words"))
    common = F.array_intersect("words", F.array(*map(F.lit, order)))
    ordered = F.array_sort(F.transform(common, lambda w: F.struct(F.element_at(ranks, w).alias("rank"), w.alias("token"))))
    blocks = blocks.where(F.arrays_overlap("words", rare)).select("doc_id", "block", F.size("words").alias("n_block"), ordered.alias("common"))
    tokens = blocks.select("doc_id", "block", "n_block", "common", F.posexplode("common").alias("at", "t"))
    tokens = tokens.select("doc_id", "block", "n_block", F.size("common").alias("n_common"), F.transform("common", lambda c: c["token"]).alias("block_tokens"), "at", F.col("t.token").alias("token"))
    pairs = tokens.join(table, "token")
    pairs = pairs.where("n_block >= least and n_tokens - place >= least and n_common - at >= least")
    pairs = pairs.withColumn("n_both", F.size(F.array_intersect("tokens", "block_tokens"))).where("n_both >= least")
    return pairs.select("doc_id", "block", "template", "label", (F.col("n_both") / F.col("n_tokens")).alias("containment")).distinct()


def licenses(document_text: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """Licence labels of each document text.

    Takes ``doc_id, text``; gives ``doc_id``, the columns of ``stated``, ``labels`` (base and template labels, sorted) and ``score``:
    1 where a base phrase stands, else the best containment of a found template, else 0. Null texts have no words.
    Rows of one ``doc_id`` share their template labels; repeated rows come back as often; an empty table gives no rows.
    """
    worded = words_of(document_text)
    found = template_blocks(worded, token_frequencies(worded, templates), templates, containment)
    found = found.groupBy("doc_id").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    base = stated(worded)
    out = base.join(found.withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id")), "left")
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_sort(F.array_distinct("base_labels")).alias("base_labels"),
        labels.alias("labels"), score.alias("score"),
    )
