"""License scans: phrase rules and an exact set-similarity join of text blocks with license templates.

Blocks are lines, and runs of words across line breaks as long as the template's words divided by ``threshold``, for
notices wrapped over several lines. A block matches a template when it holds at least ``threshold`` of the template's distinct words
(containment). The words of the templates are ordered by how many documents hold them, rarest first; a match must
share one of the template's first ``t - need + 1`` words (prefix filter), hold at least ``need`` template words (length
filter) and have enough words left after the shared one on both sides (positional filter). Pairs that pass are verified.
All steps are DataFrame functions; what is broadcast or returned to the driver is bounded by the template list.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The base phrases.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

#: Usual notices of well-known licenses.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd-3", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
)

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """Runs of digits, letters and characters above 0x7F; of these A-Z alone are lower-cased."""
    return F.array_remove(F.split(F.translate(text, UPPER, UPPER.lower()), SEPARATORS), "")


def _places(words: Column, phrase: str) -> Column:
    parts = phrase.split()
    rarest = max(parts, key=len)

    def here(i: Column) -> Column:
        same = F.get(words, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            same &= F.get(words, i + k) == p
        return same

    none = F.array().cast("array<int>")
    all_starts = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), here)
    return F.when(F.array_contains(words, rarest) & (F.size(words) >= len(parts)), all_starts).otherwise(none)


def _template_words() -> list[tuple[int, str, list[str]]]:
    out = []
    for k, (label, text) in enumerate(TEMPLATES):
        parts = "".join(c if c.isalnum() else " " for c in text.lower()).split()
        out.append((k, label, sorted(set(parts))))
    return out


def run_words(template: int, threshold: Fraction = Fraction(17, 20)) -> int:
    """How many words a run has in which the template is looked for."""
    return math.ceil(len("".join(c if c.isalnum() else " " for c in TEMPLATES[template][1].lower()).split()) / threshold)


def prefix_table(words: DataFrame, threshold: Fraction) -> tuple[list[str], list[tuple[int, str, list[str], int]]]:
    """The template words, rarest first by documents that hold them, and the templates with ordered words and ``need``."""
    templates = _template_words()
    vocabulary = sorted({w for _, _, ws in templates for w in ws})
    held = words.select(F.explode(F.array_intersect("words", F.array(*map(F.lit, vocabulary)))).alias("word"))
    counts = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    return order, [(k, label, sorted(ws, key=rank.get), math.ceil(threshold * len(ws))) for k, label, ws in templates]


def match_blocks(keyed: DataFrame, order: list[str], templates: list[tuple[int, str, list[str], int]]) -> DataFrame:
    """(columns of ``keyed`` but text, block, label, containment) for every line and template above the threshold."""
    spark = keyed.sparkSession
    rows = [(word, pos, k, label, ws, len(ws), need) for k, label, ws, need in templates for pos, word in enumerate(ws[: len(ws) - need + 1])]
    heads = spark.createDataFrame(rows, "word string, t_pos int, template int, label string, t_words array<string>, t_size int, need int")
    prefix = F.array(*(F.lit(w) for w in sorted({r[0] for r in rows})))
    least = min(need for *_, need in templates)
    ordered = F.array(*map(F.lit, order))
    keys = [c for c in keyed.columns if c not in ("text", "words")]
    own = keyed.where(F.arrays_overlap("words", prefix))
    blocks = own.select(*keys, F.posexplode(F.split("text", "\n")).alias("block", "line"))
    blocks = blocks.withColumn("b_words", F.array_intersect(ordered, words_of(F.col("line")))).where(F.size("b_words") >= least)
    tokens = blocks.select(*keys, "block", "b_words", F.posexplode("b_words").alias("b_pos", "word"))
    met = tokens.join(heads, "word").where((F.size("b_words") >= F.col("need")) & (F.least("t_pos", "b_pos") + F.least(F.col("t_size") - F.col("t_pos"), F.size("b_words") - F.col("b_pos")) >= F.col("need")))
    shared = F.size(F.array_intersect("b_words", "t_words"))
    return met.where(shared >= F.col("need")).select(*keys, "block", "label", (shared / F.col("t_size")).alias("containment"))


def match_runs(keyed: DataFrame, templates: list[tuple[int, str, list[str], int]], threshold: Fraction) -> DataFrame:
    """(columns of ``keyed`` but text and words, label, containment): the best run of words for each template above the threshold.

    Places of template words are joined with the templates that hold the word; per document and template they are slid over once,
    in order, so that the work follows the number of places. A run starts at a template word and is as long as the template's
    notice divided by ``threshold``; it counts where it holds one of the rarest words (prefix) and enough places (length).
    """
    spark = keyed.sparkSession
    keys = [c for c in keyed.columns if c not in ("text", "words")]
    reach = [run_words(k, threshold) for k, *_ in templates]
    # Places are scaled so that one frame, of ``scale`` units, is as long as the run of every template.
    scale = math.lcm(*reach)
    rows = [(word, k, label, len(ws), need, pos < len(ws) - need + 1, scale // reach[n]) for n, (k, label, ws, need) in enumerate(templates) for pos, word in enumerate(ws)]
    heads = spark.createDataFrame(rows, "word string, template int, label string, t_size int, need int, rare boolean, unit long")
    prefix = F.array(*(F.lit(w) for w in sorted({r[0] for r in rows if r[5]})))
    vocabulary = F.array(*(F.lit(w) for w in sorted({r[0] for r in rows})))
    sizes = F.array(*(F.struct(F.array(*map(F.lit, ws)).alias("words"), F.lit(need).alias("need")) for _, _, ws, need in templates))
    # Prefix and length filters on whole documents first: few hold enough of a template's words anywhere.
    own = keyed.where(F.arrays_overlap("words", prefix)).withColumn("held", F.array_intersect("words", vocabulary))
    own = own.where(F.exists(sizes, lambda t: F.size(F.array_intersect("held", t["words"])) >= t["need"]))
    seen = F.filter(F.transform("words", lambda w, i: F.struct(i.cast("long").alias("at"), w.alias("word"))), lambda x: F.array_contains(vocabulary, x["word"]))
    places = own.select(*keys, F.explode(seen).alias("p")).select(*keys, "p.*").join(F.broadcast(heads), "word")  # the template list
    run = Window.partitionBy(*keys, "template").orderBy(F.col("at") * F.col("unit")).rangeBetween(0, scale - 1)
    slid = places.select(
        *keys, "label", "t_size", "need", F.collect_set("word").over(run).alias("found"), F.count("*").over(run).alias("n"), F.count_if("rare").over(run).alias("n_rare"),
    )
    shared = F.size("found")
    able = slid.where((F.col("n_rare") > 0) & (F.col("n") >= F.col("need")) & (shared >= F.col("need")))
    return able.groupBy(*keys, "label").agg(F.max(shared / F.col("t_size")).alias("containment"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: Fraction | str = "17/20") -> DataFrame:
    """Per document: n_words, places of the base phrases, base labels, all labels and a score from 0 to 1.

    The score is 1 where a base phrase stands, else the best containment of a matching block, else 0. Null texts are empty. Each
    input row gives one row; rows that repeat an id and a text share their matches. An empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("words", words_of(F.col("text")))
    order, templates = prefix_table(base.select("words"), Fraction(threshold))

    keyed = base.withColumn("k", F.xxhash64("text"))
    blocks = match_blocks(keyed, order, templates).drop("block").unionByName(match_runs(keyed, templates, Fraction(threshold)))
    matches = blocks.groupBy(F.col("id").alias("m_id"), F.col("k").alias("m_k"))
    matches = matches.agg(F.collect_set("label").alias("found"), F.max("containment").alias("containment"))

    places = keyed.select("id", "k", F.size("words").cast("long").alias("n_words"), *(_places(F.col("words"), p).alias(f"p{n}") for n, (_, p) in enumerate(PHRASES)))
    every = F.concat(*(F.col(f"p{n}") for n in range(len(PHRASES))))
    labels = F.array_compact(F.array(*(F.when(F.size(f"p{n}") > 0, F.lit(label)) for n, (label, _) in enumerate(PHRASES))))
    places = places.select("id", "k", "n_words", every.alias("every"), labels.alias("base"))
    out = places.join(matches, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("k") == F.col("m_k")), "left")
    all_labels = F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size("every").cast("long").alias("n_base"),
        F.array_min("every").cast("long").alias("first_word"),
        F.array_max("every").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(all_labels), ",").alias("labels"),
        F.when(F.size("every") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
