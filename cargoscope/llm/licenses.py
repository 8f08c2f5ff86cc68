"""License scans: phrases at word positions, and an exact set-similarity join of text blocks with license templates.

Every text block (overlapping windows over the words of the whole text, line ends ignored, so that any template-sized
passage lies whole in one, wrapped or not) is compared with the templates by containment, the share of a template's distinct words
that the block holds. Words are ordered by how many texts of the whole corpus hold them, rarest first. A block that
reaches the threshold must share a word with the template inside both prefixes of that order (prefix filter), hold
enough template words at all (length filter), and have enough words left after the first shared one (positional
filter); what passes is counted in full. As a text holds what its blocks hold, only texts that hold enough of some
template are cut into blocks: the templates are few, so this is counted in the scan, and other texts never move. Copies
of such a text are looked at once; their labels go back to the rows in parts, so a hot text is no hot key.

Candidates of the join are then verified by places: the words must stand close together; those that set a template
apart from a similar one of another label must be among them; and a template that another label's contains whole
doesn't count where a word of the larger one stands too, so the most specific template wins.

All on the main path is DataFrame functions. The templates are a fixed list, so their table is of bounded size; no
table of the corpus is broadcast.

Defined results: a null or empty text has no words, no places, empty labels and score 0; places may overlap and count
each; results depend on the text alone, so repeated rows and null ids get the same; an empty table gives an empty
result; extra input columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoscope.llm.common import cut, text_or_empty

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
CONTAINMENT = 0.9
#: Least words per window of a text; windows start half a window apart, and half a window holds any template's place.
WINDOW = 240
#: Parts that the copies of one text are dealt into when they get its labels.
COPY_PARTS = 16

# Phrases and their labels.
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
# Notices that the licenses themselves ask to be placed, and common short forms.
TEMPLATES = (
    ("mit", "released under the MIT License"),
    ("mit", "licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "licensed under the GNU General Public License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
)


def template_words(text: str) -> list[str]:
    """Distinct words of a template, which is ASCII."""
    return sorted({w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split()})


def passage(text: str) -> tuple[int, int]:
    """Words of a template, repeated ones too, and the most words that a place of it may span."""
    n = len("".join(c if c.isalnum() else " " for c in text.lower()).split())
    return n, n + max(2, n // 2)


def rules(known: list[tuple[int, str, list[str], int]]) -> dict[int, tuple[list[str], list[str]]]:
    """Per template (number, label, words, needed count): words it must hold, words that must not stand in its place."""
    must: dict[int, set[str]] = {i: set() for i, *_ in known}
    never: dict[str, set[str]] = {}
    for i, label, words, need in known:
        for _, other, theirs, _ in known:
            if other != label and len(set(words) & set(theirs)) >= need:
                if set(words) < set(theirs):
                    never.setdefault(label, set()).update(set(theirs) - set(words))
                else:
                    must[i] |= set(words) - set(theirs)
    return {i: (sorted(must[i]), sorted(never.get(label, set()) - set(words))) for i, label, words, _ in known}


def lowered(column: str) -> Column:
    return F.translate(text_or_empty(column), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def places(words: Column, phrases: dict[tuple[str, ...], str]) -> Column:
    """Array of (start, label) of every place where a phrase's words stand one after the other."""

    def of(phrase: tuple[str, ...], label: str) -> Column:
        # Looked for by the phrase's last word; an index before the array is none.
        last = len(phrase) - 1
        at = F.sequence(F.lit(last), F.size(words) - 1)
        whole = lambda i: _all(F.get(words, i - last + k) == w for k, w in enumerate(phrase))
        found = F.transform(F.filter(at, whole), lambda i: F.struct((i - last).cast("long").alias("start"), F.lit(label).alias("label")))
        return F.when(F.size(words) > last, found).otherwise(F.array().cast("array<struct<start:bigint,label:string>>"))

    return F.concat(*(of(p, label) for p, label in phrases.items()))


def _all(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, containment: float = CONTAINMENT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    known = [(i, label, template_words(text)) for i, (label, text) in enumerate(templates)]
    known = [(i, label, words, math.ceil(containment * len(words) - 1e-9)) for i, label, words in known if words]
    vocabulary = sorted({w for _, _, words, _ in known for w in words})
    least = min(need for *_, need in known)

    vocab = F.array(*map(F.lit, vocabulary))
    empty = F.array().cast("array<struct<start:bigint,label:string>>")
    anchors = sorted({p[-1] for p in phrases})
    base = F.when(F.arrays_overlap("w", F.array(*map(F.lit, anchors))), places(F.col("w"), phrases)).otherwise(empty)
    read = docs.select(docs["doc_id"].cast("long").alias("doc_id"), lowered("text").alias("low"))
    read = read.select("doc_id", "low", F.regexp_extract_all("low", F.lit(WORD), F.lit(0)).alias("w"))
    read = read.select("doc_id", "low", "w", F.size("w").cast("long").alias("n_words"), F.array_intersect("w", vocab).alias("held"), base.alias("places"))
    enough = F.lit(False)
    for _, _, words, need in known:
        enough = enough | (F.size(F.array_intersect("held", F.array(*map(F.lit, words)))) >= need)
    read = read.withColumn("candidate", (F.size("held") >= least) & enough)
    # Only candidates carry their words on, and the digest by which copies know each other.
    only = lambda c: F.when(F.col("candidate"), c)
    facts = cut(read.select("doc_id", "n_words", "held", "places", only(F.md5("low")).alias("text_key"), only(F.col("w")).alias("w")))

    # Rarest first, over the whole corpus: texts per template word.
    rarity = {r["token"]: r["df"] for r in facts.select(F.explode("held").alias("token")).groupBy("token").agg(F.count("*").alias("df")).collect()}  # at most one row per template word
    order = sorted(vocabulary, key=lambda w: (rarity.get(w, 0), w))
    ranked = F.array(*map(F.lit, order))
    apart = rules(known)
    rows = [(i, label, sorted(ws, key=order.index), need, *apart[i], *passage(templates[i][1])) for i, label, ws, need in known]
    table = spark.createDataFrame(rows, "template int, label string, words array<string>, need int, must array<string>, never array<string>, tight int, wide int")

    def matches(blocks: DataFrame) -> DataFrame:
        """(key columns, label, share) of blocks (``held``: template words) that reach the threshold."""
        x = blocks.withColumn("held", F.array_intersect(ranked, "held")).where(F.size("held") >= least)
        probes = x.withColumn("token", F.explode(F.slice("held", F.lit(1), F.size("held") - least + 1)))
        prefixes = table.withColumn("token", F.explode(F.slice("words", F.lit(1), F.size("words") - F.col("need") + 1)))
        met = probes.join(F.broadcast(prefixes), "token")  # the fixed template list
        i, j = F.array_position("held", F.col("token")), F.array_position("words", F.col("token"))
        met = met.where((F.size("held") >= F.col("need")) & (1 + F.least(F.size("held") - i, F.size("words") - j) >= F.col("need")))
        common = F.size(F.array_intersect("held", "words"))
        return met.withColumn("common", common).where("common >= need").withColumn("share", F.col("common") / F.size("words"))

    # Copies of one text have one answer, so each distinct text goes on once.
    candidates = facts.where("text_key is not null")
    whole = candidates.select("text_key", "w").dropDuplicates(["text_key"])
    half = max([WINDOW // 2, *(wide for *_, wide in rows)])
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - half), F.lit(half))
    windows = whole.select("text_key", F.explode(F.transform(starts, lambda s: F.slice("w", s, F.lit(2 * half)))).alias("block"))
    met = matches(windows.select("text_key", "block", F.array_intersect("block", vocab).alias("held")))
    # A block meets a template once per shared prefix word; it is verified at the first.
    met = met.where(F.col("token") == F.element_at(F.array_intersect("held", "words"), 1))

    def held_at(i: Column, span: str) -> Column:
        """Template words of the passage that starts at word i, zero unless it is a place of the template."""
        part = F.slice("block", i, F.col(span))
        common = F.size(F.array_intersect(part, "words"))
        fits = (common >= F.col("need")) & (F.size(F.array_except("must", part)) == 0) & ~F.arrays_overlap(part, "never")
        return F.when(fits, common).otherwise(0)

    at = F.filter(F.sequence(F.lit(1), F.size("block")), lambda i: F.array_contains("words", F.element_at("block", i)))
    best = F.array_max(F.transform(at, lambda i: F.greatest(held_at(i, "tight"), held_at(i, "wide"))))
    hits = met.withColumn("best", best).where("best > 0").select("text_key", "label", (F.col("best") / F.size("words")).alias("share"))
    labelled = hits.groupBy("text_key").agg(F.collect_set("label").alias("method_labels"), F.max("share").alias("share"))

    dealt = labelled.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(COPY_PARTS - 1))))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(COPY_PARTS)).cast("int")
    columns = ["doc_id", "n_words", "places", "method_labels", "share"]
    answered = candidates.withColumn("part", part).join(dealt, ["text_key", "part"], "left").select(columns)
    none = {"method_labels": F.lit(None).cast("array<string>"), "share": F.lit(None).cast("double")}
    joined = answered.unionByName(facts.where("text_key is null").withColumns(none).select(columns))
    own = F.array_sort(F.array_distinct("places.label"))
    every = F.array_sort(F.array_union(own, F.coalesce("method_labels", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"),
        F.array_join(own, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
