"""License scans: phrases at their places, and notices by an exact set-similarity join. SQL functions only.

The join's sides are blocks of text and templates (short license notices, a parameter). A template of L words
meets blocks of twice its size class h (the power of two that holds L), which start every h words, so that an
unbroken notice always lies whole in one block. A block holds a template when it has THRESHOLD_PCT of the
template's different words. All such pairs are found:

- frequency order: a template's words are ranked by the number of documents with them, over all documents,
  rarest first; words in no template can't match and take no place in a block,
- prefix filter: a block that holds `need` words of a template has one of its `size - need + 1` rarest ones,
- length filter: the block has at least `need` ranked words,
- positional filter: what is left of block and template behind their first shared word is enough for `need`,
- verification on the whole sets.

Documents without any template's rare words are never cut into blocks. Broadcast: the templates' words.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erashift.llm.common import texts

THRESHOLD_PCT = 80

# Phrases that name a license, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# The notices by which works are put under common licenses.
NOTICES = (
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the "
               "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
            "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
            "distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def spaced(text: Column) -> Column:
    """The words of a text, lower-cased, with one space between them.

    lower() changes letters beyond ASCII too. That moves no border between words, and no letter that it turns into
    ASCII is in a phrase; template words are compared in this form on both sides.
    """
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _BETWEEN, " "))


def _words_in(name: str) -> list[str]:
    """The words of a template, as spaced() makes them."""
    return "".join(c if c > "\x7f" or c.isdigit() or c.islower() else " " for c in name.lower()).split()


def _spaces(s: Column) -> Column:
    return (F.octet_length(s) - F.octet_length(F.replace(s, F.lit(" "), F.lit("")))).cast("long")


def phrase_places(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word and base (labels) to rows with a column spaced, which goes.

    The text is split in front of every phrase; the words before the first and from the last cut give the places.
    """
    framed = F.concat(F.lit("# "), "spaced", F.lit(" "))
    ends = F.array_distinct(F.array(*[F.lit(f" {phrase.split()[-1]} ") for phrase, _ in phrases]))
    may_hold = F.exists(ends, lambda end: framed.contains(end))
    cut = F.when(may_hold, F.split(framed, "|".join(f"(?= {phrase} )" for phrase, _ in phrases))).otherwise(F.array(framed))

    def begins(phrase: str) -> Column:
        return F.exists("pieces", lambda piece: piece.startswith(f" {phrase} "))

    labels = [F.when(begins(phrase), F.lit(label)) for phrase, label in phrases]
    n_words = F.when(F.col("spaced") == "", F.lit(0).cast("long")).otherwise(_spaces(F.col("spaced")) + 1)
    counted = docs.withColumn("pieces", cut).withColumn("n_words", n_words).withColumn("n_base", (F.size("pieces") - 1).cast("long"))
    last = F.col("n_words") - _spaces(F.element_at("pieces", -1)) + 1
    return counted.withColumns({
        "first_word": F.when(F.col("n_base") > 0, _spaces(F.element_at("pieces", 1))), "last_word": F.when(F.col("n_base") > 0, last),
        "base": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))),
    }).drop("spaced", "pieces")


def size_class(words: int) -> int:
    """The power of two that holds so many words."""
    return 1 << (words - 1).bit_length()


def compile_templates(templates: Sequence[tuple[str, str]], threshold_pct: int) -> list[tuple[str, int, list[str], int]]:
    """(label, size class, different words, words needed) of each template with words."""
    out = []
    for label, notice in templates:
        words = _words_in(notice)
        if words:
            distinct = sorted(set(words))
            out.append((label, size_class(len(words)), distinct, max(1, -(-threshold_pct * len(distinct) // 100))))
    return out


def _relation(spark, rows: list[tuple], fields: str) -> DataFrame:
    """A few rows, as long as the templates, from one literal."""
    names = [f.split(":")[0] for f in fields.split(",")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{fields}>>")))


def _one_of(words: Sequence[str]) -> Column:
    return F.split(F.lit(" ".join(words)), " ")


def document_counts(docs: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """In how many rows of all documents each word of the vocabulary is; one number per word reaches the driver."""
    known = _one_of(vocabulary)
    seen = docs.select(F.explode(F.array_intersect(F.split(spaced(F.col("text")), " "), known)).alias("word"))
    return {r["word"]: r["count"] for r in seen.groupBy("word").count().collect()}


def find_notices(docs: DataFrame, templates: Sequence[tuple[str, str]], threshold_pct: int = THRESHOLD_PCT) -> DataFrame:
    """doc_id, digest (md5 of the text), block (its first word), label, template, containment: every pair of a block
    and a template that meets the threshold. Rows that repeat id and text answer once."""
    spark = docs.sparkSession
    compiled = compile_templates(templates, threshold_pct)
    if not compiled:
        return spark.sql("select 0L as doc_id, '' as digest, 0L as block, '' as label, 0 as template, 0.0D as containment where false")
    counts = document_counts(docs, sorted({w for t in compiled for w in t[2]}))
    ranked = sorted({w for t in compiled for w in t[2]}, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(ranked)}
    ordered = [(label, h, sorted(rank[w] for w in words), need) for label, h, words, need in compiled]
    rare = [(h, r, i, k, need) for k, (_, h, ranks, need) in enumerate(ordered) for i, r in enumerate(ranks[:len(ranks) - need + 1])]
    least: dict[int, int] = {}
    for _, h, _, need in ordered:
        least[h] = min(need, least.get(h, need))

    words = F.split(spaced(F.col("text")), " ")
    telling = _one_of(sorted({ranked[r] for _, r, *_ in rare}))
    suspects = docs.where(F.arrays_overlap(words, telling))
    placed = suspects.select("doc_id", F.md5("text").alias("digest"), F.posexplode(words).alias("pos", "word"))
    vocabulary = _relation(spark, sorted({(ranked[r], h, r) for _, h, ranks, _ in ordered for r in ranks}), "word:string,h:int,rank:int")
    known = placed.join(F.broadcast(vocabulary), "word")
    block = F.floor(F.col("pos") / F.col("h")) * F.col("h")
    in_blocks = known.select("doc_id", "digest", "h", "rank", F.explode(F.array(block, block - F.col("h"))).alias("block")).where("block >= 0")
    sets = in_blocks.groupBy("doc_id", "digest", "h", "block").agg(F.array_sort(F.collect_set("rank")).alias("ranks"))
    needs = _relation(spark, sorted(least.items()), "h:int,least:int")
    long_enough = sets.join(F.broadcast(needs), "h").where(F.size("ranks") >= F.col("least"))  # length filter

    first = F.slice("ranks", 1, F.size("ranks") - F.col("least") + 1)  # the block's prefix for the smallest need
    probes = long_enough.select("doc_id", "digest", "h", "block", "ranks", F.posexplode(first).alias("j", "rank"))
    index = _relation(spark, rare, "h:int,rank:int,i:int,template:int,need:int")
    sizes = _relation(spark, [(k, label, ranks) for k, (label, _, ranks, _) in enumerate(ordered)], "template:int,label:string,wanted:array<int>")
    met = probes.join(F.broadcast(index), ["h", "rank"])
    met = met.where(F.size("ranks") - F.col("j") >= F.col("need"))  # positional filter; the template's side holds by its prefix
    pairs = met.select("doc_id", "digest", "block", "ranks", "template", "need").distinct()
    shared = pairs.join(F.broadcast(sizes), "template").withColumn("shared", F.size(F.array_intersect("ranks", "wanted")))
    return shared.where("shared >= need").select("doc_id", "digest", "block", "label", "template",
                                                 (F.col("shared") / F.size("wanted")).alias("containment"))


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = NOTICES, phrases: Sequence[tuple[str, str]] = PHRASES,
                  threshold_pct: int = THRESHOLD_PCT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per row of docs.

    Places are those of the phrases; base_labels are their labels, labels also those of the notices the join finds
    (both empty text when there is none). score: 1 with a phrase, else the largest containment found, else 0.
    NULL and empty texts have no words. Whole texts of any length are read; rows are told apart by id and text, so
    rows without an id, or with one id and several texts, each get their own answer, and repeated rows equal ones.
    """
    docs = texts(docs)
    found = find_notices(docs, templates, threshold_pct).groupBy(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest")).agg(
        F.collect_set("label").alias("found"), F.max("containment").alias("most"))
    places = phrase_places(docs.select("doc_id", F.md5("text").alias("digest"), spaced(F.col("text")).alias("spaced")), phrases)
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("digest").eqNullSafe(F.col("_digest"))
    labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return places.join(found, same, "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"))


def oracle_sql(templates: Sequence[tuple[str, str]] = NOTICES, threshold_pct: int = THRESHOLD_PCT) -> str:
    """The same by comparing every block with every template of its size class, for DuckDB."""
    listed = ", ".join(f"({k}, '{label}', {h}, [{', '.join(repr(w) for w in words)}], {need})"
                       for k, (label, h, words, need) in enumerate(compile_templates(templates, threshold_pct)))
    return f"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
t(template, label, h, wanted, need) as (values {listed}),
p as (select doc_id, i - 1 as p, case when w[i] = 'mit' and w[i + 1] = 'license' then 'mit' when w[i] = 'apache' and w[i + 1] = 'license' then 'apache'
             when w[i] = 'general' and w[i + 1] = 'public' and w[i + 2] = 'license' then 'gpl' end as label
      from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d)),
b as (select doc_id, count(*) as n_base, min(p) as first_word, max(p) as last_word, list_sort(list(distinct label)) as base from p where label is not null group by doc_id),
k as (select doc_id, h, w[s + 1 : s + 2 * h] as block from (select doc_id, w, h, unnest(range(0, len(w), h)) as s from d, (select distinct h from t)) where len(w) > 0),
m as (select doc_id, label, len(list_intersect(block, wanted)) as shared, len(wanted) as size, need from k join t using (h)),
f as (select doc_id, list(distinct label) as found, max(shared / size) as most from m where shared >= need group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word, last_word, array_to_string(coalesce(base, []), ',') as base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ',') as labels,
       round(case when n_base > 0 then 1.0 else coalesce(most, 0.0) end, 6) as score
from d left join b using (doc_id) left join f using (doc_id)
"""
