"""License scans: phrase places, and an exact set-similarity join of text blocks with license templates.

Everything is DataFrame functions. A template's block is as many consecutive words as SPAN times the template's, from any word
on: lines do not count, so a notice is found however it is wrapped, and words that lie scattered are no notice. A block holds a
template if at least THRESHOLD of the template's distinct tokens are in it. Tokens are ordered by how often they occur in
the corpus, rarest first; only words of templates have a place in it (no other can be in an overlap), and only blocks
that begin with one are looked at, as any other block can begin later and hold as much. Such a block must hold one of the
template's rarest tokens (prefix filter), as many template tokens as are needed (length filter), and enough tokens must
be left behind the first common one on both sides (positional filter); what passes is counted exactly.
"""

from __future__ import annotations

import math
import re
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Characters between words: all ASCII but digits and letters. Texts are split before A to Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Phrases of the base rules and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices that the join looks for, and their labels.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("permission to use copy modify and or distribute this software for any purpose is hereby granted", "isc"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
#: Words of a block as a multiple of the template's, and the share of the template's tokens that it must hold.
SPAN, THRESHOLD = 1.5, 0.8
#: Places of template words that are looked at together.
CHUNK = 1000


def spaced(text: Column) -> Column:
    """The text's words, each between two single spaces; the empty text gives one space."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, GAP, "  ")), F.lit(" "))


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def n_words(words: Column) -> Column:
    """Words of a spaced text: half its spaces, or none if nothing but spaces is in it."""
    return F.when(F.trim(words) == "", F.lit(0)).otherwise(spaces(words) / 2).cast("long")


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def alternatives(phrases: list[str]) -> str:
    return "(?i) (?:" + "|".join(re.escape(p).replace(r"\ ", "  ") for p in phrases) + ") "


def base_rules(docs: DataFrame) -> DataFrame:
    """doc_id, tag, n_words, n_base, first_word, last_word and base (labels) of docs (doc_id, tag, text)."""
    d = docs.select("doc_id", "tag", spaced(F.col("text")).alias("w"))
    d = d.select("doc_id", "tag", n_words(F.col("w")).alias("n_words"), F.when(F.col("w").rlike(alternatives(list(PHRASES))), lowered(F.col("w"))).alias("w"))
    count, first, last, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        there = F.lit(f" {phrase.replace(' ', '  ')} ")
        size, k = len(phrase.replace(" ", "  ")) + 2, phrase.count(" ") + 1
        n = F.coalesce(((F.length("w") - F.length(F.replace(F.col("w"), there, F.lit("")))) / size).cast("long"), F.lit(0))
        count.append(n)
        first.append(F.when(n > 0, spaces(F.substring_index("w", f" {phrase.replace(' ', '  ')} ", 1)) / 2).cast("long"))
        last.append(F.when(n > 0, F.col("n_words") - spaces(F.substring_index("w", f" {phrase.replace(' ', '  ')} ", -1)) / 2 - k).cast("long"))
        labels.append(F.when(n > 0, F.lit(label)))
    return d.select(
        "doc_id", "tag", "n_words", sum(count[1:], count[0]).cast("long").alias("n_base"),
        F.least(*first).alias("first_word"), F.greatest(*last).alias("last_word"), F.array_compact(F.array(*labels)).alias("base"),
    )


def token_order(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> list[str]:
    """The templates' tokens, rarest in the corpus first; equally frequent ones by name."""
    known = sorted({t for text, _ in templates for t in text.split()})
    vocabulary = F.broadcast(docs.sparkSession.createDataFrame([(t,) for t in known], "token string"))  # one row a template token
    words = docs.select(F.explode(F.split(F.trim(spaced(F.col("text"))), "  ")).alias("token")).select(F.lower("token").alias("token"))
    counts = {r["token"]: r["count"] for r in words.join(vocabulary, "token").groupBy("token").count().collect()}
    return sorted(known, key=lambda t: (counts.get(t, 0), t))


def widths(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> list[int]:
    """Words of a block for each template."""
    return [math.ceil(SPAN * len(text.split())) for text, _ in templates]


def template_blocks(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, tag, start, template, label, overlap and containment of every block, from that word on, that begins with a word of templates and holds one."""
    spark = docs.sparkSession
    order = token_order(docs, templates)
    rank, width = {t: i for i, t in enumerate(order)}, widths(templates)
    sets = [sorted({rank[t] for t in text.split()}) for text, _ in templates]
    need = [math.ceil(threshold * len(s)) for s in sets]
    heads = [s[: len(s) - n + 1] for s, n in zip(sets, need, strict=True)]
    prefix = [(r, k, i, len(sets[k]), need[k], width[k], templates[k][1]) for k, head in enumerate(heads) for i, r in enumerate(head)]
    prefix = F.broadcast(spark.createDataFrame(prefix, "rank int, template int, i int, size int, need int, width int, label string"))  # bounded by the templates
    rare, widest, least = sorted({r for head in heads for r in head}), max(width), min(need)
    # the prefix filter for whole texts
    some = docs.filter(spaced(F.col("text")).rlike(alternatives([order[r] for r in rare])))
    words = F.split(F.trim(lowered(spaced(F.col("text")))), "  ")
    hits = F.filter(F.transform(words, lambda t, i: F.struct(i.alias("pos"), t.alias("t"))), lambda x: x["t"].isin(order))
    ranks = F.create_map(*(F.lit(x) for t in order for x in (t, rank[t])))
    places = some.select("doc_id", "tag", F.transform(hits, lambda x: F.struct(x["pos"].alias("pos"), F.element_at(ranks, x["t"]).alias("rank"))).alias("hits"))
    # places in pieces of bounded size, each with what its last blocks reach
    offsets = F.sequence(F.lit(0), F.greatest(F.size("hits") - 1, F.lit(0)), F.lit(CHUNK))
    pieces = places.select("doc_id", "tag", F.explode(F.transform(offsets, lambda o: F.slice("hits", o + 1, CHUNK + widest))).alias("c"))
    inside = lambda j: F.filter(F.slice("c", j, widest), lambda x: x["pos"] < F.element_at("c", j)["pos"] + widest)
    own = F.sequence(F.lit(1), F.least(F.size("c"), F.lit(CHUNK)))
    # the prefix and the length filter for the widest block from a place on, then for each template's
    may = lambda j: (F.size(inside(j)) >= least) & F.exists(inside(j), lambda x: x["rank"].isin(rare))
    pieces = pieces.filter(F.size("c") >= least)
    blocks = pieces.select("doc_id", "tag", F.explode(F.transform(F.filter(own, may), lambda j: F.struct(F.element_at("c", j)["pos"].alias("start"), inside(j).alias("near")))).alias("b"))
    blocks = blocks.select("doc_id", "tag", "b.start", "b.near", F.array_sort(F.array_distinct("b.near.rank")).alias("ranks")).filter(F.size("ranks") >= least)
    met = blocks.select("doc_id", "tag", "start", "near", "ranks", F.posexplode("ranks").alias("j", "rank")).join(prefix, "rank")
    met = met.filter((F.size("ranks") >= F.col("need")) & (1 + F.least(F.col("size") - F.col("i") - 1, F.size("ranks") - F.col("j") - 1) >= F.col("need")))
    bodies = F.array(*(F.array(*(F.lit(r) for r in s)) for s in sets))
    block = F.transform(F.filter("near", lambda x: x["pos"] < F.col("start") + F.col("width")), lambda x: x["rank"])
    met = met.withColumn("overlap", F.size(F.array_intersect(block, F.element_at(bodies, F.col("template") + 1)))).filter("overlap >= need")
    return met.select("doc_id", "tag", "start", "template", "label", "overlap", (F.col("overlap") / F.col("size")).alias("containment")).distinct()


def scan(docs: DataFrame) -> DataFrame:
    """Base columns, labels and score of every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("tag"), "text")
    found = template_blocks(docs).groupBy(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).agg(F.collect_set("label").alias("own"), F.max("containment").alias("best"))
    both = base_rules(docs).join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag")), "left")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    every = F.concat("base", F.coalesce("own", F.array().cast("array<string>")))
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        joined(F.col("base")).alias("base_labels"), joined(every).alias("labels"), F.coalesce("best", F.lit(0.0)).alias("score"),
    )


def op7_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license scan of every document.

    A null text has no words, a null doc_id is a value of its own, repeated rows get equal results, an empty table gives no
    rows and other columns are ignored. Very long texts are scanned in whole. Of blocks that hold templates, the score is the
    largest containment; labels of all count, so ties need no order.
    """
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _oracle() -> str:
    gap = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    phrases = ", ".join(f"({p.split()!r}, '{label}')" for p, label in PHRASES.items())
    templates = ", ".join(f"({k}, {sorted(set(t.split()))!r}, {n}, '{label}')" for k, ((t, label), n) in enumerate(zip(TEMPLATES, widths(), strict=True)))
    lower = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {lower} AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{gap}') AS w FROM d),
ph(p, label) AS (VALUES {phrases}),
pl AS (SELECT r, label, i FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE t ~ 'license|cc') x, ph WHERE w[i:i + len(p) - 1] = p),
b AS (SELECT r, count(*) AS n, min(i) - 1 AS f, max(i) - 1 AS l, list_distinct(list(label)) AS labels FROM pl GROUP BY 1),
tp(k, s, n, label) AS (VALUES {templates}),
tt AS (SELECT k, n, unnest(s) AS token FROM tp),
o AS (SELECT r, k, n, token, i FROM (SELECT r, unnest(w) AS token, unnest(range(1, len(w) + 1)) AS i FROM w) JOIN tt USING (token)),
m AS (SELECT a.r, a.k, a.i, count(DISTINCT b.token) AS o FROM o a JOIN o b ON a.r = b.r AND a.k = b.k AND b.i >= a.i AND b.i < a.i + a.n GROUP BY 1, 2, 3),
g AS (SELECT r, list_distinct(list(label)) AS labels, max(o::DOUBLE / len(s)::DOUBLE) AS best FROM m JOIN tp USING (k) WHERE o >= ceil({THRESHOLD}::DOUBLE * len(s)::DOUBLE) GROUP BY 1)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, f::BIGINT AS first_word, l::BIGINT AS last_word,
       array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(g.labels, [])))), ',') AS labels,
       coalesce(best, 0::DOUBLE) AS score
FROM w LEFT JOIN b USING (r) LEFT JOIN g USING (r)"""


ORACLE = {"op7_license_join": _oracle()}
