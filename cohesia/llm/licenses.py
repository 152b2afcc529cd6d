"""License scan by an exact set-similarity join, in DataFrame operations only.

Words are runs of letters and digits (A-Z lower-cased; any character beyond ASCII
counts as a letter). Base phrases are found at every place. Further labels come
from license templates: the word sequence is read in blocks of ``BLOCK`` words,
``STRIDE`` apart, and a template is present if at least ``CONTAINMENT`` of its
distinct words stand in one block.

The join is exact. Template words are ordered by how many documents of the corpus
have them, rarest first. A block that holds the needed share of a template must
hold one of its first |T| - need + 1 words (prefix filter), must have as many
template words as are needed (length filter), and from the first shared word on
enough words must be left on both sides (positional filter). Survivors are
verified by set intersection. The templates are a fixed list, so their index is a literal
of the plan: every text looks its blocks up where it is read, whatever source, line or group of copies it
belongs to, and nothing but the counts of template words is shuffled.

Null or empty text: no words, score 0, empty labels, null places. Every row is judged by its own text: rows
with a null or repeated doc_id get their own answers. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohesia.session import Scratch

CONTAINMENT = 0.9
BLOCK, STRIDE = 64, 32
# Base phrases, and the wording of public license notices (each at most STRIDE words) with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("cc0", "cc0 1 0 universal public domain dedication"),
)
_BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _needed(n: int) -> int:
    return math.ceil(CONTAINMENT * n - 1e-9)


def words(text: Column) -> Column:
    """All words of a text. Case mapping beyond ASCII changes no word boundary and makes no phrase."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _BREAK), "")


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _phrase_places(w: Column) -> Column:
    """(start, label) of every base phrase: each ends in its last word, so one look back decides."""
    found = F.filter(F.transform(w, lambda x, i: F.when(x == "license", i)), lambda i: i.isNotNull())

    def at(i: Column) -> Column:
        one, two = F.get(w, i - 1), F.get(w, i - 2)
        start = lambda back, label: F.struct((i - back).cast("long").alias("start"), F.lit(label).alias("label"))
        return F.when(one == "mit", start(1, "mit")).when(one == "apache", start(1, "apache")).when((one == "public") & (two == "general"), start(2, "gpl"))

    return F.when(F.array_contains(w, "license"), F.filter(F.transform(found, at), lambda h: h.isNotNull()))


def _vocabulary() -> list[str]:
    return sorted({x for _, t in TEMPLATES for x in t.split()})


def digest(documents: DataFrame) -> DataFrame:
    """What one reading of each whole text gives: doc_id, n_words, places of base phrases, the template words of the text
    (numbers in alphabetical order) and those of each block that has enough of them for some template."""
    vocabulary = _vocabulary()
    known = F.array(*map(F.lit, vocabulary))
    number = F.create_map(*(x for i, w in enumerate(vocabulary) for x in (F.lit(w), F.lit(i + 1))))
    templates = [sorted(set(t.split())) for _, t in TEMPLATES]
    wanted = F.array(*(F.struct(F.array(*map(F.lit, t)).alias("words"), F.lit(_needed(len(t))).alias("need")) for t in templates))
    least = min(_needed(len(t)) for t in templates)
    numbers = lambda found: F.transform(found, lambda x: number[x])

    def of_words(w: Column) -> Column:
        def of_own(own: Column) -> Column:
            starts = F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(STRIDE))
            cut = F.transform(starts, lambda i: F.array_intersect(F.slice(w, i + 1, BLOCK), known))
            held = F.transform(F.filter(cut, lambda b: F.size(b) >= least), numbers)
            # a text that has not enough words of any template has no block that does
            possible = (F.size(own) >= least) & F.exists(wanted, lambda t: F.size(F.array_intersect(own, t["words"])) >= t["need"])
            return F.struct(numbers(own).alias("own"), F.when(possible, held).otherwise(F.array().cast("array<array<int>>")).alias("blocks"))

        return F.struct(F.size(w).cast("long").alias("n"), _phrase_places(w).alias("places"), _let(F.array_intersect(w, known), of_own).alias("c"))

    one = documents.select("doc_id", _let(words(F.col("text")), of_words).alias("b"))
    nowhere = F.array().cast("array<struct<start:bigint,label:string>>")
    return one.select("doc_id", F.col("b.n").alias("n_words"), F.coalesce("b.places", nowhere).alias("places"), F.col("b.c.own").alias("own"), F.col("b.c.blocks").alias("blocks"))


def word_order(read: DataFrame) -> list[int]:
    """The numbers of all template words by the number of documents that have them, rarest first."""
    counts = read.select(F.explode("own").alias("word")).groupBy("word").count()
    seen = {r["word"]: r["count"] for r in counts.collect()}  # one row for each template word at most
    return sorted(range(1, len(_vocabulary()) + 1), key=lambda x: (seen.get(x, 0), x))


def _array(values: list[int]) -> Column:
    return F.array(*map(F.lit, values))


def template_matches(blocks: Column, order: list[int]) -> Column:
    """(label, containment) of every template that a block holds: the join of a text's blocks with the index of templates.

    Each template is indexed under its prefix, its rarest words; a block looks up only the prefix words it has.
    """
    number = {w: i + 1 for i, w in enumerate(_vocabulary())}
    rank = {x: k for k, x in enumerate(order)}
    entries: dict[int, list[tuple[str, list[int], int, int]]] = {}
    for label, text in TEMPLATES:
        ranks = sorted({rank[number[x]] for x in text.split()})
        need = _needed(len(ranks))
        for at, r in enumerate(ranks[: len(ranks) - need + 1]):
            entries.setdefault(r, []).append((label, ranks, need, at))
    fields = lambda e: F.struct(F.lit(e[0]).alias("label"), _array(e[1]).alias("ranks"), F.lit(e[2]).alias("need"), F.lit(e[3]).alias("at"))
    index = F.create_map(*(x for r, some in sorted(entries.items()) for x in (F.lit(r), F.array(*map(fields, some)))))
    to_rank = F.create_map(*(x for w, r in sorted(rank.items()) for x in (F.lit(w), F.lit(r))))
    wanted = _array(sorted(entries))

    def of_block(b: Column) -> Column:
        def at_word(r: Column) -> Column:
            mine = F.filter(index[r], lambda t: (F.size(b) >= t["need"]) & (_words_left(b, t, r) >= t["need"]))
            return F.filter(F.transform(mine, lambda t: _shared(b, t)), lambda m: m["ok"])

        return F.flatten(F.transform(F.array_intersect(b, wanted), at_word))

    ranked = F.transform(blocks, lambda b: F.array_sort(F.transform(b, lambda w: to_rank[w])))
    return F.flatten(F.transform(ranked, of_block))


def _words_left(b: Column, t: Column, r: Column) -> Column:
    """Words that block and template can still share from r, their first shared word of a true match, on (positional filter)."""
    return F.least(F.size(t["ranks"]) - t["at"], F.size(b) - F.array_position(b, r).cast("int") + 1)


def _shared(b: Column, t: Column) -> Column:
    def of_size(n: Column) -> Column:
        return F.struct(t["label"].alias("label"), (n / F.size(t["ranks"])).alias("containment"), (n >= t["need"]).alias("ok"))

    return _let(F.size(F.array_intersect(b, t["ranks"])), of_size)


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every document.

    Texts are read once; their digest is written to the shared folder, counted for the order of words, and judged row by row.
    """
    read = Scratch(documents.sparkSession).keep(digest(documents))
    found = read.withColumn("more", template_matches(F.col("blocks"), word_order(read)))
    starts = F.transform("places", lambda p: p["start"])
    own = F.transform("places", lambda p: p["label"])
    best = F.array_max(F.transform("more", lambda m: m["containment"]))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(own)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own, F.transform("more", lambda m: m["label"]))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.round(F.coalesce(best, F.lit(0.0)), 6)).alias("score"),
    )


def oracle_sql() -> str:
    """The same for DuckDB, row by row: containment of every template in every block, without filters."""
    values = ", ".join(f"('{label}', '{text}')" for label, text in TEMPLATES)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
    WITH w AS (SELECT row_number() OVER () AS row, doc_id,
          regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    t AS (SELECT label, list_distinct(string_split(words, ' ')) AS t FROM (VALUES {values}) AS v(label, words)),
    p AS (SELECT row, w, unnest(range(len(w))) AS i FROM w),
    h AS (SELECT row, i, CASE WHEN w[i + 1] = 'mit' AND w[i + 2] = 'license' THEN 'mit' WHEN w[i + 1] = 'apache' AND w[i + 2] = 'license' THEN 'apache'
          WHEN w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license' THEN 'gpl' END AS label FROM p),
    base AS (SELECT row, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS own FROM h WHERE label IS NOT NULL GROUP BY row),
    b AS (SELECT row, list_distinct(w[s + 1 : s + {BLOCK}]) AS b FROM (SELECT row, w, unnest(range(0, len(w), {STRIDE})) AS s FROM w)),
    m AS (SELECT row, label, len(list_intersect(b, t)) AS shared, len(t) AS size FROM b, t),
    more AS (SELECT row, list(DISTINCT label) AS more, max(shared / size) AS best FROM m WHERE shared >= ceil({CONTAINMENT} * size - 1e-9) GROUP BY row)
    SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(own, ','), '') AS base_labels,
      coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ','), '') AS labels,
      CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE round(coalesce(best, 0.0)::DOUBLE, 6) END AS score
    FROM w LEFT JOIN base USING (row) LEFT JOIN more USING (row)
    """
