"""Licence scan: lines and paragraphs compared with licence templates by the Dice coefficient over word bigrams.

With bigram sets of sizes a and b the coefficient is at most 2 min(a, b) / (a + b), so a template is only compared with
texts whose size allows the threshold. Templates are a parameter, so their number is bounded and they are literals of the
plan: a document is scanned where it is read, without a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.tables import keyed, with_fixed

# Public licence notices and standard permission texts, in lower case without punctuation.
TEMPLATES = {
    "apache-2.0": (
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the"
        " license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    "bsd": (
        "released under the bsd license",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the"
        " following conditions are met"),
    "cc-by-4.0": ("this work is licensed under a creative commons attribution 4 0 international license",
                  "licensed under cc by 4 0"),
    "cc-by-nc-4.0": ("this work is licensed under a creative commons attribution noncommercial 4 0 international license",
                     "licensed under cc by nc 4 0"),
    "cc-by-sa-4.0": ("this work is licensed under a creative commons attribution sharealike 4 0 international license",
                     "licensed under cc by sa 4 0"),
    "gpl-3.0": (
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public"
        " license as published by the free software foundation either version 3 of the license or at your option any later"
        " version"),
    "mit": (
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction including without limitation the"
        " rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
    "reserved": ("all rights reserved",),
}


def _bigrams(text: str) -> list[str]:
    words = text.split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """The set sizes that can reach the threshold with a set of this size."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9)


def _words(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    return F.split(plain, " ")


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = 0.8,
         key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: row, doc_id, found (array of name, dice and text of each line or paragraph), n_found, licences.

    A unit is a line, or a paragraph of several lines (blank lines part them); it takes the template it is most like (ties:
    by name) if the coefficient reaches the threshold. A null or empty text has no unit. Equal rows give equal results;
    whole texts are read; an empty table gives an empty table.
    """
    sized = [(name, grams) for name in sorted(templates) for grams in map(_bigrams, templates[name])]
    low, high = (f(bounds(len(g), threshold)[i] for _, g in sized) for i, f in ((0, min), (1, max)))
    rows = keyed(docs, key, text)
    paragraphs = F.filter(F.split(text, r"\n[\x20\x09-\x0D]*\n"), lambda b: F.contains(F.trim(b), F.lit("\n")))
    rows = with_fixed(rows, units=F.transform(F.concat(F.split(text, "\n"), paragraphs),
                                              lambda u: F.struct(u.alias("text"), _words(u).alias("words"))))
    # n words make n - 1 different pairs at most, and d different words make d - 1 of them at least
    fits = lambda u: (F.size(u["words"]) > low) & (F.size(F.array_distinct(u["words"])) - 1 <= high)
    rows = with_fixed(rows, fitting=F.filter("units", fits)).drop("units")
    pairs = lambda w: F.array_distinct(F.zip_with(
        F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))
    rows = with_fixed(rows, sets=F.transform("fitting", lambda u: F.struct(
        u["text"].alias("text"), pairs(u["words"]).alias("pairs"))))

    def likeness(place: int, template: list[str], found: Column) -> Column:
        least, most = bounds(len(template), threshold)
        shared = F.size(F.array_intersect(found, F.array(*map(F.lit, template))))
        dice = F.when(F.size(found).between(least, most), 2.0 * shared / (F.size(found) + len(template)))
        return F.struct(F.coalesce(dice, F.lit(0.0)).alias("dice"), F.lit(-place).alias("place"))

    names = F.array(*[F.lit(name) for name, _ in sized])
    best = lambda u: F.array_max(F.array(*[
        likeness(i, template, u["pairs"]) for i, (_, template) in enumerate(sized)]))
    rows = with_fixed(rows, scored=F.transform("sets", lambda u: F.struct(u["text"].alias("text"), best(u).alias("best"))))
    found = F.transform(F.filter("scored", lambda u: u["best"]["dice"] >= threshold), lambda u: F.struct(
        F.element_at(names, 1 - u["best"]["place"]).alias("name"), F.round(u["best"]["dice"], 6).alias("dice"),
        u["text"].alias("text")))
    rows = with_fixed(rows, found=found)
    return rows.select("row", F.col("key").alias("doc_id"), "found", F.size("found").cast("long").alias("n_found"),
                       F.array_join(F.array_sort(F.array_distinct("found.name")), ",").alias("licences"))
