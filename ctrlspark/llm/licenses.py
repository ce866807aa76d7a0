"""License scan: a positional index of rare template words, in DataFrame operations only.

The index lists, for each word, its places in licence templates; of a template it
holds the words with the highest IDF over all templates.  A file's words that the
index knows are its highest-IDF licence words; their postings, moved back by the
place in the template, meet on one start in the file where the template stands.  An
alignment counts when enough of the template's indexed words meet on it and the
template's mandatory phrase stands inside the aligned stretch.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: phrases and labels of the base scan
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_AS_IS = "software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_GNU = "is free software you can redistribute it and or modify it under the terms of the gnu {} public license as published by the free software foundation either version {} of the license or at your option any later version"
_CC = "licensed under a creative commons {} international license"

#: (label, mandatory phrase, template words), all as the word rule gives them; the texts are those of the licences (fixed values)
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("apache-2.0", "apache license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-2.0", "apache license", "licensed under the apache license version 2 0"),
    ("gpl-2.0", "general public license", _GNU.format("general", "2")),
    ("gpl-3.0", "general public license", "licensed under the gnu general public license version 3"),
    ("gpl-3.0", "general public license", _GNU.format("general", "3")),
    ("lgpl-2.1", "lesser general public license", _GNU.format("lesser general", "2 1")),
    ("lgpl-3.0", "lesser general public license", _GNU.format("lesser general", "3")),
    ("agpl-3.0", "affero general public license", _GNU.format("affero general", "3")),
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the " + _AS_IS),
    ("bsd-2-clause", "redistribution and use", _BSD + " 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "redistribution and use", _BSD),
    ("bsd-3-clause", "neither the name", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "altered source versions", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("bsl-1.0", "boost software license", "distributed under the boost software license version 1 0"),
    ("mpl-2.0", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("epl-2.0", "eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0"),
    ("unlicense", "public domain", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "public license", "do what the fuck you want to public license"),
    ("cc0-1.0", "cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights cc0 1 0 universal"),
    ("cc-by-nc-4.0", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "creative commons attribution", _CC.format("attribution 4 0")),
    ("cc-by-sa-4.0", "attribution sharealike", _CC.format("attribution sharealike 4 0")),
    ("cc-by-nc-4.0", "attribution noncommercial", _CC.format("attribution noncommercial 4 0")),
    *(
        (name, "spdx license identifier", "spdx license identifier " + name.replace("-", " ").replace(".", " "))
        for name in ("mit", "apache-2.0", "gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0", "bsd-2-clause", "bsd-3-clause", "isc", "mpl-2.0", "epl-2.0", "bsl-1.0", "unlicense", "cc0-1.0", "zlib")
    ),
)

#: indexed words of a template, and the share of them that has to meet
RARE_WORDS, ENOUGH = 8, 0.75


#: words of grammar, which say nothing about a licence: no index holds them (fixed values)
COMMON = frozenset("the of and or to a in is it its that this for with as by on be are was from at an not any all if may you one no can do so which shall has have under".split())


def rare_word_index(templates: Sequence[tuple[str, str, str]] = TEMPLATES, rare: int = RARE_WORDS) -> list[tuple[int, str, int]]:
    """(template, word, place) of the words with the highest IDF over templates; ties to the earlier place."""
    texts = [t[2].split() for t in templates]
    df = Counter(w for words in texts for w in set(words))
    out = []
    for t, words in enumerate(texts):
        ranked = sorted((p for p, w in enumerate(words) if w not in COMMON), key=lambda p: (-math.log(len(texts) / df[words[p]]), p))
        out += [(t, words[p], p) for p in sorted(ranked[:rare])]
    return out


def least_met(indexed: int, enough: float = ENOUGH) -> int:
    """How many of a template's indexed words have to meet."""
    return max(1, math.ceil(enough * indexed))


def _quoted(words: Sequence[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def split_words(text: Column) -> Column:
    """A-Z to lower case, then runs of digits, letters and characters beyond ASCII."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    plain = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), upper, lower), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    trimmed = F.trim(plain)
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, " "))


def _places(words: str, phrase: str) -> str:
    """SQL: starts of a phrase's words standing in a row."""
    parts = phrase.split()
    same = " and ".join(f"{words}[i + {k}] = '{w}'" for k, w in enumerate(parts))
    return f"filter(sequence(0, size({words}) - {len(parts)}), i -> {same})" if parts else "array()"


PLACES = "array<struct<start: bigint, label: string>>"
#: parts of a vote
ABOVE, EARLY = 1 << 34, 1 << 20
VOTES = "array<struct<template: int, label: string, start: bigint, matched: int, indexed: int>>"


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str, str]] = TEMPLATES, rare: int = RARE_WORDS, enough: float = ENOUGH) -> DataFrame:
    """Licence phrases and template alignments of every whole text.

    Returns one row per document: doc_id, n_words, base_places (start, label),
    alignments (template, label, start, matched, indexed).  A start may lie before
    the file's first word, where a template is cut off.  Null texts have no words;
    null doc_ids stay; repeated rows are scanned each; an empty table gives none;
    other columns are ignored.  The index is made from ``templates`` and stands in
    the plan as literals, so nothing is shuffled.
    """
    index = rare_word_index(templates, rare)
    rare_words = sorted({w for _, w, _ in index})
    base = docs.select("doc_id", split_words(F.col("text")).alias("words"))
    per_phrase = [
        f"case when array_contains(words, '{p.split()[0]}') and size(words) >= {len(p.split())} then transform({_places('words', p)}, i -> named_struct('start', cast(i as bigint), 'label', '{label}')) else cast(array() as {PLACES}) end"
        for p, label in PHRASES.items()
    ]
    places = f"case when array_contains(words, 'license') then array_sort(concat({', '.join(per_phrase)})) else cast(array() as {PLACES}) end"
    # a file's places of indexed words; it is only looked at word by word if it holds as many as some template needs
    sizes = Counter(t for t, _, _ in index)
    fewest = min((len({w for t, w, _ in index if t == k}) - (n - least_met(n, enough)) for k, n in sizes.items()), default=1)
    known = f"case when size(array_intersect(words, {_quoted(rare_words)})) >= {max(1, fewest)} then filter(sequence(0, size(words) - 1), i -> words[i] in ({', '.join(f"'{w}'" for w in rare_words)})) else cast(array() as array<int>) end"
    # a vote is one number: the template above, the start (moved by EARLY, as it may be negative) below
    posts: dict[str, list[str]] = {w: [] for w in rare_words}
    for t, w, p in index:
        posts[w].append(f"{t * ABOVE + EARLY - p}L")
    lookup = "map(" + ", ".join(f"'{w}', array({', '.join(x)})" for w, x in posts.items()) + ")"
    base = base.select("doc_id", F.size("words").cast("long").alias("n_words"), F.expr(places).alias("base_places"), "words", F.expr(known).alias("known"))
    votes = f"array_sort(flatten(transform(known, i -> transform({lookup}[words[i]], x -> x + i))))"
    base = base.withColumn("votes", F.expr(f"case when size(known) > 0 then {votes} else cast(array() as array<bigint>) end"))
    labels, phrases, lengths, needs, counts = ("array(" + ", ".join(x) + ")" for x in (
        [f"'{t[0]}'" for t in templates], [f"' {t[1]} '" for t in templates], [str(len(t[2].split())) for t in templates],
        [str(least_met(sizes[k], enough)) for k in range(len(templates))], [str(sizes[k]) for k in range(len(templates))]))
    # in order of votes, equal ones are as many as indexed words meet on a start: each has a place of its own
    runs = f"filter(sequence(0, size(votes) - 1), i -> (i = 0 or votes[i - 1] <> votes[i]) and get(votes, i + {needs}[cast(votes[i] div {ABOVE}L as int)] - 1) <=> votes[i])"
    met = f"transform({runs}, i -> named_struct('template', cast(votes[i] div {ABOVE}L as int), 'start', cast(votes[i] % {ABOVE}L - {EARLY} as int), 'matched', size(filter(slice(votes, i + 1, {max(sizes.values())}), v -> v = votes[i]))))"
    inside = f"instr(concat(' ', array_join(slice(words, greatest(v.start, 0) + 1, {lengths}[v.template] + least(v.start, 0)), ' '), ' '), {phrases}[v.template]) > 0"
    fine = f"filter({met}, v -> {lengths}[v.template] + least(v.start, 0) > 0 and {inside})"
    named = f"transform({fine}, v -> named_struct('template', v.template, 'label', {labels}[v.template], 'start', cast(v.start as bigint), 'matched', v.matched, 'indexed', {counts}[v.template]))"
    return base.select("doc_id", "n_words", "base_places", F.expr(f"case when size(votes) > 0 then array_sort({named}) else cast(array() as {VOTES}) end").alias("alignments"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``scan_licenses``; score: share of indexed words met by the best alignment."""
    labels = lambda c: F.transform(F.col(c), lambda x: x["label"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    starts = F.transform("base_places", lambda x: x["start"])
    best = F.array_max(F.transform("alignments", lambda x: x["matched"] / x["indexed"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base_places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(labels("base_places")).alias("base_labels"),
        joined(F.concat(labels("base_places"), labels("alignments"))).alias("labels"),
        F.coalesce(best, F.when(F.size("base_places") > 0, F.lit(0.5)), F.lit(0.0)).alias("score"),
    )
