"""License scans: an exact set-similarity join of text blocks with license templates.

The blocks are all windows of consecutive words, as long as a template at the threshold: n / threshold words for a template
of n words (or the whole text, if it is shorter), so layout, blank lines and comment marks don't matter. A block meets a template if it holds at least
``threshold`` of the template's distinct words (all of them for templates of fewer than SHORT, which chance would meet
too often). Of templates that hold all words of another label's one (CC BY-NC and CC BY), a block must have the words
that tell it apart, and a block of the other one none of them, so labels of variants exclude each other.

All words of templates are put into one global order, rarest first (frequencies are counted over every text), and:

* prefix filter: with o required words, a matching block, and so its text, holds one of the first |T| - o + 1 words of the
  template in that order, so an index over these prefixes finds every candidate;
* length filter: a text with fewer than o distinct words can't match;
* positional filter: after a first common word at position i of the template and j of the text's known words, at most
  1 + min(|T| - i - 1, m - j - 1) words can be common, and less than o rules the pair out;

what remains is verified exactly, by a window that slides over the places of the template's words. The templates are few
and fixed, so they and the order of their words are broadcast.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import col, map_arrow

_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

THRESHOLD = 0.8
#: Templates of fewer distinct words have to be met in full.
SHORT = 10

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Opening notices of public licenses; label and text.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
]


def words_of(raw: bytes | None) -> list[bytes]:
    """The words of the contract: ASCII letters (lower case) and digits, and all that is not ASCII."""
    return _WORDS.findall(raw.lower()) if raw else []


def phrase_places(words: list[bytes], phrases: dict[str, str] = PHRASES) -> list[tuple[int, str]]:
    """Start and label of every place where a phrase's words stand consecutively."""
    out = []
    for phrase, label in phrases.items():
        parts = phrase.encode().split()
        at = -1
        while True:
            try:
                at = words.index(parts[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(parts)] == parts:
                out.append((at, label))
    return out


class TemplateIndex:
    """Prefix index over the templates under a global order of their words."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[bytes, int], threshold: float = THRESHOLD):
        lists = [words_of(text.encode()) for _, text in templates]
        self.labels, self.members = [label for label, _ in templates], [frozenset(x) for x in lists]
        self.rank = {w: i for i, w in enumerate(sorted(frozenset().union(*self.members), key=lambda w: (frequency.get(w, 0), w)))}
        shares = [1.0 if len(m) < SHORT else threshold for m in self.members]
        self.need = [max(1, math.ceil(t * len(m) - 1e-9)) for t, m in zip(shares, self.members, strict=True)]
        #: Words of a block.
        self.width = [math.ceil(len(x) / t - 1e-9) for t, x in zip(shares, lists, strict=True)]
        parts = [[j for j, n in enumerate(self.members) if n < m and self.labels[j] != label] for label, m in zip(self.labels, self.members, strict=True)]
        #: Words that a block must hold, and that it may not.
        self.own = [frozenset().union(*[m - self.members[j] for j in p]) for m, p in zip(self.members, parts, strict=True)]
        self.others = [frozenset().union(*[self.members[k] - m for k, p in enumerate(parts) if j in p]) for j, m in enumerate(self.members)]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for k, m in enumerate(self.members):
            for i, token in enumerate(sorted(self.rank[w] for w in m)[: len(m) - self.need[k] + 1]):
                self.prefix.setdefault(token, []).append((k, i))
        self.prefix_words, self.shortest = frozenset(w for w, r in self.rank.items() if r in self.prefix), min(self.need, default=0)

    def candidates(self, distinct: frozenset[bytes]) -> list[int]:
        """The templates of which a text with these words holds as many as a block needs."""
        if len(distinct) < self.shortest or self.prefix_words.isdisjoint(distinct):
            return []
        known = sorted(self.rank[w] for w in distinct if w in self.rank)
        seen, out = set(), []
        for j, token in enumerate(known):
            for k, i in self.prefix.get(token, ()):
                if k in seen:
                    continue
                seen.add(k)  # the first common word; later ones allow for less
                need, size = self.need[k], len(self.members[k])
                if len(distinct) >= need and 1 + min(size - i - 1, len(known) - j - 1) >= need and len(self.members[k] & distinct) >= need:
                    out.append(k)
        return out

    def best(self, k: int, words: list[bytes]) -> float:
        """The largest share of template ``k`` that a block which meets it holds; 0 if none does."""
        members, others = self.members[k], self.others[k]
        inside, low, most = [], 0, 0
        for at, word in enumerate(words):
            if word in members:
                inside.append((at, word))
            elif word in others:  # no block reaches over it
                most, inside, low = max(most, self._most(k, inside, at - low, len(words))), [], at + 1
        most = max(most, self._most(k, inside, len(words) - low, len(words)))
        return most / len(members) if most else 0.0

    def _most(self, k: int, inside: list[tuple[int, bytes]], length: int, whole: int) -> int:
        """Of a run of ``length`` words with the template's words ``inside``, the most distinct ones in a block that meets it."""
        if length < min(self.width[k], whole):
            return 0  # no block fits in
        held: Counter = Counter()
        most = first = 0
        for at, word in inside:
            held[word] += 1
            while inside[first][0] <= at - self.width[k]:
                gone = inside[first][1]
                first += 1
                held[gone] -= 1
                if not held[gone]:
                    del held[gone]
            if len(held) > most and len(held) >= self.need[k] and self.own[k] <= held.keys():
                most = len(held)
        return most

    def found(self, words: list[bytes]) -> dict[str, float]:
        """Label and largest share of the templates that blocks of the text meet."""
        out: dict[str, float] = {}
        for k in self.candidates(frozenset(words)):
            if share := self.best(k, words):
                out[self.labels[k]] = max(share, out.get(self.labels[k], 0.0))
        return out


def word_frequencies(docs: DataFrame, templates: list[tuple[str, str]], *, text_col: str = "text") -> dict[bytes, int]:
    """In how many texts of the whole corpus each template word occurs (a few hundred words at most)."""
    wanted = frozenset(w for _, t in templates for w in words_of(t.encode()))
    schema = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())])

    def run(rows: dict[str, list]) -> dict[str, list]:
        found: Counter = Counter()
        for raw in rows["t"]:
            found.update(wanted.intersection(words_of(raw)))
        return {"word": list(found), "n": list(found.values())}

    counts = map_arrow(docs.select(col(docs, text_col).cast("binary").alias("t")), run, schema)
    return {bytes(r["word"]): r["n"] for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}


SCANNED = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "n_base", "first_word", "last_word")]
    + [T.StructField(n, T.StringType()) for n in ("base_labels", "labels")]
    + [T.StructField("score", T.DoubleType())]
)


def scan(docs: DataFrame, key: str = "doc_id", *, text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: the key, phrase places and labels, the labels of all templates met, and a score.

    The score is 1 with a phrase, else the largest share of a template that a block holds, else 0. A null or empty text
    has no words; labels without a member are empty strings; equal rows get equal results; an empty table gives an empty
    one. The key may have any name but that of a result.
    """
    if key.lower() in SCANNED.names:
        raise ValueError(f"the key {key} has the name of a result")
    index = docs.sparkSession.sparkContext.broadcast(TemplateIndex(templates, word_frequencies(docs, templates, text_col=text_col), threshold))
    slim = docs.select(col(docs, key).alias("k"), col(docs, text_col).cast("binary").alias("body"))

    def run(rows: dict[str, list]) -> dict[str, list]:
        found = [scan_text(raw, index.value) for raw in rows["body"]]
        return {name: [x[i] for x in found] for i, name in enumerate(SCANNED.names)}

    return map_arrow(slim, run, T.StructType([slim.schema["k"], *SCANNED.fields]), carry=["k"]).withColumnRenamed("k", key)


def scan_text(raw: bytes | None, index: TemplateIndex) -> tuple:
    words = words_of(raw)
    places, met = phrase_places(words), index.found(words)
    starts, base = [p for p, _ in places], {x for _, x in places}
    score = 1.0 if places else max(met.values(), default=0.0)
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | met.keys())), score
