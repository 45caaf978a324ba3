"""License notices by exact set-similarity join of text blocks and templates.

A template is a paragraph of a public license or of its usual notice. A block is
any stretch of a paragraph (between blank lines) of at most twice the template's
words. It meets the template when it holds at least ``share`` of the template's
distinct words, one of each group of words that it must hold, and none that it
must not; such words tell licenses apart that share most of their text.

Words are ordered by their frequency in the whole corpus, rare ones first. If
the overlap reaches the bound o, the first |T| - o + 1 words of the template and
the first |B| - o + 1 of the paragraph share one (prefix filter); a paragraph
with fewer than o words can't reach it (length filter); a first shared word at
places i and j leaves at most 1 + min(|T| - i - 1, |B| - j - 1) (positional
filter). What passes is checked in every block. Words outside all templates are
left out of B, as they never count. The templates are a table of fixed size, so
the join needs no shuffle; only the words' counts do.

Words: runs of ASCII letters and digits and of all other characters, lower-cased
in ASCII. Null texts are empty. Repeated rows are scanned alike; extra columns
are ignored; ties in frequency are ordered by the word.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import small_batches

#: Phrases whose every place counts, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


class Template(NamedTuple):
    """must: groups of words, of each of which a block holds one; never: words that it doesn't hold."""

    label: str
    text: str
    must: tuple[tuple[str, ...], ...] = ()
    never: tuple[str, ...] = ()


_OTHER_GPL, _OTHER_CC = ("lesser", "library", "affero"), ("noncommercial", "sharealike", "noderivatives", "nc", "sa", "nd")
#: Paragraphs of public licenses and of their notices, and their labels.
TEMPLATES = [
    Template("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", (("affero",),)),
    Template("agpl", "This work is licensed under the GNU Affero General Public License, version 3", (("affero",),)),
    Template("apache", "Licensed under the Apache License, Version 2.0", (("apache",),)),
    Template("apache", "you may not use this file except in compliance with the License", (("file",), ("compliance",))),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", (("redistribution",),)),
    Template("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution", (("redistributions",),)),
    Template("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", (("contributors",), ("endorse",))),
    Template("bsl", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software", (("organization",),)),
    Template("bsl", "Distributed under the Boost Software License, Version 1.0", (("boost",),)),
    Template("cc-by", "Licensed under CC BY 4.0", (("by",), ("cc",)), _OTHER_CC),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", (("creative",), ("attribution",)), _OTHER_CC),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", (("nc",), ("cc",)), ("sa", "nd")),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", (("noncommercial",),), ("sharealike", "noderivatives")),
    Template("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0", (("nc",), ("sa",), ("cc",))),
    Template("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", (("noncommercial",), ("sharealike",))),
    Template("cc-by-nd", "Licensed under CC BY-ND 4.0", (("nd",), ("cc",)), ("nc",)),
    Template("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", (("noderivatives",),), ("noncommercial",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", (("sa",), ("cc",)), ("nc",)),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", (("sharealike",),), ("noncommercial",)),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", (("waived",),)),
    Template("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", (("eclipse",),)),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3", (("gnu", "gpl"), ("general",)), _OTHER_GPL),
    Template("gpl", "it under the terms of the GNU General Public License as published by the Free Software Foundation", (("general",),), _OTHER_GPL),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", (("fee",), ("purpose",))),
    Template("lgpl", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", (("lesser", "library"),)),
    Template("lgpl", "This work is licensed under the GNU Lesser General Public License, version 3", (("lesser", "library"),)),
    Template("mit", "Released under the MIT License", (("mit",),)),
    Template("mit", "Licensed under the MIT License", (("mit",),)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so", (("sublicense",), ("sell",))),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", (("obtaining",), ("associated",))),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", (("mozilla",),)),
    Template("proprietary", "This software is proprietary and confidential; unauthorized copying of this file is strictly prohibited", (("proprietary", "confidential"),)),
    Template("reserved", "All rights reserved", (("reserved",),)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", (("unencumbered",),)),
    Template("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means", (("compile", "compiled"),)),
    Template("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", (("alter",), ("freely",))),
]

_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_BLANK = re.compile(rb"\n[\x20\t\r]*\n")
_PHRASE = [(p.encode(), label) for p, label in PHRASES.items()]


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_TABLE).split()


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


VOCABULARY = frozenset(w for t in TEMPLATES for w in words_of(_bytes(t.text)))
#: Words that decide between templates; those outside all of them are looked for in blocks alone.
_DECIDING = frozenset(w.encode() for t in TEMPLATES for w in (*t.never, *(x for group in t.must for x in group)))
KNOWN = VOCABULARY | _DECIDING


def frequencies(docs: DataFrame, text: str = "text") -> dict[bytes, int]:
    """How often each template word stands in all texts; the result's size is fixed."""
    small_batches(docs.sparkSession)

    def run(batches):
        n: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                n.update(filter(VOCABULARY.__contains__, words_of(_bytes(t.as_py()))))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    found = docs.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in found.collect()}


class Index:
    """The templates, ordered and indexed by their prefixes."""

    def __init__(self, frequency: dict[bytes, int], share: float = 0.8):
        self.rank = {w: i for i, w in enumerate(sorted(VOCABULARY, key=lambda w: (frequency.get(w, 0), w)))}
        self.sets, self.need, self.at = [], [], {}
        self.words, self.span, self.must, self.never = [], [], [], []
        for t, template in enumerate(TEMPLATES):
            own = words_of(_bytes(template.text))
            ranks = sorted({self.rank[w] for w in own})
            need = math.ceil(len(ranks) * share - 1e-9)
            self.words.append(frozenset(own))
            self.span.append(2 * len(own))
            self.must.append([frozenset(w.encode() for w in group) for group in template.must])
            self.never.append(frozenset(w.encode() for w in template.never))
            self.sets.append(ranks)
            self.need.append(need)
            for i, r in enumerate(ranks[: len(ranks) - need + 1]):
                self.at.setdefault(r, []).append((t, i))
        self.least = min(self.need)
        self.prefix = frozenset(w for w, r in self.rank.items() if r in self.at)

    def candidates(self, words: frozenset) -> list[int]:
        """Every template that the distinct words reach, wherever they stand; words: of the vocabulary."""
        if len(words) < self.least or self.prefix.isdisjoint(words):
            return []
        block = sorted(self.rank[w] for w in words)
        own, out, seen = frozenset(block), [], set()
        for j, r in enumerate(block):
            for t, i in self.at.get(r, ()):
                n, need = len(self.sets[t]), self.need[t]
                if t in seen or len(block) < need or j > len(block) - need:
                    continue
                seen.add(t)  # the first shared word decides, as all later ones leave less
                if 1 + min(n - i - 1, len(block) - j - 1) >= need and sum(x in own for x in self.sets[t]) >= need:
                    out.append(t)
        return out

    def containment(self, t: int, at: list[tuple[int, bytes]]) -> float:
        """The template's largest containment in a block that meets it, else 0. at: (place, word) of known words, in order."""
        own, must, never = self.words[t], self.must[t], self.never[t]
        held, n, bad, best, first = Counter(), 0, 0, 0, 0
        for place, word in at:
            held[word] += 1
            n += word in own and held[word] == 1
            bad += word in never
            while at[first][0] <= place - self.span[t]:
                old = at[first][1]
                held[old] -= 1
                n -= old in own and not held[old]
                bad -= old in never
                first += 1
            if n > best and n >= self.need[t] and not bad and all(any(held[w] for w in group) for group in must):
                best = n
        return best / len(own)

    def matches(self, words: list[bytes]) -> list[tuple[int, float]]:
        """(template, containment) of every template that a block of these words meets."""
        found = self.candidates(VOCABULARY.intersection(words))
        if not found:
            return []
        at = [(i, w) for i, w in enumerate(words) if w in KNOWN]
        return [(t, c) for t in found if (c := self.containment(t, at))]


def places(words: list[bytes]) -> tuple[list[int], set[str]]:
    """Word numbers at which a phrase starts, and the phrases' labels."""
    text, at, labels = b" " + b" ".join(words) + b" ", [], set()
    for phrase, label in _PHRASE:
        i = text.find(b" " + phrase + b" ")
        done, number = 0, -1
        while i >= 0:
            number += text.count(b" ", done, i + 1)
            at.append(number)
            labels.add(label)
            done = i + 1
            i = text.find(b" " + phrase + b" ", i + 1)
    return at, labels


def scan_text(text: str | None, index: Index):
    """n_words, phrase places, base labels, all labels, score."""
    data = _bytes(text)
    words, labels, best = [], set(), 0.0
    for paragraph in _BLANK.split(data) if b"\n\n" in data or _BLANK.search(data) else [data]:
        own = words_of(paragraph)
        words += own
        for t, c in index.matches(own):
            labels.add(TEMPLATES[t].label)
            best = max(best, c)
    at, base = places(words)
    return len(words), at, base, labels | base, 1.0 if base else best


def scan(docs: DataFrame, share: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    small_batches(docs.sparkSession)
    chosen = docs.select("doc_id", "text")
    frequency = frequencies(docs)
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def run(batches):
        index = Index(frequency, share)
        for b in batches:
            rows = []
            for t in b.column(1):
                n, at, base, labels, score = scan_text(t.as_py(), index)
                rows.append((n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return chosen.mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
