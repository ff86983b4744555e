"""License scans: exact phrases, and an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches, text_bytes

#: The phrases whose places are counted, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Public licenses, whole or their usual notices, with their labels.
TEMPLATES = (
    ("Licensed under the Apache License, Version 2.0", "apache"),
    ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis", "apache"),
    ("Released under the MIT License", "mit"),
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. "
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection "
        "with the Software or the use or other dealings in the Software.",
        "mit",
    ),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. "
        "In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, "
        "whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software.",
        "isc",
    ),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. "
        "In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; "
        "loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) "
        "arising in any way out of the use of this software, even if advised of the possibility of such damage.",
        "bsd",
    ),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    (
        "This software is provided as is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        "zlib",
    ),
    ("This work is licensed under the GNU General Public License, version 3", "gpl"),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. See the GNU General Public License for more details.",
        "gpl",
    ),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl"),
    (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "unlicense",
    ),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
)
#: Least share of a template's distinct words that a block must hold.
CONTAINMENT = Fraction(9, 10)
#: A template is looked for in blocks of consecutive words, a half longer than itself; they begin at every word.
SLACK = Fraction(3, 2)

#: A-Z become a-z; 0-9, a-z and bytes of other than ASCII characters stay; the rest parts words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


class TemplateIndex:
    """Templates as sets of words from rare to common, indexed by their prefixes, with the length of their blocks."""

    def __init__(self, templates: tuple[tuple[str, str], ...], frequency: dict[bytes, int], threshold: Fraction) -> None:
        words = [words_of(t.encode()) for t, _ in templates]
        self.rank = {w: r for r, w in enumerate(sorted({w for t in words for w in t}, key=lambda w: (frequency.get(w, 0), w)))}
        self.labels = [label for _, label in templates]
        self.sets = [sorted({self.rank[w] for w in t}) for t in words]
        self.members = [frozenset(s) for s in self.sets]
        self.block = [int(-(-SLACK * len(t) // 1)) for t in words]
        self.need = [max(1, -(-threshold.numerator * len(s) // threshold.denominator)) for s in self.sets]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for t, ranks in enumerate(self.sets):
            for at, r in enumerate(ranks[: len(ranks) - self.need[t] + 1]):
                self.prefix.setdefault(r, []).append((t, at))

    def _candidates(self, places: list[tuple[int, int]]) -> dict[int, list[list[int]]]:
        """Stretches of words, by template, outside of which none of its blocks can hold enough.

        A block that holds enough holds a word of the template's prefix, so it lies within a block's length of one.
        A stretch is a list: first and last word, and the rarest of its prefix words with the place in the template's order.
        """
        stretches: dict[int, list[list[int]]] = {}
        for at, r in places:
            for t, i in self.prefix.get(r, ()):
                first, last = at - self.block[t] + 1, at + self.block[t] - 1
                found = stretches.setdefault(t, [])
                if found and found[-1][1] >= first:
                    found[-1][1] = last
                    if r < found[-1][2]:
                        found[-1][2:] = r, i
                else:
                    found.append([first, last, r, i])
        return stretches

    def matches(self, places: list[tuple[int, int]], n_words: int) -> list[tuple[int, int, int, int]]:
        """(template, first, last, most): every longest run of blocks, by their first words, that hold enough of a template, and the most words shared.

        ``places`` are the (place, rank) of the text's template words. A block at the text's end, or of a short text, is
        the text's last words.
        """
        where = [at for at, _ in places]
        out = []
        for t, stretches in self._candidates(places).items():
            size, need, member = self.block[t], self.need[t], self.members[t]
            latest = max(0, n_words - size)
            for first, last, rarest, i in stretches:
                around = places[bisect_left(where, first) : bisect_right(where, last)]
                if len(around) < need:  # length filter
                    continue
                ranks = sorted({r for _, r in around})
                # positional filter: what both orders have from their first common word on
                if min(len(self.sets[t]) - i, len(ranks) - bisect_left(ranks, rarest)) < need:
                    continue
                inside = [p for p in around if p[1] in member]
                if len({r for _, r in inside}) < need:
                    continue
                out += [(t, *run) for run in _runs(inside, size, need, latest)]
        return sorted(out)


def _runs(inside: list[tuple[int, int]], size: int, need: int, latest: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, most) of the longest runs of starts from 0 to ``latest`` whose ``size`` words hold ``need`` distinct ranks.

    The count changes only where a word comes in at the block's end or leaves at its start.
    """
    changes: dict[int, list[tuple[int, int]]] = {}
    for at, r in inside:
        changes.setdefault(min(latest, max(0, at - size + 1)), []).append((r, 1))
        if at + 1 <= latest:
            changes.setdefault(at + 1, []).append((r, -1))
    count: dict[int, int] = {}
    begun = most = None
    distinct = 0
    for start in sorted(changes):
        for r, step in changes[start]:
            before = count.get(r, 0)
            count[r] = before + step
            distinct += (before + step > 0) - (before > 0)
        if distinct >= need:
            begun, most = (start, distinct) if begun is None else (begun, max(most, distinct))
        elif begun is not None:
            yield begun, start - 1, most
            begun = None
    if begun is not None:
        yield begun, latest, most


def word_frequencies(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, text_col: str = "text") -> dict[bytes, int]:
    """How often each template word occurs in all documents; as many numbers as the templates have words."""
    vocabulary = {w: i for i, w in enumerate(sorted({w for t, _ in templates for w in words_of(t.encode())}))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [0] * len(vocabulary)
        for batch in batches:
            for text in text_bytes(batch.column(0)):
                for w, count in Counter(words_of(text)).items():
                    if w in vocabulary:
                        n[vocabulary[w]] += count
        yield pa.RecordBatch.from_arrays([pa.array(range(len(n)), pa.int32()), pa.array(n, pa.int64())], names=["word", "n"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {r["word"]: r["n"] for r in rows}
    return {w: n.get(i, 0) for w, i in vocabulary.items()}


PLACES = "array<struct<word: bigint, label: string>>"
MATCHES = "array<struct<first: bigint, last: bigint, words: int, label: string, containment: double>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: tuple[tuple[str, str], ...] = PHRASES, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: Fraction = CONTAINMENT) -> DataFrame:
    """(doc_id, n_words, places, matches) of every row, over whole texts; null texts count as empty.

    ``places``: where a phrase's words stand consecutively, by the first one's number. ``matches``: of every template,
    the longest runs (first, last) of places where a block of ``words`` words begins that holds at least ``threshold`` of
    the template's distinct words, and the most that a block of the run holds. Templates may have any length. Repeated
    rows stay, an empty table gives an empty one, other columns are ignored.
    """
    index = TemplateIndex(templates, word_frequencies(docs, templates, text_col), threshold)
    first: dict[bytes, list[tuple[list[bytes], str]]] = {}
    for phrase, label in phrases:
        first.setdefault(words_of(phrase.encode())[0], []).append((words_of(phrase.encode()), label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, places, matches = [], [], []
            for text in text_bytes(batch.column(1)):
                words = words_of(text)
                n_words.append(len(words))
                places.append([{"word": i, "label": label} for i, w in enumerate(words) if w in first for phrase, label in first[w] if words[i : i + len(phrase)] == phrase])
                rank = index.rank
                spots = [(i, rank[w]) for i, w in enumerate(words) if w in rank]
                found = index.matches(spots, len(words))
                matches.append([{"first": a, "last": b, "words": index.block[t], "label": index.labels[t], "containment": n / len(index.sets[t])} for t, a, b, n in found])
            kinds = [pa.struct([("word", pa.int64()), ("label", pa.string())]), pa.struct([("first", pa.int64()), ("last", pa.int64()), ("words", pa.int32()), ("label", pa.string()), ("containment", pa.float64())])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(places, pa.list_(kinds[0])), pa.array(matches, pa.list_(kinds[1]))], names=["doc_id", "n_words", "places", "matches"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, places {PLACES}, matches {MATCHES}")


def digest(scanned: DataFrame) -> DataFrame:
    """The scan's places and matches as counts, ends, label lists and the best containment (0 where nothing matches)."""
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    words = F.col("places")["word"]
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        joined(F.col("places")["label"]).alias("base_labels"),
        joined(F.concat(F.col("places")["label"], F.col("matches")["label"])).alias("labels"),
        F.coalesce(F.array_max(F.col("matches")["containment"]), F.lit(0.0)).alias("score"),
    )
