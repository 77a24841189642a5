"""License scans: phrases, and blocks of text that contain most of a license notice's words."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator, Mapping
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panolith.llm.texts import TEXTS, map_texts

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Fixed values: (label, public notice) of well-known licenses.
TEMPLATES = (
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "gpl",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    ("mit", "Released under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

#: A-Z in lower case; bytes outside words become blanks.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
#: A block is a window of so many times a notice's words, repeats included.
WINDOW = 1.5
#: Notices of a table are read by the driver and sent to the tasks, up to so many.
MOST_NOTICES = 10_000


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class NoticeJoin:
    """Exact containment join of a text's blocks with notices.

    A notice's blocks are the windows of WINDOW times its words, from every word of the text on,
    whatever lines and paragraphs they cross. Words have one global order, rarest in the corpus first.
    A block with at least need of a notice's n distinct words holds one of the first n - need + 1
    in that order (prefix). If the first that it holds stands at place p, it can hold n - p at
    most, and no more than the later words found around it (position); texts of fewer than need
    words are passed over (length). What passes is counted by sliding the window.
    """

    def __init__(self, notices: list[tuple[str, list[bytes]]], frequency: Mapping[bytes, int], threshold: float) -> None:
        self.labels = [label for label, _ in notices]
        self.words = [frozenset(words) for _, words in notices]
        self.need = [max(1, ceil(threshold * len(s) - 1e-9)) for s in self.words]
        self.window = [ceil(WINDOW * len(words)) for _, words in notices]
        self.prefix: dict[bytes, list[tuple[int, frozenset]]] = {}
        for t, s in enumerate(self.words):
            order = sorted(s, key=lambda w: (frequency.get(w, 0), w))
            for p, w in enumerate(order[: len(s) - self.need[t] + 1]):
                self.prefix.setdefault(w, []).append((t, frozenset(order[p + 1 :])))

    def anchors(self, words: list[bytes]) -> dict[int, list[int]]:
        """For each notice the places of prefix words with enough later words of the order around them."""
        out: dict[int, list[int]] = {}
        prefix = self.prefix
        if prefix.keys().isdisjoint(words):
            return out
        for i, w in enumerate(words):
            for t, later in prefix.get(w, ()):
                need, size = self.need[t], self.window[t]
                if need <= len(words) and 1 + len(later.intersection(words[max(0, i - size + 1) : i + size])) >= need:
                    out.setdefault(t, []).append(i)
        return out

    def blocks(self, words: list[bytes]) -> Iterator[tuple[int, int, int, float]]:
        """(notice, first word, end, containment) of all runs of blocks that hold a notice up to the threshold.

        Blocks that overlap are one run, from the first to the last of the notice's words in it.
        """
        for t, places in self.anchors(words).items():
            size, need, of = self.window[t], self.need[t], self.words[t]
            counts: Counter = Counter()
            held: deque[int] = deque()
            run, e = None, 0
            for i in places:
                if i - size + 1 > e:
                    counts.clear()
                    held.clear()
                    e = i - size + 1
                while e < min(len(words), i + size):
                    while held and held[0] <= e - size:
                        old = words[held.popleft()]
                        counts[old] -= 1
                        if not counts[old]:
                            del counts[old]
                    if words[e] in of:
                        held.append(e)
                        counts[words[e]] += 1
                        if len(counts) >= need:
                            share = len(counts) / len(of)
                            if run and held[0] < run[1]:
                                run = (run[0], e + 1, max(run[2], share))
                            else:
                                if run:
                                    yield t, *run
                                run = (held[0], e + 1, share)
                    e += 1
            if run:
                yield t, *run


def word_frequencies(docs: DataFrame, text: str, vocabulary: frozenset) -> dict[bytes, int]:
    """In how many documents each word of the notices stands; over all documents, whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for batch in batches:
            for s in range(0, batch.num_rows, TEXTS):
                for t in batch.column(0).slice(s, TEXTS).to_pylist():
                    if t:
                        count.update(vocabulary.intersection(words_of(t)))
        items = sorted(count.items())
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w, _ in items], pa.string()), pa.array([n for _, n in items], pa.int64())], names=["w", "n"])

    rows = docs.select(F.col(text)).mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    return {r["w"].encode(): r["n"] for r in rows}


def notices_of(templates: tuple | DataFrame) -> list[tuple[str, list[bytes]]]:
    """(label, words) of each notice that has words; a table of (label, notice) may have MOST_NOTICES rows."""
    if isinstance(templates, DataFrame):
        rows = templates.select("label", "notice").where("label IS NOT NULL AND notice IS NOT NULL").distinct().limit(MOST_NOTICES + 1).collect()
        if len(rows) > MOST_NOTICES:
            raise ValueError(f"over {MOST_NOTICES} notices; scan with parts of the table")
        templates = sorted((r["label"], r["notice"]) for r in rows)
    return [(label, words) for label, notice in templates if (words := words_of(notice))]


def scan_licenses(
    docs: DataFrame,
    phrases: Mapping[str, str] = PHRASES,
    templates: tuple | DataFrame = TEMPLATES,
    threshold: float = 0.9,
    text: str = "text",
) -> DataFrame:
    """`docs` with the license phrases and notices found in the whole `text`.

    Adds n_words, n_base (places of all phrases), first_word and last_word (least and largest
    start of one, null if none), base_labels and labels (distinct, sorted, comma-joined; labels
    has those of notices too), score (1 with a phrase, else the largest containment) and blocks
    ("label:first word:end" of every run of blocks that hold at least `threshold` of a notice's
    distinct words, comma-joined in text order). They replace input columns of these names.

    Words are runs of digits, ASCII letters (lower-cased) and non-ASCII characters, so line
    ends, blank lines and comment marks part words like blanks do. Blocks are all windows of 1.5
    times a notice's words (see `NoticeJoin`). Notices come as (label, notice) pairs or as a table of
    these two columns. Null is an empty text: 0 words, no labels, score 0. Rows are scanned each
    by itself; an empty table gives an empty result. The word order comes from all documents;
    only notices' words are counted, so what the driver gets has their number.
    """
    notices = notices_of(templates)
    vocabulary = frozenset(w for _, words in notices for w in words)
    join = NoticeJoin(notices, word_frequencies(docs, text, vocabulary), threshold)
    sought = [(b" " + b" ".join(words_of(p)) + b" ", label) for p, label in phrases.items()]

    def make():
        def one(t: str | None):
            words = words_of(t or "")
            line = b" " + b" ".join(words) + b" "
            starts, base = [], set()
            for phrase, label in sought:
                at, word, counted = line.find(phrase), 0, 0
                while at >= 0:
                    word, counted = word + line.count(b" ", counted, at), at
                    starts.append(word)
                    base.add(label)
                    at = line.find(phrase, at + 1)
            found = list(join.blocks(words))
            labels = base | {join.labels[t] for t, *_ in found}
            score = 1.0 if starts else max((c for *_, c in found), default=0.0)
            spans = sorted({(a, e, join.labels[t]) for t, a, e, _ in found})
            return (
                len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)),
                score, ",".join(f"{label}:{a}:{e}" for a, e, label in spans),
            )

        return lambda texts: [list(c) for c in zip(*map(one, texts), strict=True)] if texts else [[]] * 8

    added = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks string"
    names = [c.split()[0] for c in added.split(", ")]
    return map_texts(docs.withColumn("__text", F.col(text)).drop(*names), "__text", added, make)
