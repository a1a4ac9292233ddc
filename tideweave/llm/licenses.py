"""License scans: phrase places and an exact set-similarity join of text blocks.

A block is a line of a text, or a run of words as long as the template, which
may go over line ends as wrapped notices do.  It meets a template if it contains at least
``threshold`` of the template's distinct words.  Words are ordered by how many
documents hold them (counted over all documents), rarest first.  A block that
meets a template of ``n`` words shares at least ``need = ceil(threshold * n)``
of them, so it holds one of the template's ``n - need + 1`` rarest (prefix
filter), has at least ``need`` distinct words (length filter), and the words
after the first shared one must suffice for the rest (positional filter).
What passes is counted exactly.  Templates are few and go to every worker;
documents are not shuffled.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideweave.llm.batches import arrow_map, binaries, sliced

THRESHOLD = 0.8
#: Phrases whose places are counted, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices in common use, and the labels that a matching block gets.  Notices
#: that share over the threshold of their words with another licence's are left
#: out, as containment can't tell them apart.
TEMPLATES = [
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    ("ofl", "this font software is licensed under the sil open font license version 1 1"),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
]
#: A-Z to a-z; what is neither letter, digit nor beyond ASCII to a space.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
FOLD_LINES = FOLD[:10] + b"\n" + FOLD[11:]
OUT = (
    "id long, n_words long, n_base long, first_word long, last_word long, "
    "base_labels string, labels string, score double"
)


def in_order(run: list[bytes], order: list[bytes]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(order) + 1)
    for w in run:
        last = 0
        for j, v in enumerate(order, 1):
            last, row[j] = row[j], last + 1 if w == v else max(row[j], row[j - 1])
    return row[-1]


class Templates:
    """The templates with their words in global order, and their prefixes."""

    def __init__(self, templates: list[tuple[str, str]], counts: dict[str, int], threshold: float) -> None:
        self.items: list[tuple[str, list[bytes], int]] = []
        self.orders: list[tuple[list[bytes], int]] = []
        self.by_word: dict[bytes, list[tuple[int, int]]] = {}
        for label, text in templates:
            words = sorted(set(text.split()), key=lambda w: (counts.get(w, 0), w))
            need = max(1, math.ceil(threshold * len(words) - 1e-9))
            if not words:
                continue
            k = len(self.items)
            self.items.append((label, [w.encode() for w in words], need))
            order = [w.encode() for w in text.split()]
            self.orders.append((order, math.ceil(threshold * len(order) - 1e-9)))
            for at, w in enumerate(words[: len(words) - need + 1]):
                self.by_word.setdefault(w.encode(), []).append((k, at))
        self.prefix = frozenset(self.by_word)
        self.least = min((need for _, _, need in self.items), default=0)

    def meets(self, block: set[bytes]) -> Iterator[tuple[str, float]]:
        """``(label, containment)`` of every template that the block meets."""
        if len(block) < self.least:
            return
        seen: dict[int, int] = {}
        for w in block & self.prefix:
            for k, at in self.by_word[w]:
                seen[k] = min(at, seen.get(k, at))
        for k, at in seen.items():
            label, words, need = self.items[k]
            if len(block) < need or len(words) - at < need:
                continue
            shared = sum(w in block for w in words[at:])
            if shared >= need:
                yield label, shared / len(words)

    def meets_window(self, text: list[bytes], held: set[bytes]) -> Iterator[tuple[str, float]]:
        """``(label, containment)`` of every template that a run of words meets.

        A run is as long as the template and ignores line ends; as it may join
        lines that have nothing to do with each other, the threshold must also
        be met by words in the template's order.  Only templates that the words
        of the whole text (``held``) meet are slid over it.
        """
        for k in {k for w in held & self.prefix for k, _ in self.by_word[w]}:
            label, words, need = self.items[k]
            if sum(w in held for w in words) < need:
                continue
            wanted, (order, least) = set(words), self.orders[k]
            inside: Counter[bytes] = Counter()
            run: deque[tuple[int, bytes]] = deque()
            best = 0
            for at, w in enumerate(text):
                if w not in wanted:
                    continue
                while run and run[0][0] <= at - len(order):
                    old = run.popleft()[1]
                    inside[old] -= 1
                    if not inside[old]:
                        del inside[old]
                run.append((at, w))
                inside[w] += 1
                if len(inside) >= max(need, best + 1) and in_order([w for _, w in run], order) >= least:
                    best = len(inside)
            if best >= need:
                yield label, best / len(words)


def template_words(templates: list[tuple[str, str]]) -> set[str]:
    return {w for _, text in templates for w in text.split()}


def word_counts(df: DataFrame, text_col: str, words: set[str]) -> dict[str, int]:
    """In how many documents each template word stands; over all documents.

    The result has at most as many rows as the templates have words.
    """
    wanted = frozenset(w.encode() for w in words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for part in sliced(batches, column=0):
            for raw in binaries(part.column(0)):
                counts.update(wanted.intersection(raw.translate(FOLD).split()))
        found = [w.decode() for w in counts]
        yield pa.RecordBatch.from_arrays(
            [pa.array(found, pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
        )

    each = arrow_map(df.select(F.col(text_col).cast("string").alias("text")), run, "word string, n long")
    return {r["word"]: r["n"] for r in each.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def base_places(words: list[bytes], phrases: dict[str, str]) -> tuple[list[int], set[str]]:
    """Word positions at which a phrase starts, and the labels found."""
    joined = b" " + b" ".join(words) + b" "
    places, labels = [], set()
    for phrase, label in phrases.items():
        needle = b" " + phrase.encode() + b" "
        at, spaces, done = joined.find(needle), 0, 0
        while at >= 0:
            spaces += joined.count(b" ", done, at)
            done = at
            places.append(spaces)
            labels.add(label)
            at = joined.find(needle, at + 1)
    return places, labels


def license_scan(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    templates: list[tuple[str, str]] | None = None,
    phrases: dict[str, str] | None = None,
) -> DataFrame:
    """Phrases and template matches of every row of ``df``.

    Whole texts; null is empty (no words, no labels, score 0, null positions).
    ``score`` is 1 if a phrase stands in the text, else the highest containment
    of a template in one of its blocks that reaches the threshold, else 0.
    Repeated rows and null ids pass through; an empty table gives an empty
    result; other columns of ``df`` are not read.
    """
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    index = Templates(templates, word_counts(df, text_col, template_words(templates)), threshold)
    hints = [max(p.split(), key=len).encode() for p in phrases]

    def scan(raw: bytes) -> tuple:
        folded = raw.translate(FOLD)
        words = folded.split()
        places, base = base_places(words, phrases) if any(h in folded for h in hints) else ([], set())
        labels, score = set(base), 1.0 if base else 0.0
        if not index.prefix.isdisjoint(words):
            for line in raw.translate(FOLD_LINES).split(b"\n"):
                for label, share in index.meets(set(line.split())):
                    labels.add(label)
                    score = max(score, share)
            for label, share in index.meets_window(words, set(words)):
                labels.add(label)
                score = max(score, share)
        return (
            len(words),
            len(places),
            min(places, default=None),
            max(places, default=None),
            ",".join(sorted(base)),
            ",".join(sorted(labels)),
            score,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        names = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        for part in sliced(batches):
            rows = [scan(raw) for raw in binaries(part.column(1))]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)

    kept = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(kept, run, OUT).withColumnRenamed("id", id_col)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_license_scan": op7_license_scan}
ORACLES: dict[str, str] = {}
