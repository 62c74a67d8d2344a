"""License scans: an exact set-similarity join between license templates and text blocks.

A template is the set of its words. Text blocks are the lines of a document of at most `LINE_WORDS` words, and its runs of
as many words as a template has, divided by `threshold`, at each place and across line ends. A block matches a template
if it holds at least `threshold` of the template's words. Words are ordered by how many lines of the whole corpus hold
them, rarest first; a block can only match if it shares one of the template's first |T| - ceil(threshold |T|) + 1 words
(prefix filter), has enough distinct words (length filter), and enough words from the shared one on (positional filter).
Survivors are counted exactly. A document's runs pass the filters together, as one block that holds them all. A run must
also hold `threshold` of the template in its order, as words of neighbouring lines are no notice by themselves.

Overlapping runs that match are one block, with the most that one of them holds, at the line of its first template word.
It is left out if a line that it touches matches as a block and holds as much.

Beside this, phrases of known licenses are found word for word. Defined results: null or empty text has no words, no
places and no labels; repeated rows give repeated results; other columns of the input are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The phrases that the scan must report, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Notices by which well-known licenses are recognised.
TEMPLATES = {
    "mit": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0"],
    "cc-by-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
}
THRESHOLD = 0.8
#: Words up to which a line is a block of its own; longer ones are seen by runs only.
LINE_WORDS = 128
_WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_BLOCK_BYTES = bytes(10 if c == 10 else _WORD_BYTES[c] for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of other characters than ASCII, with A-Z lower-cased."""
    return text.translate(_WORD_BYTES).split()


def phrase_places(found: list[bytes], phrases: dict[str, str]) -> list[tuple[int, str]]:
    """(start word, label) wherever a phrase's words stand consecutively."""
    out = []
    for phrase, label in phrases.items():
        want = phrase.encode().split()
        at = -1
        while True:
            try:
                at = found.index(want[0], at + 1)
            except ValueError:
                break
            if found[at : at + len(want)] == want:
                out.append((at, label))
    return sorted(out)


def template_sets(templates: dict[str, list[str]]) -> list[tuple[str, frozenset[bytes]]]:
    return [(label, frozenset(words(t.encode()))) for label, texts in templates.items() for t in texts]


class Shape:
    """A template's words in their order, and how many words the runs have that it is looked for in."""

    def __init__(self, text: str, threshold: float):
        self.order = words(text.encode())
        self.length = math.floor(len(self.order) / threshold + 1e-9)
        self.need = math.ceil(threshold * len(self.order) - 1e-9)
        self.masks: dict[bytes, int] = {}
        for i, w in enumerate(self.order):
            self.masks[w] = self.masks.get(w, 0) | 1 << i

    def in_order(self, run: list[bytes]) -> int:
        """Length of the longest common subsequence of a run and the template; each bit left is a word that lacks."""
        full = (1 << len(self.order)) - 1
        left = full
        for w in run:
            both = left & self.masks.get(w, 0)
            left = ((left + both) | (left - both)) & full
        return len(self.order) - left.bit_count()


def shapes_of(templates: dict[str, list[str]], threshold: float) -> list[Shape]:
    """In the order of template_sets."""
    return [Shape(t, threshold) for texts in templates.values() for t in texts]


def runs(found: list[bytes], shape: Shape, need: int) -> list[tuple[int, int, int]]:
    """(first word, last word, most distinct template words) of overlapping runs that hold at least `need` of them, and
    enough of the template in its order."""
    places = [i for i, w in enumerate(found) if w in shape.masks]
    out: list[tuple[int, int, int]] = []
    held: Counter[bytes] = Counter()
    first = 0
    for at in places:
        held[found[at]] += 1
        while at - places[first] >= shape.length:
            w = found[places[first]]
            held[w] -= 1
            if not held[w]:
                del held[w]
            first += 1
        if len(held) >= need and shape.in_order(found[places[first] : at + 1]) >= shape.need:
            if out and places[first] <= out[-1][1]:
                out[-1] = (out[-1][0], at, max(out[-1][2], len(held)))
            else:
                out.append((places[first], at, len(held)))
    return out


def word_frequencies(df: DataFrame, text_col: str, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many blocks of the whole corpus each template word stands; as many rows as templates have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                if raw:
                    for block in raw.translate(_BLOCK_BYTES).split(b"\n"):
                        seen.update(vocabulary.intersection(block.split()))
        yield pa.RecordBatch.from_pydict({"word": list(seen.keys()), "n": list(seen.values())}, schema=pa.schema([("word", pa.binary()), ("n", pa.int64())]))

    counts = df.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "word binary, n long")
    return {bytes(r["word"]): r["n"] for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}


class TemplateIndex:
    """Templates by the words of their prefixes, under one global order of words."""

    def __init__(self, templates: list[tuple[str, frozenset[bytes]]], frequency: dict[bytes, int], threshold: float):
        self.templates = templates
        vocabulary = sorted(frozenset().union(*(t for _, t in templates)), key=lambda w: (frequency.get(w, 0), w)) if templates else []
        self.rank = {w: i for i, w in enumerate(vocabulary)}
        self.need = [math.ceil(threshold * len(t) - 1e-9) for _, t in templates]
        self.by_word: dict[bytes, list[tuple[int, int]]] = {}
        for k, (_, t) in enumerate(templates):
            for place, w in enumerate(sorted(t, key=self.rank.__getitem__)[: len(t) - self.need[k] + 1]):
                self.by_word.setdefault(w, []).append((k, place))
        self.prefix_words = frozenset(self.by_word)

    def match(self, block: list[bytes]) -> list[tuple[int, float]]:
        """(template, containment) of every template that the block holds enough of."""
        have = frozenset(block)
        shared = have & self.prefix_words
        if not shared:
            return []
        known = sorted((self.rank[w] for w in have if w in self.rank))
        tried, out = set(), []
        for w in sorted(shared, key=self.rank.__getitem__):
            left = sum(r >= self.rank[w] for r in known)
            for k, place in self.by_word[w]:
                if k in tried:
                    continue
                tried.add(k)
                size = len(self.templates[k][1])
                if len(have) < self.need[k] or min(left, size - place) < self.need[k]:
                    continue
                both = len(have & self.templates[k][1])
                if both >= self.need[k]:
                    out.append((k, both / size))
        return out

    def blocks(self, raw: bytes, found: list[bytes], shapes: list[Shape]) -> list[tuple[int, int, float]]:
        """(line, template, containment) of the blocks of a text that match; found are its words."""
        whole = self.match(found)
        if not whole:
            return []
        lines = [line.split() for line in raw.translate(_BLOCK_BYTES).split(b"\n")]
        ends = list(accumulate(map(len, lines)))
        out = [(n, k, c) for n, line in enumerate(lines) if len(line) <= LINE_WORDS for k, c in self.match(line)]
        held = {(n, k): c for n, k, c in out}
        for k, _ in whole:
            size = len(self.templates[k][1])
            for first, last, most in runs(found, shapes[k], self.need[k]):
                low, high = bisect_right(ends, first), bisect_right(ends, last)
                if all(held.get((n, k), 0.0) < most / size for n in range(low, high + 1)):
                    out.append((low, k, most / size))
        return sorted(out)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: word count, phrase places, matched blocks (line, label, containment) and a score."""
    sets, shapes = template_sets(templates), shapes_of(templates, threshold)
    index = TemplateIndex(sets, word_frequencies(df, text_col, frozenset().union(*(t for _, t in sets))), threshold)
    quick = sorted({p.encode().split()[-1] for p in phrases})
    place = pa.struct([("word", pa.int64()), ("label", pa.string())])
    block = pa.struct([("line", pa.int64()), ("label", pa.string()), ("containment", pa.float64())])
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("places", pa.list_(place)), ("blocks", pa.list_(block))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"id": batch.column(0).to_pylist(), "n_words": [], "places": [], "blocks": []}
            for raw in batch.column(1).to_pylist():
                found = words(raw) if raw else []
                out["n_words"].append(len(found))
                here = phrase_places(found, phrases) if any(q in found for q in quick) else []
                out["places"].append([{"word": w, "label": label} for w, label in here])
                blocks = []
                if found and not index.prefix_words.isdisjoint(found):
                    blocks = [{"line": n, "label": sets[k][0], "containment": c} for n, k, c in index.blocks(raw, found, shapes)]
                out["blocks"].append(blocks)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "id long, n_words long, places array<struct<word:long,label:string>>, blocks array<struct<line:long,label:string,containment:double>>")


def op9(df: DataFrame) -> DataFrame:
    """The digest columns of the license contract."""
    found = scan(df)
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    every = F.array_sort(F.array_union(F.col("places.label"), F.col("blocks.label")))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.coalesce(F.array_max("blocks.containment"), F.lit(0.0)).alias("score"),
    )
