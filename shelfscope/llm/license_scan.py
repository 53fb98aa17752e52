"""License scans by an exact set-similarity join.

Every text block (a run of lines without a blank line between them) that holds
at least ``threshold`` of a template's distinct words is found.  A template's
words are ordered by how many blocks of the whole corpus hold them, rarest
first.  A block that reaches the threshold must hold one of the first
``n - need + 1`` of them (prefix), must have ``need`` words (length), and with
its first hit at place p only ``n - p`` words can still agree (position).
Only what passes all three is counted out.  The few words of a short template
stand somewhere in any long block; they must stand together, in a window a
quarter longer than the template.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfscope.llm.base import emitted, scan, struct
from shelfscope.llm.spans import LETTERS, VALUES, Words, bytes_of, first_of, owners, per_text, rolling

#: Phrases of the base rule and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices looked for, as their projects print them.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights '
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
    "compliance with the License. You may obtain a copy of the License at",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
}
THRESHOLD = 0.8  # share of a template's distinct words that a block must hold
SHORT = 16  # templates with fewer distinct words are sought in windows a quarter longer than they are
BLANKS = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])

RESULTS = struct(
    n_words=T.LongType(),
    n_base=T.LongType(),
    first_word=T.LongType(),
    last_word=T.LongType(),
    base_labels=T.ArrayType(T.StringType()),
    matches=T.ArrayType(struct(template=T.StringType(), containment=T.DoubleType(), start=T.LongType(), end=T.LongType())),
)


def word_bytes(text: str) -> list[bytes]:
    data, at = bytes_of(pa.array([text]))
    words = Words(data, at, LETTERS, lower=True)
    return [words.data[a:b].tobytes() for a, b in zip(words.starts, words.ends, strict=True)]


def word_hash(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return rolling(VALUES[data], ends - [len(w) for w in words], ends)


class Blocks:
    """The blocks of a slice of texts and which template words stand in them."""

    def __init__(self, texts: pa.Array, vocabulary: list[bytes]):
        data, at = bytes_of(texts)
        self.words = words = Words(data, at, LETTERS, lower=True)
        # A block begins with a text and after each line of nothing but white space.
        line_ends = np.flatnonzero(data == 10)
        empty = line_ends[1:]
        if len(line_ends):
            empty = empty[~np.logical_or.reduceat(~BLANKS[data], line_ends)[:-1]]
        self.borders = np.unique(np.concatenate([at[:-1], empty])) if len(at) > 1 else np.zeros(0, np.int64)
        self.block = owners(words.starts, self.borders) if len(self.borders) else np.zeros(0, np.int64)
        known = word_hash(vocabulary)
        order = np.argsort(known)
        place = np.searchsorted(known[order], words.hashes)
        place[place == len(known)] = 0
        self.hits = np.flatnonzero(known[order][place] == words.hashes)
        tokens = order[place[self.hits]]
        # Equal hashes are confirmed by the bytes of the words.
        right = [
            words.data[a:b].tobytes() == vocabulary[t]
            for a, b, t in zip(words.starts[self.hits], words.ends[self.hits], tokens, strict=True)
        ]
        self.hits, self.tokens = self.hits[right], tokens[right]


def densest(places: np.ndarray, tokens: np.ndarray, width: int) -> tuple[int, int, int]:
    """The most distinct tokens whose places fit into ``width``, with the first and last place of the earliest such window."""
    best, inside, distinct, left = (0, 0, 0), defaultdict(int), 0, 0
    places, tokens = places.tolist(), tokens.tolist()
    for place, token in zip(places, tokens, strict=True):
        inside[token] += 1
        distinct += inside[token] == 1
        while place - places[left] >= width:
            inside[tokens[left]] -= 1
            distinct -= not inside[tokens[left]]
            left += 1
        if distinct > best[0]:
            best = (distinct, places[left], place)
    return best


def vocabulary_of(*texts: str) -> list[bytes]:
    return sorted({w for text in texts for w in word_bytes(text)})


def block_frequencies(docs: DataFrame, text_col: str, vocabulary: list[bytes]) -> dict[bytes, int]:
    """How many blocks of all texts hold each template word: partial counts per slice, then one row per word."""
    schema = struct(token=T.IntegerType(), blocks=T.LongType())

    def count(part: pa.RecordBatch):
        found = Blocks(part.column(part.num_columns - 1), vocabulary)
        pairs = np.unique(np.stack([found.block[found.hits], found.tokens]), axis=1)
        tokens, n = np.unique(pairs[1], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int32()), pa.array(n, pa.int64())], ["token", "blocks"])

    partial = emitted(docs, [], text_col, schema, lambda: count)
    rows = partial.groupBy("token").agg(F.sum("blocks").alias("blocks")).collect()  # a row per template word at most
    return {vocabulary[r.token]: r.blocks for r in rows}


class Index:
    """Templates with their words in global order, filed under the words of their prefixes."""

    def __init__(self, templates: dict[str, str], threshold: float, frequency: dict[bytes, int], place: dict[bytes, int]):
        self.sizes, self.needs, self.filed, self.position, self.width = {}, {}, defaultdict(list), {}, {}
        for name, text in templates.items():
            ordered = sorted(set(word_bytes(text)), key=lambda w: (frequency.get(w, 0), w))
            if not ordered:
                continue
            need = max(1, math.ceil(threshold * len(ordered) - 1e-9))
            self.sizes[name], self.needs[name] = len(ordered), need
            if len(ordered) < SHORT:
                self.width[name] = len(word_bytes(text)) * 5 // 4
            self.position[name] = {place[w]: i for i, w in enumerate(ordered)}
            for w in ordered[: len(ordered) - need + 1]:
                self.filed[place[w]].append(name)

    def matches(self, tokens: set[int], n_block_words: int) -> list[tuple[str, float]]:
        found = []
        for name in sorted({name for t in tokens for name in self.filed.get(t, ())}):
            size, need, position = self.sizes[name], self.needs[name], self.position[name]
            if n_block_words < need:
                continue
            first = min(position[t] for t in tokens if t in position)
            if size - first < need:
                continue
            overlap = sum(t in position for t in tokens)
            if overlap >= need:
                found.append((name, overlap / size))
        return found


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, str] | None = None,
    threshold: float = THRESHOLD,
    phrases: dict[str, str] | None = None,
) -> DataFrame:
    """License phrases and every block that holds ``threshold`` of a template's words.

    One row per input row, repeated rows and null ids included; other columns
    are left out.  A null or empty text has no words, empty lists and null
    places.  ``matches`` has the best block per template (the best window of a
    short one; the earliest of equals): its containment and its first and last
    word (end exclusive).  Templates and phrases are
    parameters of the caller, so what is sent to the tasks has their size; the
    texts are scanned twice and never shuffled.
    """
    templates = dict(TEMPLATES if templates is None else templates)
    phrases = dict(PHRASES if phrases is None else phrases)
    vocabulary = vocabulary_of(*templates.values(), *phrases)
    place = {w: i for i, w in enumerate(vocabulary)}
    frequency = block_frequencies(docs, text_col, vocabulary)
    index = Index(templates, threshold, frequency, place)
    sought = {label: [place[w] for w in word_bytes(phrase)] for phrase, label in phrases.items()}

    def run(texts: pa.Array) -> dict:
        found = Blocks(texts, vocabulary)
        words, n = found.words, len(texts)
        begins = first_of(words.owner, n)
        token = np.full(len(words) + max(map(len, sought.values())), -1)
        token[found.hits] = found.tokens
        starts, labels = [np.zeros(0, np.int64)], defaultdict(set)
        for label, ids in sought.items():
            at = np.ones(len(words), bool)
            for k, t in enumerate(ids):
                at &= token[k : k + len(words)] == t
            at = np.flatnonzero(at)
            at = at[words.owner[at] == words.owner[np.minimum(at + len(ids) - 1, len(words) - 1)]]
            starts.append(at)
            for i in np.unique(words.owner[at]):
                labels[i].add(label)
        starts = np.sort(np.concatenate(starts))
        owner = words.owner[starts]
        n_base = per_text(owner, n)
        bounds = first_of(owner, n)
        first, last = [], []
        for i in range(n):
            none = bounds[i] == bounds[i + 1]
            first.append(None if none else int(starts[bounds[i]] - begins[i]))
            last.append(None if none else int(starts[bounds[i + 1] - 1] - begins[i]))

        best: dict[int, dict[str, tuple]] = defaultdict(dict)
        blocks = found.block[found.hits]
        edges = np.append(np.flatnonzero(np.diff(blocks, prepend=-1)), len(blocks))
        for a, b in itertools.pairwise(edges):
            block = blocks[a]
            begin, end = np.searchsorted(found.block, [block, block + 1])
            i = words.owner[begin]
            for name, share in index.matches(set(found.tokens[a:b].tolist()), end - begin):
                first_word, past = int(begin), int(end)
                if name in index.width:
                    own = np.isin(found.tokens[a:b], list(index.position[name]))
                    held, first_word, last_word = densest(found.hits[a:b][own], found.tokens[a:b][own], index.width[name])
                    if held < index.needs[name]:
                        continue
                    share, past = held / index.sizes[name], last_word + 1
                if share > best[i].get(name, (0,))[0]:
                    best[i][name] = (share, first_word - int(begins[i]), past - int(begins[i]))
        return {
            "n_words": per_text(words.owner, n),
            "n_base": n_base,
            "first_word": first,
            "last_word": last,
            "base_labels": [sorted(labels[i]) if i in labels else [] for i in range(n)],
            "matches": [
                [{"template": k, "containment": s, "start": a, "end": b} for k, (s, a, b) in sorted(best[i].items())] if i in best else []
                for i in range(n)
            ],
        }

    return scan(docs, [id_col], text_col, RESULTS, lambda: run)
