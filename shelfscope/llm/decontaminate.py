"""Benchmark decontamination by pigeonhole: an item that occurs with at most k edits holds one of k + 1 pieces unchanged.

Every item is split into its error budget plus one pieces.  An automaton over
all pieces finds their exact occurrences in a text, and around each the item is
compared by Myers' bit-parallel edit distance, one machine-independent integer
per column.
"""

from __future__ import annotations

import math
from collections import defaultdict
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfscope.llm.base import free, scan, struct

ERROR_RATE = 0.05  # edits allowed per character of an item
BLOCK_CHARS = 2_000_000  # characters of items that are sought in one pass over the texts

UNSPACED = "\u2e80"  # scripts from here on are written without spaces

#: Case and the kind of white space are not compared; offsets stay those of the text.
FOLDED = {**{c: c + 32 for c in range(65, 91)}, **{c: 32 for c in (9, 10, 11, 12, 13, 0xA0)}}

MATCHES = T.ArrayType(struct(item_id=T.LongType(), distance=T.IntegerType(), start=T.LongType(), end=T.LongType()))


def within_word(text: str, at: int) -> bool:
    """Whether a place lies between two letters or digits of one word; scripts that set no spaces have no such places."""
    return 0 < at < len(text) and all(c.isalnum() and c < UNSPACED for c in text[at - 1 : at + 1])


class Match(NamedTuple):
    item_id: int
    distance: int
    start: int
    end: int


def masks_of(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    return masks


def columns(masks: dict[str, int], m: int, text: str, anchored: bool):
    """The edit distance of the whole pattern to the text up to each place: from its begin if anchored, else from the best place."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    for c in text:
        equal = masks.get(c, 0)
        vertical = equal | down
        horizontal = (((equal & up) + up) ^ up) | equal
        more = down | (full & ~(horizontal | up))
        less = up & horizontal
        score += bool(more & high) - bool(less & high)
        more = (more << 1 | anchored) & full
        less = less << 1 & full
        up = less | (full & ~(vertical | more))
        down = more & vertical
        yield score


class Item:
    def __init__(self, item_id: int, text: str, error_rate: float):
        self.id, self.text = item_id, text.translate(FOLDED)
        self.budget = math.floor(error_rate * len(text))
        self.masks, self.back = masks_of(self.text), masks_of(self.text[::-1])

    def pieces(self) -> list[tuple[str, int]]:
        """Budget plus one pieces of nearly equal length, with their offsets."""
        parts = self.budget + 1
        borders = [i * len(self.text) // parts for i in range(parts + 1)]
        return [(self.text[a:b], a) for a, b in zip(borders, borders[1:], strict=False)]

    def near(self, text: str, start: int) -> Match | None:
        """The best occurrence that begins within the budget of ``start``."""
        m, k = len(self.text), self.budget
        if text.startswith(self.text, start):
            inside = not k and (within_word(text, start) or within_word(text, start + m))
            return None if inside else Match(self.id, 0, start, start + m)
        if not k:
            return None
        low = max(0, start - k)
        window = text[low : start + m + k]
        scores = list(columns(self.masks, m, window, anchored=False))
        best = min(scores, default=k + 1)
        if best > k:
            return None
        end = scores.index(best) + 1
        back = list(columns(self.back, m, window[:end][::-1], anchored=True))
        return Match(self.id, best, low + end - 1 - back.index(best), low + end)


class Finder:
    def __init__(self, rows: list[tuple[int, str]], error_rate: float):
        self.items = [Item(i, t, error_rate) for i, t in rows]
        filed = defaultdict(list)
        for item in self.items:
            for piece, offset in item.pieces():
                filed[piece].append((item, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in filed.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def matches(self, text: str) -> list[Match]:
        """All occurrences found; those of one item do not overlap."""
        text = text.translate(FOLDED)
        looked: dict[int, set[int]] = defaultdict(set)
        found: dict[int, list[Match]] = defaultdict(list)
        for last, (size, places) in self.automaton.iter(text):
            for item, offset in places:
                start = last + 1 - size - offset
                if start in looked[item.id] or start < -item.budget:
                    continue
                looked[item.id].add(start)
                if found[item.id] and found[item.id][-1].start <= start + offset < found[item.id][-1].end:
                    continue  # a further piece of what was found
                match = item.near(text, max(0, start))
                if match and (not found[item.id] or match.start >= found[item.id][-1].end):
                    found[item.id].append(match)
        return sorted((m for matches in found.values() for m in matches), key=lambda m: (m.start, m.item_id))


def blocks(items: DataFrame, item_id: str, item_text: str, size: int) -> list[list[tuple[int, str]]]:
    """The items in blocks of about ``size`` characters, brought over one at a time as each is used."""
    items = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("words")).filter(
        F.col("id").isNotNull() & (F.length("words") > 0)
    )
    total = items.agg(F.sum(F.length("words"))).first()[0] or 0
    n = max(1, math.ceil(total / size))
    for b in range(n if total else 0):
        part = items.filter(F.pmod(F.xxhash64("id", "words"), F.lit(n)) == b).distinct()
        yield sorted((r.id, r.words) for r in part.collect())


def benchmark_matches(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    error_rate: float = ERROR_RATE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``id``, ``item_id``, ``distance``, ``start``, ``end`` (code points, end exclusive) of every occurrence of an item.

    An item of n characters may have floor(error_rate * n) insertions, deletions
    and substitutions; case and the kind of white space do not count.  An item
    too short for any edit must begin and end where words do ("yes" is not in
    "eyesight").  Items
    without an id or text are passed over, as are null and empty texts; repeated
    rows give repeated results, repeated items do not.  Items go to the tasks in
    blocks of bounded size, with a pass over the texts for each; texts are never
    shuffled.
    """
    found = None
    for rows in blocks(items, item_id, item_text, block_chars):
        part = _scanned(docs, [id_col], text_col, rows, error_rate)
        part = part.select(F.col(id_col), F.explode("__matches").alias("m")).select(F.col(id_col), "m.*")
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = _scanned(docs, [id_col], text_col, [], error_rate)
        found = found.select(F.col(id_col), F.explode("__matches").alias("m")).select(F.col(id_col), "m.*")
    return found


def _scanned(docs: DataFrame, keep: list[str], text_col: str, rows: list[tuple[int, str]], error_rate: float, name: str = "__matches") -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(rows)

    def make():
        if not sent.value:
            return lambda texts: {"__matches": [[] for _ in range(len(texts))]}
        finder = Finder(sent.value, error_rate)

        def run(texts: pa.Array) -> dict:
            return {name: [[m._asdict() for m in finder.matches(t)] if t else [] for t in texts.to_pylist()]}

        return run

    return scan(docs, keep, text_col, struct(**{name: MATCHES}), make)


def without_benchmarks(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", error_rate: float = ERROR_RATE
) -> DataFrame:
    """The rows whose texts hold no item, all columns as they were; null and empty texts stay."""
    kept, matches = docs, free("__matches", docs.columns)
    for rows in blocks(items, item_id, item_text, BLOCK_CHARS):
        kept = _scanned(kept, docs.columns, text_col, rows, error_rate, matches).filter(F.size(matches) == 0).drop(matches)
    return kept
