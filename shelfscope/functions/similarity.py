"""Title similarity: token-sort ratio, token Jaccard, longest common subsequence."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The function below travels to the executors with its code, so they need no
# copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD = 64  # characters in one machine word
CELLS = 4_000_000  # cells of the grids worked on at once


def tokens(title: Column) -> Column:
    """Words of a normalised title; none for an empty one."""
    return F.filter(F.split(title, " ", -1), lambda w: w != "")


def sorted_tokens(title: Column) -> Column:
    """The words of a title in sorted order, joined again."""
    return F.array_join(F.array_sort(tokens(title)), " ")


def token_set(title: Column) -> Column:
    """The distinct words of a title in sorted order, joined again."""
    return F.array_join(F.array_sort(F.array_distinct(tokens(title))), " ")


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _advance(short: list[np.ndarray], long: list[np.ndarray]) -> np.ndarray:
    """Common subsequence lengths of pairs of like sizes, all advancing together one character of ``long`` at a time."""
    rows = np.arange(len(short))
    sizes = np.array([len(s) for s in short])
    codes, coded = np.unique(np.concatenate(short), return_inverse=True)
    words = -(-int(sizes.max()) // WORD)
    if len(short) > 1 and len(short) * (len(codes) * words + max(map(len, long))) > CELLS:
        half = len(short) // 2
        return np.concatenate([_advance(short[:half], long[:half]), _advance(short[half:], long[half:])])
    # Bit i of a character's row: the short text has it at place i.
    places = np.zeros((words, len(short), len(codes) + 1), np.uint64)
    at = np.concatenate([np.arange(n) for n in sizes])
    np.bitwise_or.at(places, (at // WORD, np.repeat(rows, sizes), coded + 1), np.uint64(1) << (at % WORD).astype(np.uint64))
    grid = np.zeros((max(map(len, long)), len(short)), np.int64)  # 0 matches nothing
    for row, text in enumerate(long):
        place = np.minimum(np.searchsorted(codes, text), len(codes) - 1)
        grid[: len(text), row] = np.where(codes[place] == text, place + 1, 0)
    open_bits = np.full((words, len(short)), ~np.uint64(0))
    for column in grid:
        carry = np.zeros(len(short), np.uint64)
        for w in range(words):
            bits = open_bits[w]
            hit = bits & places[w][rows, column]
            total = bits + hit
            over = total < bits
            total += carry
            carry = (over | (total < carry)).astype(np.uint64)
            open_bits[w] = total | (bits - hit)
    return np.bitwise_count(~open_bits).sum(axis=0).astype(np.int64)


def lcs_lengths(left: pd.Series, right: pd.Series) -> np.ndarray:
    """Length of the longest common subsequence of each pair, a batch at a time.

    Bit-parallel dynamic programming over as many machine words as the shorter
    text of a pair needs.  Pairs are put together by length, so that a long text
    makes no grid of its length for the short ones of its batch.
    """
    pairs = [sorted((_code_points(a), _code_points(b)), key=len) for a, b in zip(left, right, strict=True)]
    order = sorted((i for i, (a, _) in enumerate(pairs) if len(a)), key=lambda i: (-(-len(pairs[i][0]) // WORD), len(pairs[i][1])))
    out = np.zeros(len(pairs), np.int64)
    begin = 0
    while begin < len(order):
        words = -(-len(pairs[order[begin]][0]) // WORD)
        most = 2 * len(pairs[order[begin]][1])
        end = begin + 1
        while end < len(order) and -(-len(pairs[order[end]][0]) // WORD) == words and len(pairs[order[end]][1]) <= most:
            end += 1
        group = order[begin:end]
        out[group] = _advance([pairs[i][0] for i in group], [pairs[i][1] for i in group])
        begin = end
    return out


@F.pandas_udf(T.LongType())
def lcs_length(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(lcs_lengths(left, right))


def ratio_reaches(lcs: Column, left: Column, right: Column, threshold: int) -> Column:
    """Whether 100 * 2 * lcs / (|left| + |right|) >= threshold, in integers."""
    return 200 * lcs >= threshold * (F.length(left) + F.length(right))


def token_sort_ratio(left: Column, right: Column) -> Column:
    """Similarity 0..100 of two token-sorted titles; two empty ones score 100."""
    total = F.length(left) + F.length(right)
    return F.when(total == 0, F.lit(100.0)).otherwise(200.0 * lcs_length(left, right) / total)


def token_jaccard(left: Column, right: Column) -> Column:
    """100 * common / all distinct words of two titles; 0 if either has none."""
    a, b = tokens(left), tokens(right)
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        both / F.size(F.array_union(a, b)) * 100.0
    )
