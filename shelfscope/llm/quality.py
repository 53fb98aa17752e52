"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths mark every word that lies inside an
n-gram found twice or more in its text; what counts is the share of the text's
characters so covered, and the share inside repeated lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from shelfscope.llm.base import scan, struct
from shelfscope.llm.spans import NOT_NEWLINE, NOT_SPACE, VALUES, Words, bytes_of, mixed, owners, per_text, rolling, runs

SYMBOLS = b"#*$%&|<>"
WINDOW = 8  # words of the base rule's windows
FEWEST_WORDS = 20
MOST_REPEATED = 30  # per cent of words inside repeated windows

#: Largest share of characters inside repeated n-grams, by n; and inside repeated lines.
COVERAGE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_COVERAGE = 0.20

RESULTS = struct(
    n_words=T.LongType(),
    word_chars=T.LongType(),
    n_symbols=T.LongType(),
    n_dup_lines=T.LongType(),
    n_repeat_words=T.LongType(),
    base_failed=T.BooleanType(),
    kept=T.BooleanType(),
    gram_coverage=T.ArrayType(T.DoubleType()),
    line_coverage=T.DoubleType(),
)


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where the key occurs twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    found = np.zeros(len(keys), bool)
    found[order[1:]] |= same
    found[order[:-1]] |= same
    return found


def later(keys: np.ndarray) -> np.ndarray:
    """True where an equal key stands earlier in the list."""
    order = np.argsort(keys, kind="stable")
    found = np.zeros(len(keys), bool)
    found[order[1:]] = keys[order][1:] == keys[order][:-1]
    return found


def of_text(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes made different between texts, so that equal keys lie in one text."""
    return mixed(hashes + mixed(owner.astype(np.uint64) + np.uint64(1)))


def covered(words: Words, n: int) -> np.ndarray:
    """True for every word inside an n-word window found twice or more in its text."""
    firsts, hashes = words.grams(n)
    firsts = firsts[repeated(of_text(hashes, words.owner[firsts]))]
    edges = np.zeros(len(words) + 1, np.int32)
    np.add.at(edges, firsts, 1)
    np.add.at(edges, firsts + n, -1)
    return np.cumsum(edges[:-1]) > 0


def measured(texts: pa.Array, coverage: dict[int, float], line_coverage: float) -> dict:
    data, at = bytes_of(texts)
    n = len(at) - 1
    characters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    words = Words(data, at, NOT_SPACE, lower=False)
    sizes = characters[words.ends] - characters[words.starts]
    n_words, word_chars = per_text(words.owner, n), per_text(words.owner, n, sizes)

    symbols = np.zeros(256, bool)
    symbols[list(SYMBOLS)] = True
    n_symbols = per_text(owners(np.flatnonzero(symbols[data]), at), n)

    # Lines that hold a word; an empty line has none, so runs of non-newlines are all of them.
    starts, ends = runs(NOT_NEWLINE[data], at)
    with_word = np.searchsorted(words.starts, starts) < np.searchsorted(words.starts, ends)
    starts, ends = starts[with_word], ends[with_word]
    line_owner = owners(starts, at)
    again = later(of_text(rolling(VALUES[data], starts, ends), line_owner))
    n_dup_lines = per_text(line_owner[again], n)
    # Characters of words inside repeated lines, from the words' own sums.
    word_sums = np.concatenate([[0], np.cumsum(sizes)])
    in_line = word_sums[np.searchsorted(words.starts, ends)] - word_sums[np.searchsorted(words.starts, starts)]
    total = np.maximum(word_chars, 1)
    line_share = np.bincount(line_owner[again], in_line[again], n) / total

    n_repeat = per_text(words.owner, n, covered(words, WINDOW))
    shares = np.stack([np.bincount(words.owner, sizes * covered(words, k), n) / total for k in coverage], axis=1) if n else np.zeros((0, len(coverage)))

    failed = (n_words < FEWEST_WORDS) | (100 * n_repeat > MOST_REPEATED * n_words)
    kept = ~failed & (shares <= np.array(list(coverage.values()))).all(axis=1) & (line_share <= line_coverage)
    flat = pa.array(shares.ravel(), pa.float64())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(coverage)), flat)
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": n_symbols,
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat,
        "base_failed": failed,
        "kept": kept,
        "gram_coverage": lists,
        "line_coverage": line_share,
    }


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    coverage: dict[int, float] | None = None,
    line_coverage: float = LINE_COVERAGE,
) -> DataFrame:
    """Counts, repetition coverage and the verdict of every text.

    One row per input row, repeated rows and null ids included; other columns
    are left out.  A null or empty text has no words, so ``base_failed`` is true
    and all counts and shares are 0.  ``gram_coverage`` follows the order of
    ``coverage`` (n-gram length -> largest share).  No shuffle.
    """
    limits = dict(COVERAGE if coverage is None else coverage)
    return scan(docs, [id_col], text_col, RESULTS, lambda: lambda texts: measured(texts, limits, line_coverage))
