"""Token counts from piece counts of distinct pre-tokens.

A text is cut into pre-tokens; a byte-level BPE never merges across them, so
the number of pieces of a text is the sum over its distinct pre-tokens of
(pieces of the pre-token) x (its frequency in the text).  Pieces are counted
once per distinct pre-token by the tokenizers library and joined to the
frequencies; the ids of a text never exist.

The join is done where the text lies: a task's table of distinct pre-tokens
meets the frequencies of its own documents.  A shuffle join of (document,
pre-token, frequency) rows would move several times the text.
"""

from __future__ import annotations

from collections import Counter
from operator import mul

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from shelfscope.llm.base import kept, scan, struct
from shelfscope.llm.pretokens import SLICE_BYTES, Known, split

FILE = "byte_bpe_50k.json"
LIMIT = 1024

#: Characters on whose classes the library's pattern engine and this one agree; texts with others
#: (newer Unicode, symbols of other planes) are cut by the library itself.
AGREED = regex.compile(r"[\x00-\u0557\u2000-\u2080\u3000-\ua000\uac00-\ud7a3]*+")

RESULTS = struct(n_bytes=T.LongType(), n_tokens=T.LongType())


class Library:
    """The tokenizer, once as its file says and once with the strings of special tokens as ordinary text."""

    def __init__(self, path: str):
        whole = Tokenizer.from_file(path)
        special = [t.content for t in whole.get_added_tokens_decoder().values()]
        self.borders = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.cut = whole.pre_tokenizer.pre_tokenize_str
        self.bare = Tokenizer.from_file(path)
        self.bare.encode_special_tokens = True

    def pieces(self, text: str) -> list[str]:
        if AGREED.fullmatch(text):
            return split(text)
        return [text[a:b] for _, (a, b) in self.cut(text)]

    def counts(self, pieces: list[str]) -> list[int]:
        return [len(e.ids) for e in self.bare.encode_batch_fast(pieces, add_special_tokens=False)]


def counter(path: str):
    library = kept(f"counter {path}", lambda: Library(path))
    borders, pieces = library.borders, library.pieces
    known = Known(library.counts)  # goes with the task; a worker that is idle holds the tokenizer only

    def run(texts: pa.Array) -> dict:
        frequencies, specials = [], []
        for text in texts.to_pylist():
            text = text or ""
            n = 0
            if borders and borders.search(text):
                parts = borders.split(text)
                n = len(parts) - 1
                frequency = Counter()
                for part in parts:
                    frequency.update(pieces(part))
            else:
                frequency = Counter(pieces(text))
            frequencies.append(frequency)
            specials.append(n)
        known.learn(set().union(*frequencies))
        sums = [n + sum(map(mul, map(known.__getitem__, f), f.values())) for f, n in zip(frequencies, specials, strict=True)]
        return {"n_bytes": pc.fill_null(pc.binary_length(texts), 0), "n_tokens": sums}

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Bytes and tokens of every text, as the tokenizer file ``path`` counts them.

    One row per input row, repeated rows and null ids included; other columns
    are left out.  Null and empty texts have 0 of both.  No begin, end or other
    added tokens; the strings of special tokens inside a text count as one token
    each, as the library's default is.  The file is read on each executor and
    must lie there.  No shuffle.
    """
    path = path or public_tokenizers.path(FILE)
    return scan(docs, [id_col], text_col, RESULTS, lambda: counter(path), size=SLICE_BYTES)
