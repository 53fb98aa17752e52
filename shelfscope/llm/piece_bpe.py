"""SentencePiece encoding and decoding for vocabularies of merges.

Blanks become the space mark and one stands before the text.  A text is cut
where no piece of the vocabulary holds the two characters next to each other:
no merge can cross such a place, so the parts are merged on their own.  The
symbols of a part begin as its characters; an agenda of adjacent pairs, highest
score first and leftmost among equals, merges them until no pair is a piece.
The agendas of many short parts are worked off side by side, one merge of each
part a step; a long part has a heap.  What is left over goes byte by byte.
Every distinct word is merged once a task's memory, and each Arrow batch of new
ones is held against the sentencepiece library; a difference ends the job.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush
from itertools import accumulate, chain, groupby, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor

from shelfscope.llm.base import kept, scan, struct
from shelfscope.llm.pretokens import SLICE_BYTES, Known

FILE = "piece_bpe_32k.model"
SPACE = "▁"  # the mark of a blank inside pieces
WORD = re.compile(f"{SPACE}+[^{SPACE}]*")
MOST_REMEMBERED = 64  # characters of a word that is remembered; longer ones are merged where they stand
SHORT = 64  # symbols of a part whose agenda is worked off beside others

ENCODED = struct(ids=T.ArrayType(T.IntegerType(), False), n_tokens=T.LongType())
DECODED = struct(text=T.StringType())


class Vocabulary:
    """Scores, ids and bytes of the pieces, and the library they come from."""

    def __init__(self, path: str):
        self.library = library = SentencePieceProcessor(model_file=path)
        numbers = range(library.vocab_size())
        names = [library.id_to_piece(i) for i in numbers]
        self.hidden = {i for i in numbers if library.is_control(i)}
        self.bytes = {int(names[i][3:5], 16): i for i in numbers if library.is_byte(i)}
        plain = [i for i in numbers if not (i in self.hidden or library.is_byte(i) or library.is_unknown(i))]
        self.ids = {names[i]: i for i in plain}
        self.scores = np.array([library.get_score(i) for i in numbers], np.float32)
        characters = {c for name in self.ids for c in name}
        if len(self.bytes) < 256 or any(library.is_unused(i) for i in plain) or not characters <= self.ids.keys():
            raise ValueError("only vocabularies with all bytes and characters and without unused pieces are read")
        if library.normalize("  a \n") != f"{SPACE * 3}a{SPACE}\n":
            raise ValueError("only vocabularies that leave characters as they are and mark the beginning are read")
        self.joins = {
            (self.ids[name[:k]], self.ids[name[k:]]): i
            for name, i in self.ids.items()
            for k in range(1, len(name))
            if name[:k] in self.ids and name[k:] in self.ids
        }
        self.width = len(names)
        keys = np.array([a * self.width + b for a, b in self.joins], np.int64)
        order = np.argsort(keys)
        self.keys, self.results = keys[order], np.array(list(self.joins.values()), np.int32)[order]
        neighbours = {(self.ids[a], self.ids[b]) for name in self.ids for a, b in pairwise(name)}
        if any(names[a] != SPACE and names[b] == SPACE for a, b in neighbours):
            raise ValueError("only vocabularies that mark blanks before words are read")
        self.neighbours = np.sort(np.array([a * self.width + b for a, b in neighbours], np.int64))
        table = np.full(max(map(ord, characters)) + 1, -1, np.int32)
        table[[ord(c) for c in characters]] = [self.ids[c] for c in characters]
        self.of_character = table
        fragments = {i: names[i].replace(SPACE, " ").encode() for i in plain}
        fragments |= {i: bytes([b]) for b, i in self.bytes.items()} | dict.fromkeys(self.hidden, b"")
        unknown = " ⁇ ".encode()
        self.fragments = [fragments.get(i, unknown) for i in numbers]
        self.is_byte = [bool(library.is_byte(i)) for i in numbers]

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece two neighbours make, or -1; unknown characters are negative and make none."""
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.results[at], -1)

    def stepwise(self, symbols: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Work off the agendas of all parts, one merge of each a step; the symbols that are left and their parts."""
        done: list = []
        pair = np.full(len(symbols), -1, np.int32)
        inside = np.flatnonzero(part[1:] == part[:-1])
        pair[inside] = self.joined(symbols[inside], symbols[inside + 1])
        while len(symbols):
            score = np.where(pair >= 0, self.scores[pair], -np.inf)
            begins = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            sizes = np.diff(np.append(begins, len(part)))
            best = np.repeat(np.maximum.reduceat(score, begins), sizes)
            open_ = best > -np.inf
            done.append((symbols[~open_], part[~open_]))
            symbols, part, pair, score, best = (x[open_] for x in (symbols, part, pair, score, best))
            if not len(symbols):
                break
            at = np.flatnonzero(score == best)
            at = at[np.concatenate([[True], part[at][1:] != part[at][:-1]])]
            symbols[at] = pair[at]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            at -= np.arange(len(at))  # where they are without the symbols merged into others
            symbols, part, pair = symbols[stay], part[stay], pair[stay]
            for place in (at, at[at > 0] - 1):  # the pairs with the next symbol and with the one before
                pair[place] = -1
                place = place[place + 1 < len(part)]
                place = place[part[place] == part[place + 1]]
                pair[place] = self.joined(symbols[place], symbols[place + 1])
        if not done:
            return symbols, part
        symbols, part = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(part, kind="stable")
        return symbols[order], part[order]

    def by_heap(self, symbols: list[int]) -> list[int]:
        """The same for one part, in time n log n."""
        n, join, score = len(symbols), self.joins.get, self.scores
        before, after, size = list(range(-1, n - 1)), list(range(1, n + 1)), [1] * n
        agenda = [
            (-score[made], i, 2, made) for i, two in enumerate(pairwise(symbols)) if (made := join(two)) is not None
        ]
        heapify(agenda)

        def propose(i: int, j: int) -> None:
            if (made := join((symbols[i], symbols[j]))) is not None:
                heappush(agenda, (-score[made], i, size[i] + size[j], made))

        while agenda:
            _, i, length, made = heappop(agenda)
            j = after[i]
            if j == n or not size[i] or size[i] + size[j] != length:
                continue  # one of the two has been merged with another since
            symbols[i], size[i], size[j] = made, length, 0
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                propose(i, k)
            if before[i] >= 0:
                propose(before[i], i)
        return [s for s, n in zip(symbols, size, strict=True) if n]

    def ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of words, four bytes each."""
        whole = "".join(words)
        points = np.frombuffer(whole.encode("utf-32-le"), "<u4").astype(np.int64)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        symbols = np.where(points < len(self.of_character), self.of_character[np.minimum(points, len(self.of_character) - 1)], -1)
        symbols = np.where(symbols < 0, -1 - points, symbols)  # an unknown character is told by its code point
        key = symbols[:-1] * self.width + symbols[1:]
        at = np.minimum(np.searchsorted(self.neighbours, key), len(self.neighbours) - 1)
        cut = (self.neighbours[at] != key) | (symbols[:-1] < 0) | (symbols[1:] < 0) | (word[1:] != word[:-1])
        part = np.concatenate([np.zeros(min(1, len(points)), np.int64), np.cumsum(cut)])
        sizes = np.bincount(part) if len(part) else np.zeros(0, np.int64)
        of_part = word[np.cumsum(sizes) - sizes] if len(part) else word
        short = (sizes <= SHORT)[part]
        pieces, parts = self.stepwise(symbols[short].astype(np.int32), part[short])
        for long in np.flatnonzero(sizes > SHORT):
            merged = np.array(self.by_heap(symbols[part == long].tolist()), np.int32)
            pieces, parts = np.concatenate([pieces, merged]), np.concatenate([parts, np.full(len(merged), long)])
        order = np.argsort(parts, kind="stable")
        pieces, owner = pieces[order], of_part[parts[order]]
        unknown = np.flatnonzero(pieces < 0)
        if len(unknown):
            as_bytes = [[self.bytes[b] for b in chr(-1 - p).encode()] for p in pieces[unknown].tolist()]
            times = np.ones(len(pieces), np.int64)
            times[unknown] = [len(x) for x in as_bytes]
            pieces, owner = np.repeat(pieces, times), np.repeat(owner, times)
            pieces[pieces < 0] = list(chain.from_iterable(as_bytes))
        ends = np.cumsum(np.bincount(owner, minlength=len(words))) * 4
        data = pieces.astype("<i4").tobytes()
        return [data[a:b] for a, b in pairwise([0, *ends.tolist()])]

    def encoded(self, words: list[str]) -> list[bytes]:
        """Ids of words, agreed with the library; the mark before a word is the one it puts there."""
        found = self.ids_of(words)
        alone = [self.ids[SPACE]]  # a mark by itself; the library puts none before an empty text
        theirs = [x or alone for x in self.library.encode([word[1:] for word in words], num_threads=1)]
        sizes = np.fromiter(map(len, theirs), np.int64) * 4
        same = b"".join(found) == np.fromiter(chain.from_iterable(theirs), "<i4").tobytes()
        if not same or (sizes != np.fromiter(map(len, found), np.int64)).any():
            odd = next(w for w, a, b in zip(words, found, theirs, strict=True) if np.frombuffer(a, "<i4").tolist() != b)
            raise ValueError(f"the pieces of {odd[:200]!r} are not those of the library")
        return found

    def encode(self, text: str, known: Known) -> bytes:
        words = WORD.findall(marked(text))
        return b"".join([known[w] if len(w) <= MOST_REMEMBERED else self.encoded([w])[0] for w in words])

    def decode(self, ids: list[int]) -> str:
        """The text of any list of ids: the blank before the first visible piece goes, loose bytes become U+FFFD each."""
        whole = b"".join(map(self.fragments.__getitem__, ids))
        if not self.hidden.isdisjoint(ids):  # bytes on both sides of a hidden piece are no character together
            runs = [list(run) for hidden, run in groupby(ids, self.hidden.__contains__) if not hidden]
            return "".join(self.decode(run) if i == 0 else self.decode([self.ids[SPACE], *run]) for i, run in enumerate(runs))
        if ids and not self.is_byte[ids[0]] and self.library.id_to_piece(ids[0]).startswith(SPACE):
            whole = whole[1:]
        try:
            return whole.decode()
        except UnicodeDecodeError:
            return each_byte(whole)


def each_byte(data: bytes) -> str:
    """UTF-8 with one replacement character for each byte that belongs to no character."""
    found, rest = [], data
    while rest:
        try:
            found.append(rest.decode())
            break
        except UnicodeDecodeError as problem:
            found.append(rest[: problem.start].decode() + "�")
            rest = rest[problem.start + 1 :]
    return "".join(found)


def marked(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def lists(rows: list[bytes]) -> pa.ListArray:
    """Lists of ids from their bytes."""
    offsets = np.array([0, *accumulate(len(x) // 4 for x in rows)], np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), "<i4")))


def vocabulary(path: str) -> Vocabulary:
    return kept(f"pieces {path}", lambda: Vocabulary(path))


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, back: bool = False
) -> DataFrame:
    """``ids`` and ``n_tokens`` of every text, and with ``back`` the text ``decoded`` from the ids again.

    No begin or end ids; strings of special pieces in a text are ordinary text.
    One row per input row, repeated rows and null ids included; other columns
    are left out, so their names do not matter.  Null and empty texts have no
    ids.  A space mark in a text is a blank after decoding.  Texts are worked on
    in slices; a single part without any place to cut takes some hundred bytes
    of memory a character.  No shuffle.
    """
    path = path or public_tokenizers.path(FILE)

    def make():
        codec = vocabulary(path)
        known = Known(codec.encoded)

        def run(texts: pa.Array) -> dict:
            plain = [x or "" for x in texts.to_pylist()]
            known.learn({w for x in plain for w in set(WORD.findall(marked(x))) if len(w) <= MOST_REMEMBERED})
            rows = [codec.encode(x, known) for x in plain]
            found = {"ids": lists(rows), "n_tokens": [len(x) // 4 for x in rows]}
            return found | {"decoded": [codec.decode(np.frombuffer(x, "<i4").tolist()) for x in rows]} if back else found

        return run

    results = T.StructType([*ENCODED.fields, T.StructField("decoded", T.StringType())]) if back else ENCODED
    return scan(docs, [id_col], text_col, results, make, size=SLICE_BYTES)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """The id and the ``text`` of every list of ids; ids of control pieces give nothing, a null list an empty text.

    A character whose bytes are not all there comes out as one replacement
    character a byte.  An id outside the vocabulary, or a null one, raises.  One
    row per input row.  No shuffle.
    """
    path = path or public_tokenizers.path(FILE)
    schema = T.StructType([encoded.schema[id_col], *DECODED.fields])

    def work(batches):
        codec = vocabulary(path)
        for batch in batches:
            texts = [codec.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(work, schema)
