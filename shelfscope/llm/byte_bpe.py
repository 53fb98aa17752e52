"""Byte-level BPE: encoding with offsets, and decoding back to the bytes.

The tokenizers library merges; it works on characters, so every byte has a
printable stand-in.  Merges are taken from a rank file: a token can be made
from any two tokens it is the concatenation of, with the rank of the result.
Texts are cut by the pattern of the rank file, and a distinct pre-token is
encoded once and remembered.
"""

from __future__ import annotations

import base64
from struct import pack

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer, models

from shelfscope.llm.base import kept, scan, struct
from shelfscope.llm.pretokens import SLICE_BYTES, Known, split

FILE = "byte_bpe_50k.tiktoken"

ENCODED = struct(ids=T.BinaryType(), n_tokens=T.LongType(), starts=T.BinaryType())
DECODED = struct(bytes=T.BinaryType(), text=T.StringType(), n_split=T.LongType())


def stand_ins() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else the next from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


SHOWN = stand_ins()
BYTE_OF = {c: b for b, c in enumerate(SHOWN)}


TO_SHOWN = dict(enumerate(SHOWN))


def shown(piece: bytes) -> str:
    return piece.decode("latin-1").translate(TO_SHOWN)


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merger(ranks: dict[bytes, int]) -> Tokenizer:
    merges = [
        (shown(token[:i]), shown(token[i:]))
        for token in sorted(ranks, key=ranks.get)
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    return Tokenizer(models.BPE(vocab={shown(t): r for t, r in ranks.items()}, merges=merges))


def packed(ids: list[int]) -> bytes:
    return pack(f"<{len(ids)}I", *ids)


def lengths_of(ranks: dict[bytes, int]) -> np.ndarray:
    """The number of bytes of every token."""
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    lengths[list(ranks.values())] = [len(t) for t in ranks]
    return lengths


class Encoder:
    def __init__(self, path: str):
        ranks = ranks_of(path)
        self.merger = merger(ranks)
        self.lengths = lengths_of(ranks)

    def encoded(self, pieces: list[str]) -> list[bytes]:
        """Ids of pre-tokens, four bytes each."""
        merged = self.merger.encode_batch_fast([shown(p.encode()) for p in pieces], add_special_tokens=False)
        return [packed(e.ids) for e in merged]

    def encode(self, texts: list[str], known: Known) -> list[bytes]:
        cut = [split(text) for text in texts]
        known.learn(set().union(*cut))
        return [b"".join(map(known.__getitem__, pieces)) for pieces in cut]

    def starts(self, ids: bytes, text: str) -> np.ndarray:
        """The character each token begins in; tokens that split a character share it."""
        lengths = self.lengths[np.frombuffer(ids, "<u4")]
        at = np.cumsum(lengths) - lengths
        if len(at) and lengths.sum() == len(text):
            return at.astype("<u4")
        first = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
        return (np.cumsum(first)[at] - 1).astype("<u4")


class Decoder:
    def __init__(self, path: str):
        ranks = ranks_of(path)
        self.lengths = lengths_of(ranks)
        self.tokens: list[bytes | None] = [None] * len(self.lengths)
        for token, rank in ranks.items():
            self.tokens[rank] = bytes(BYTE_OF[c] for c in shown(token))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, back: bool = False
) -> DataFrame:
    """Ids (little-endian unsigned 32-bit numbers) of every text, and the character each token begins in.

    With ``back`` the ids are decoded again in the same pass, into ``bytes``.
    One row per input row, repeated rows and null ids included; other columns
    are left out.  Null and empty texts have no ids.  Special tokens are not
    known: their strings are ordinary text.  No shuffle.
    """
    path = path or public_tokenizers.path(FILE)

    def make():
        codec = kept(f"encoder {path}", lambda: Encoder(path))
        known = Known(codec.encoded)  # goes with the task; a worker that is idle holds the tokenizer only
        decoder = kept(f"decoder {path}", lambda: Decoder(path)) if back else None

        def run(texts: pa.Array) -> dict:
            plain = [x or "" for x in texts.to_pylist()]
            ids = codec.encode(plain, known)
            starts = [codec.starts(i, x).tobytes() for i, x in zip(ids, plain, strict=True)]
            found = {"ids": ids, "n_tokens": [len(i) // 4 for i in ids], "starts": starts}
            return found | {"bytes": [decoder.decode(i) for i in ids]} if back else found

        return run

    results = T.StructType([*ENCODED.fields, DECODED["bytes"]]) if back else ENCODED
    return scan(docs, [id_col], text_col, results, make, size=SLICE_BYTES)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """The bytes of every list of ids, their text, and how many tokens begin inside a character.

    A list that was cut inside a character has its loose bytes in ``bytes`` and a
    replacement character for them in ``text``.  Null ids are an empty list; an
    id that is not in the file raises.  One row per input row.  No shuffle.
    """
    path = path or public_tokenizers.path(FILE)

    def make():
        codec = kept(f"decoder {path}", lambda: Decoder(path))

        def run(ids: pa.Array) -> dict:
            lists = [x or b"" for x in ids.to_pylist()]
            whole = [codec.decode(x) for x in lists]
            inside = []
            for x, data in zip(lists, whole, strict=True):
                lengths = codec.lengths[np.frombuffer(x, "<u4")]
                begins = np.frombuffer(data, np.uint8)[np.cumsum(lengths) - lengths] if len(data) else np.zeros(0, np.uint8)
                inside.append(int(((begins & 0xC0) == 0x80).sum()))
            return {"bytes": whole, "text": [x.decode("utf-8", "replace") for x in whole], "n_split": inside}

        return run

    return scan(encoded, [id_col, *(keep or [])], ids_col, DECODED, make, kind="binary", size=SLICE_BYTES)
