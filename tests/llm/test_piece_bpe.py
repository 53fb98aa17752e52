"""Pieces and texts against the sentencepiece library."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from llm.conftest import ODD
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from shelfscope.llm import catalog, piece_bpe
from shelfscope.llm.pretokens import Known

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=public_tokenizers.path(piece_bpe.FILE))


@pytest.fixture(scope="module")
def codec():
    return piece_bpe.Vocabulary(public_tokenizers.path(piece_bpe.FILE))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_against_the_library(spark, library):
    docs = pq.read_table(f"{FOLDER}/documents.parquet").to_pydict()
    ids = library.encode([x or "" for x in docs["text"]])
    want = Counter(
        (i, len(x), sha(",".join(map(str, x))), sha(library.decode(x) if x else "")) for i, x in zip(docs["doc_id"], ids, strict=True)
    )
    rows = catalog.op11_sentencepiece(spark, FOLDER).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want


def test_odd_texts(docs_of, library):
    marks = [(20, " "), (21, "   "), (22, "▁▁a ▁ b"), (23, "<s></s><unk> <0x0A>"), (24, "=" * 5000), (25, " " * 3000), (26, "a\0b\r\n")]
    pairs = [*ODD, *marks, *[(i, x) for i, x in ODD]]
    rows = piece_bpe.encode(docs_of(pairs), back=True).collect()
    want = Counter((i, tuple(library.encode(x or "")), (x or "").replace("▁", " ")) for i, x in pairs)
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in rows) == want
    assert all(r.n_tokens == len(r.ids) for r in rows)
    assert piece_bpe.encode(docs_of([])).collect() == []


def test_random_texts(codec, library):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab =\n-▁é漢🎈theingrat") for _ in range(rng.randrange(300))) for _ in range(2000)]
    known = Known(codec.encoded)
    known.learn({w for x in texts for w in piece_bpe.WORD.findall(piece_bpe.marked(x)) if len(w) <= piece_bpe.MOST_REMEMBERED})
    assert [piece_bpe.np.frombuffer(codec.encode(x, known), "<i4").tolist() for x in texts] == library.encode(texts)


def test_heap_and_steps_agree(codec, monkeypatch):
    rng = random.Random(6)
    words = ["▁" + "".join(rng.choice("theingratosd=") for _ in range(rng.randrange(1, 40))) for _ in range(500)]
    stepwise = codec.ids_of(words)
    monkeypatch.setattr(piece_bpe, "SHORT", 1)
    assert codec.ids_of(words) == stepwise


def test_decode_any_ids(spark, library):
    rng = random.Random(1)
    lists = [[rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(262) for _ in range(rng.randrange(8))] for _ in range(3000)]
    lists += [[1, 1, 28705, 28705], [259], [0], [3 + 0xE2, 3 + 0x96, 3 + 0x81, 28705], [2]]
    encoded = spark.createDataFrame([*enumerate(lists), (-1, None)], "doc_id int, ids array<int>")
    got = {r.doc_id: r.text for r in piece_bpe.decode(encoded).collect()}
    assert got == {-1: ""} | {i: library.decode(x) for i, x in enumerate(lists)}


def test_a_difference_ends_the_job(codec, monkeypatch):
    monkeypatch.setattr(codec, "ids_of", lambda words: [b"\1\0\0\0"] * len(words))
    with pytest.raises(ValueError, match="not those of the library"):
        codec.encoded(["▁word"])


def test_decoded_is_the_text(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    back = piece_bpe.encode(docs, back=True)
    wrong = back.join(docs, "doc_id").filter(F.col("decoded") != F.translate(F.coalesce("text", F.lit("")), "▁", " "))
    assert wrong.isEmpty()
