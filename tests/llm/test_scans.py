"""Operators that look at one text at a time, against brute force."""

from __future__ import annotations

import base64
import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from llm.conftest import ODD
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfscope.llm import byte_bpe, catalog, license_scan, pii, quality, token_counts

SMALL = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def texts_of(folder=SMALL):
    table = pq.read_table(f"{folder}/documents.parquet").to_pydict()
    return dict(zip(table["doc_id"], table["text"], strict=True))


@pytest.fixture(scope="module")
def texts():
    return texts_of()


def by_id(rows):
    return {r.doc_id: r for r in rows}


def some_texts(n=300, alphabet="ab ,.\n0é漢🎈'“<|endoftext|>"):
    rng = random.Random(4)
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(n)] + ["<|endoftext|>x <|endoftext|>", "It's  a\n\n b"]


def test_token_counts(spark, docs_of, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in texts.items()}
    got = catalog.op2_token_counts(spark, SMALL).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    pairs = [*ODD, *enumerate(some_texts(), 100)]
    got = token_counts.token_counts(docs_of(pairs)).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in pairs]
    assert Counter(map(tuple, got)) == Counter(want)


@pytest.fixture(scope="module")
def reference_encoder():
    ranks = {
        base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))
    }
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_the_rank_library(spark, texts, reference_encoder):
    for r in catalog.op7_byte_bpe(spark, SMALL).collect():
        ids = reference_encoder.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_byte_bpe_round_trip_offsets_and_split_characters(docs_of, reference_encoder):
    pairs = [*((i, t) for i, t in ODD if i != 8), *enumerate(some_texts(), 100)]
    encoded = byte_bpe.encode(docs_of(pairs))
    rows = encoded.collect()
    assert len(rows) == len(pairs)
    import numpy as np

    for r, (i, t) in zip(rows, pairs, strict=True):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == reference_encoder.encode_ordinary(t or "")
        assert np.frombuffer(r.starts, "<u4").tolist() == reference_encoder.decode_with_offsets(ids)[1]
    back = byte_bpe.decode(encoded).collect()
    assert [r.text for r in back] == [t or "" for _, t in pairs]
    balloon = next(r for r, (i, _) in zip(rows, pairs, strict=True) if i == 7)
    cut = encoded.filter("doc_id = 7").select("doc_id", F.expr(f"substring(ids, 1, {len(balloon.ids) - 8})").alias("ids"))
    loose = byte_bpe.decode(cut).collect()[0]
    assert dict(pairs)[7].encode().startswith(bytes(loose.bytes)) and loose.n_split > 0
    assert loose.text == bytes(loose.bytes).decode("utf-8", "replace")


def brute_quality(text):
    text = text or ""
    words = SPACE.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = [False] * len(words)
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            inside[i : i + 8] = [True] * 8
    seen, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        if SPACE.search(line):
            if line in seen:
                dup += 1
                dup_chars += sum(map(len, SPACE.findall(line)))
            seen.add(line)
    chars = sum(map(len, words))
    shares = []
    for n in quality.COVERAGE:
        grams = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        mark = [False] * len(words)
        for i in range(len(words) - n + 1):
            if grams[tuple(words[i : i + n])] > 1:
                mark[i : i + n] = [True] * n
        shares.append(sum(len(w) for w, m in zip(words, mark, strict=True) if m) / max(chars, 1))
    failed = len(words) < 20 or 100 * sum(inside) > 30 * len(words)
    kept = not failed and all(s <= m for s, m in zip(shares, quality.COVERAGE.values(), strict=True)) and dup_chars / max(chars, 1) <= 0.2
    return len(words), chars, sum(text.count(c) for c in "#*$%&|<>"), dup, sum(inside), failed, kept


def test_quality(spark, docs_of, texts):
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = catalog.op10_quality_rules(spark, SMALL).collect()
    assert {r.doc_id: tuple(r[f] for f in fields) for r in got} == {i: brute_quality(t) for i, t in texts.items()}
    pairs = [p for p in ODD if p[0] != 6]
    got = quality.quality_rules(docs_of(ODD)).filter("doc_id is null or doc_id != 6").collect()
    assert Counter((r.doc_id, *(r[f] for f in fields)) for r in got) == Counter((i, *brute_quality(t)) for i, t in pairs)


def brute_license(text):
    words = LETTERS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts, labels = [], set()
    for phrase, label in license_scan.PHRASES.items():
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                starts.append(i)
                labels.add(label)
    found = set()
    for block in re.split(r"\n[ \t\r\v\f]*(?=\n)", text or ""):
        block = LETTERS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), block))
        for name, template in license_scan.TEMPLATES.items():
            every = LETTERS.findall(template.lower())
            have, want = set(block), set(every)
            if len(want) < license_scan.SHORT and len(have & want) >= license_scan.THRESHOLD * len(want) - 1e-9:
                windows = [set(block[i : i + len(every) * 5 // 4]) for i in range(len(block))]
                have = max(windows, key=lambda w: len(w & want))
            if len(have & want) >= license_scan.THRESHOLD * len(want) - 1e-9:
                found.add((name, len(have & want) / len(want)))
    names = {n for n, _ in found}
    return (
        len(words),
        len(starts),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted(labels)),
        ",".join(sorted(labels | names)),
        round(max((s for _, s in found), default=0.0), 9),
    )


def test_license(spark, docs_of, texts):
    fields = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels"]
    got = {r.doc_id: (*(r[f] for f in fields), round(r.score, 9)) for r in catalog.op4_license_scan(spark, SMALL).collect()}
    assert got == {i: brute_license(t) for i, t in texts.items()}
    assert sum(x[1] > 0 for x in got.values()) >= 2
    odd = [
        *ODD,
        (20, "MIT LICENSE mit license\nmit\n\nlicense"),
        (21, "All\nrights\n\n\nreserved. All rights, Reserved!"),
        (22, "the mit"),
        (25, "The reserve of all birds was visited by the minister for Human rights and reserved by the chairman"),
        (26, "The MIT campus: students licensed and released under the same roof hold a license"),
        (27, "All rights\r\n \t\r\nreserved. x All rights\r\nreserved"),
        (23, "license"),
        (24, license_scan.TEMPLATES["mit-grant"].replace(" ", "\n")),
    ]
    rows = license_scan.license_scan(docs_of(odd)).collect()
    for r, (i, t) in zip(rows, odd, strict=True):
        want = brute_license(t)
        assert (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, ",".join(r.base_labels)) == (i, *want[:5])
        assert ",".join(sorted({*r.base_labels, *(m.template for m in r.matches)})) == want[5]
    labels = {r.doc_id: [(m.template, m.start, m.end) for m in r.matches] for r in rows if r.doc_id}
    assert labels[25] == labels[26] == [] and labels[27] == [("all-rights-reserved", 4, 7)]


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_base(text):
    def luhn(digits):
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0

    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return found


def test_pii_base(spark, texts):
    got = by_id(catalog.op8_personal_data(spark, SMALL).collect())
    for i, t in texts.items():
        want = brute_base(t or "")
        said = ",".join(":".join(map(str, s)) for s in want)
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest(), i
        assert [got[i][f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s[0] == k for s in want) for k in pii.BASE_KINDS]
        assert not said or got[i].spans.startswith(said[:20])


def test_pii_on_random_strings():
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choices("a@.-+ 1234560()_é", k=rng.randint(0, 50)))
        assert pii.base_spans(text) == brute_base(text), text
    for _ in range(500):
        text = "".join(rng.choices("4012888818 -", k=rng.randint(10, 40))) + " 4111 1111 1111 1111 1.2.3.255.6.7 a@b.c_d@e.f"
        assert pii.base_spans(text) == brute_base(text), text


def test_pii_added_spans_and_context():
    spans = pii.spans_of("bank account GB82 WEST 1234 5698 7654 32 and GB82 WEST 1234 5698 7654 33; ssn 123-45-6789")
    assert [(s["kind"], s["base"]) for s in spans] == [("iban", False), ("ssn", False)]
    assert pii.spans_of("part 123-45-6789") == []
    near, far = pii.spans_of("server address 10.0.0.1"), pii.spans_of("release version 10.0.0.1")
    assert near[0]["score"] > far[0]["score"] and far[0]["base"]


@pytest.mark.parametrize(
    ("text", "numbers"),
    [
        ("ES9121000418450200051332 EUR 50", ["ES9121000418450200051332"]),
        ("AT61 1904 3002 3457 3201 BIC X", ["AT61 1904 3002 3457 3201"]),
        ("BE68 5390 0754 7034 2024", ["BE68 5390 0754 7034"]),
        ("pay ES91 2100 0418 4502 0005 1332 AT61 1904 3002 3457 3201 TRANSFERS", ["ES91 2100 0418 4502 0005 1332", "AT61 1904 3002 3457 3201"]),
        ("ref AB12 CDEF GB82 WEST 1234 5698 7654 32", ["GB82 WEST 1234 5698 7654 32"]),
        ("ES9121000418450200051333 EUR 50", []),
        ("ES9121000418450200051332EUR 50", []),
    ],
)
def test_pii_iban_before_capital_words_and_numbers(text, numbers):
    assert [text[s["start"] : s["end"]] for s in pii.spans_of(text) if s["kind"] == "iban"] == numbers


def test_pii_odd_texts(docs_of):
    long = [(30, "a" * 200_000), (31, "1." * 100_000), (32, "a@" * 50_000), (33, "+1" * 50_000), (34, "1 " * 60_000)]
    rows = pii.personal_data(docs_of([*ODD, *long])).collect()
    assert [r.doc_id for r in rows] == [i for i, _ in [*ODD, *long]]
    assert rows[0].spans == [] and rows[1].spans == []


@pytest.mark.parametrize("operator", [token_counts.token_counts, byte_bpe.encode, quality.quality_rules, license_scan.license_scan, pii.personal_data])
def test_empty_table(docs_of, operator):
    assert operator(docs_of([])).collect() == []
