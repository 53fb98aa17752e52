"""Conversation repair against a search over all edits."""

from __future__ import annotations

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest

from shelfscope.llm import catalog, conversations

FOLDER = "/root/testdata/sf0.01"
BLANKS = " \t\n\x0b\x0c\r"


def damaged_rows(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = [" " if x is None else str(x) for x in (conv, turn)]
        chance = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if chance == 0:
            continue
        if chance == 1:
            text = ""
        if chance == 2:
            text = text.replace(".", "").replace("!", "").replace("?", "")
        if chance == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if chance == 3 else 1)
    return out


def in_order(rows):
    return sorted(
        rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(f"{r[2]}\0{r[3]}".encode()).digest())
    )


def cheapest(rows):
    """(cost, audit, lines) by a search from the cheapest and least audit on; rows are (role, text, fault)."""
    agenda = [(0, "", 0, "", ())]
    seen = set()
    while agenda:
        cost, audit, at, last, lines = heapq.heappop(agenda)
        if at == len(rows) and last in ("", "a"):
            return cost, audit, lines
        if (at, last) in seen:
            continue
        seen.add((at, last))
        due = ("assistant" if last == "u" else "user")

        def go(letter, price, forward, new=None, cost=cost, audit=audit, at=at, last=last, lines=lines):
            state = last if new is None else new[0][:1]
            heapq.heappush(agenda, (cost + price, audit + letter, at + forward, state, lines if new is None else (*lines, new)))

        go("I", 3, 0, (due, ""))
        if at < len(rows):
            role, text, fault = rows[at]
            go("D", 4, 1)
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if (last, role[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    go("K", more, 1, (role, text))
                go("R", 3 + more, 1, (due, text))
    raise AssertionError


def expected(rows):
    """One conversation's report from its rows after damage."""
    rows = in_order(rows)
    seen, judged = set(), []
    for _, _, role, text in rows:
        body = text.rstrip(BLANKS)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else None if body[-1] in ".!?" else "truncated"
        seen.add((role, text))
        judged.append((role, text, fault))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    counts = [sum(f == name for *_, f in judged) for name in ("blank", "duplicate", "truncated")]
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, lines = cheapest(judged)
    text = "\n".join(f"{role}:{text}" for role, text in lines)
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()), lines


FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def grouped(rows):
    found = defaultdict(list)
    for row in rows:
        found[row[0]].append(row)
    return found


def test_query_against_search(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    after = grouped(damaged_rows(given))
    empty = (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())
    want = {conv: expected(after[conv])[0] if conv in after else empty for conv in {r[0] for r in given}}
    rows = catalog.op12_conversation_repair(spark, FOLDER).collect()
    assert len(rows) == len(want)
    assert {r.conv_id: tuple(r[f] for f in FIELDS) for r in rows} == want
    assert sum(len(set(r.audit)) > 1 for r in rows) > 20


def odd_rows(rng, n_convs, longest):
    roles = ["system", "user", "assistant", "tool", "", None, "ursine", "s"]
    texts = ["Fine.", "cut off", "", " \t\n", None, "Who?", "same", "Ünï \U0001f388!", "x.\x0b ", "why.\x85"]
    rows = []
    for conv in range(n_convs):
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(roles) if rng.random() < 0.4 else ["user", "assistant"][turn % 2]
            text = rng.choice(texts) if rng.random() < 0.5 else f"t{rng.randrange(10**6)}."
            when = None if rng.random() < 0.1 else rng.randrange(3 * longest) if rng.random() < 0.1 else turn
            rows += [(None if conv == 0 else conv, when, role, text)] * (2 if rng.random() < 0.1 else 1)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, conv string, pos string, kind string, head string, audit string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], SCHEMA)


@pytest.mark.parametrize("bits", [14, 1, 0])
def test_odd_conversations(spark, monkeypatch, bits):
    """Null, empty and unknown values, ties and repeated rows, also where a conversation lies in many pieces."""
    monkeypatch.setattr(conversations, "PIECE", bits)
    rows = odd_rows(random.Random(bits), 60 if bits else 12, 14)
    spaced = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    want = {conv: expected(own) for conv, own in grouped(spaced).items()}
    docs = table(spark, rows)
    got = {r.conv_id: tuple(r[f] for f in FIELDS) for r in conversations.repair_report(docs).collect()}
    assert got == {conv: report for conv, (report, _) in want.items()}
    lines = defaultdict(list)
    for r in sorted(conversations.repaired(docs).collect(), key=lambda r: r.place):
        lines[r.conv_id].append((r.role, r.text))
    assert lines == {conv: list(lines) for conv, (_, lines) in want.items() if lines}


def test_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(conversations, "PIECE", 7)
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"{t}{rng.choice(['.', ''])}") for t in range(3000)]
    [row] = conversations.repair_report(table(spark, rows)).collect()
    assert tuple(row[f] for f in FIELDS) == expected(rows)[0]


def test_no_conversations(spark):
    assert conversations.repair_report(table(spark, [])).collect() == []
    assert conversations.repaired(table(spark, [])).collect() == []


def test_paths_of_one_piece():
    """Ties between audits go to the least letters."""
    user, assistant = 1, 2
    rows = pa.table({"conv": pa.array([7, 7, 8, 9]), "pos": pa.array([0, 1, 2, 3]), "kind": pa.array([user, user, assistant, 4 + user])})
    piece = conversations.Piece(rows)
    found = list(piece.paths(*(conversations.np.tile(conversations.LAST, (3, 1)), *[conversations.np.zeros(3, bool)] * 2)))
    assert [(audit, cost) for *_, audit, cost in found] == [("KR", 3), ("IK", 3), ("D", 4)]
