"""The corpus pipeline: each stage on what the one before kept, against brute force where there is one."""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from llm.conftest import ODD
from llm.test_near_dups import brute

import __spark_entry__ as entry
import corpus_pipeline
from shelfscope.llm import byte_bpe, catalog, decontaminate
from shelfscope.llm.base import documents, written

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    """Documents, then what each stage wrote."""
    docs = documents(spark, FOLDER)
    found = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, FOLDER))
        found.append(docs)
    return found


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark, tables):
    documents_, civil, once, single, clean, encoded = map(rows_of, tables)
    for df in tables[1:-1]:
        assert df.schema == tables[0].schema or [f.name for f in df.schema] == [f.name for f in tables[0].schema]

    toxic = {r.doc_id for r in catalog.op1_toxicity(spark, FOLDER).collect() if r.predicted}
    assert civil.keys() == documents_.keys() - toxic
    assert all(civil[i] == documents_[i] for i in civil)

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(r.doc_id, r.text) for r in civil.values()])
    want = {i: text for i, text, _ in con.execute(catalog.ORACLES["op3_line_dedup"]).fetchall()}
    assert {i: r.text for i, r in once.items()} == want
    assert all(r.n_chars == len(r.text) for r in once.values())

    groups = brute([(i, r.text) for i, r in once.items()], 5)
    assert single.keys() == {i for i, root in groups.items() if i == root}
    assert all(single[i] == once[i] for i in single)

    items = pq.read_table(f"{FOLDER}/benchmark.parquet").to_pydict()["text"]
    holding = {i for i, r in single.items() if any(x in r.text for x in items)}
    dropped = single.keys() - clean.keys()
    assert holding <= dropped and len(dropped) <= len(holding) + 2

    decoder = byte_bpe.Decoder(byte_bpe.public_tokenizers.path(byte_bpe.FILE))
    assert encoded.keys() == clean.keys()
    assert all(decoder.decode(r.ids).decode() == clean[i].text and r.n_tokens == len(np.frombuffer(r.ids, "<u4")) for i, r in encoded.items())


def test_last_stage_decodes(tables):
    clean, encoded = map(rows_of, tables[-2:])
    assert {i: bytes(r.bytes).decode() for i, r in encoded.items()} == {i: r.text for i, r in clean.items()}


def test_stages_on_odd_rows(spark, docs_of):
    """Every stage takes null ids and texts, repeated rows and columns of other names, and an empty table."""
    extra = [(30, pq.read_table(f"{FOLDER}/benchmark.parquet").to_pydict()["text"][0])]
    for rows in ([*ODD, *extra], []):
        docs = docs_of(rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, FOLDER))
            assert docs.columns == docs_of([]).columns
        left = [r.doc_id for r in docs.collect()]
        assert 30 not in left and left.count(4) == (2 if rows else 0) and (None in left) == bool(rows)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == len(left)


def test_registered():
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op") and n[2].isdigit()) == list(range(1, 14))
    assert decontaminate.ERROR_RATE == 0.05
