"""The pipeline against a plain version of its stages."""

import re
from collections import Counter

import duckdb

import corpus_pipeline
from lendscope.llm.sql import MIX, QUALITY

from .conftest import SF01
from .test_queries import near_components


def test_pipeline_equals_plain_version(spark):
    con = duckdb.connect()
    con.sql(f"create table documents as select * from '{SF01}/documents.parquet'")
    con.sql("create table good as select * from documents where doc_id in (with " + QUALITY.format(rows="select doc_id, text from documents")
            + " select doc_id from verdict where kept)")
    con.sql("create table single as select * from good qualify doc_id = max(doc_id) over (partition by text)")
    near = near_components(con.sql("select doc_id, text from single").fetchall(), 80)
    firsts = [i for i, (_, c) in near.items() if c == i]
    con.sql(f"create table apart as select * from single where doc_id in ({', '.join(map(str, firsts))})")
    want = Counter()
    for i, epochs in con.sql("with " + MIX.format(rows="select doc_id, source, text from apart") + " select doc_id, epochs from times").fetchall():
        if epochs:
            want[i] = epochs
    rows = corpus_pipeline.run(spark, SF01).collect()
    assert Counter(r.doc_id for r in rows) == want
    text = dict(con.sql("select doc_id, text from documents").fetchall())
    assert all(r.lossless and r.text == text[r.doc_id] and r.n_pieces == len(r.pieces) for r in rows)


def test_stages_on_hostile_rows(spark, hostile, empty):
    for docs in (hostile, empty):
        for name, function in corpus_pipeline.STAGES:
            before = docs.columns
            docs = function(spark, docs, SF01)
            if name != "encoding":
                assert docs.columns == before
        assert docs.columns[: len(before)] == before
        assert all(r.lossless for r in docs.collect())


def test_stage_order():
    assert [re.sub(r"\W", " ", n) for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "source mix", "encoding"]
