"""Registered queries against their SQL, and the pipeline against plain Python on a small folder."""

from __future__ import annotations

import collections
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from compare import connect, differences  # noqa: E402
from llm_cases import empty_documents, odd_documents  # noqa: E402
from test_llm_operators import brute_components, brute_lines  # noqa: E402

from scanloom.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, small, name):
    got = queries.QUERIES[name](spark, small).toPandas()
    assert len(got) > 0
    assert differences(got, connect(small).execute(queries.ORACLES[name]).df()) is None


def test_one_query_for_each_operator():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}


def test_pipeline_stages_take_effect(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = []
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = spark.createDataFrame(step(spark, docs, small).collect(), docs.schema)
        after = {r.doc_id: r for r in docs.collect()}
        kept.append(len(after))
        assert docs.columns == corpus_pipeline.COLUMNS
        if name in ("quality", "language"):
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
            assert dict(before).items() >= {i: r.text for i, r in after.items()}.items()
            if name == "quality":
                judged = [(i in after, labels[i] == 1) for i, _ in before if i in labels]
                assert sum(a == b for a, b in judged) >= 0.95 * len(judged)
            else:
                assert len(after) >= 0.99 * len(before)
        elif name == "line_dedup":
            assert {i: after[i].text for i in after} == {i: text for i, text, _, _ in brute_lines(before)}
            assert all(r.n_chars == len(r.text) for r in after.values())
        else:
            components, _ = brute_components(before, 5, 80, 100)
            assert set(after) == {i for i, c in components.items() if i == c}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert {p.doc_id for p in pieces} == set(after)
    whole = corpus_pipeline.run(spark, small).collect()
    key = lambda rows: collections.Counter((p.doc_id, p.doc_tokens) for p in rows if p.start == 0)
    assert key(whole) == key(pieces)


@pytest.mark.parametrize("make", [odd_documents, empty_documents])
def test_stages_take_odd_and_empty_tables(spark, small, make):
    docs = make(spark)
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(step(spark, docs, small).collect(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() >= docs.count()
