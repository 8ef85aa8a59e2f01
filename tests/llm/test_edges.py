"""Every operator and stage on odd rows, on no rows, and beside clashing columns."""

from __future__ import annotations

import pytest

import corpus_pipeline
from tessera.llm.registry import QUERIES
from llm_helpers import documents_of

#: Operators 11 to 13 read other tables or return other rows; see test_conversations_and_sources.
DOCUMENTS = sorted(set(QUERIES) - {"op11_chat_format", "op12_conversation_repair", "op13_source_audit"})
CLASH = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, tokens string, digest string, norm string, shard int, path string, spans string, bucket int, keep_id long, text_sha256 string, `file` string, `row` long, n long"


@pytest.mark.parametrize("name", DOCUMENTS)
def test_odd_rows(spark, write, odd, name):
    d = write(odd, labels=[(0, 1, 0), (3, 1, 1), (3, 0, 0), (6, 1, None), (99, 0, 1), (None, 1, 1)])
    out = QUERIES[name](spark, d).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(len(odd)))


@pytest.mark.parametrize("name", DOCUMENTS)
def test_no_rows(spark, write, name):
    assert QUERIES[name](spark, write([])).collect() == []


@pytest.mark.parametrize("name", DOCUMENTS)
def test_null_ids_repeats_and_clashing_columns(spark, write, name):
    one = ("en", "s", 3, 0.5, "k", "t", "d", "n", 1, "p", "x", 2, 7, "h", "f", 1, 9)
    data = [(1, "a b c", *one), (1, "a b c", *one), (None, "a b c", *one), (2, None, *[None] * len(one)), (None, None, *one), (3, "d e f", *one)]
    out = QUERIES[name](spark, write(data, CLASH)).collect()
    assert len(out) == len(data)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, write, odd, name, stage):
    for texts in (odd, []):
        d = write(texts, labels=[(0, 1, 0), (3, 1, 1)])
        docs = documents_of(spark, d)
        out = stage(spark, docs, d)
        if name != "packing":
            assert out.columns == docs.columns
        assert out.count() <= len(texts)
        if not texts:
            assert out.count() == 0


def test_stages_with_nulls_and_clashing_columns(spark, write):
    one = ("en", "s", 3, 0.5, "k", "t", "d", "n", 1, "p", "x", 2, 7, "h", "f", 1, 9)
    data = [(1, "a b c", *one), (1, "a b c", *one), (None, "a b c", *one), (2, None, *[None] * len(one)), (3, "password = abcdefgh12", *one)]
    d = write(data, CLASH)
    docs = documents_of(spark, d)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, d).count() == len(data)


def test_whole_pipeline(spark, write):
    texts = ["one two three four five six seven eight nine ten"] * 3 + ["token = abcdefgh1234 and some more words here", None, ""]
    assert corpus_pipeline.run(spark, write(texts)).count() == 3
