"""Registered queries against SQL, and the pipeline as a whole."""

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from marquee.llm import decontaminate, minhash
from marquee.llm.common import table
from marquee.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "pages", "conversations", "embeddings"):
        connection.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == sorted(result.fetchall(), key=repr)


def test_every_operator_has_one_query():
    assert [q.split("_")[0] for q in QUERIES] == [f"op{i}" for i in range(1, 14)] + ["pipeline"]


def test_planted_passages_are_found(spark):
    words = lambda t: t.lower().split()
    items = {r.item_id: words(r.text) for r in table(spark, SF, "benchmark").collect()}
    for r in QUERIES["op1_string_tiling"](spark, SF).join(table(spark, SF, "documents").select("doc_id", "text"), "doc_id").collect():
        text = words(r.text)
        inside = [i for i, w in items.items() if any(text[k:k + len(w)] == w for k in range(len(text) - len(w) + 1))]
        assert set(inside) <= {x.item_id for x in r.leaks} and r.contaminated == bool(r.leaks)


def test_pipeline_stage_by_stage(spark):
    docs, columns = table(spark, SF, "documents"), table(spark, SF, "documents").columns
    before = {r.doc_id: r for r in docs.collect()}
    for name, function in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.stage(function(spark, docs, SF), "test")
        assert after.columns == columns, name
        kept = {r.doc_id: r for r in after.collect()}
        assert kept and set(kept) <= set(before)
        if name == "language_id":
            assert set(kept) == {i for i, r in before.items() if any(c.isalpha() for c in r.text or "")}
        elif name == "line_dedup":
            assert all(r.n_chars == len(r.text) <= len(before[i].text) for i, r in kept.items()) and len(kept) > 0.9 * len(before)
        elif name == "near_duplicates":
            assert set(kept) == {r.doc_id for r in minhash.near_duplicates(docs).collect() if r.component_id == r.doc_id}
        else:
            leaks = decontaminate.find_leaks(docs, table(spark, SF, "benchmark"))
            assert set(before) - set(kept) == {r.doc_id for r in leaks.collect() if r.leaks}
        docs, before = after, kept
    tokens = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {p.doc_id: p.doc_tokens for p in pieces} == {i: len(tokens.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in before.items()}
    assert [r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().orderBy("doc_id").collect()] == sorted(before)
