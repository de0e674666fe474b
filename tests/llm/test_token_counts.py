import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marquee.llm import token_counts
from marquee.llm.common import table
from marquee.llm.pretokens import PreTokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = PreTokenizer(PATH, words=False, value=len)


def count(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abcXYZ é'ÉßΣ   \t\n\r\x0b\x1c\x1f\x85\xa0\u2028¼²³ª–’€,.!<|>endoftext日09"), st.characters(codec="utf-8")), max_size=40))
def test_counts_are_the_librarys(text):
    got = sum(COUNTER.values(text)) if COUNTER.plain(text) else len(COUNTER.whole(text))
    assert got == count(text)


def test_documents_and_edge_cases(spark, documents):
    rows = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").limit(60).collect()]
    rows += [(900, None), (901, ""), (902, "a<|endoftext|>b  <|endoftext|> "), (903, "日本" * 10), (904, "longword" * 20_000), (None, "x"), (905, "same"), (905, "same")]
    for entries in (50_000, 3):
        got = token_counts.count_tokens(documents(rows), PATH, entries=entries).collect()
        assert sorted(((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got)) == sorted(
            (i or -1, len((t or "").encode()), count(t), count(t) > 1024) for i, t in rows)
    assert token_counts.count_tokens(documents([]), PATH).count() == 0


def test_frequent_table_is_bounded(documents):
    found = token_counts.frequent_pretokens(documents([(1, "b b b a a c d e f g" + "x" * 1000)]), PATH, 3).collect()
    assert len(found) == 1 and len(found[0].pieces) == len(found[0].tokens) == 3 and found[0].pieces[:2] == [" a", " b"]


def test_summaries_of_many_tasks_merge_to_all_counts(documents, monkeypatch):
    monkeypatch.setattr(token_counts, "FAN_IN", 3)
    docs = documents([(i, f"all some{i % 7} w{i}") for i in range(200)]).repartition(40)
    found = token_counts.frequent_pretokens(docs, PATH, 20).first()
    assert found.pieces[:3] == [" some", " w", "all"] and found.tokens[:3] == [1, 1, 1]
    plan = token_counts.frequent_pretokens(docs, PATH, 20)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(piece" not in plan and "TakeOrdered" not in plan


def test_long_runs_are_not_remembered():
    counter = PreTokenizer(PATH, words=False, value=len)
    for i in range(50):
        text = f"{chr(97 + i % 26)}{'z' * (200 + i)} a"
        assert sum(counter.values(text)) == count(text)
    assert set(counter.cache) == {" a"}
