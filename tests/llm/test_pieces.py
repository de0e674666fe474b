import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marquee.llm import blocks, pieces
from marquee.llm.common import table

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = pieces.library(PATH)
TEXT = st.text(st.one_of(st.sampled_from("abc  ▁é'日本🎉\t\n　\xa0<s>0x4."), st.characters(codec="utf-8")), max_size=40)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_chunks_give_the_librarys_ids(text):
    assert np.frombuffer(pieces.chunk_table(PATH).encode([text])[0], "<u4").tolist() == LIBRARY.encode(text)


def expected(doc_id, text):
    ids = LIBRARY.encode(text or "")
    decoded = LIBRARY.decode(ids) if ids else ""
    return doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), decoded


def check(df, docs):
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.decoded) for r in df.collect()]
    assert sorted(got, key=repr) == sorted((expected(*d) for d in docs), key=repr)


def test_whole_table_is_the_librarys(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").repartition(3)
    check(pieces.encode(docs, PATH), [(r.doc_id, r.text) for r in docs.collect()])


def test_edge_cases(documents, monkeypatch):
    rows = [(1, None), (2, ""), (3, " "), (4, "   "), (5, "x" * 300_000), (6, "a b " * 50_000), (7, "日本語" * 3000 + " ▁ \x00 ퟿🎉"), (None, "no id"), (8, "same"), (8, "same"),
            (9, "<s></s><unk><0x41> [INST]"), (10, " lead and trail \n")]
    check(pieces.encode(documents(rows).repartition(3), PATH), rows)
    assert pieces.encode(documents([]), PATH).count() == 0


def test_each_distinct_chunk_is_segmented_once(monkeypatch):
    asked = []

    class Counting:
        def encode(self, chunks, num_threads):
            asked.extend(chunks)
            return LIBRARY.encode(chunks, num_threads=num_threads)

    table = pieces.ChunkTable(PATH)
    monkeypatch.setattr(pieces, "library", lambda path: Counting())
    for _ in range(3):
        got = table.encode(["the same words again and again the same", "the same  two", "", " "])
    assert sorted(asked) == sorted({"the", "same", "words", "again", "and", " two", " "})
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [LIBRARY.encode(t) for t in ("the same words again and again the same", "the same  two", "", " ")]


def test_the_table_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 20)
    table = pieces.ChunkTable(PATH)
    for i in range(40):
        table.encode([" ".join(f"w{i}x{k}" for k in range(10)) + " " + "long" * 200])
    assert len(table.ids) <= 31 and max(map(len, table.ids)) <= pieces.LONG


def test_models_that_cross_blanks_are_refused(monkeypatch):
    class Crossing:
        def vocab_size(self):
            return 1

        def id_to_piece(self, i):
            return "of▁the"

    monkeypatch.setattr(pieces, "library", lambda path: Crossing())
    with pytest.raises(ValueError):
        pieces.check_model("any")


def test_numbers_as_bytes():
    import numpy as np
    for values in ([], [0], [65535], [65536, 3], [7] * 1000):
        assert blocks.unpacked(blocks.packed(np.array(values, "i8"))).tolist() == values
