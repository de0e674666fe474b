import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marquee.llm import packing
from marquee.llm.common import table
from marquee.llm.packing import word_ids

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abcXYZ é'ÉßİŉǅΣς  \t\n\r\x0b\x1c\x1f\x85\xa0\u2028¼²³ª–’€,.!<|>endoftextstart日"), st.characters(codec="utf-8")), max_size=40))
def test_ids_are_the_librarys(text):
    assert np.frombuffer(word_ids(PATH).ids(text), "<u4").tolist() == ids(text)[:-1]


def test_special_strings_and_contractions():
    for text in ("a <|endoftext|> b", "<|startoftext|>x", "it's we'll I'D they've'", "<|endoftext|", "don’t stop—now", "x" * 5000):
        assert np.frombuffer(word_ids(PATH).ids(text), "<u4").tolist() == ids(text)[:-1]


def test_long_runs_are_not_remembered():
    encoder = packing.WordIds(PATH)
    for i in range(50):
        text = f"{chr(97 + i % 26)}{'z' * (200 + i)} a"
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == ids(text)[:-1]
    assert set(encoder.chunks) == {"a"}


def check(pieces, docs, window=packing.WINDOW):
    """Round trip: every document's ids in order, every sequence gapless and full but the last."""
    whole, places = {}, {}
    for p in sorted(pieces, key=lambda p: (p.doc_id is None, p.doc_id, p.start)):
        whole.setdefault(p.doc_id, []).append(p)
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
        assert len(p.ids) == 4 * p.length and 0 < p.length <= window
    for doc_id, text in docs:
        got = np.concatenate([np.frombuffer(p.ids, "<u4") for p in whole[doc_id]]).tolist()
        assert got == ids(text) and whole[doc_id][0].doc_tokens == len(got)
        assert [p.start for p in whole[doc_id]] == np.cumsum([0] + [p.length for p in whole[doc_id]])[:-1].tolist()
    for number, found in places.items():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at == window or number == max(places)
    assert sorted(places) == list(range(len(places)))


def test_round_trip(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").repartition(5, "doc_id")
    check(packing.pack(docs, PATH).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_edge_cases(documents):
    rows = [(1, None), (2, ""), (3, "word " * 9000), (4, "日本 <|endoftext|>"), (None, "no id")]
    pieces = packing.pack(documents(rows).coalesce(2), PATH, window=64)
    check(pieces.collect(), rows, 64)
    repeated = packing.pack(documents([(5, "same"), (5, "same")]), PATH)
    assert [p.doc_tokens for p in repeated.collect()] == [2, 2]
    assert packing.pack(documents([]), PATH).count() == 0


def test_sequences_and_padding(documents):
    pieces = packing.pack(documents([(i, "a b c " * i) for i in range(1, 9)]), PATH, window=32).cache()
    packed = packing.sequences(pieces).select("*", packing.padding(packing.F.col("n_tokens"), 32).alias("pad")).orderBy("sequence_id").collect()
    assert [r.n_tokens for r in packed[:-1]] == [32] * (len(packed) - 1) and len(packed[-1].ids) == 4 * packed[-1].n_tokens
    last = packed[-1]
    assert last.pad == (0 if last.n_tokens & (last.n_tokens - 1) == 0 else 32 - last.n_tokens)
    assert zlib.crc32(b"".join(bytes(r.ids) for r in packed)) == zlib.crc32(b"".join(bytes(p.ids) for p in sorted(pieces.collect(), key=lambda p: (p.sequence_id, p.offset))))
    assert sum(len(r.boundaries) for r in packed) == pieces.count()
