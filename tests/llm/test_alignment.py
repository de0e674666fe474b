import hashlib
from collections import Counter

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from marquee.llm import alignment
from marquee.llm.common import table

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TOKENS = Tokenizer.from_file(A)
TOKENS.encode_special_tokens = True
PIECES = SentencePieceProcessor(model_file=B)


def byte_level():
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars, n = {chr(b): b for b in keep}, 0
    for b in range(256):
        if b not in keep:
            chars[chr(256 + n)] = b
            n += 1
    return chars


CHARS = byte_level()


def bytes_a(i):
    return bytes(CHARS[c] for c in TOKENS.id_to_token(i))


def bytes_b(i):
    piece = PIECES.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if PIECES.is_byte(i) else piece.replace("▁", " ").encode()


def plain(text):
    """(ids of A, ids of B, links, groups) of one text, one token after the other."""
    if not text:
        return [], [], [], []
    a, b = TOKENS.encode(" " + text, add_special_tokens=False).ids, PIECES.encode(text)
    sides = []
    for ids, of in ((a, bytes_a), (b, bytes_b)):
        at, spans, whole = 0, [], b""
        for i in ids:
            spans.append((at, at + len(of(i)), i))
            at, whole = spans[-1][1], whole + of(i)
        if whole != (" " + text).encode():
            return [], [], [], []
        sides.append(spans)
    links = [(x[2], y[2]) for x in sides[0] for y in sides[1] if x[0] < y[1] and y[0] < x[1]]
    cuts = sorted({x[1] for x in sides[0]} & {y[1] for y in sides[1]})
    groups, begin = [], 0
    for cut in cuts:
        groups.append("|".join(",".join(str(i) for s, e, i in side if begin <= s and e <= cut) for side in sides))
        begin = cut
    return a, b, links, groups


def brute_force(docs):
    read = [(doc_id, *plain(text)) for doc_id, text in docs]
    counts = Counter(pair for *_, links, _ in read for pair in set(links))
    highest = {}
    for (a, _), n in counts.items():
        highest[a] = max(n, highest.get(a, 0))
    return [(doc_id, len(a), len(b), len(groups), len(links), sum(counts[p] == highest[p[0]] for p in links), sum(counts[p] for p in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "") for doc_id, a, b, links, groups in read]


def check(df, docs):
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(brute_force(docs), key=repr)


def test_tables_agree_with_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").filter("length(text) < 3000").repartition(3)
    check(alignment.align(docs, A, B), [(r.doc_id, r.text) for r in docs.collect()])


def test_edge_cases(documents):
    rows = [(1, None), (2, ""), (3, " "), (4, "a  b "), (5, "▁ marks"), (6, "日本語 🎉 \x00é"), (None, "no id"), (8, "same text"), (8, "same text"), (9, "same text, twice: same text"),
            (10, "<|endoftext|> </s> <s><unk>"), (11, "Donaudampfschifffahrt " * 40), (12, "x" * 3000), (13, "\n\n\t tabs\r\n"), (14, "l'été naïve señor Straße")]
    check(alignment.align(documents(rows).repartition(3), A, B), rows)
    assert alignment.align(documents([]), A, B).count() == 0
    check(alignment.align(documents([(1, None), (2, "▁")]), A, B), [(1, None), (2, "▁")])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("abc  é'日本🎉\t\nthe <|endoftext|>"), st.characters(codec="utf-8")), max_size=30), min_size=1, max_size=4))
def test_blocks_agree_with_brute_force(texts):
    done = alignment.align_block(alignment.aligner(A, B), texts)
    for i, text in enumerate(texts):
        a, b, links, groups = plain(text)
        assert (done["n_a"][i], done["n_b"][i], done["n_links"][i], done["n_groups"][i]) == (len(a), len(b), len(links), len(groups))
        assert done["groups_sha256"][i] == (hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")


def test_identity_links_are_not_shuffled(documents):
    parts = alignment.align_documents(documents([(1, "the house and the garden"), (2, "the house")]), A, B)
    same = alignment.aligner(A, B).same
    pairs = parts.filter("kind = 1").collect()
    assert all(same[r.a] != r.b for r in pairs)
    the = TOKENS.encode(" the").ids[0]
    assert parts.filter(f"kind = 2 and a = {the}").groupBy().sum("docs").first()[0] == 2
