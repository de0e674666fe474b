import math
import random
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest

from marquee.llm import language_id as l
from marquee.llm.common import table

PATH = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(word, pieces):
    if not word:
        yield []
    for j in range(1, min(len(word), 20) + 1):
        piece = pieces.get(word[:j], len(pieces) if j == 1 else None)
        if piece is not None:
            for rest in segmentations(word[j:], pieces):
                yield [piece, *rest]


def test_word_score_sums_all_segmentations():
    pieces = l.vocabulary(PATH)
    rng = np.random.default_rng(1)
    model = l.Model(PATH, ["a", "b"], rng.integers(0, 50, (2, len(pieces) + 1)).astype(float))
    words = ["the", "attend", "ß", "日本", "naïve", "xqz", "a"]
    direct = [[math.log(sum(math.prod(model.chances[p, k] for p in way) for way in segmentations(l.MARK + w, pieces))) for k in (0, 1)] for w in words]
    assert l.word_scores(words, PATH, model.chances) == pytest.approx(np.array(direct))
    assert l.word_scores([], PATH, model.chances).shape == (0, 2)
    assert np.isfinite(l.word_scores(["x" * l.SHORT, "日" * l.SHORT], PATH, model.chances * 1e-6)).all()


@pytest.mark.parametrize("length", [33, 34, 60, 200])
def test_long_words_are_summed_whole(length):
    """The sum over all segmentations, place by place, with exact fractions' logarithms."""
    pieces, rng = l.vocabulary(PATH), random.Random(length)
    word = "".join(rng.choice("abenstuß日本ü") for _ in range(length))
    counts = np.random.default_rng(2).integers(0, 50, (2, len(pieces) + 1)).astype(float)
    chances = l.Model(PATH, ["a", "b"], counts).chances
    text, direct, share = l.MARK + word, [], []
    for k in (0, 1):
        ways = [Fraction(1)]
        for j in range(1, len(text) + 1):
            total = Fraction(0)
            for i in range(max(0, j - 20), j):
                piece = pieces.get(text[i:j], len(pieces) if j - i == 1 else None)
                total += 0 if piece is None else ways[i] * Fraction(chances[piece, k])
            ways.append(total)
        direct.append(math.log(ways[-1].numerator) - math.log(ways[-1].denominator))
    assert l.word_scores([word, "the"], PATH, chances)[0] == pytest.approx(direct, rel=1e-9)
    # short words give the same in logarithms
    short = word[:30]
    assert l.LongWord(short, PATH).score(np.log(chances)) == pytest.approx(l.word_scores([short], PATH, chances)[0], rel=1e-9)
    at, piece, uses = l.piece_uses([short, word, "a"], PATH)
    assert all(np.isfinite(uses)) and uses[at == 1].sum() <= length + 1.001
    lattice, long = l.Lattice([short], PATH), l.LongWord(short, PATH)
    for found, of in ((np.bincount(lattice.piece, lattice.uses()), np.bincount(long.piece, long.uses())),):
        assert found == pytest.approx(of, rel=1e-9)


def test_huge_counts_give_numbers():
    pieces = l.vocabulary(PATH)
    counts = np.zeros((2, len(pieces) + 1))
    counts[:, 5] = 1e16
    chances = l.Model(PATH, ["a", "b"], counts).chances
    scores = l.word_scores(["☃".replace("☃", "ﬀ") * 32, "ﬀ" * 31, "the"], PATH, chances)
    assert np.isfinite(scores).all() and scores[0, 0] == pytest.approx(math.log(chances[pieces.get("ﬀ", len(pieces)), 0]) * 32 + math.log(chances[pieces[l.MARK], 0]))


def test_every_piece_that_words_meet_is_used():
    model = l.SentencePieceProcessor(model_file=PATH)
    met = {p for p in map(model.id_to_piece, range(model.get_piece_size())) if l.words_of(p.removeprefix(l.MARK)) == [p.removeprefix(l.MARK)]}
    assert met <= set(l.vocabulary(PATH)) and max(map(len, met)) > 12


def test_more_languages_than_one_model_holds(documents):
    words = {f"l{i:03d}": " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{c}" for c in "abcdefgh") for i in range(30)}
    rows = [(1 + 100 * n + i, text, lang) for i, (lang, text) in enumerate(words.items()) for n in range(6)]
    docs = documents(rows)
    labelled = docs.filter("lang is not null").select("lang", "text")
    whole, blocks = l.learn(labelled, PATH), l.learn(labelled, PATH, at_a_time=7)
    assert len(whole) == 1 and len(blocks) == 5
    one, many = ({r.doc_id: (r.lang_pred, r.score) for r in l.predict(docs.select("doc_id", "text"), m).collect()} for m in (whole, blocks))
    assert one == many and sum(one[i][0] == lang for i, _, lang in rows) > 0.9 * len(rows)


def test_expected_uses_are_averages_over_segmentations():
    pieces, words = l.vocabulary(PATH), ["then", "ünder", "ß日"]
    chance = 1 / (len(pieces) + 1)
    lattice = l.Lattice(words, PATH)
    uses = lattice.uses()
    for i, word in enumerate(words):
        ways = list(segmentations(l.MARK + word, pieces))
        total, direct, got = sum(chance ** len(w) for w in ways), {}, {}
        for w in ways:
            for p in w:
                direct[p] = direct.get(p, 0) + chance ** len(w) / total
        for p, share in zip(lattice.piece[lattice.word == i].tolist(), uses[lattice.word == i].tolist(), strict=True):
            got[p] = got.get(p, 0) + share
        assert got == pytest.approx(direct)


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    judged = l.identify(docs, PATH).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").selectExpr("avg(int(lang = lang_pred))", "count(*)").first()
    assert judged[0] >= 0.98 and judged[1] > 150


def test_edge_cases(spark, documents):
    rng = random.Random(4)
    make = lambda words: " ".join(rng.choice(words) for _ in range(40))
    en, de = ("the", "and", "of", "with", "house"), ("der", "und", "nicht", "mit", "haus")
    rows = [(i, make(en), "en") for i in range(40)] + [(100 + i, make(de), "de") for i in range(40)]
    odd = [(200, None), (201, ""), (202, "123 !? ½ ²"), (203, "THE HOUSE OF THE"), (204, "und" * 40_000, None), (205, "日本語", None), (None, "the and of", "de"), (206, make(de), None), (206, make(de), None)]
    got = {}
    for r in l.identify(documents(rows + odd), PATH).collect():
        assert (r.lang_pred == "und") == (r.score == 0) and 0 <= r.score <= 1
        got.setdefault(r.doc_id, r)
    assert [got[i].lang_pred for i in (200, 201, 202)] == ["und"] * 3
    assert got[203].lang_pred == "en" and got[204].lang_pred == "de" and got[206].lang_pred == "de" and got[None].held_out
    assert got[205].lang_pred in ("en", "de") and got[None].lang_pred == "en"
    assert all(got[i].lang_pred == ("en" if i < 100 else "de") for i in got if i is not None and i < 200)
    kept = l.keep_known(documents(rows + odd), PATH)
    assert kept.columns == documents([]).columns and kept.count() == 80 + 6
    unlabelled = l.identify(documents([(1, "text", None), (2, None, None)]), PATH).collect()
    assert [(r.lang_pred, r.score) for r in unlabelled] == [("und", 0.0)] * 2
    assert l.identify(documents([]), PATH).count() == 0
