import random

import numpy as np
import pytest

from marquee.llm import decontaminate as d

ITEM = "id long, text string, leaks int"


def greedy(doc, item, least):
    """Greedy string tiling, word by word."""
    in_doc, in_item, tiles = set(), set(), []
    while True:
        best, found = least - 1, []
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and i + n not in in_item and j + n not in in_doc:
                    n += 1
                if n > best:
                    best, found = n, []
                if n == best and n >= least:
                    found.append((j, i))
        if not found:
            return tiles
        for j, i in sorted(found):
            if not (set(range(i, i + best)) & in_item or set(range(j, j + best)) & in_doc):
                in_item |= set(range(i, i + best))
                in_doc |= set(range(j, j + best))
                tiles.append((i, j, best))


@pytest.mark.parametrize("seed", range(60))
def test_tiles_match_brute_force(seed):
    rng = random.Random(seed)
    letters = rng.choice((2, 3, 8))
    doc, item = ([rng.randrange(1, letters + 1) for _ in range(rng.randrange(0, 40))] for _ in range(2))
    if seed % 2:
        item = doc[10:20] + item[:4] + doc[:7]
    least = rng.choice((2, 3, 5))
    assert d.tile(np.array(doc, np.uint64), np.array(item, np.uint64), least) == greedy(doc, item, least)


def passages(n=12, seed=1):
    rng = random.Random(seed)
    return [[" ".join(f"b{i}w{rng.randrange(10**6)}" for _ in range(8)).capitalize() + "." for _ in range(5)] for i in range(n)]


def filler(rng, n):
    return " ".join(f"f{rng.randrange(300)}" for _ in range(n))


@pytest.mark.parametrize("block", [d.BLOCK, 700])
def test_reordered_and_altered_passages_are_caught(spark, documents, block):
    rng, items = random.Random(6), passages()
    benchmark = spark.createDataFrame([(i, " ".join(p), 0) for i, p in enumerate(items)] + [(50, None, 0), (51, "too short", 0), (None, "", 0)], ITEM)
    rows, want = [], {}
    for i, p in enumerate(items):
        order = rng.sample(p, 5)
        rows.append((i, f"{filler(rng, 50)} {' '.join(order)} {filler(rng, 50)}"))
        rows.append((100 + i, f"{filler(rng, 20)}\n{', '.join(order).upper().replace(' ', ' – ')}\n"))
        rows.append((200 + i, f"{filler(rng, 90)} {p[0]} {filler(rng, 9)} {p[3]}"))  # two sentences of five
        want |= {i: [i], 100 + i: [i], 200 + i: []}
    rows += [(300, None), (301, ""), (302, " ".join(items[0] + items[1])), (None, " ".join(items[2])), (303, "the same " * 50_000), (304, filler(rng, 20_000) + " ".join(items[3])), (305, "too short")]
    want |= {300: [], 301: [], 302: [0, 1], None: [2], 303: [], 304: [3], 305: []}
    docs = documents(rows)
    found = d.find_leaks(docs, benchmark, name="found", item_col="id", block=block)
    assert found.columns == [*docs.columns, "found"]
    assert {r.doc_id: sorted(x.item_id for x in r.found) for r in found.collect()} == want
    clean = d.decontaminate(docs, benchmark, item_col="id", block=block)
    assert clean.columns == docs.columns and clean.count() == sum(not v for v in want.values())


def test_tiles_are_places_of_words(spark, documents):
    item = "one two three four five six seven eight nine ten"
    benchmark = spark.createDataFrame([(1, item, 0)], ITEM)
    row = d.find_leaks(documents([(1, "x Six seven, EIGHT nine ten y z one two three four five!")]), benchmark, name="found", item_col="id").first()
    assert [(t.item_word, t.doc_word, t.words) for t in row.found[0].tiles] == [(0, 8, 5), (5, 1, 5)] and row.found[0].coverage == 1


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], ITEM)
    assert [r.found for r in d.find_leaks(documents([(1, "a b c d e f")]), none, name="found", item_col="id").collect()] == [[]]
    assert d.find_leaks(documents([]), spark.createDataFrame([(1, "a b c d e f", 0)], ITEM), name="found", item_col="id").count() == 0


def test_accents_fold_and_signs_separate():
    import pyarrow as pa

    from marquee.llm.textarrays import slices

    def words(text):
        return d.plain_words(*next(slices(pa.array([text])))[2:])[0].tolist() if text else []

    assert words("ÉTÉ “à” l’ÔTEL") == words("été à l ôtel") and len(words("«a»\xa0b…c×d")) == 3


@pytest.mark.parametrize(("item", "text"), [
    ("北京是中国的首都，人口超过两千万。", "有人说北京是中国的首都，人口超过两千万。对吗"),
    ("東京タワーはどこにありますか", "質問：東京タワーはどこにありますか？"),
    ("กรุงเทพมหานครเป็นเมืองหลวง", "ว่ากรุงเทพมหานครเป็นเมืองหลวงของ"),
    ("Ο ΉΛΙΟΣ ΚΑΙ Η ΘΆΛΑΣΣΑ ΤΗΣ ΕΛΛΆΔΑΣ", "λέει: ο ήλιος και η θάλασσα της ελλάδας!"),
    ("столица россии это город москва", "ВОТ: СТОЛИЦА РОССИИ ЭТО ГОРОД МОСКВА"),
    ("żółw łódź ćma świat źrebię", "x ŻÓŁW, ŁÓDŹ, ĆMA, ŚWIAT, ŹREBIĘ"),
    ("die große straße heißt weiße gasse", "DIE GROSSE STRASSE HEISST WEISSE GASSE"),
])
def test_scripts_without_spaces_and_other_case(spark, documents, item, text):
    docs = documents([(1, text), (2, item), (3, "plain ASCII text beside it"), (4, None)])
    found = d.find_leaks(docs, spark.createDataFrame([(7, item, 0)], ITEM), name="found", item_col="id")
    assert {r.doc_id: [(x.item_id, x.coverage) for x in r.found] for r in found.collect()} == {1: [(7, 1.0)], 2: [(7, 1.0)], 3: [], 4: []}


def test_words_are_the_same_beside_other_scripts():
    import pyarrow as pa

    from marquee.llm.textarrays import slices

    text = "Ünïcode ª²x straße «µ» a×b c÷d_e …f—g h\u200bi 3½ İ"
    words = lambda *t: d.plain_words(*next(slices(pa.array(t)))[2:])
    alone, first = words(text[:-1])
    both, rows = words("aж", text[:-1] + "ж", text[:-1])
    assert first.tolist() == [0, len(alone)] and rows.tolist() == [0, 1, len(alone) + 2, 2 * len(alone) + 2]
    assert both[1:1 + len(alone)].tolist() == alone.tolist() == both[-len(alone):].tolist()


@pytest.mark.parametrize("block", [d.BLOCK, 80])
def test_short_items_are_found_as_one_whole_run(spark, documents, block):
    benchmark = spark.createDataFrame([(1, "Forty two", 0), (2, "what is it called", 0), (3, "xyzzy", 0), (4, "forty, two!", 0), (5, "", 0), (6, None, 0), (7, "首都", 0)], ITEM)
    rows = [(1, "a forty-two b forty two"), (2, "forty"), (3, "two it is called what"), (4, "so what is it called?"), (5, "Xyzzy"), (6, "forty two two"), (7, "中国的首都"), (8, None)]
    found = d.find_leaks(documents(rows), benchmark, name="found", item_col="id", block=block, short_items=True).collect()
    assert {r.doc_id: sorted(x.item_id for x in r.found) for r in found} == {1: [1, 4], 2: [], 3: [], 4: [2], 5: [3], 6: [1, 4], 7: [7], 8: []}
    assert [(t.item_word, t.doc_word, t.words) for r in found if r.doc_id == 1 for x in r.found for t in x.tiles] == [(0, 1, 2)] * 2


def test_tiles_of_repetitive_texts_need_memory_of_their_size_only():
    import tracemalloc

    doc, item = np.full(250_000, 5, np.uint64), np.full(300, 5, np.uint64)
    d.tile(doc[:1000], item)  # powers are kept between calls
    tracemalloc.start()
    try:
        assert d.tile(doc, item) == [(0, 0, 300)]
        period = np.tile(np.arange(1, 8, dtype=np.uint64), 3000)
        assert sum(n for *_, n in d.tile(period, np.concatenate([period[3:2000], [99], period[:500]]).astype(np.uint64))) == 2497
        assert tracemalloc.get_traced_memory()[1] < 100 << 20
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("block", [d.BLOCK, 16_000])
def test_equal_words_by_the_hundred_thousand(spark, documents, block):
    benchmark = spark.createDataFrame([(i, "word " * (300 + i), 0) for i in range(20)], ITEM)
    docs = documents([(1, "word " * 250_000), (2, "word " * 200), (3, "word " * 100), (4, None)])
    found = d.find_leaks(docs, benchmark, name="found", item_col="id", block=block).collect()
    assert {r.doc_id: sorted(x.item_id for x in r.found) for r in found} == {1: list(range(20)), 2: list(range(20)), 3: [], 4: []}


def test_blocks_find_the_same_for_repeated_rows_and_texts(spark, documents):
    items = [" ".join(p) for p in passages(6)]
    benchmark = spark.createDataFrame([(i % 4, t, 0) for i, t in enumerate(items * 3)], ITEM)
    docs = documents([(i % 3 or None, t, "en") for i, t in enumerate([*items * 2, " ".join(items), "", None])])

    def found(block):
        rows = d.find_leaks(docs, benchmark, name="found", item_col="id", block=block).collect()
        return sorted((r.text or "", str(r.doc_id), sorted((x.item_id, x.coverage, [tuple(t) for t in x.tiles]) for x in r.found)) for r in rows)

    assert found(400) == found(d.BLOCK) and len(found(d.BLOCK)) == 15
