import random
import re

import numpy as np
import pytest

from marquee.llm import minhash
from marquee.llm.common import table
from marquee.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(fold)
    if not words:
        return set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def brute_force(rows):
    """doc_id -> (n, component) for rows with different ids."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if both and 100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both):
                    a, b = sorted((find(x), find(y)))
                    root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_small_tables_match_brute_force(spark, documents):
    rows = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    assert result(minhash.near_duplicates(documents(rows))) == brute_force(rows)


def test_families_of_near_copies_match_brute_force(documents):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((6, 40, 120)))]
        for _ in range(8):
            words = list(base)
            for _ in range(rng.choice((0, 1, 2, 4))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((n, rng.choice((" ", "  ", "\n")).join(words)))
            n += 1
    rng.shuffle(rows)
    assert result(minhash.near_duplicates(documents(rows))) == brute_force(rows)


def test_edge_cases(documents):
    ten = "a b c d e f g h i j"
    got = minhash.near_duplicates(documents([
        (5, ten), (9, ten.upper()), (None, ten), (7, None), (8, ""), (10, " \t\n"), (11, "one two"), (12, "ONE\ttwo"), (13, "\xa0"),
        (None, "only here, without an id"), (20, "x y " * 30_000), (20, "x y " * 30_000), (21, "repeated row"), (21, "repeated row")])).collect()
    by_id = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None}
    assert by_id[5] == (6, 5, True) and by_id[9] == (6, 5, False)
    assert by_id[7] == (0, 7, True) and by_id[8] == (0, 8, True) and by_id[10] == (0, 10, True)
    assert by_id[11] == (1, 11, True) and by_id[12] == (1, 11, False) and by_id[13] == (1, 13, True)
    assert by_id[20] == (2, 20, True) and by_id[21] == (1, 21, True)
    assert sorted((r.component_id == 5, r.kept) for r in got if r.doc_id is None) == [(False, True), (True, False)]
    assert len(got) == 14


def test_empty_table_and_kept_columns(documents):
    assert minhash.near_duplicates(documents([])).count() == 0
    docs = documents([(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (None, "q")])
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "q"), (1, "a b c d e f"), (3, "")]


def test_prefix_join_finds_every_similar_pair(spark):
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(60)]
    common = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(60):  # much shared text, similarities on both sides of the limit
        own = [f"u{i}_{j}" for j in range(rng.randrange(2, 25))]
        rows.append((i, " ".join(common + own)))
    rows += [(100 + i, " ".join(common[: 50 + i])) for i in range(11)]
    texts = spark.createDataFrame(rows, "cid long, text string")
    apart = texts.selectExpr("cid", "cid as component")
    pairs = minhash.prefix_pairs(apart, texts)
    found = {(r.a, r.b) for r in minhash.similar(pairs, texts).collect()}
    sets = {i: shingles(t) for i, t in rows}
    assert found == {(x, y) for x in sets for y in sets if x > y
                     and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y])}
    assert 0 < len(found) < len(rows) * (len(rows) - 1) // 2


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.int64).astype(np.uint64)
    a, b = pool[:2000], pool[500:2500]  # similarity 0.6
    same = (minhash.signature(a, 2000) == minhash.signature(b, 2000)).mean()
    assert abs(same - 0.6) < 0.05
    assert len(minhash.band_keys(minhash.signature(a, 160), 40)) == 40


@pytest.mark.parametrize("pairs", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51), (51, 60), (60, 50)]])
def test_components(spark, pairs):
    root = {}
    for x, y in pairs:
        root.setdefault(x, x), root.setdefault(y, y)
    for _ in pairs:
        for x, y in pairs:
            root[x] = root[y] = min(root[x], root[y])
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == root
