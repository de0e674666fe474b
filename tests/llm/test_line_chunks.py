import random

import pyarrow as pa
from pyspark.sql import functions as F

from marquee.llm import line_chunks


def chunks_of(text):
    raw, found = next(line_chunks.chunk_spans(pa.array([text])))
    return raw, found


def brute_force(rows):
    """doc_id -> text for rows with different ids: the rule applied to all chunks in order of (id, place)."""
    seen, count, cut = set(), {}, {i: chunks_of(t or "") for i, t in rows}
    for raw, chunks in cut.values():
        for a, b, _, counts in chunks:
            if counts:
                count[raw[a:b]] = count.get(raw[a:b], 0) + 1
    out = {}
    for i, t in sorted(rows):
        raw, chunks = cut[i]
        kept, place = [], 0
        for a, b, following, counts in chunks:
            if counts and count[raw[a:b]] > 1:
                if raw[a:b] in seen:
                    kept.append(raw[place:a])
                    place = following
                seen.add(raw[a:b])
        out[i] = None if t is None else b"".join([*kept, raw[place:]]).decode()
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def sample(n=60, seed=3):
    rng = random.Random(seed)
    line = lambda: " ".join(f"w{rng.randrange(500)}" for _ in range(rng.choice((3, 8, 60))))
    passages = [[line() for _ in range(rng.randrange(2, 9))] for _ in range(6)]
    rows = []
    for i in range(n):
        lines = [line() for _ in range(rng.randrange(1, 6))]
        for p in rng.sample(passages, 2) * rng.choice((1, 1, 2)):
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = p
        rows.append((i, rng.choice(("\n", "\n\n")).join(lines) + rng.choice(("", "\n"))))
    rng.shuffle(rows)
    return rows


def test_matches_brute_force_and_keeps_columns(documents):
    rows = sample()
    docs = documents(rows)
    done = line_chunks.dedup_lines(docs)
    assert done.columns == [*docs.columns, "n_chunks", "removed_chunks", "removed_bytes"]
    assert texts(done) == brute_force(rows)
    assert done.selectExpr("sum(removed_chunks)").first()[0] > 50


def test_chunks_cover_the_text_in_order_and_resist_shifts():
    for _, text in sample(20, 9):
        raw, chunks = chunks_of(text)
        assert [c[0] for c in chunks[1:]] == [c[2] for c in chunks[:-1]] and chunks[-1][2] == len(raw)
    lines = [f"line number {i * i} of the passage" for i in range(60)]
    plain = {raw[a:b] for raw, found in [chunks_of("\n".join(lines))] for a, b, _, _ in found}
    shifted = {raw[a:b] for raw, found in [chunks_of("\n".join(["something", "else", *lines]))] for a, b, _, _ in found}
    assert len(plain - shifted) <= 2 and len(plain) > 10


def test_edge_cases(documents):
    long = " ".join(f"p{i}" for i in range(55))
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, long), (5, f"first\n{long}\nlast"), (6, long), (6, long), (7, "one\ntwo"), (8, "one"),
            (None, long), (None, f"{long}\nwithout id"), (9, "tail " * 40_000 + "\n" + long)]
    got = sorted(((r.doc_id or 0, r.text, r.removed_chunks) for r in line_chunks.dedup_lines(documents(rows)).collect()), key=repr)
    assert got == sorted([(1, None, 0), (2, "", 0), (3, "\n\n", 0), (4, long, 0), (5, "first\nlast", 1), (6, "", 1), (6, "", 1), (7, "one\ntwo", 0),
                          (8, "one", 0), (0, "", 1), (0, "without id", 1), (9, "tail " * 40_000 + "\n", 1)], key=repr)
    assert line_chunks.dedup_lines(documents([])).count() == 0


def test_digest_collisions_remove_nothing(documents, monkeypatch, spark):
    rows = [(i, f"a{i}\nb{i}") for i in range(6)]
    same = line_chunks.chunk_rows(documents(rows).selectExpr("doc_id", "text"), True).selectExpr("doc_id", "cast(X'00' as binary) as digest", "times", "content")
    monkeypatch.setattr(line_chunks, "chunk_rows", lambda *a, **b: same)
    assert line_chunks.repeated_chunks(documents(rows)).count() == 0


def passage(rng, n, words):
    return [" ".join(f"p{rng.randrange(10**6)}" for _ in range(words // n + 1)) for _ in range(n)]


def test_every_shared_passage_goes_whatever_surrounds_it(documents):
    rng, rows, shared = random.Random(5), [], []
    own = lambda: [f"own {rng.randrange(10**9)}" for _ in range(rng.randrange(4))]
    for n in [2, 3, 4, 5, 6, 7, 8] * 5:
        lines = passage(rng, n, 51)
        shared.append((len(rows), lines))
        for _ in range(2):
            before, after = own(), own()
            rows.append((len(rows), "\n".join([*before, *lines, *after]), "\n".join([*before, *after])))
    done = texts(line_chunks.dedup_lines(documents([r[:2] for r in rows]), passages=True))
    for first, _ in shared:
        assert done[first] == rows[first][1]
        assert done[first + 1].rstrip("\n") == rows[first + 1][2]


def test_passages_keep_the_first_place_of_every_line(documents):
    rows = sample()
    done = texts(line_chunks.dedup_lines(documents(rows), passages=True))
    assert sum(map(len, done.values())) < sum(len(t) for t in brute_force(rows).values())
    kept = {line for t in done.values() for line in t.split("\n")}
    assert {line for _, t in rows for line in t.split("\n")} <= kept | {""}


def test_passages_of_one_document(documents):
    lines = passage(random.Random(8), 3, 60)
    block, line = "\n".join(lines), " ".join(f"r{i}" for i in range(20))
    rows = [(1, f"{block}\nbetween\n{block}\nend"), (2, "\n".join([line] * 4)), (3, f"  \n{block}\n \n{lines[0]}"), (None, block), (4, None)]
    done = texts(line_chunks.dedup_lines(documents(rows), passages=True))
    assert done == {1: f"{block}\nbetween\nend", 2: rows[1][1], 3: f"  \n \n{lines[0]}", None: "", 4: None}


def test_run_hash_collisions_remove_nothing(documents, monkeypatch):
    docs = documents([(i, "\n".join(passage(random.Random(i), 3, 60))) for i in range(4)])
    rows, contents = line_chunks.run_rows, line_chunks.run_contents
    asked = docs.withColumn("hashes", F.array(F.lit(0)))
    hashes = {r.hash for r in rows(docs).collect()}
    every = asked.withColumn("hashes", F.array(*map(F.lit, sorted(hashes))))
    monkeypatch.setattr(line_chunks, "run_rows", lambda *a: rows(docs).withColumn("hash", F.lit(0).cast("long")))
    monkeypatch.setattr(line_chunks, "run_contents", lambda *a: contents(every).withColumn("hash", F.lit(0).cast("long")))
    assert len(hashes) >= 4 and line_chunks.repeated_runs(docs).count() == 0
    monkeypatch.setattr(line_chunks, "run_contents", lambda *a: contents(asked))
    assert line_chunks.repeated_runs(docs).count() == 4


def test_no_short_line_is_left_alone_after_short_ones(documents):
    rng = random.Random(17)
    bodies = [[f"line {rng.randrange(10**9)} of {i}" for _ in range(n)] for i, n in enumerate([2, 3, 4, 5, 6, 7, 8] * 6)]
    long = " ".join(f"p{i}" for i in range(55))
    for lines in [*bodies, *([*b, long] for b in bodies)]:
        assert all(counts for *_, counts in chunks_of("\n".join(lines))[1])
    rows = [(i + 1000 * copy, "\n".join(b)) for i, b in enumerate(bodies) for copy in range(3)]
    done = texts(line_chunks.dedup_lines(documents(rows)))
    assert all(done[i] == (t if i < 1000 else "") for i, t in rows)


def test_copies_with_long_lines_are_emptied_whole(documents):
    rng = random.Random(23)
    bodies = [[" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice((2, 3, 60)))) for _ in range(rng.randrange(2, 9))] for _ in range(60)]
    rows = [(i + 1000 * copy, "\n".join(b)) for i, b in enumerate(bodies) for copy in range(2)]
    done = texts(line_chunks.dedup_lines(documents(rows), passages=True))
    assert all(done[i] == (t if i < 1000 else "") for i, t in rows)
