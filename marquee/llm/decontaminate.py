"""Benchmark decontamination by greedy string tiling.

Seeds are runs of ``min_match`` words. A document's runs are looked up among the benchmark's: a table
of 2^20 bits first, then the sorted hashes. Where the seeds that a document shares with an item could
cover enough of the item, the two are tiled: all common runs of unmarked words of at least min_match are
found by Karp-Rabin hashes, the longest ones that don't overlap are marked, and so on until none is left
(Wise 1993). Order plays no part, so passages with their sentences in another order are caught. A document
leaks an item if the tiles cover ``coverage`` of the item's words.

The benchmark comes to the documents in blocks of about BLOCK bytes, one at a time: a block is collected, indexed and broadcast, and
what the documents leak of it is written before the next one is read, so neither the driver nor a task holds more than one index.
No passage is a hot key, however many documents hold it. With one block documents never move; with several they meet,
once, the table of leaks by digest of text, which has one row per distinct text that leaks.

Words are runs of letters, marks and digits, with case folded by Unicode; all else separates. In scripts that are written
without spaces (Chinese, Japanese, Thai and so on) each letter with its marks is a word.

Defined results: null and empty texts leak nothing. Items without a word, null ones among them, are never found. Items of
fewer than min_match words are found only with ``short_items``: as one whole run. Ids of documents and items may be null or repeat; every row
is judged by itself, but benchmark rows that repeat both id and text are one item. An empty benchmark leaves all documents clean. Other columns are kept and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import numbered, stage, unused
from marquee.llm.textarrays import U64, gram_hashes, powers, slices, span_hashes, spans

MIN_MATCH, COVERAGE = 5, 0.5
#: Bytes of benchmark text that are broadcast at a time.
BLOCK = 16 << 20
LEAKS = "array<struct<item_id:bigint,coverage:double,tiles:array<struct<item_word:bigint,doc_word:bigint,words:bigint>>>>"
LEAKS_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.list_(pa.struct(
    [("item_word", pa.int64()), ("doc_word", pa.int64()), ("words", pa.int64())])))]))

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[:128] = [not chr(i).isalnum() for i in range(128)]
#: Scripts whose words are not separated, with the signs of Japanese that belong to no script.
_UNSPACED = "".join(rf"\p{{{s}}}" for s in ("Han", "Hiragana", "Katakana", "Bopomofo", "Yi", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan",
                                           "Tai_Le", "New_Tai_Lue", "Tai_Tham", "Tai_Viet", "Javanese", "Balinese")) + "\u30fc\uff70"
_LETTERS = r"\p{L}\p{M}\p{Nd}\p{Nl}\u00d7\u00f7"  # the two signs count as letters, as they do in the bytes of Latin-1
_WORD = regex.compile(rf"(?V1)[[{_LETTERS}]&&[{_UNSPACED}]]\p{{M}}*|[[{_LETTERS}]--[{_UNSPACED}]]+")


def _by_unicode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with those rewritten as folded words between spaces that hold more than Latin-1 and common signs."""
    other = data >= 0xC4
    other[:-1] &= (data[:-1] != 0xE2) | (data[1:] != 0x80)
    rows = np.unique(np.searchsorted(offsets, np.flatnonzero(other), "right") - 1)
    if not len(rows):
        return data, offsets
    sizes, parts, place = np.diff(offsets), [], 0
    for row in rows.tolist():
        low, high = int(offsets[row]), int(offsets[row + 1])
        text = " ".join(_WORD.findall(data[low:high].tobytes().decode().casefold())).encode()
        parts += [data[place:low], np.frombuffer(text, np.uint8)]
        sizes[row], place = len(text), high
    return np.concatenate([*parts, data[place:]]), np.concatenate([[0], np.cumsum(sizes)])


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row)."""
    data, offsets = _by_unicode(data, offsets)
    folded, breaks = _FOLD[data], _BREAK[data]
    if len(data) > 1 and data.max() >= 0xC2:
        latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        folded[latin] += 0x20
        for (lead, last), (to, then) in (((0xC3, 0x9F), b"ss"), ((0xC2, 0xB5), "μ".encode())):
            folds = np.flatnonzero((data[:-1] == lead) & (data[1:] == last))
            folded[folds], folded[folds + 1] = to, then
        signs = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80))
        breaks[signs] = breaks[signs + 1] = breaks[signs + 2] = True
        signs = np.flatnonzero((data[:-1] == 0xC2) & (data[1:] < 0xC0) & ~np.isin(data[1:], (0xAA, 0xB5, 0xBA)))
        breaks[signs] = breaks[signs + 1] = True
    starts, ends, first = spans(breaks, offsets)
    return span_hashes(folded, starts, ends), first


class Index:
    """The runs of min_match words of a block of benchmark items, sorted by hash."""

    def __init__(self, items: list[tuple[int | None, str]], min_match: int = MIN_MATCH, short_items: bool = False):
        self.min_match, self.ids, self.words = min_match, [i for i, _ in items], []
        for _, _, data, offsets in slices(pa.array([t for _, t in items], pa.string())):
            words, first = plain_words(data, offsets)
            self.words += [words[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        grams = [gram_hashes(w, min_match) for w in self.words]
        hashes = np.concatenate([np.zeros(0, U64), *grams])
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(g)) for g in grams)])[order]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.hashes >> U64(44)] = True
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, min_match if short_items else 1):
            of = np.array([k for k, w in enumerate(self.words) if len(w) == n], np.int64)
            if len(of):
                whole = np.concatenate([gram_hashes(self.words[k], n) for k in of.tolist()])
                order = np.argsort(whole, kind="stable")
                self.short[n] = whole[order], of[order]

    def shared(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, first entry, last entry + 1) of every run that the benchmark has as well."""
        at = np.flatnonzero(self.sieve[grams >> U64(44)])
        low, high = np.searchsorted(self.hashes, grams[at], "left"), np.searchsorted(self.hashes, grams[at], "right")
        met = high > low
        return at[met], low[met], high[met]


def _marked(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n words lie in a run of ``size`` words from one of ``starts`` on."""
    inside = np.zeros(n, bool)
    for i in range(size):
        inside[starts + i] = True
    return inside


class _Runs:
    """Karp-Rabin hashes of a sequence's runs, of any length, by differences of one prefix sum."""

    def __init__(self, words: np.ndarray):
        self.n, self.marked = len(words), np.zeros(len(words), bool)
        up, self.down = powers(self.n + 1)
        self.total = np.zeros(self.n + 1, U64)
        np.cumsum(words * up[:self.n], out=self.total[1:])

    def unmarked(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, start) of each run of ``size`` words that holds no marked one."""
        marks = np.concatenate([[0], np.cumsum(self.marked)])
        free = np.flatnonzero(marks[size:] == marks[:self.n + 1 - size])
        return (self.total[free + size] - self.total[free]) * self.down[free], free


def tile(doc: np.ndarray, item: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (place in the item, place in the document, words) between two sequences of word hashes.

    The greatest length that unmarked runs of both share is found by bisection, since shorter parts of a common run are
    common as well. Runs are looked up, never paired: memory is that of the two sequences, however often they repeat.
    """
    in_doc, in_item, tiles = _Runs(doc), _Runs(item), []

    def meet(size: int) -> bool:
        d_hash, i_hash = in_doc.unmarked(size)[0], np.sort(in_item.unmarked(size)[0])
        at = np.searchsorted(i_hash, d_hash)
        return bool(len(i_hash) and (i_hash[np.minimum(at, len(i_hash) - 1)] == d_hash).any())

    most = min(len(doc), len(item))
    while most >= min_match and meet(min_match):
        longest, most = min_match, most + 1
        while most - longest > 1:
            middle = (longest + most) // 2
            longest, most = (middle, most) if meet(middle) else (longest, middle)
        d_hash, d_at = in_doc.unmarked(longest)
        i_hash, i_at = in_item.unmarked(longest)
        order = np.argsort(i_hash, kind="stable")
        i_hash, i_at = i_hash[order], i_at[order]
        low, high = np.searchsorted(i_hash, d_hash, "left"), np.searchsorted(i_hash, d_hash, "right")
        free, met, next_entry = 0, high > low, {}
        for x, first, last in zip(d_at[met].tolist(), low[met].tolist(), high[met].tolist(), strict=True):
            if x < free:
                continue
            k = next_entry.get(first, first)
            while k < last and in_item.marked[i_at[k]:i_at[k] + longest].any():  # once marked it stays so
                k += 1
            next_entry[first] = k
            if k < last:
                y, free = int(i_at[k]), x + longest
                in_doc.marked[x:free] = in_item.marked[y:y + longest] = True
                tiles.append((y, x, longest))
        most = longest - 1
    return tiles


def leaks_of(words: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, index: Index, coverage: float) -> list[dict]:
    """The leaked items of one document, given where its shared runs lie and their entries. An entry is looked at once,
    however often the document repeats its run."""
    found, m = [], index.min_match
    groups, first = np.unique(low, return_index=True)
    n = high[first] - groups
    entry = np.repeat(groups - np.cumsum(n) + n, n) + np.arange(n.sum())
    order = np.argsort(index.item[entry], kind="stable")
    entry, group = entry[order], np.repeat(groups, n)[order]
    items, begin = np.unique(index.item[entry], return_index=True)
    begin = np.append(begin, len(entry)).tolist()
    for k, a, b in zip(items.tolist(), begin[:-1], begin[1:], strict=True):
        item = index.words[k]
        if _marked(index.place[entry[a:b]], m, len(item)).sum() < coverage * len(item):
            continue
        # Only words inside shared runs can be in a tile; a gap stays between runs that don't touch.
        near = _marked(at[np.isin(low, group[a:b])], m, len(words) + 1)
        keep = np.flatnonzero(near | np.concatenate([[False], near[:-1]]))
        part = np.where(near[keep], np.append(words, U64(0))[keep], U64(0))
        tiles = [(y, int(keep[x]), n) for y, x, n in tile(part, item, m)]
        share = sum(n for *_, n in tiles) / len(item)
        if share >= coverage:
            found.append({"item_id": index.ids[k], "coverage": share,
                          "tiles": [{"item_word": y, "doc_word": x, "words": n} for y, x, n in sorted(tiles)]})
    return found


def short_leaks(words: np.ndarray, first: np.ndarray, index: Index) -> Iterator[tuple[int, dict]]:
    """(row, leak) of each item of fewer than min_match words that a row holds as one run, at its first place."""
    for n, (whole, of) in index.short.items():
        grams = gram_hashes(words, n)
        at = np.flatnonzero(np.isin(grams, whole))
        row = np.searchsorted(first, at, "right") - 1
        inside = at + n <= first[row + 1]
        at, row = at[inside], row[inside]
        _, firsts = np.unique(np.stack([row.astype(U64), grams[at]]), axis=1, return_index=True)
        for k in firsts.tolist():
            low, high = np.searchsorted(whole, grams[at[k]], "left"), np.searchsorted(whole, grams[at[k]], "right")
            place = int(at[k] - first[row[k]])
            for item in of[low:high].tolist():
                yield int(row[k]), {"item_id": index.ids[item], "coverage": 1.0, "tiles": [{"item_word": 0, "doc_word": place, "words": n}]}


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block: int) -> list[DataFrame]:
    """The distinct (item_id, text) in blocks of about so many bytes."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    n = -(-(items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) // block)
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def _scan(rows: DataFrame, at: int, index: Index, coverage: float) -> DataFrame:
    """Adds to the last column, leaks, what the texts in column number ``at`` leak of the index."""
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in parts:
            leaks = batch.column(batch.num_columns - 1).to_pylist()
            for first_row, _, data, offsets in slices(batch.column(at)):
                words, first = plain_words(data, offsets)
                where, low, high = index.shared(gram_hashes(words, index.min_match))
                row = np.searchsorted(first, where, "right") - 1
                inside = where + index.min_match <= first[row + 1]  # not over the border of two documents
                where, low, high, row = where[inside], low[inside], high[inside], row[inside]
                of, begin = np.unique(row, return_index=True)
                begin = np.append(begin, len(row)).tolist()
                for r, a, b in zip(of.tolist(), begin[:-1], begin[1:], strict=True):
                    leaks[first_row + r] += leaks_of(words[first[r]:first[r + 1]], where[a:b] - first[r], low[a:b], high[a:b], index, coverage)
                for r, leak in short_leaks(words, first, index):
                    leaks[first_row + r].append(leak)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(leaks, LEAKS_ARROW)], batch.schema.names)

    return rows.mapInArrow(scan, rows.schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", name: str = "leaks", item_col: str = "item_id",
               item_text: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, block: int = BLOCK, short_items: bool = False) -> DataFrame:
    """docs with one more column, ``name``: the items that each document leaks, with their coverage and tiles."""
    at = docs.columns.index(text_col)
    none = F.expr(f"cast(array() as {LEAKS})")
    parts = _blocks(benchmark, item_col, item_text, block)

    def index(part: DataFrame) -> Index:
        return Index(sorted(((r.item_id, r.text) for r in part.collect()), key=str), min_match, short_items)

    rows = numbered(docs)
    if len(parts) <= 1:
        found = rows.withColumn("leaks", none)
        return (_scan(found, at, index(parts[0]), coverage) if parts else found).toDF(*docs.columns, name)
    # One block at a time: what it finds is written, by digest of the text, before the next one is read.
    digest = F.sha2(F.col(f"c{at}"), 256)
    texts = rows.select(F.col(f"c{at}").alias("text")).withColumn("leaks", none)
    leaked = [stage(_scan(texts, 0, index(part), coverage).filter(F.size("leaks") > 0)
                    .select(F.sha2("text", 256).alias("digest"), "leaks").dropDuplicates(["digest"]).withColumn("block", F.lit(i)), "leaks")
              for i, part in enumerate(parts)]
    by_text = stage(reduce(DataFrame.union, leaked).groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("block", "leaks"))).alias("found"))
                    .select("digest", F.flatten(F.col("found.leaks")).alias("leaks")), "leaks")
    return (rows.withColumn("digest", digest).join(by_text, "digest", "left").select(*rows.columns, F.coalesce("leaks", none).alias("leaks"))
            .toDF(*docs.columns, name))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that leak no item, with all their columns."""
    name = unused(docs, "leaks")
    return find_leaks(docs, benchmark, text_col, name, **options).filter(F.size(name) == 0).drop(name)
