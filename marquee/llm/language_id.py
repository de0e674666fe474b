"""Language identification by unigram models over a fixed public vocabulary, summed over all segmentations.

A word's probability in a language is the sum, over all ways to cut it into pieces of the vocabulary, of
the product of the pieces' probabilities; a forward pass computes it. A text's is the product of its
words'. Piece probabilities are learned per language from the counts of all words of the labelled texts:
the expected number of times each piece is used, again over all segmentations (the E step of expectation
maximisation), starting from equal probabilities.

Words are counted in the tasks before they are shuffled; what reaches the driver is the languages' names and one number per piece and
language, for some languages at a time. Words seen before are looked up in their Python worker. Short words are summed many at once, with a
fixed scale per letter; long ones, and those whose sums a double can't hold, one by one in logarithms: the same sums.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is any text if nothing could be
learned. A row without an id is held out. Repeated rows are judged each; other columns are kept and may have any
name; equal scores go to the first language in order. A text of any length is scored whole.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from marquee.llm.common import numbered, stage, unused, with_fields
from marquee.llm.textarrays import U64, mix64, slices

MARK = "▁"
LETTER = regex.compile(r"\p{L}")
#: Longest piece in characters, with the word mark, that a vocabulary may have; weight added to each piece's count; languages scored at a time.
LONGEST, SMOOTHING, LANGUAGES = 48, 0.5, 400
#: Words that a task counts, and that a worker remembers, at a time.
COUNTED, REMEMBERED = 200_000, 400_000
#: Floating-point numbers that a worker holds for remembered words, and an eighth of it for a batch of them; letters of such words.
NUMBERS, LETTERS = 8_000_000, 16_000_000
UNDETERMINED = "und"
#: Letters up to which words are summed many at once, and the sums below which a word is summed again in logarithms.
SHORT, TINY = 32, 1e-280
WORD = re.compile(r"[^\W\d_]+")
SCALE = 10.0 ** (5 * np.arange(LONGEST + 1))
LOG_SCALE = math.log(1e5)
_PLACES = np.random.default_rng(11).integers(1, 1 << 63, LONGEST, dtype=np.int64).astype(U64) | U64(1)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[str, int]:
    """The model file's pieces that words can be cut into: all of lower-case letters, some after the word mark."""
    model = SentencePieceProcessor(model_file=path)
    pieces = sorted({p for p in map(model.id_to_piece, range(model.get_piece_size()))
                     if p == p.lower() and (WORD.fullmatch(p.removeprefix(MARK)) or p == MARK)})
    if max(map(len, pieces)) > LONGEST:
        raise ValueError(f"the vocabulary has a piece of more than {LONGEST} characters")
    return {p: i for i, p in enumerate(pieces)}


def run_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each run of n characters."""
    total = np.zeros(len(codes) - n + 1, U64)
    for i in range(n):
        total += codes[i:len(codes) - n + 1 + i] * _PLACES[i]
    return mix64(total)


class Pieces:
    """The vocabulary by hash: a table of 2^19 bits first, then the sorted hashes."""

    def __init__(self, path: str):
        names = list(vocabulary(path))
        hashes = np.array([run_hashes(code_points(p), len(p))[0] for p in names], U64)
        self.order = np.argsort(hashes)
        self.hashes, self.lengths = hashes[self.order], sorted({len(p) for p in names})
        self.sieve = np.zeros(1 << 19, bool)
        self.sieve[hashes >> U64(45)] = True

    def find(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(starts, pieces, length) of all pieces in a text, length by length."""
        for n in self.lengths:
            if n > len(codes):
                return
            hashes = run_hashes(codes, n)
            at = np.flatnonzero(self.sieve[hashes >> U64(45)])
            entry = np.searchsorted(self.hashes, hashes[at])
            entry[entry == len(self.hashes)] = 0
            same = self.hashes[entry] == hashes[at]
            yield at[same], self.order[entry[same]], n


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def code_points(text: str) -> np.ndarray:
    return mix64(np.frombuffer(text.encode("utf-32-le"), "<u4").astype(U64) + U64(1 << 40))


class Lattice:
    """All ways to cut a batch of words into pieces: one edge per piece found; a character that is no piece is the unknown one."""

    def __init__(self, words: list[str], path: str):
        self.size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        text = "\n".join([MARK + w for w in words])
        self.unknown = len(vocabulary(path))
        base = np.concatenate([[0], np.cumsum(self.size + 1)[:-1]])
        owner = np.repeat(np.arange(len(words)), self.size + 1)[:len(text)]
        bare = np.ones(len(text), bool)
        bare[(base + self.size)[:-1]] = False  # the line breaks between words
        starts, pieces, lengths = [], [], []
        for at, piece, n in pieces_of(path).find(code_points(text)):
            if n == 1:
                bare[at] = False
            starts.append(at)
            pieces.append(piece)
            lengths.append(np.full(len(at), n))
        bare = np.flatnonzero(bare)
        starts, length = np.concatenate([*starts, bare]), np.concatenate([*lengths, np.ones(len(bare), np.int64)])
        piece, word = np.concatenate([*pieces, np.full(len(bare), self.unknown)]), owner[starts]
        end = starts + length - base[word]
        order = np.argsort(end.astype(np.uint8), kind="stable")  # a word has at most SHORT letters
        self.word, self.end, self.piece, self.length = word[order], end[order], piece[order], length[order]
        self.start = self.end - self.length

    def _at(self, places: np.ndarray) -> list[slice]:
        edges = np.searchsorted(places, np.arange(1, self.size.max(initial=0) + 2))
        return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def forward(self, weights: np.ndarray) -> np.ndarray:
        """Sums over all ways to each place, by word, place and column of the edges' weights."""
        ways = np.zeros((len(self.size), self.size.max(initial=0) + 1, weights.shape[1]))
        ways[:, 0] = 1
        for j, edges in enumerate(self._at(self.end), 1):
            word = self.word[edges]
            more = ways[word, self.start[edges]] * weights[edges]
            for k in range(weights.shape[1]):
                ways[:, j, k] = np.bincount(word, more[:, k], len(self.size))
        return ways

    def scores(self, chances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each word, by column of the pieces' probabilities, and the words for which a sum is too small for a double."""
        ways = self.forward(chances[self.piece] * SCALE[self.length][:, None])
        whole = ways[np.arange(len(self.size)), self.size]
        return np.log(np.maximum(whole, TINY)) - (self.size * LOG_SCALE)[:, None], np.flatnonzero((whole <= TINY).any(axis=1))

    def uses(self) -> np.ndarray:
        """How often each edge is used, on average over the word's segmentations, if all pieces are equally probable."""
        weights = SCALE[self.length] / (self.unknown + 1)
        before = self.forward(weights[:, None])[..., 0]
        after = np.zeros_like(before)
        after[np.arange(len(self.size)), self.size] = 1
        by_start = np.argsort(self.start, kind="stable")
        slices = self._at(self.start[by_start] + 1)
        for i in range(len(slices) - 1, -1, -1):
            edges = by_start[slices[i]]
            after[:, i] += np.bincount(self.word[edges], after[self.word[edges], self.end[edges]] * weights[edges], len(self.size))
        return before[self.word, self.start] * weights * after[self.word, self.end] / before[self.word, self.size[self.word]]


class LongWord:
    """All ways to cut one word of any length, in logarithms: the pieces that end at each place, and sums from place to place."""

    def __init__(self, word: str, path: str):
        self.size, unknown = len(word) + 1, len(vocabulary(path))
        bare = np.ones(self.size, bool)
        starts, pieces, lengths = [], [], []
        for at, piece, n in pieces_of(path).find(code_points(MARK + word)):
            if n == 1:
                bare[at] = False
            starts.append(at)
            pieces.append(piece)
            lengths.append(np.full(len(at), n))
        bare = np.flatnonzero(bare)
        starts, lengths = np.concatenate([*starts, bare]), np.concatenate([*lengths, np.ones(len(bare), np.int64)])
        order = np.argsort(starts + lengths, kind="stable")
        self.piece, self.start, self.end = np.concatenate([*pieces, np.full(len(bare), unknown)])[order], starts[order], (starts + lengths)[order]
        self.unknown = unknown

    def score(self, log_chances: np.ndarray) -> np.ndarray:
        """Log probability by column; of the sums only as many as the longest piece has characters are kept."""
        reach = LONGEST + 1
        ways = np.full((reach, log_chances.shape[1]), -np.inf)
        ways[0] = 0.0
        edges = np.searchsorted(self.end, np.arange(1, self.size + 2))
        for j, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True), 1):
            ways[j % reach] = np.logaddexp.reduce(ways[self.start[a:b] % reach] + log_chances[self.piece[a:b]], axis=0)
        return ways[self.size % reach].copy()

    def uses(self) -> np.ndarray:
        """How often each edge is used on average, if all pieces are equally probable."""
        weight = -math.log(self.unknown + 1)
        before, after = np.full(self.size + 1, -np.inf), np.full(self.size + 1, -np.inf)
        before[0] = after[self.size] = 0.0
        by_end = np.searchsorted(self.end, np.arange(1, self.size + 2)).tolist()
        for j in range(1, self.size + 1):
            before[j] = np.logaddexp.reduce(before[self.start[by_end[j - 1]:by_end[j]]]) + weight
        order = np.argsort(self.start, kind="stable")
        by_start = np.searchsorted(self.start[order], np.arange(self.size + 1)).tolist()
        for i in range(self.size - 1, -1, -1):
            after[i] = np.logaddexp.reduce(after[self.end[order[by_start[i]:by_start[i + 1]]]]) + weight
        return np.exp(before[self.start] + weight + after[self.end] - before[self.size])


def word_scores(words: list[str], path: str, chances: np.ndarray) -> np.ndarray:
    """Log probability of each word, whatever its length, by column of the pieces' probabilities."""
    out = np.zeros((len(words), chances.shape[1]))
    again = [i for i, w in enumerate(words) if len(w) > SHORT]
    short = [i for i, w in enumerate(words) if len(w) <= SHORT]
    step = max(64, NUMBERS // (8 * (SHORT + 2) * max(1, chances.shape[1])))
    for i in range(0, len(short), step):
        part = np.array(short[i:i + step])
        out[part], tiny = Lattice([words[k] for k in part], path).scores(chances)
        again += part[tiny].tolist()
    logs = np.log(chances) if again else None
    for i in again:
        out[i] = LongWord(words[i], path).score(logs)
    return out


def piece_uses(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, piece, uses): how often each piece is expected in each word."""
    short, long = (np.array([i for i, w in enumerate(words) if (len(w) > SHORT) == is_long], np.int64) for is_long in (False, True))
    lattice = Lattice([words[i] for i in short], path)
    found = [(short[lattice.word], lattice.piece, lattice.uses())]
    for i in long.tolist():
        word = LongWord(words[i], path)
        found.append((np.full(len(word.piece), i), word.piece, word.uses()))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def words_of(text: str) -> list[str]:
    """Lower-case words."""
    return WORD.findall(text.lower())


def word_counts(labelled: DataFrame) -> DataFrame:
    """(lang, word, n) over all texts of (lang, text)."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)
        letters = 0
        for batch in parts:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                seen[lang].update(words)
                letters += sum(len(w) for w in words if len(w) > SHORT)
                if sum(map(len, seen.values())) > COUNTED or letters > LETTERS:
                    yield from rows(seen)
                    seen, letters = defaultdict(Counter), 0
        yield from rows(seen)

    def rows(seen: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counts in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(counts.keys(), pa.string()),
                                              pa.array(counts.values(), pa.int64())], ["lang", "word", "n"])

    return (labelled.select("lang", "text").mapInArrow(count, "lang string, word string, n long")
            .groupBy("lang", "word").agg(F.sum("n").alias("n")))


class Model:
    """Probabilities of the vocabulary's pieces in each language."""

    def __init__(self, path: str, languages: list[str], counts: np.ndarray):
        """counts: expected uses by language and piece, the unknown piece last."""
        self.path, self.languages = path, languages
        weights = counts + SMOOTHING
        self.chances = np.ascontiguousarray((weights / weights.sum(axis=1, keepdims=True)).T)


class Scorer:
    """The model in one Python worker, with the words it has met."""

    def __init__(self, model: Model):
        self.model, self.n = model, max(1, len(model.languages))
        self.room = min(REMEMBERED, NUMBERS // self.n)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.letters = 0
        self.scores = np.zeros((0, self.n))

    def learn_words(self, texts: list[list[str]]) -> None:
        """Score the words of these texts that aren't known yet, in batches."""
        if len(self.known) > self.room or self.letters > LETTERS:
            self.forget()
        new = list(set().union(*texts).difference(self.known)) if self.model.languages else []
        self.letters += sum(map(len, new))
        if not new:
            return
        found = word_scores(new, self.model.path, self.model.chances)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.scores = np.concatenate([self.scores, found])

    def judge(self, texts: list[str | None]) -> Iterator[tuple[str, float, float]]:
        """Of each text the best language, its log probability, and the log of the sum of all languages' probabilities."""
        cut = [words_of(t) if t and self.model.languages and LETTER.search(t) else [] for t in texts]
        self.learn_words(cut)
        for words in cut:
            if not words:
                yield UNDETERMINED, -math.inf, -math.inf
                continue
            total = np.zeros(self.n)
            for i in range(0, len(words), REMEMBERED):
                total += self.scores[np.fromiter(map(self.known.__getitem__, words[i:i + REMEMBERED]), np.int64)].sum(axis=0)
            best = int(total.argmax())
            yield self.model.languages[best], float(total[best]), float(total[best] + np.log(np.exp(total - total[best]).sum()))


_scorers: dict[str, Scorer] = {}


def worker_scorer(run: str, model: Broadcast) -> Scorer:
    """One per Python worker and model."""
    if run not in _scorers:
        _scorers.clear()
        _scorers[run] = Scorer(model.value)
    return _scorers[run]


def learn(labelled: DataFrame, path: str, at_a_time: int = LANGUAGES) -> list[Model]:
    """Learn from (lang, text), neither null: a model for each block of languages, in the order of their names."""

    def use(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(vocabulary(path)) + 1
        sums: dict[str, np.ndarray] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, into in sums.items():
                used = np.flatnonzero(into)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int64()), pa.array(into[used])], ["lang", "piece", "uses"])

        for batch in parts:
            langs, words, counts = (c.to_pylist() for c in batch.columns)
            word, piece, uses = piece_uses(words, path)
            uses = uses * np.array(counts, float)[word]
            names, which = np.unique(np.array(langs, object).astype(str), return_inverse=True)
            order = np.argsort(which[word], kind="stable")
            borders = np.searchsorted(which[word][order], np.arange(len(names) + 1))
            for i, lang in enumerate(names.tolist()):
                mine = order[borders[i]:borders[i + 1]]
                sums[lang] = sums.get(lang, 0) + np.bincount(piece[mine], uses[mine], size)
                if len(sums) > at_a_time:
                    yield from rows()
                    sums.clear()
        yield from rows()

    words = stage(word_counts(labelled), "words")
    languages = [r.lang for r in words.select("lang").distinct().orderBy("lang").collect()]
    uses = stage(words.mapInArrow(use, "lang string, piece long, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses")), "uses")
    models = []
    for i in range(0, len(languages), at_a_time):
        block = {lang: k for k, lang in enumerate(languages[i:i + at_a_time])}
        counts = np.zeros((len(block), len(vocabulary(path)) + 1))
        for r in uses.filter(F.col("lang").between(languages[i], languages[min(i + at_a_time, len(languages)) - 1])).collect():  # one row per piece and language of the block
            counts[block[r.lang], r.piece] = r.uses
        models.append(Model(path, list(block), counts))
    return models or [Model(path, [], np.zeros((0, len(vocabulary(path)) + 1)))]


def predict(docs: DataFrame, models: list[Model], text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with two more columns: the language of the text, and its probability among the learned ones (six digits).

    Each block of languages is a pass in the same plan, which keeps the best one so far; equal ones stay.
    """
    at, width = docs.columns.index(text_col), len(docs.columns)
    extra = dict(lang_pred="string", best="double", every="double")

    def judged(table: DataFrame, model: Model) -> DataFrame:
        run, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)

        def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = worker_scorer(run, shared)
            for batch in parts:
                found = []
                for first, last, _, _ in slices(batch.column(at)):
                    found += scorer.judge(batch.column(at).slice(first, last - first).to_pylist())
                lang, best, every = [x for x, _, _ in found], np.array([x for _, x, _ in found]), np.array([x for _, _, x in found])
                if batch.num_columns > width:
                    old_lang, old_best, old_every = (batch.column(width + i) for i in range(3))
                    old_best, old_every = old_best.to_numpy(zero_copy_only=False), old_every.to_numpy(zero_copy_only=False)
                    lang = [new if b > o else old for new, old, b, o in zip(lang, old_lang.to_pylist(), best, old_best, strict=True)]
                    best, every = np.maximum(best, old_best), np.logaddexp(every, old_every)
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(lang, pa.string()), pa.array(best, pa.float64()), pa.array(every, pa.float64())],
                                                 [*batch.schema.names[:width], *extra])

        kept = table.select(*table.columns)
        return kept.mapInArrow(judge, with_fields(plain, **extra))

    plain = numbered(docs)
    table = plain
    for model in models:
        table = judged(table, model)
    score = F.when(F.col("lang_pred") == UNDETERMINED, 0.0).otherwise(F.round(F.exp(F.col("best") - F.col("every")), 6))
    return table.select(*plain.columns, "lang_pred", score.alias("score")).toDF(*docs.columns, *names)


def held_out(doc_id: Column) -> Column:
    """One document in five, by its id, and all without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. Learned from the labelled documents that aren't held out."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = learn(named.filter("not held_out and lang is not null and text is not null").select("lang", "text"), path)
    return predict(named.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def keep_known(docs: DataFrame, path: str, least: float = 0.5) -> DataFrame:
    """The documents whose text is in one of the learned languages with at least this score, with all their columns."""
    model = learn(docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text"), path)
    names = unused(docs, "lang_pred"), unused(docs, "score")
    return predict(docs, model, names=names).filter((F.col(names[0]) != UNDETERMINED) & (F.col(names[1]) >= least)).drop(*names)
