"""Alignment of two tokenizers' tokens over the same bytes, with corpus-wide counts of linked ids.

Tokens of A (byte-level BPE over a space and the text) and of B (SentencePiece, which puts the space itself) are intervals of one byte
string. Offsets where tokens of both end cut them into groups; a token of A and one of B are linked where they overlap. Each stretch
between neighbouring ends, of whichever side, is one link, so links come from merging the two lists of ends.

Fast path: an array gives for every A id the B id of the same bytes. Links of that kind, which all exact
one-to-one groups are, are counted by document in one vector of A's vocabulary length per task, and the
vectors are added. Only other links, of irregular groups, become pairs: a block's distinct ones are counted by document, meet in a shuffle,
and come back to the documents by position (see ``blocks``). What passes through the driver has one row per A id.

Texts that are null or empty, and those whose joined token bytes differ from a space and the text on either side, have no
tokens: zeros, and '' for the digest. Null ids stay null, repeated rows are documents of their own, other columns are not used, an empty
table gives no row, and a text may have any length.
"""

from __future__ import annotations

import array
import hashlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marquee.llm.blocks import answered, blocks, packed, rows, unpacked
from marquee.llm.common import documents, stage
from marquee.llm.pieces import MARK, ChunkTable, check_model, library
from marquee.llm.pretokens import PreTokenizer, byte_alphabet

#: Pre-tokens that a worker remembers; bytes of a block's texts.
REMEMBERED, BLOCK = 400_000, 2 << 20
DOCUMENT, PAIR, VECTOR = 0, 1, 2
PART = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                  ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("same", pa.binary()), ("other", pa.binary()),
                  ("at", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("docs", pa.int64())])
PART_DDL = ("kind int, block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, same binary, other binary, "
            "at int, a int, b int, docs long")


class PlainIds(PreTokenizer):
    """Ids of byte-level BPE, strings of special tokens read as plain text."""

    def __init__(self, path: str):
        super().__init__(path, words=False, value=lambda ids: array.array("I", ids).tobytes())
        self.room = REMEMBERED

    @cached_property
    def library(self) -> Tokenizer:
        found = Tokenizer.from_file(self.path)
        found.encode_special_tokens = True
        found.no_truncation()
        found.no_padding()
        return found

    def ids(self, text: str) -> bytes:
        return b"".join(self.values(text)) if self.plain(text) else array.array("I", self.whole(text)).tobytes()


class Aligner:
    """Both tokenizers in one Python worker, their tokens' bytes, and the array from A ids to B ids of the same bytes."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = PlainIds(a_path), ChunkTable(b_path)
        model, vocabulary = library(b_path), self.a.library.get_vocab()
        byte_of = {c: bytes([i]) for i, c in enumerate(byte_alphabet())}
        self.size_a, self.size_b = max(vocabulary.values()) + 1, model.vocab_size()
        self.bytes_a = [b""] * self.size_a
        for token, i in vocabulary.items():
            self.bytes_a[i] = b"".join(byte_of.get(c, c.encode()) for c in token)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(MARK, " ").encode()
                        for i, p in enumerate(map(model.id_to_piece, range(self.size_b)))]
        if not all(bytes([i]) in side for side in (set(self.bytes_a), set(self.bytes_b)) for i in range(256)):
            raise ValueError("a vocabulary lacks bytes, so its tokens can't always give back a text")
        self.length_a, self.length_b = (np.array([len(x) for x in side], "i8") for side in (self.bytes_a, self.bytes_b))
        # a byte's piece stands for it only where no other piece does
        by_bytes = {self.bytes_b[i]: i for i in sorted(range(self.size_b), key=lambda i: (not model.is_byte(i), model.is_control(i) or model.is_unknown(i), -i))
                    if not (model.is_control(i) or model.is_unknown(i))}
        self.same = np.array([by_bytes.get(x, -1) for x in self.bytes_a], "i8")
        # ids as they are written into a document's groups: A before ',' and '|', B before ',' and ';'
        self.written = ([b"%d," % i for i in range(self.size_a)] + [b"%d|" % i for i in range(self.size_a)]
                        + [b"%d," % i for i in range(self.size_b)] + [b"%d;" % i for i in range(self.size_b)])

    def tokens(self, texts: list[str]) -> tuple[list, list]:
        """Id arrays of both sides; empty ones where either side's bytes are not those of a space and the text."""
        a, b, none = [], [], np.zeros(0, "i8")
        for text, data in zip(texts, self.b.encode(texts), strict=True):
            ids_a, ids_b = none, none
            # Both sides give back every byte (see the constructor), but B's can't tell a marker in the text from a space.
            if text and MARK not in text:
                ids_a, ids_b = (np.frombuffer(x, "<u4").astype("i8") for x in (self.a.ids(" " + text), data))
                size = 1 + len(text.encode())
                if self.length_a[ids_a].sum() != size or self.length_b[ids_b].sum() != size:
                    ids_a, ids_b = none, none
            a.append(ids_a)
            b.append(ids_b)
        return a, b


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One per Python worker."""
    return Aligner(a_path, b_path)


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values, sorted."""
    values = np.sort(values, kind="stable")  # quick where sorted runs lie one after another, as they do here
    return values[np.append(True, values[1:] != values[:-1])[:len(values)]]


def align_block(found: Aligner, texts: list[str]) -> dict:
    """Counts and links of a block's documents: every document's links, the block's distinct irregular pairs and in how many documents each is."""
    tokens_a, tokens_b = found.tokens(texts)
    n = len(texts)
    n_a, n_b = (np.array([len(x) for x in side], "i8") for side in (tokens_a, tokens_b))
    a, b = np.concatenate(tokens_a), np.concatenate(tokens_b)
    # one string of bytes for the whole block: documents end where both sides do
    ends_a, ends_b = np.cumsum(found.length_a[a]), np.cumsum(found.length_b[b])
    ends = distinct(np.concatenate([ends_a, ends_b]))
    of_a, of_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    doc = np.repeat(np.arange(n), n_a)[of_a]
    cuts = (ends_a[of_a] == ends) & (ends_b[of_b] == ends)
    link_a, link_b = a[of_a], b[of_b]
    same = found.same[link_a] == link_b
    other = link_a[~same] * found.size_b + link_b[~same]
    pairs = distinct(other)
    place = np.searchsorted(pairs, other)
    in_docs = distinct(doc[~same] * max(len(pairs), 1) + place)
    a_docs = distinct(doc[same] * found.size_a + link_a[same]) % found.size_a

    def by_document(values: np.ndarray, which: np.ndarray) -> list[bytes]:
        borders = np.searchsorted(which, np.arange(n + 1))
        return [packed(values[i:j]) for i, j in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)]

    return {"n_a": n_a, "n_b": n_b, "n_links": np.bincount(doc, minlength=n), "n_groups": np.bincount(doc[cuts], minlength=n),
            "groups_sha256": digests(found, a, b, n_a + n_b, np.searchsorted(ends[cuts], ends_a), np.searchsorted(ends[cuts], ends_b)),
            "same": by_document(link_a[same], doc[same]), "other": by_document(place, doc[~same]),
            "pairs": pairs, "pair_docs": np.bincount(in_docs % max(len(pairs), 1), minlength=len(pairs)), "a_docs": a_docs}


def digests(found: Aligner, a: np.ndarray, b: np.ndarray, sizes: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> list[str]:
    """Of each document the digest of its groups' ids, written as 'a1,a2|b1;a3|b2,b3'; '' without tokens."""
    def last(groups: np.ndarray) -> np.ndarray:
        return np.append(groups[1:] != groups[:-1], True)[:len(groups)]

    texts = np.concatenate([a + found.size_a * last(group_a), 2 * found.size_a + b + found.size_b * last(group_b)])
    order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
    written = [found.written[i] for i in texts[order].tolist()]
    out, begin = [], 0
    for size in sizes.tolist():
        out.append(hashlib.sha256(b"".join(written[begin:begin + size])[:-1]).hexdigest() if size else "")
        begin += size
    return out


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of documents, of blocks' irregular pairs, and of tasks' vectors, told apart by ``kind``; written and read back."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = aligner(a_path, b_path)
        vector = np.zeros(found.size_a, "i8")
        for block, ids, texts in blocks(parts, BLOCK):
            done = align_block(found, texts)
            vector += np.bincount(done["a_docs"], minlength=found.size_a)
            n = len(ids)
            yield rows(PART, {"kind": [DOCUMENT] * n, "block": [block] * n, "doc_id": ids, **{
                k: done[k] for k in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "same", "other")}}, n)
            p = len(done["pairs"])
            yield rows(PART, {"kind": [PAIR] * p, "block": [block] * p, "at": range(p), "a": done["pairs"] // found.size_b, "b": done["pairs"] % found.size_b,
                              "docs": done["pair_docs"]}, p)
        held = np.flatnonzero(vector)
        yield rows(PART, {"kind": [VECTOR] * len(held), "a": held, "docs": vector[held]}, len(held))

    return stage(documents(docs).mapInArrow(read, PART_DDL), "alignment-parts")


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    check_model(b_path)
    parts = align_documents(docs, a_path, b_path)
    vector = parts.filter(F.col("kind") == VECTOR).groupBy("a").agg(F.sum("docs").alias("n"))
    pairs = stage(parts.filter(F.col("kind") == PAIR).groupBy("a", "b").agg(F.sum("docs").alias("n")), "alignment-pairs")
    # at most one row per A id each
    same, other = (df.toPandas() for df in (vector, pairs.groupBy("a").agg(F.max("n").alias("n"))))
    counts = np.zeros(max([0, *same["a"], *other["a"]]) + 1, "i8")
    counts[same["a"].to_numpy("i8")] = same["n"]
    highest = counts.copy()
    highest[other["a"].to_numpy("i8")] = np.maximum(highest[other["a"].to_numpy("i8")], other["n"])

    def add_same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [unpacked(x) for x in batch.column("same").to_pylist()]
            out = {name: batch.column(name) for name in batch.schema.names if name != "same"}
            yield pa.RecordBatch.from_pydict({
                **out, "count_sum": pa.array([int(counts[x].sum()) for x in held], pa.int64()),
                "n_best": pa.array([int((counts[x] == highest[x]).sum()) for x in held], pa.int64())})

    kept = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, other binary"
    summed = (parts.filter(F.col("kind") == DOCUMENT).select(*[c.split()[0] for c in kept.split(", ")], "same")
              .mapInArrow(add_same, f"{kept}, count_sum long, n_best long"))
    answers = parts.filter(F.col("kind") == PAIR).select("block", "at", "a", "b").join(pairs, ["a", "b"]).select("block", "at", "a", "n")

    def finish(found: pa.Table, answer: pa.Table) -> pa.Table:
        of_pair, best = np.zeros(len(answer), "i8"), np.zeros(len(answer), bool)
        if len(answer):
            at, n = answer["at"].to_numpy(), answer["n"].to_numpy()
            of_pair[at], best[at] = n, highest[answer["a"].to_numpy()] == n
        held = [unpacked(x) for x in found["other"].to_pylist()]
        sums = found["count_sum"].to_numpy() + np.array([of_pair[x].sum() for x in held], "i8")
        bests = found["n_best"].to_numpy() + np.array([best[x].sum() for x in held], "i8")
        return pa.table({**{c: found[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")},
                         "n_best": pa.array(bests, pa.int64()), "count_sum": pa.array(sums, pa.int64()), "groups_sha256": found["groups_sha256"]})

    return answered(summed, answers, finish, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
