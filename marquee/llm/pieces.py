"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the model has a white space marker behind another character, so merges never reach over the place
before a run of markers. Texts are cut there into chunks (the markers and the word behind them). A task takes its documents in blocks of
bounded size; the distinct chunks of a block that the worker's table lacks are segmented together, each once, by the library,
and every document's ids are joined from the table by position and decoded by the library. Nothing is shuffled or written. A model that has a
piece across such a place, or whose normalisation changes more than blanks, is refused.

The table is bounded: beyond REMEMBERED chunks it starts anew, and chunks longer than LONG last for one block. (One table for all
tasks was built first: blocks' distinct chunks met it in a shuffle and came back by position. It gave the same ids, but where most
words are rare it moves more than the texts: 4.7 times the input on disk, against a limit of 1.5.)

Null and empty texts have no ids and decode to ''. Null ids stay null, repeated rows are encoded each, other columns are not used, an
empty table gives no row. A text without blanks is one chunk, whatever its length.
"""

from __future__ import annotations

import array
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import SentencePieceProcessor

from marquee.llm.blocks import blocks
from marquee.llm.common import documents

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Texts by which a model's normalisation is probed: it must leave them as they are.
PROBES = ("a  b ", " x", "ﬁ①Å é́ ｱ　\t\n", "A b​c")
#: Chunks that a worker remembers, and the longest of them, in characters. Bytes of a block's texts.
REMEMBERED, LONG, BLOCK = 300_000, 100, 2 << 20
OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.binary()), ("decoded", pa.string())])


@lru_cache(maxsize=2)
def library(path: str) -> SentencePieceProcessor:
    return SentencePieceProcessor(model_file=path)


def check_model(path: str) -> None:
    """ValueError if texts can't be cut at white space for this model."""
    model = library(path)
    if any(re.search(f"[^{MARK}]{MARK}", model.id_to_piece(i)) for i in range(model.vocab_size())):
        raise ValueError("the model has pieces across white space")
    if any(model.decode(model.encode(t)) != t for t in PROBES):
        raise ValueError("the model's normalisation changes texts")


def cut(text: str) -> list[str]:
    """The chunks of a text, each without its first marker and with blanks for the others."""
    if not text:
        return []
    if MARK not in text:
        words = text.split(" ")
        if "" not in words:
            return words
    return [c[1:].replace(MARK, " ") for c in CHUNK.findall(MARK + text.replace(" ", MARK))]


@lru_cache(maxsize=2)
def marker_alone(path: str) -> bytes:
    """The ids of a marker with nothing behind it, which the library gives for no text that is cut as ``cut`` does."""
    model = library(path)
    found = model.piece_to_id(MARK)
    ids = [found] if found != model.unk_id() else [model.piece_to_id(f"<0x{b:02X}>") for b in MARK.encode()]
    return array.array("I", ids).tobytes()


class ChunkTable:
    """Distinct chunks and their ids (unsigned 32-bit) in one Python worker."""

    def __init__(self, path: str):
        self.path, self.ids = path, {"": marker_alone(path)}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of a block of texts. What the table lacks is segmented in one call; the library puts a marker before each chunk."""
        if len(self.ids) > REMEMBERED:
            self.ids = {"": marker_alone(self.path)}
        known, chunks = self.ids, [cut(t) for t in texts]
        new = list(set().union(*chunks).difference(known))
        for chunk, ids in zip(new, library(self.path).encode(new, num_threads=1), strict=True):
            known[chunk] = array.array("I", ids).tobytes()
        joined = [b"".join([known[c] for c in cs]) for cs in chunks]
        for chunk in new:
            if len(chunk) > LONG:
                del known[chunk]
        return joined


@lru_cache(maxsize=2)
def chunk_table(path: str) -> ChunkTable:
    """One per Python worker, so that later tasks find what earlier ones have segmented."""
    return ChunkTable(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, ids (binary, unsigned 32-bit little-endian), decoded."""
    check_model(path)

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = library(path), chunk_table(path)
        names = list(map(str, range(model.vocab_size())))
        for _, doc_ids, texts in blocks(parts, BLOCK):
            joined = table.encode(texts)
            ids = [np.frombuffer(data, "<u4").tolist() for data in joined]
            decoded = [model.decode(i) if i else "" for i in ids]
            columns = (doc_ids, map(len, ids), (hashlib.sha256(",".join([names[i] for i in found]).encode()).hexdigest() for found in ids),
                       (hashlib.sha256(d.encode()).hexdigest() for d in decoded), joined, decoded)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, OUT.types, strict=True)], schema=OUT)

    return documents(docs).mapInArrow(read, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary, decoded string")
