"""Blocks of documents, whose rows ask a distributed table once per distinct key of the block.

A task cuts its documents into blocks of a bounded number of bytes. A block's distinct keys are numbered and become
rows, and its documents name keys by number. The key rows meet the table in a shuffle; the answers meet the block's documents in a second one.
What moves per key is one row per block, not one per occurrence, and a task holds one block at a time (or one
document, if that is longer). A key that is in every block has as many rows as there are blocks, which Spark may split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Bytes of text (at least 64 for a row) after which a block ends.
BLOCK_BYTES = 4 << 20


def blocks(parts: Iterator[pa.RecordBatch], size: int = BLOCK_BYTES) -> Iterator[tuple[int, list, list]]:
    """(number, ids, texts) of the blocks of a task's (doc_id, text) batches. Numbers are unique over all tasks of a job."""
    number, ids, texts, weight = TaskContext.get().partitionId() << 32, [], [], 0
    for batch in parts:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(doc_id.as_py())
            texts.append(text.as_py())
            weight += 64 + len(texts[-1])
            if weight >= size:
                yield number, ids, texts
                number, ids, texts, weight = number + 1, [], [], 0
    if ids:
        yield number, ids, texts


def packed(numbers: np.ndarray) -> bytes:
    """Numbers as bytes, two for each where all allow it, else four; the first byte says which."""
    narrow = not len(numbers) or numbers.max() < 1 << 16
    return (b"\2" if narrow else b"\4") + numbers.astype("<u2" if narrow else "<u4").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[:1] == b"\2" else "<u4", offset=1)


def rows(schema: pa.Schema, columns: dict, n: int) -> pa.RecordBatch:
    """A batch of ``n`` rows; columns that are not given are null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def answered(docs: DataFrame, answers: DataFrame, finish: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``finish`` of each block's documents and answers, both with the column block."""
    return docs.groupBy("block").cogroup(answers.withColumnRenamed("block", "of_block").groupBy("of_block")).applyInArrow(finish, schema)
