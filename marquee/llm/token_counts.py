"""Token counts by a two-tier lookup inside the scan.

First tier: a table of the most frequent pre-tokens and their numbers of tokens, broadcast. It is found
from all texts: each task keeps a bounded summary of its pre-tokens (when it is full, the rarer half
goes), measures the ones it hands on, and hands them on as one row. Summaries are merged in a tree by the numbers of their
tasks, some dozens at a time, each result as bounded as they are. The table has a fixed number of entries of bounded length.
Second tier: what a Python worker meets beyond the table is encoded once and remembered there, unless it is long. No
pre-token is a row of a shuffle, and the table changes the speed alone: counts are the library's with any table.

Null and empty texts have no token. Null ids stay null, repeated rows are counted each, other columns
are not used, an empty table gives no row, and a text may have any length.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import documents
from marquee.llm.pretokens import LONG, PreTokenizer

#: Entries of the first tier, of a task's summary while it reads, and of what it hands on.
FREQUENT, SUMMARY, HANDED_ON = 50_000, 400_000, 50_000
#: Summaries merged at a time, and levels of the tree: 32^3 tasks end in one merge of at most 32, a million in one of 31.
FAN_IN, LEVELS = 32, 3
SUMMARY_DDL = "task long, pieces array<string>, n array<long>, tokens array<int>"
OVER = 1024


_counters: dict[str, PreTokenizer] = {}


def worker_counter(run: str, tokenizer: str, known: Broadcast) -> PreTokenizer:
    """One per Python worker and run, so that later tasks find what earlier ones have encoded."""
    if run not in _counters:
        _counters.clear()
        pieces, tokens = known.value
        _counters[run] = PreTokenizer(tokenizer, words=False, value=len, known=dict(zip(pieces.to_pylist(), tokens.tolist(), strict=True)))
    return _counters[run]


def _row(task: int, seen: Counter, tokens: dict[str, int], entries: int) -> pa.RecordBatch:
    """A summary as one row, most frequent first, equal ones in order."""
    top = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:entries]
    columns = [task], [[p for p, _ in top]], [[n for _, n in top]], [[tokens[p] for p, _ in top]]
    types = pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["task", "pieces", "n", "tokens"])


def _shortened(seen: Counter) -> Counter:
    return Counter(dict(seen.most_common(SUMMARY // 2))) if len(seen) > SUMMARY else seen


def frequent_pretokens(docs: DataFrame, tokenizer: str, entries: int = FREQUENT) -> DataFrame:
    """(pieces, tokens): one row with the most frequent pre-tokens of all texts and their numbers of tokens; none for an empty table."""

    def summarise(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, seen = PreTokenizer(tokenizer, words=False, value=len), Counter()
        for batch in parts:
            for text in batch.column(0):
                if cutter.plain(text := text.as_py()):
                    seen.update(p for p in cutter.cut(text) if len(p) <= LONG)
                seen = _shortened(seen)
        kept = Counter(dict(seen.most_common(HANDED_ON)))
        yield _row(TaskContext.get().partitionId(), kept, {p: cutter.piece(p) for p in kept}, HANDED_ON)

    def merge(summaries: pa.Table) -> pa.Table:
        seen, tokens = Counter(), {}
        for pieces, n, measured in zip(*(summaries[c] for c in ("pieces", "n", "tokens")), strict=True):
            pieces = pieces.as_py()
            seen.update(dict(zip(pieces, n.as_py(), strict=True)))
            tokens.update(zip(pieces, measured.as_py(), strict=True))
            seen = _shortened(seen)
        return pa.Table.from_batches([_row(summaries["task"][0].as_py() // FAN_IN, seen, tokens, max(HANDED_ON, entries))])

    tree = documents(docs).select("text").mapInArrow(summarise, SUMMARY_DDL)
    for _ in range(LEVELS):
        tree = tree.groupBy(F.floor(F.col("task") / FAN_IN)).applyInArrow(merge, SUMMARY_DDL)
    tree = tree.groupBy(F.col("task") < 0).applyInArrow(merge, SUMMARY_DDL)  # all of them
    return tree.select(F.slice("pieces", 1, entries).alias("pieces"), F.slice("tokens", 1, entries).alias("tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, over: int = OVER, entries: int = FREQUENT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    first = frequent_pretokens(docs, tokenizer, entries).first()  # at most ``entries`` pre-tokens of bounded length
    run = uuid.uuid4().hex
    pieces, tokens = (first.pieces, first.tokens) if first else ([], [])
    known = docs.sparkSession.sparkContext.broadcast((pa.array(pieces, pa.string()), np.array(tokens, "<u2")))

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(run, tokenizer, known)
        for batch in parts:
            counts = []
            for text in batch.column(1):
                text = text.as_py()
                counts.append(sum(counter.values(text)) if counter.plain(text) else len(counter.whole(text)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    sized = documents(docs).select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    return (sized.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > over))
