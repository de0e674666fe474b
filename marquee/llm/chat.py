"""Chat formatting from an event log.

Events (conv_id, the keys of a message, seq, kind, role, text) are folded per message in the order of seq (any type that sorts): ``start``
and ``edit`` set the text, ``delta`` appends to it, ``regenerate`` sets it and takes back all later messages that
began before it. A conversation's deltas are thus spread over tasks by message; only finished messages
meet, sorted, in one task per conversation, which streams them: a conversation with more than PART characters is
rendered in several consecutive parts, so memory is bounded by a part and a message.

Template: ``<|start|>role<|message|>text<|end|>`` and a line break per turn. Inside roles and texts every
backslash is doubled, and a backslash is put after the first character of every control string; no
control string is left then, and ``unescape`` gives back the text. The loss mask is a list of spans of the
rendered text that hold the assistant's texts and nothing else.

Defined results: null roles and texts are empty; an empty text is a turn. Rows of the same turn are all kept, in the
order of role and text; a null turn comes first. Rows without a conversation id form one conversation with a
null id. Other columns are not used; an empty log gives no row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, MESSAGE, END = "<|start|>", "<|message|>", "<|end|>\n"
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TURN = re.compile(r"<\|start\|>(.*?)<\|message\|>(.*?)<\|end\|>\n", re.DOTALL)
ESCAPED = re.compile(r"\\(\\?)")
LOSS_ROLE = "assistant"
#: Characters after which a conversation goes on in another part; characters of one streamed delta.
PART, DELTA = 8 << 20, 400
#: What a log with slips says before it is put right.
DRAFT = "draft <|end|> \\"
#: Characters of rendered text in one output batch, about.
BATCH = 2 << 20


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for control in CONTROL:
        text = text.replace(control, f"{control[0]}\\{control[1:]}")
    return text


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def turn_events(turns: DataFrame, slips: bool = False) -> DataFrame:
    """The log of finished turns (conv_id, turn, role, text): the assistant's texts as a stream of deltas, the others at once.

    Events are numbered by (turn, tie, i), so any turn number will do. ``slips`` writes a log in which things went
    wrong and were put right: other roles' texts are edited from a draft; the assistant begins a wrong answer, a later message follows
    it, and then the answer is regenerated, which takes that message back. What remains is the same.
    """
    tie = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    named = (turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
             .withColumn("tie", F.row_number().over(tie).cast("long")))

    def events(*of: tuple) -> Column:
        return F.array(*[F.struct(F.lit(kind).alias("kind"), (F.lit(text) if isinstance(text, str) else text).alias("text"), F.lit(later).alias("later"))
                         for kind, text, later in of])

    whole = events(("start", DRAFT, False), ("edit", F.col("text"), False)) if slips else events(("start", F.col("text"), False))
    begun = events(("start", "", False), ("delta", DRAFT, False), ("start", DRAFT, True), ("regenerate", "", False)) if slips else events(("start", "", False))
    deltas = F.concat(begun, F.transform(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{DELTA}}}"), F.lit(0)), lambda x: F.struct(
        F.lit("delta").alias("kind"), x.alias("text"), F.lit(False).alias("later"))))
    told = named.select("conv_id", "turn", "tie", "role", F.posexplode(F.when(F.col("role") == LOSS_ROLE, deltas).otherwise(whole)).alias("i", "e"))
    seq = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), "tie", "i")
    # the message to be taken back stands behind all that share the turn
    return told.select("conv_id", "turn", F.when(F.col("e.later"), F.col("tie") + (1 << 62)).otherwise(F.col("tie")).alias("tie"), seq.alias("seq"),
                       "e.kind", "role", "e.text")


def fold(events: DataFrame, message: tuple[str, ...] = ("turn", "tie")) -> DataFrame:
    """(conv_id, message keys, role, text) of the messages that remain, sorted within the tasks that hold them."""
    log = F.array_sort(F.collect_list(F.struct("seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    told = events.groupBy("conv_id", *message).agg(log.alias("log"))

    def last(*kinds: str):
        return F.array_max(F.transform(F.filter("log", lambda e: e["kind"].isin(*kinds)), lambda e: e["seq"]))

    folded = told.select(
        "conv_id", *message, F.col("log")[0]["seq"].alias("began"), F.col("log")[0]["role"].alias("role"), last("regenerate").alias("again"),
        F.array_join(F.transform(F.filter("log", lambda e: e["seq"] >= F.coalesce(last("start", "edit", "regenerate"), e["seq"])),
                                 lambda e: e["text"]), "").alias("text"))
    # The window sorts each conversation's messages in one task; the renderer reads them in that order.
    before = Window.partitionBy("conv_id").orderBy(*message).rowsBetween(Window.unboundedPreceding, -1)
    return (folded.withColumn("taken_back", F.coalesce(F.max("again").over(before) > F.col("began"), F.lit(False)))
            .filter("not taken_back").select("conv_id", *message, "role", "text"))


def render(messages: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, part, n_turns, formatted, loss): the rendered conversations, part after part, from what ``fold`` returns."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()),
                        ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, weight = [], 0
        open_id, number, n, at, text, loss = None, -1, 0, 0, [], []
        for batch in parts:
            for conv_id, role, message in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if number < 0 or conv_id != open_id or at >= part:
                    if number >= 0:
                        rows.append((open_id, number, n, "".join(text), loss))
                        weight += at
                    number = number + 1 if number >= 0 and conv_id == open_id else 0
                    open_id, n, at, text, loss = conv_id, 0, 0, [], []
                    if weight >= BATCH:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                        rows, weight = [], 0
                head, body = START + escape(role) + MESSAGE, escape(message)
                if role == LOSS_ROLE:
                    loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
                text += head, body, END
                at += len(head) + len(body) + len(END)
                n += 1
        if number >= 0:
            rows.append((open_id, number, n, "".join(text), loss))
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    return messages.select("conv_id", "role", "text").mapInArrow(
        write, "conv_id long, part long, n_turns long, formatted string, loss array<struct<start:long,end:long>>")


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a rendered text."""
    return [(unescape(role), unescape(text)) for role, text in TURN.findall(formatted)]


def read_back(rendered: DataFrame) -> DataFrame:
    """One row per conversation, from the rendered text alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, state = [], None  # of the conversation that is being read: its id, counts and hashes

        def closed():
            conv_id, turns, all_turns, chars, loss, size = state
            return conv_id, turns, all_turns.hexdigest(), chars, loss.hexdigest(), size

        for batch in parts:
            for conv_id, part, _, formatted, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part == 0:
                    if state:
                        done.append(closed())
                    state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(formatted):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for span in spans:
                    text = unescape(formatted[span["start"]:span["end"]])
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(formatted)
            if len(done) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
                done = []
        if state:
            done.append(closed())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)

    return rendered.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_turns(turns: DataFrame, part: int = PART, slips: bool = False) -> DataFrame:
    """Rendered conversations of finished turns, through the event log (``slips``: one with edits and regenerations)."""
    return render(fold(turn_events(turns, slips)), part)
