"""Chat formatting with offset-aligned loss masks.

A conversation's turns are rendered by a template that marks where turns, roles and
texts begin and end; control strings inside roles and texts are escaped reversibly.
The rendering is encoded once, with offsets, which a byte-level tokenizer's tokens
give by the bytes that each stands for; a token is under the loss mask if
its characters meet the span of an assistant's text, which a binary search in the
sorted spans tells.  Control strings are special tokens, so no token crosses the
edge of a text.

Rows are dealt by conversation and sorted there; a task keeps one segment at a
time: a conversation longer than ``SEGMENT`` characters is rendered and
encoded in segments that end with a turn, which gives the same tokens, as none
crosses a control string.  So a very long conversation takes time in its task, not memory.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.scratch import filesystem

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Largest tokenizer file that is sent to the workers.
TOKENIZER_BYTES = 32 << 20
SEGMENT = 1 << 20

# The template's control strings: start of a conversation, of a role, of a text, end of a turn.
START, ROLE, TEXT, END = "<s>", "[INST]", "[/INST]", "</s>"
_CONTROL = r"(?=s>|/s>|INST\]|/INST\])"
_ESCAPE = re.compile(rf"([<\[])(\\*){_CONTROL}")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*){_CONTROL}")
_TURN = re.compile(rf"{re.escape(ROLE)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.DOTALL)
LEARNED_ROLE = "assistant"

_FORMATTED = "conv_id long, segment int, formatted string, n_turns int, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss array<boolean>"


def escape(text: str) -> str:
    """``text`` without control strings: one backslash more after the first character of each that it has."""
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def render(turns: list[tuple[str, str]], first: bool = True) -> tuple[str, np.ndarray]:
    """The rendering of (role, text) turns and the spans (start, end) of the learned texts in it."""
    parts, spans, at = [START] if first else [], [], len(START) * first
    for role, text in turns:
        head, body = f"{ROLE}{escape(role)}{TEXT}", escape(text)
        if role == LEARNED_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Whether each token meets one of the sorted, disjoint ``spans``."""
    spans = spans[spans[:, 0] < spans[:, 1]]
    if not len(spans):
        return np.zeros(len(starts), bool)
    k = np.minimum(np.searchsorted(spans[:, 1], starts, "right"), len(spans) - 1)
    return (starts < spans[k, 1]) & (ends > spans[k, 0]) & (starts < ends)


def read_back(formatted: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> tuple[list[tuple[str, str]], list[str]]:
    """The turns of a rendering, and the texts under its mask, unescaped."""
    turns = [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]
    masked = []
    which = np.flatnonzero(loss)
    if len(which):
        a, b = starts[which], np.maximum.accumulate(ends[which])
        new = np.concatenate([[True], a[1:] > b[:-1]])
        last = np.append(np.flatnonzero(new)[1:], len(which)) - 1
        masked = [unescape(formatted[x:y]) for x, y in zip(a[new].tolist(), b[last].tolist(), strict=True)]
    return turns, masked


_loaded: dict[int, tuple] = {}


def _tokenizer(data: str):
    """The tokenizer of this worker, with the template's control strings as special tokens; and the bytes that each token stands for."""
    key = hash(data)
    if key not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer

        tokenizer = Tokenizer.from_str(data)
        tokenizer.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (START, ROLE, TEXT, END)])
        added = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
        vocabulary = tokenizer.get_vocab()
        sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            sizes[number] = len(token.encode()) if token in added else len(token)  # a character of the vocabulary is a byte
        _loaded[key] = tokenizer, sizes
    return _loaded[key]


def offsets(text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points at which the tokens of ``text`` start and end, from the bytes of each; a character that tokens share is in all of them."""
    raw = np.frombuffer(text.encode(), np.uint8)
    ends = np.cumsum(sizes)
    if (int(ends[-1]) if len(ends) else 0) != len(raw):
        raise ValueError("the tokenizer isn't a byte-level one: its tokens don't make up the text")
    character = np.cumsum((raw & 0xC0) != 0x80) - 1
    return character[ends - sizes].astype(np.int32), (character[ends - 1] + 1).astype(np.int32)


def _format(shared, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, sizes = _tokenizer(shared.value)
        ready: list[tuple[int | None, int, str, int, np.ndarray]] = []
        turns: list[tuple[str, str]] = []
        current: object = run  # no conversation yet
        number, size, held = 0, 0, 0

        def close() -> None:
            nonlocal turns, number, size, held
            text, spans = render(turns, number == 0)
            ready.append((current, number, text, len(turns), spans))
            held += len(text)
            turns, number, size = [], number + 1, 0

        def encoded() -> pa.RecordBatch:
            nonlocal ready, held
            codes = [c.ids for c in tokenizer.encode_batch_fast([r[2] for r in ready], add_special_tokens=False)]
            bounds = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int32)
            lists = lambda flat, kind: pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat, kind))
            ids = np.fromiter(chain.from_iterable(codes), np.int32, int(bounds[-1]))
            starts, ends = (np.concatenate(x) for x in zip(*(offsets(r[2], sizes[ids[a:b]]) for a, b, r in zip(bounds[:-1], bounds[1:], ready, strict=True)), strict=True))
            out = pa.RecordBatch.from_pydict({
                "conv_id": pa.array([r[0] for r in ready], pa.int64()), "segment": pa.array([r[1] for r in ready], pa.int32()), "formatted": [r[2] for r in ready], "n_turns": pa.array([r[3] for r in ready], pa.int32()),
                "token_ids": lists(ids, pa.int32()), "token_starts": lists(starts, pa.int32()), "token_ends": lists(ends, pa.int32()),
                "loss": lists(np.concatenate([loss_mask(starts[a:b], ends[a:b], r[4]) for a, b, r in zip(bounds[:-1], bounds[1:], ready, strict=True)]), pa.bool_()),
            })
            ready, held = [], 0
            return out

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if current is run or conv != current or size >= segment:
                    if turns:
                        close()
                    if current is run or conv != current:
                        current, number = conv, 0
                    if held >= segment:
                        yield encoded()
                turns.append((role or "", text or ""))
                size += len(text or "") + len(role or "")
        if turns:
            close()
        if ready:
            yield encoded()

    return run


def format_chats(turns: DataFrame, tokenizer: str = TOKENIZER, segment: int = SEGMENT) -> DataFrame:
    """Rendered and encoded conversations: conv_id, segment, formatted, n_turns, token_ids, token_starts, token_ends, loss.

    Takes ``conv_id``, ``turn``, ``role`` and ``text``; other columns are ignored.  Rows of a
    conversation follow each other by turn, then role, then text (null first).  Null roles
    and texts count as empty; rows of a null conv_id make a conversation of their own;
    repeated rows are turns of their own; an empty table gives no rows.  ``segment`` counts from 0
    and is above 0 for the parts of a very long conversation alone; parts follow each other in order.
    ``tokenizer`` is the path of a byte-level tokenizer file of the tokenizers library.
    """
    spark = turns.sparkSession
    path = tokenizer if re.match(r"\w+:", tokenizer) else f"file://{tokenizer}"
    fs, p = filesystem(spark, path)
    if fs.getFileStatus(p).getLen() > TOKENIZER_BYTES:
        raise ValueError(f"{tokenizer} is larger than {TOKENIZER_BYTES} bytes")
    data = spark.sparkContext.wholeTextFiles(path).first()[1] if not os.path.exists(tokenizer) else open(tokenizer, encoding="utf-8").read()
    shared = spark.sparkContext.broadcast(data)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(_format(shared, segment), _FORMATTED)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    state = None

    def close() -> None:
        conv, n, turns, chars, loss, size = state
        rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))

    def out() -> pa.RecordBatch:
        names = [c.split()[0] for c in _DIGEST.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for batch in batches:
        segment, conv = batch.column("segment").to_pylist(), batch.column("conv_id").to_pylist()
        tokens = {c: (batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy(zero_copy_only=False)) for c in ("token_starts", "token_ends", "loss")}
        for k, formatted in enumerate(batch.column("formatted").to_pylist()):
            if segment[k] == 0:
                if state:
                    close()
                state = [conv[k], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            turns, masked = read_back(formatted, *(values[at[k] : at[k + 1]] for at, values in tokens.values()))
            state[1] += len(turns)
            for role, text in turns:
                state[2].update(f"{role}\n{text}\n".encode())
            for text in masked:
                state[3] += len(text)
                state[4].update(text.encode())
            state[5] += len(formatted)
        if len(rows) >= 1000:
            yield out()
            rows = []
    if state:
        close()
    if rows:
        yield out()


def digests(formatted: DataFrame) -> DataFrame:
    """What ``format_chats`` has rendered and masked, read back from its output: one row a conversation.

    turns_sha256 is of role, newline, text, newline for each turn; loss_sha256 and
    loss_chars of all texts under the mask.  It reads the segments in the order in
    which ``format_chats`` gives them, so it takes its output as it is.
    """
    return formatted.select("conv_id", "segment", "formatted", "token_starts", "token_ends", "loss").mapInArrow(_digest, _DIGEST)
