r"""Operator 8: chat formatting by columnar byte assembly.

The turns of a task come sorted by conversation. For a block of turns, the lengths of headers,
escaped texts and footers give each piece's place in one preallocated buffer; three scatters copy
the pieces into it, and the buffer becomes the Arrow column of formatted conversations. The loss
mask is the list of byte ranges of the assistant's texts.

Template (one line each): ``<s>[INST] text [/INST]</s>`` for a user, ``<s><<SYS>> text <</SYS>></s>``
for a system turn, ``<s> text </s>`` for the assistant, ``<s>[ROLE] role [/ROLE] text </s>`` for any
other role. A control string inside a text or role gets one more backslash before it and the
backslashes that stand there already, so reading drops one and gives back what was there.

A conversation is one value, so its turns meet in one task, in order. They are worked on in blocks
of ``BLOCK_BYTES``: a conversation of any length comes out in parts that follow each other, and is
never held whole.

Defined results: null texts and roles are empty; turns that repeat a number are ordered by role and
text, and all stay; null turn numbers come first; a null conversation is one of its own; empty tables
give empty results; other columns are not read and may have any names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tidegate.llm.common import offsets, ragged

BLOCK_BYTES = 8 << 20

_CONTROL = r"</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\]"
_ESCAPE = rf"(\\*(?:{_CONTROL}))"
_ESCAPED = re.compile(rf"\\(\\*(?:{_CONTROL}))")
_TURN = re.compile(
    r"<s>(?:\[INST\] (?P<user>.*?) \[/INST\]|<<SYS>> (?P<system>.*?) <</SYS>>"
    r"|\[ROLE\] (?P<role>.*?) \[/ROLE\] (?P<text>.*?) | (?P<assistant>.*?) )</s>\n", re.S)
_FRAMES = {"user": (b"<s>[INST] ", b" [/INST]</s>\n"), "system": (b"<s><<SYS>> ", b" <</SYS>></s>\n"),
           "assistant": (b"<s> ", b" </s>\n")}
_LOSS = ArrayType(StructType().add("start", "long").add("end", "long"))


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, _ESCAPE, r"\\\1")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _frame(role: str) -> tuple[bytes, bytes]:
    other = escape(pa.array([role]))[0].as_py().encode()
    return _FRAMES.get(role) or (b"<s>[ROLE] " + other + b" [/ROLE] ", b" </s>\n")


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The formatted turns in one buffer, where each ends (from 0), where its text starts, and the text's bytes."""
    coded = pc.fill_null(roles, "").dictionary_encode()
    names = coded.dictionary.to_pylist()
    code = coded.indices.to_numpy()
    heads, tails = zip(*map(_frame, names)) if names else ((), ())
    body = escape(pc.fill_null(texts, "")).cast(pa.large_string())
    bounds = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + len(body) + 1]
    n_body = np.diff(bounds)
    head_at, tail_at = offsets(np.array([len(h) for h in heads])), offsets(np.array([len(t) for t in tails]))
    n_head, n_tail = np.diff(head_at)[code], np.diff(tail_at)[code]
    ends = offsets(n_head + n_body + n_tail)
    start = ends[:-1] + n_head
    out = np.empty(int(ends[-1]), np.uint8)
    for at, n, source, source_at in ((ends[:-1], n_head, b"".join(heads), head_at[code]),
                                     (start + n_body, n_tail, b"".join(tails), tail_at[code])):
        out[ragged(at, n)] = np.frombuffer(source, np.uint8)[ragged(source_at, n)]
    if bounds[-1] > bounds[0]:
        out[ragged(start, n_body)] = np.frombuffer(body.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    return out, ends, start, n_body


def format_conversations(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text") -> DataFrame:
    """``conv``, ``part``, ``n_turns``, ``formatted`` (bytes of UTF-8) and ``loss`` (byte ranges in it).

    Parts of a conversation follow each other in one partition; nearly all conversations have one.
    """
    schema = (turns.select(turns[conv]).schema.add("part", "long").add("n_turns", "long").add("formatted", "binary")
              .add("loss", _LOSS))

    def emit(rows: pa.Table, part: int) -> pa.RecordBatch:
        """The conversations in the rows; ``part`` counts for the first of them."""
        ids, roles, texts = (rows.column(i).combine_chunks() for i in (0, 2, 3))
        out, ends, start, n_body = assemble(roles, texts)
        new = np.flatnonzero(_changes(ids))
        bounds = np.append(new, len(ids))
        mine = np.flatnonzero(pc.fill_null(pc.equal(roles, "assistant"), False).to_numpy(zero_copy_only=False))
        base = ends[new][np.searchsorted(new, mine, side="right") - 1]
        loss = pa.StructArray.from_arrays([pa.array(start[mine] - base), pa.array(start[mine] - base + n_body[mine])],
                                          names=["start", "end"])
        formatted = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(new), [None, pa.py_buffer(ends[bounds].copy()), pa.py_buffer(out)])
        parts = np.zeros(len(new), np.int64)
        parts[0] = part
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(new)), pa.array(parts), pa.array(np.diff(bounds)), formatted.cast(pa.binary()),
             pa.ListArray.from_arrays(pa.array(np.searchsorted(mine, bounds), pa.int32()), loss)], names=schema.names)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, part = [], 0, 0
        for batch in rows:
            held.append(batch)
            size += batch.nbytes
            if size < BLOCK_BYTES:
                continue
            block = pa.Table.from_batches(held)
            cut = int(np.flatnonzero(_changes(block.column(0).combine_chunks()))[-1])
            if cut:  # the last conversation may go on
                yield emit(block.slice(0, cut), part)
                held, part = [pa.RecordBatch.from_arrays([c.combine_chunks() for c in block.slice(cut).columns],
                                                         names=block.schema.names)], 0
                size = held[0].nbytes
            else:
                yield emit(block, part)
                last = block.column(0)[-1]
                held, size, part = [], 0, part + 1
                batch = next(rows, None)
                if batch is not None:
                    if batch.column(0)[0] != last:
                        part = 0
                    held, size = [batch], batch.nbytes
        if held:
            yield emit(pa.Table.from_batches(held), part)

    ordered = (turns.select(turns[conv].alias("conv"), turns[turn].alias("turn"), turns[role].alias("role"), turns[text].alias("text"))
               .repartition("conv").sortWithinPartitions("conv", "turn", "role", "text"))
    return ordered.mapInArrow(run, schema)


def _changes(ids: pa.Array) -> np.ndarray:
    """Where another conversation begins, the first included."""
    codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.diff(codes, prepend=-1) != 0


def turns_in(formatted: str) -> Iterator[tuple[str, str]]:
    """Roles and texts, read back from formatted text."""
    for m in _TURN.finditer(formatted):
        kind = m.lastgroup
        role = unescape(m["role"]) if kind == "text" else kind
        yield role, unescape(m[kind])


def read_back(formatted: DataFrame, *, conv: str = "conv_id") -> DataFrame:
    """What a reader of the formatted parts finds, as counts and digests of each conversation."""
    schema = (formatted.select(conv).schema.add("n_turns", "long").add("turns_sha256", "string").add("loss_chars", "long")
              .add("loss_sha256", "string").add("formatted_chars", "long"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def close() -> list:
            own, n, turns, loss_n, loss, size = state
            return [own, n, turns.hexdigest(), loss_n, loss.hexdigest(), size]

        for batch in rows:
            done = []
            for own, part, body, loss in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
                if part == 0:
                    if state:
                        done.append(close())
                    state = [own, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = body.decode()
                for role, said in turns_in(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = unescape(body[span["start"] : span["end"]].decode())
                    state[3] += len(said)
                    state[4].update(said.encode())
                state[5] += len(text)
            yield _as_batch(done, batch.schema.field(0).type, schema.names)
        if state:
            yield _as_batch([close()], batch.schema.field(0).type, schema.names)

    return formatted.mapInArrow(run, schema)


def _as_batch(rows: list[list], id_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
    types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
