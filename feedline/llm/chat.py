"""Chat formatting by columnar byte assembly.

A conversation is the concatenation of its turns.  An assistant turn is
``<s>role\\ntext</s>``, any other ``[INST] role\\ntext[/INST]``.  Inside a role
or text a backslash goes before each backslash and before each control string
(``<s> </s> [INST] [/INST]``), in a role before a line feed too; dropping one
backslash each gives the text back.  The loss mask covers the texts of
assistant turns, escapes included, and nothing else.

For each slice of rows numpy computes which bytes need an escape, the length of
every segment, their cumulative offsets and the place of every byte; headers,
contents and ends are then copied into one preallocated Arrow buffer.

Rows are range-partitioned by conversation and turn, so a conversation may run
over many slices and tasks: the output has one row per conversation and slice
(``part`` orders them), and memory holds one slice whatever the length of a
conversation.

Turns of one conversation are ordered by turn, then role, then text, nulls
first.  A null role or text is empty; rows without a conversation id are one
conversation without id; repeated rows are repeated turns.  An empty table gives
an empty table; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import frugal, slices, text_bytes

ASSISTANT = "assistant"
CONTROL = re.compile(rb"</?s>|\[/?INST\]")
ESCAPE = ord("\\")
#: Formatted bytes assembled at a time.
SLICE = 4 << 20

FORMATTED = "conv_id long, part long, n_turns long, formatted string, loss array<struct<start:long,end:long>>"


def _inner(role: str) -> bytes:
    raw = CONTROL.sub(lambda m: b"\\" + m[0], role.encode().replace(b"\\", b"\\\\"))
    return raw.replace(b"\n", b"\\\n")


def _frame(role: str) -> tuple[bytes, bytes]:
    if role == ASSISTANT:
        return b"<s>" + _inner(role) + b"\n", b"</s>"
    return b"[INST] " + _inner(role) + b"\n", b"[/INST]"


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of each range, one after the other."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())


def assemble(roles: list[str], buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Formatted bytes of some turns, the n + 1 offsets of their segments, and the byte range of each text in them."""
    n = len(roles)
    kinds = list(dict.fromkeys(roles))
    frames = [_frame(r) for r in kinds]
    kind = np.fromiter(map({r: i for i, r in enumerate(kinds)}.__getitem__, roles), np.int64, n)
    # bytes before which an escape goes
    mark = buf == ESCAPE
    hits = np.array([m.span() for m in CONTROL.finditer(buf.tobytes())], np.int64).reshape(-1, 2)
    own = np.searchsorted(offs, hits[:, 0], "right")
    mark[hits[hits[:, 1] <= offs[np.minimum(own, n)], 0]] = True  # not across two texts
    shift = np.concatenate([[0], np.cumsum(mark)])
    sizes = [np.array([len(f[i]) for f in frames], np.int64) for i in (0, 1)]
    head, tail = (s[kind] for s in sizes)
    body = np.diff(offs) + shift[offs[1:]] - shift[offs[:-1]]
    seg = np.concatenate([[0], np.cumsum(head + body + tail)])
    out = np.empty(seg[-1], np.uint8)
    text0 = seg[:-1] + head
    # where each byte of a text goes: its segment's text, its place there, the escapes up to it
    place = np.arange(len(buf)) + shift[1:]
    place += np.repeat(text0 - offs[:-1] - shift[offs[:-1]], np.diff(offs))
    out[place] = buf
    out[place[mark] - 1] = ESCAPE
    for i, at, size in ((0, seg[:-1], head), (1, text0 + body, tail)):
        flat = np.frombuffer(b"".join(f[i] for f in frames), np.uint8)
        first = np.cumsum(sizes[i]) - sizes[i]
        out[_ranges(at, size)] = flat[_ranges(first[kind], size)]
    return out, seg, text0, text0 + body


def format_conversations(turns: DataFrame, partitions: int | None = None) -> DataFrame:
    """``conv_id, part, n_turns, formatted, loss`` of ``turns(conv_id, turn, role, text)``.

    A conversation's text is its ``formatted`` in the order of ``part``;
    ``loss`` holds ranges of code points of ``formatted``.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = partitions or int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 33
        for b in batches:
            buf, offs = text_bytes(b.column("text"))
            roles, conv = b.column("role").to_pylist(), b.column("conv_id")
            for lo, hi in slices(offs, SLICE):
                out, seg, t0, t1 = assemble(roles[lo:hi], buf[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
                ids = conv.slice(lo, hi - lo)
                key, null = ids.fill_null(0).to_numpy(), np.asarray(ids.is_null())
                cut = np.flatnonzero((key[1:] != key[:-1]) | (null[1:] != null[:-1])) + 1
                first = np.concatenate([[0], cut]).astype(np.int64)
                ends = np.concatenate([cut, [hi - lo]]).astype(np.int64)
                chars = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])  # code points before each byte
                said = np.fromiter((r == ASSISTANT for r in roles[lo:hi]), bool, hi - lo)
                base = chars[np.repeat(seg[first], ends - first)]
                start, end = (chars[t] - base for t in (t0, t1))
                loss = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(said)])[np.append(first, hi - lo)], pa.int32()),
                    pa.StructArray.from_arrays([pa.array(start[said]), pa.array(end[said])], ["start", "end"]))
                text = pa.StringArray.from_buffers(len(first), pa.py_buffer(seg[np.append(first, hi - lo)].astype(np.int32)), pa.py_buffer(out))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(first)), pa.array(part + np.arange(len(first))), pa.array(ends - first), text, loss],
                    ["conv_id", "part", "n_turns", "formatted", "loss"])
                part += len(first)

    return rows.mapInArrow(frugal(scan), FORMATTED)


TURN = re.compile(r"""
    \[INST\]\ (?P<role> (?: [^\\\n]++ | \\. )*+ )\n (?P<text> (?: [^\\\[]++ | \\. | \[(?!/INST\]) )*+ ) \[/INST\]
  | <s>(?P<arole> (?: [^\\\n]++ | \\. )*+ )\n (?P<atext> (?: [^\\<]++ | \\. | <(?!/s>) )*+ ) </s>
""", re.S | re.X)
_ESCAPED = re.compile(r"\\(.)", re.S)


def plain(text: str) -> str:
    """A role or text without its escapes."""
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def parse(formatted: str) -> list[tuple[str, str]]:
    """``(role, text)`` of each turn of a formatted text."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at code point {at}")
        role, text = (m["role"], m["text"]) if m["role"] is not None else (m["arole"], m["atext"])
        out.append((plain(role), plain(text)))
        at = m.end()
    return out


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from ``format_conversations``.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``:
    digests of all turns (role, line feed, text, line feed) and of the text under
    the loss mask, both without escapes.  Parts stream through in order, so a
    task holds one part and two hash states.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = object(), None, []

        def close():
            done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flush():
            cols = list(zip(*done)) if done else [[]] * 6
            done.clear()
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [f.split()[0] for f in schema.split(", ")])

        for b in batches:
            for conv, text, loss in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))):
                if state is None or conv != now:
                    if state is not None:
                        close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = parse(text)
                state[0] += len(turns)
                state[1].update("".join(f"{r}\n{t}\n" for r, t in turns).encode())
                said = "".join(plain(text[x["start"]:x["end"]]) for x in loss)
                state[2] += len(said)
                state[3].update(said.encode())
                state[4] += len(text)
            if done:
                yield flush()
        if state is not None:
            close()
            yield flush()

    return formatted.select("conv_id", "part", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(frugal(scan), schema)
