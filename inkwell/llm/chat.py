"""Chat formatting by columnar byte assembly.

Rows come sorted by conversation and turn. For each batch the lengths of all
segments and their running sums give every header's and content's place in one
preallocated Arrow buffer, into which numpy scatters them. A turn reads
``<|im_start|>role\\ntext<|im_end|>\\n``.

Escaping is reversible: between the ``<`` and the ``|`` of ``<|`` one more
backslash is put (and of ``<\\|``, and so on), so no control string is left
inside a text. In roles a backslash is doubled and a line feed is ``\\n`` first.

Defined results: a null text or role is empty. Turns that tie are ordered by
role, then text; a null turn comes first; rows without a conversation id are one
conversation, whose id is null. An empty table gives no rows. Extra columns are
left out. A conversation is one output row, so its length must stay under 2 GB.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

START, END = "<|im_start|>", "<|im_end|>\n"
LEARNT_ROLE = "assistant"
SCHEMA = "conv_id bigint, n_turns bigint, formatted string, loss array<struct<start:int,end:int>>"
_LOSS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_BACK = re.compile(r"<\\(\\*)\|")
_ROLE_BACK = re.compile(r"\\(\\|n)")


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\1\\|")


def escape_roles(roles: pa.Array) -> pa.Array:
    return escape(pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n"))


def unescape(text: str) -> str:
    return _BACK.sub(r"<\1|", text) if "<\\" in text else text


def unescape_role(role: str) -> str:
    return _ROLE_BACK.sub(lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def _bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The strings' bytes one behind the other, and their lengths."""
    strings = pa.concat_arrays([strings.cast(pa.large_string())])
    ends = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int64)
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data, np.diff(ends)


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, lens: np.ndarray) -> None:
    """Put the segments of data, of these lengths, at these places of out."""
    if len(data):
        out[np.arange(len(data)) + np.repeat(at - (np.cumsum(lens) - lens), lens)] = data


def assemble(conv: pa.Array, role: pa.Array, text: pa.Array) -> pa.RecordBatch:
    """One row per conversation from the rows of whole conversations, in order."""
    n = len(conv)
    learnt = pc.equal(role, LEARNT_ROLE).to_numpy(zero_copy_only=False).astype(bool)
    roles, role_lens = _bytes(escape_roles(role))
    texts, text_lens = _bytes(escape(text))
    start, end = np.frombuffer(START.encode(), np.uint8), np.frombuffer(END.encode(), np.uint8)
    lens = len(start) + role_lens + 1 + text_lens + len(end)
    at = np.cumsum(lens) - lens
    out = np.empty(int(lens.sum()), np.uint8)
    out[at[:, None] + np.arange(len(start))] = start
    role_at = at + len(start)
    _scatter(out, role_at, roles, role_lens)
    out[role_at + role_lens] = 10
    text_at = role_at + role_lens + 1
    _scatter(out, text_at, texts, text_lens)
    out[(text_at + text_lens)[:, None] + np.arange(len(end))] = end

    firsts = np.flatnonzero(_changes(conv))
    bounds = np.append(firsts, n)
    begins = np.append(at[firsts], len(out))
    if (np.diff(begins) >= 1 << 31).any():
        raise ValueError("a conversation is longer than 2 GB")
    formatted = pa.LargeStringArray.from_buffers(len(firsts), pa.py_buffer(begins.astype(np.int64)), pa.py_buffer(out))
    own = np.repeat(begins[:-1], np.diff(bounds))
    loss = pa.StructArray.from_arrays([pa.array((text_at - own)[learnt].astype(np.int32)), pa.array((text_at - own + text_lens)[learnt].astype(np.int32))], names=["start", "end"])
    learnt_before = np.append(0, np.cumsum(learnt))[bounds]
    return pa.RecordBatch.from_arrays(
        [conv.take(pa.array(firsts)), pa.array(np.diff(bounds)), formatted.cast(pa.string()), pa.ListArray.from_arrays(pa.array(learnt_before.astype(np.int32)), loss).cast(_LOSS)],
        ["conv_id", "n_turns", "formatted", "loss"],
    )


def _changes(conv: pa.Array) -> np.ndarray:
    """True where a row's conversation is not that of the row before."""
    if not len(conv):
        return np.zeros(0, bool)
    null = conv.is_null().to_numpy(zero_copy_only=False)
    ids = conv.fill_null(0).to_numpy(zero_copy_only=False)
    return np.concatenate([[True], (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that end where a conversation ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            edge = pa.concat_arrays([held[-1].column(0).slice(held[-1].num_rows - 1), batch.column(0).slice(0, 1)])
            if _changes(edge)[1]:
                yield pa.Table.from_batches(held)
                held = []
        last = int(np.flatnonzero(_changes(batch.column(0)))[-1])
        if last and held:
            # The held conversation ends inside this batch.
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        elif last:
            yield pa.Table.from_batches([batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, n_turns, formatted, loss: byte ranges in ``formatted`` of the texts that are learnt."""
    rows = df.selectExpr(f"cast(`{conv_col}` as bigint) as conv_id", f"`{turn_col}` as turn", f"coalesce(cast(`{role_col}` as string), '') as role", f"coalesce(cast(`{text_col}` as string), '') as text")
    sorted_rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches):
        for t in _whole(batches):
            columns = [c.combine_chunks() for c in t.columns]
            yield assemble(*(c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks) for c in columns))

    return sorted_rows.mapInArrow(run, SCHEMA)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, as they were before formatting."""
    out = []
    for part in formatted.split(START)[1:]:
        role, text = part.split("\n", 1)
        out.append((unescape_role(role), unescape(text.removesuffix(END))))
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """The columns of the query, read from the formatted strings and their loss masks."""

    def run(batches):
        for b in batches:
            rows = []
            for conv, text, loss in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                turns, raw, learnt, chars = parse(text), text.encode(), sha256(), 0
                for r in loss:
                    own = unescape(raw[r["start"] : r["end"]].decode())
                    learnt.update(own.encode())
                    chars += len(own)
                rows.append((conv, len(turns), sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), chars, learnt.hexdigest(), len(text)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
