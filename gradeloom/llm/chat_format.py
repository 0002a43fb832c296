"""Chat formatting by columnar byte assembly.

A conversation's turns become one string, in the order of their turns:

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

Inside texts and roles each ``<`` followed by any number of ``!`` and ``|im_``
gets one more ``!``, so no text can hold a mark, and removing one ``!`` gives
the text back. A role's ``%`` and newline are written ``%25`` and ``%0A``.

Bytes are assembled per Arrow batch: segment lengths, their cumulative offsets
and a scatter index per byte are computed in numpy; headers and contents are
copied into one preallocated buffer, which becomes the Arrow string column.

Defined cases: null role or text is empty. Turns are ordered by (turn, role,
text), null first, so ties and repeated rows have one order and each is a turn.
Rows with a null conversation id are one conversation. An empty table gives an
empty table. Columns other than the four are ignored. A conversation is one
output value, so its turns meet in one task; nothing else of its size is held.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.shared import bounded_batches

START, END = "<|im_start|>", "<|im_end|>\n"
_MARK = re.compile(r"<(!*)\|im_")
_ESCAPED = re.compile(r"<!(!*)\|im_")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return _MARK.sub(r"<!\1|im_", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|im_", text)


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    return [(unescape_role(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Data, begins and lengths of a large_string array without nulls, without a copy."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, ends[:-1], np.diff(ends)


def _scatter(out: np.ndarray, at: np.ndarray, raw: np.ndarray, begin: np.ndarray, length: np.ndarray, block: int = 1 << 22) -> None:
    """Copy the segments raw[begin:begin+length] to out[at:...], with indices for about ``block`` bytes at a time."""
    total = np.cumsum(length)
    i = 0
    while i < len(length):
        done = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, done + block, side="right")))
        if j == i + 1:  # a long segment needs no index
            out[at[i] : at[i] + length[i]] = raw[begin[i] : begin[i] + length[i]]
        else:
            n = length[i:j]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(at[i:j], n) + step] = raw[np.repeat(begin[i:j], n) + step]
        i = j


def assemble(conv: np.ndarray, role: pa.Array, text: pa.Array, loss_roles: tuple[str, ...]) -> tuple[pa.Array, pa.Array]:
    """Formatted strings and loss spans of conversations; ``conv`` numbers each turn's conversation from 0, ascending."""
    role, text = (pc.fill_null(pc.cast(c, pa.large_string()), "") for c in (role, text))
    if pc.any(pc.match_substring(text, "|im_")).as_py():
        text = pc.replace_substring_regex(text, pattern=r"<(!*)\|im_", replacement=r"<!\1|im_")
    coded = pc.dictionary_encode(role)
    names = coded.dictionary.to_pylist()
    heads = pa.array([f"{START}{escape_role(r)}\n" for r in names], pa.large_string())
    code = np.asarray(coded.indices)
    h_raw, h_begin, h_len = _bytes_of(heads)
    t_raw, t_begin, t_len = _bytes_of(text)
    end = np.frombuffer(END.encode(), np.uint8)
    turns, n = len(code), int(conv[-1]) + 1 if len(conv) else 0
    lengths = np.empty((turns, 3), np.int64)
    lengths[:, 0], lengths[:, 1], lengths[:, 2] = h_len[code], t_len, len(end)
    ends = np.cumsum(lengths.ravel())
    begins = (ends - lengths.ravel()).reshape(turns, 3)
    out = np.empty(int(ends[-1]) if turns else 0, np.uint8)
    _scatter(out, begins[:, 0], h_raw, h_begin[code], lengths[:, 0])
    _scatter(out, begins[:, 1], t_raw, t_begin, t_len)
    _scatter(out, begins[:, 2], end, np.zeros(turns, np.int64), lengths[:, 2])
    first = np.searchsorted(conv, np.arange(n + 1))
    cuts = np.append(begins[:, 0], len(out))[first]
    formatted = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(out)])
    masked = np.isin(code, [i for i, r in enumerate(names) if r in loss_roles])
    own = conv[masked]
    rel = begins[masked, 1] - cuts[:-1][own] if n else np.zeros(0, np.int64)
    spans = pa.StructArray.from_arrays([pa.array(rel), pa.array(rel + t_len[masked])], ["begin", "end"])
    return formatted, pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(n + 1)), pa.int32()), spans)


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", *, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv, formatted, loss): the formatted string and the byte spans under the loss mask: the texts of ``loss_roles``."""
    kind = turns.schema[conv_col].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            new = changes(table.column("conv").combine_chunks())
            conv = np.cumsum(new) - 1
            formatted, loss = assemble(conv, table.column("role").combine_chunks(), table.column("text").combine_chunks(), loss_roles)
            ids = table.column("conv").combine_chunks().take(pa.array(np.flatnonzero(new)))
            return pa.RecordBatch.from_arrays([ids, formatted, loss], ["conv", "formatted", "loss"])

        def changes(ids: pa.Array) -> np.ndarray:
            code = np.asarray(pc.fill_null(pc.dictionary_encode(ids).indices, -1))
            return np.concatenate([[True], code[1:] != code[:-1]])

        held: list[pa.RecordBatch] = []
        for part in parts:
            if not part.num_rows:
                continue
            last = part.num_rows - int(np.argmax(changes(part.column(0))[::-1])) - 1  # where the last conversation of the batch begins
            before = held[-1].column(0)[-1].as_py() if held else None
            if last == 0 and (not held or before == part.column(0)[0].as_py()):
                held.append(part)
                continue
            if last:
                held.append(part.slice(0, last))
            yield emit(pa.Table.from_batches(held))
            held = [part.slice(last)]
        if held:
            yield emit(pa.Table.from_batches(held))

    bounded_batches(turns.sparkSession, 5000)
    own = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    ranked = own.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    out = ranked.mapInArrow(run, f"conv {kind}, formatted string, loss array<struct<begin:bigint,end:bigint>>")
    return out.withColumnRenamed("conv", conv_col)


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all from the formatted bytes and spans."""
    import hashlib

    kind = formatted.schema[conv_col].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for text, loss in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                raw, turns = text.encode(), parse(text)
                masked = "".join(unescape(raw[s["begin"] : s["end"]].decode()) for s in loss)
                rows.append((len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(masked), hashlib.sha256(masked.encode()).hexdigest(), len(text)))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])]], ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    own = formatted.select(F.col(conv_col).alias("conv"), "formatted", "loss")
    return own.mapInArrow(run, f"conv {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint").withColumnRenamed("conv", conv_col)
