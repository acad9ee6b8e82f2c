"""Packing of tokenized documents into fixed windows by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acctpulse.llm.tokens import END, encoder

WINDOW = 2048
TOKENIZER = "byte_bpe_50k.json"
# Rows, and bytes of ids, of a batch that goes out.
ROW_FLUSH, BYTE_FLUSH = 20_000, 1 << 22
_NEVER = np.iinfo(np.int64).max
_FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class Levels:
    """Open windows by fill level. ``counts[h]`` is the number of windows filled to ``h`` tokens.

    A piece of ``n`` tokens goes to the level ``h`` (0: a new window) for which the sum of ``counts[h] ** 2`` over
    the partly filled levels ends smallest; among equals, to the fullest. A full window no longer counts.
    """

    def __init__(self, size: int = WINDOW):
        self.size = size
        self.counts = np.zeros(size + 1, np.int64)
        self.windows: list[list[list]] = [[] for _ in range(size)]

    def choose(self, n: int) -> int:
        last = self.size - n
        left, joined = self.counts[: last + 1], self.counts[n : self.size + 1]
        change = 2 * joined - 2 * left + 2
        change[0] = 2 * joined[0] + 1
        change[-1] -= 2 * joined[-1] + 1  # a window that becomes full leaves the sum
        change[1:][left[1:] == 0] = _NEVER
        return last - int(np.argmin(change[::-1]))

    def place(self, piece: tuple, n: int) -> list | None:
        """Put a piece of ``n`` tokens; gives the window back once it is full."""
        level = self.choose(n)
        if level:
            self.counts[level] -= 1
            window = self.windows[level].pop()
        else:
            window = []
        window.append(piece)
        if level + n == self.size:
            return window
        self.counts[level + n] += 1
        self.windows[level + n].append(window)
        return None

    def rest(self) -> list[tuple[int, list]]:
        """Windows left open, emptiest first."""
        return [(level, w) for level, ws in enumerate(self.windows) for w in ws]


def close(rest: list[tuple[int, list]], size: int) -> Iterator[list]:
    """Close open windows without padding.

    The fullest windows are topped up with what the emptiest hold, cut where needed. The tokens that remain, fewer
    than a window, become windows whose lengths are powers of two.
    """
    low, high = 0, len(rest) - 1
    while low < high:
        level, window = rest[high]
        while level < size and low < high:
            have, source = rest[low]
            take = min(size - level, have)
            window += _take(source, take)
            level += take
            rest[low] = (have - take, source)
            low += have == take
        rest[high] = (level, window)
        if level < size:
            break
        yield window
        high -= 1
    if rest and low <= high:
        level, window = rest[high]
        while level:
            part = 1 << (level.bit_length() - 1)
            yield _take(window, part)
            level -= part


def _take(window: list, n: int) -> list:
    """Remove ``n`` tokens from the end of a window, as pieces ``(doc, start, ids)``."""
    got = []
    while n:
        doc, start, ids = window.pop()
        keep = len(ids) // 4 - n
        if keep > 0:
            window.append((doc, start, ids[: 4 * keep]))
            doc, start, ids = doc, start + keep, ids[4 * keep :]
        got.append((doc, start, ids))
        n -= len(ids) // 4
    return got


def _pack_partition(batches: Iterator[pa.RecordBatch], tokenizer: str, size: int, with_ids: bool, schema: pa.Schema):
    encode, levels, rows = encoder(tokenizer).encode, Levels(size), []
    base, made, held = TaskContext.get().partitionId() << 32, 0, 0

    def add(window: list) -> None:
        nonlocal made, held
        offset = 0
        for (doc_id, tokens), start, ids in window:
            n = len(ids) // 4
            row = [doc_id, start, n, zlib.crc32(ids), tokens, base + made, offset]
            rows.append((*row, ids) if with_ids else row)
            held += len(ids) * with_ids
            offset += n
        made += 1

    def due() -> bool:
        return len(rows) >= ROW_FLUSH or held >= BYTE_FLUSH

    def flush() -> pa.RecordBatch:
        nonlocal held
        columns = list(zip(*rows)) or [()] * len(schema)
        arrays = [pa.array(c, f.type) for c, f in zip(columns, schema) if f.name != "ids"]
        if with_ids:
            flat = np.frombuffer(b"".join(columns[-1]), "<i4")
            ends = np.cumsum([0, *(len(x) // 4 for x in columns[-1])], dtype=np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
        rows.clear()
        held = 0
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            ids = encode(text.as_py()) + END
            doc, at, total = (doc_id.as_py(), len(ids) // 4), 0, len(ids) // 4
            while total - at >= size:
                add([(doc, at, ids[4 * at : 4 * (at + size)])])
                at += size
                if due():
                    yield flush()
            if at < total:
                full = levels.place((doc, at, ids[4 * at :]), total - at)
                if full:
                    add(full)
            if due():
                yield flush()
    for window in close(levels.rest(), size):
        add(window)
        if due():
            yield flush()
    yield flush()


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, size: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """Sequences of at most ``size`` tokens as piece rows; ``with_ids`` adds each piece's ids.

    Each input partition packs its own documents, online and in their order, so nothing is shuffled and a lost task
    is simply run again. Whole windows of a long document are cut off first; the remainder is placed by
    :class:`Levels`. Only at the end of a partition are documents cut to fill windows (:func:`close`), so no
    sequence needs padding: each is full or has a power of two as its length. A partition makes at most as many
    short sequences as ``size`` has bits.

    Null text is empty: its document is the end id alone. A null ``doc_id`` stays null. Repeated rows are packed
    each on its own. No rows give no sequences. Columns other than ``doc_id`` and ``text`` are not read.
    """
    kind = "doc_id bigint, " + ", ".join(f"`{c}` bigint" for c in _FIELDS[1:]) + (", ids array<int>" if with_ids else "")
    schema = pa.schema(
        [(c, pa.int64()) for c in _FIELDS] + ([pa.field("ids", pa.list_(pa.int32()))] if with_ids else [])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pack_partition(batches, tokenizer, size, with_ids, schema)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, kind)
