"""SentencePiece encoding and decoding for merge-type vocabularies, as the sentencepiece library does both.

Encoding keeps an agenda of adjacent symbol pairs, the best-scored first and the leftmost among equals. The pair taken is
merged if both symbols are still what they were, and the pairs that the merged symbol makes with its neighbours are put
on the agenda. Symbols that are no piece in the end fall apart into their bytes.

No piece of such a vocabulary has a space after another letter (checked when it is loaded), so no merge reaches over the
beginning of a run of spaces, and a text's ids are those of its chunks one after another. A worker keeps the ids of the
chunks it has met lately. In every Arrow batch the chunks that are new are encoded by the library too; a difference raises.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acctpulse.llm.tokens import tokenizer_path

MODEL = "piece_bpe_32k.model"
# The letter that stands for a space in pieces.
SPACE = "▁"
UNKNOWN = " ⁇ "
BLOCK_CHARS = 1 << 20
CACHE_CHUNKS = 800_000
CHECKED_AT_ONCE = 10_000


class PieceCodec:
    """``encode(text)`` and ``decode(ids)`` of one vocabulary."""

    def __init__(self, name: str = MODEL, cache_chunks: int = CACHE_CHUNKS):
        from sentencepiece import SentencePieceProcessor

        self.library = model = SentencePieceProcessor(model_file=tokenizer_path(name))
        ids = range(model.get_piece_size())
        if any(model.is_unused(i) for i in ids):
            raise ValueError("vocabularies with unused pieces are not supported")
        special = {i for i in ids if model.is_unknown(i) or model.is_control(i) or model.is_byte(i)}
        pieces = {i: model.id_to_piece(i) for i in ids}
        self.ids = {p: i for i, p in pieces.items() if i not in special}
        self.rank = {p: -model.get_score(i) for p, i in self.ids.items()}
        self.unknown = model.unk_id()
        # A byte's piece has its value in its name, as <0x0A>.
        self.bytes = {int(pieces[i][3:-1], 16): i for i in ids if model.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("the vocabulary has no piece for every byte")
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("a piece holds a space after another letter: texts cannot be cut before spaces")
        if any("\n" in p for p in self.ids):
            raise ValueError("a piece holds a line end: texts cannot be cut before line ends")
        # What an id stands for, before the first space is taken off; control pieces for nothing.
        shown = {self.ids[p]: p.replace(SPACE, " ").encode() for p in self.ids}
        shown |= {i: bytes([b]) for b, i in self.bytes.items()} | {self.unknown: UNKNOWN.encode()}
        self.surface = [shown.get(i, b"") for i in ids]
        self.controls = {i for i in ids if model.is_control(i)}
        self.byte_ids = {i: b for b, i in self.bytes.items()}
        self.spaced = {i for p, i in self.ids.items() if p.startswith(SPACE)}
        self.cache_chunks = cache_chunks
        # Two generations: what has not been asked for since the last change is forgotten at the next.
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.beside = {pair for p in self.ids for pair in map(add, p, p[1:])}
        self.lone_space = _packed([self.ids[SPACE]])
        self.decimal = [*map(str, ids)]

    def merged(self, chunk: str) -> list[int]:
        """Ids of a chunk in which spaces are written as pieces have them."""
        symbols, end = [*chunk], len(chunk)
        left, right = [*range(-1, end - 1)], [*range(1, end + 1)]
        rank = self.rank
        # Best score first, then the leftmost; the size of the pair tells whether it is still what it was.
        agenda = [(rank[pair], a, a + 1, 2) for a, pair in enumerate(map(add, chunk, chunk[1:])) if pair in rank]
        heapq.heapify(agenda)
        while agenda:
            _, a, b, size = heapq.heappop(agenda)
            whole = symbols[a] + symbols[b]
            if not symbols[a] or not symbols[b] or len(whole) != size:
                continue  # one of the two has been merged since
            symbols[a], symbols[b] = whole, ""
            before, after = left[a], right[b]
            right[a] = after
            if before >= 0 and (pair := symbols[before] + whole) in rank:
                heapq.heappush(agenda, (rank[pair], before, a, len(pair)))
            if after < end:
                left[after] = a
                if (pair := whole + symbols[after]) in rank:
                    heapq.heappush(agenda, (rank[pair], a, after, len(pair)))
        out: list[int] = []
        for symbol in filter(None, symbols):
            found = self.ids.get(symbol)
            out += [found] if found is not None else [self.bytes[b] for b in symbol.encode()]
        return out

    def _parts(self, chunk: str) -> Iterator[str]:
        """A chunk cut where no piece holds the two letters beside each other, so that nothing merges over the cut."""
        at = 0
        for k, pair in enumerate(map(add, chunk, chunk[1:]), 1):
            if pair not in self.beside:
                yield chunk[at:k]
                at = k
        yield chunk[at:]

    def _ids(self, chunk: str) -> bytes:
        out = []
        for part in self._parts(chunk):
            if part not in self.parts:
                self.parts[part] = _packed(self.merged(part))
            out.append(self.parts[part])
        return b"".join(out)

    def _learn(self, chunks: set[str]) -> None:
        """Ids of chunks, named without the space they begin with; those that begin with a line end have none."""
        if len(self.new) > self.cache_chunks:
            self.old, self.new = self.new, {}
        if len(self.parts) > self.cache_chunks:
            self.parts = {}
        fresh = []
        for chunk in chunks.difference(self.new):
            if chunk in self.old:
                self.new[chunk] = self.old[chunk]
            else:
                fresh.append(chunk)
        for at in range(0, len(fresh), CHECKED_AT_ONCE):
            part = fresh[at : at + CHECKED_AT_ONCE]
            for chunk, theirs in zip(part, self.library.encode(part, num_threads=1)):
                line = chunk.startswith("\n")
                own = self._ids(chunk if line else SPACE + chunk)
                # The library puts a space before a text. After it nothing merges with a line end; an empty text has none.
                told = self.lone_space + own if line else own
                if _packed(theirs) != told and chunk:
                    raise ValueError(f"ids differ from the library's for {chunk!r}")
                self.new[chunk] = own

    def blocks(self, text: str) -> Iterator[list[str]]:
        """The chunks of a text in order, in lists. Every chunk but those at a line end begins with a space, left out here."""
        at = 0
        while text and at <= len(text):
            end = len(text)
            if end - at > BLOCK_CHARS:
                cut = _CUT.search(text, at + BLOCK_CHARS)
                end = cut.start() if cut else end
            body = text[at:end]
            chunks = body.replace("\n", " \n").split(" ")
            if "" in chunks or SPACE in body:  # runs of spaces: they belong to the chunk behind them
                chunks = [c if c[0] == "\n" else c[1:] for c in _CHUNK.findall(SPACE + body.replace(" ", SPACE))]
            yield chunks
            at = end + 1  # the space at the cut

    def encoded(self, text: str | None) -> Iterator[bytes]:
        """Ids of a text, block by block, as little-endian unsigned 32-bit integers."""
        for chunks in self.blocks(text or ""):
            try:
                yield b"".join(map(self.new.__getitem__, chunks))
            except KeyError:
                self._learn({*chunks})
                yield b"".join(map(self.new.__getitem__, chunks))

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(self.encoded(text)), "<u4")

    def decode(self, ids: list[int]) -> str:
        """The text that ids stand for; a byte that begins no character becomes U+FFFD."""
        parts = [*map(self.surface.__getitem__, ids)]
        # The space put before a text goes with the first piece; control pieces before it show nothing.
        first = next((k for k, part in enumerate(parts) if part), None)
        if first is not None and ids[first] in self.spaced:
            parts[first] = parts[first][1:]
        if self.controls.isdisjoint(ids):
            try:
                return b"".join(parts).decode()
            except UnicodeDecodeError:
                pass
        return self._careful(ids, parts)

    def _careful(self, ids: list[int], parts: list[bytes]) -> str:
        out, run = [], b""
        for i, part in zip(ids, parts):
            if i in self.byte_ids:
                run += part
                continue
            out += [_lenient(run), part.decode()]
            run = b""
        return "".join([*out, _lenient(run)])


# Before a run of spaces that follows another character; the block before it ends there.
_CUT = re.compile(f"(?<=[^ {SPACE}])(?= )")
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*")


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _lenient(run: bytes) -> str:
    """A run of bytes as text, one U+FFFD for each byte that begins no character."""
    out, at = [], 0
    while at < len(run):
        for size in range(1, 5):
            try:
                out.append(run[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=4)
def codec(name: str = MODEL) -> PieceCodec:
    """One codec, and so one cache, for each worker process and vocabulary."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return PieceCodec(name)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), F.col("`text`").cast("string").alias("text"))


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, ids`` of whole texts, without begin or end ids.

    Null and empty texts have no ids; repeated rows and null ids of documents are returned each; no rows give no rows; other
    columns, whatever their names, are not read. A text of any length is taken in blocks of about a million characters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            ids = [own.encode(t.as_py()).astype("i4") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _rows(docs).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``. No ids, and null, give the empty text; an id beyond the vocabulary raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            texts = [own.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: whole texts encoded and decoded again, without handing on ids or texts.

    Rows and their defined results are those of ``encode``.
    """
    fields = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            counts, shown, texts = [], [], []
            for text in batch.column(1):
                ids = own.encode(text.as_py()).tolist()
                counts.append(len(ids))
                shown.append(hashlib.sha256(",".join(map(own.decimal.__getitem__, ids)).encode()).hexdigest())
                texts.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(shown), pa.array(texts)]
            yield pa.RecordBatch.from_arrays(columns, names=fields)

    return _rows(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def differences(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id`` of texts whose ids or decoded text differ from the library's, both over whole texts in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            theirs = own.library.encode(texts, num_threads=1)
            apart = [
                (ids := own.encode(t).tolist()) != known or own.decode(ids) != back
                for t, known, back in zip(texts, theirs, own.library.decode(theirs, num_threads=1) if texts else [])
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(apart, pa.bool_()))], names=["doc_id"])

    return _rows(docs).mapInArrow(run, "doc_id bigint")
