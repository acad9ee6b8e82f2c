"""Token-id files of independent zstandard frames with a seek table.

A file is a sequence of frames:

* one zstandard frame per document: its ids as little-endian unsigned 32-bit integers;
* one skippable frame (``0x184D2A5D``) with the documents' ids: a count (u64), a byte per document (1: the id is
  null) and the ids (i64), all little-endian;
* one skippable frame (``0x184D2A5E``), the seek table: for each frame before it the compressed size, the
  decompressed size and the low 32 bits of XXH64 of its content (u32 each), then the number of entries (u32), a
  descriptor byte with the checksum bit set and the magic number ``0x8F92EAB1``. This is the public seekable format,
  so other readers of that format can open the files; the id frame is an entry of decompressed size 0.

A reader takes the end of the file, the id frame and the frames it wants, and decompresses nothing else.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from acctpulse.llm.tokens import END, encoder
from acctpulse.session import staged, work_path

TOKENIZER = "word_bpe_49k.json"
READ_BYTES = 1 << 23
# Fixed values of the public seekable format.
IDS_MAGIC, SEEK_MAGIC, FOOTER_MAGIC, HAS_CHECKSUMS = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1, 0x80
ENTRY, FOOTER = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")]), struct.Struct("<IBI")
FILES = "file_no bigint, path string, first_doc bigint, last_doc bigint, n_docs bigint, n_tokens bigint, bytes bigint"
FRAMES = "path string, frame bigint, doc_id bigint"
ROWS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def check_of(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class Writer:
    """Frames of one file, appended to an output stream."""

    def __init__(self, out):
        self.out, self.entries, self.docs, self.bytes = out, [], [], 0
        self.zstd = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=True)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        packed = self.zstd.compress(ids)
        self._put(packed)
        self.entries.append((len(packed), len(ids), check_of(ids)))
        self.docs.append(doc_id)

    def finish(self) -> None:
        nulls = np.array([d is None for d in self.docs], "u1").tobytes()
        known = np.array([d or 0 for d in self.docs], "<i8").tobytes()
        body = struct.pack("<Q", len(self.docs)) + nulls + known
        self._put(struct.pack("<II", IDS_MAGIC, len(body)) + body)
        self.entries.append((len(body) + 8, 0, check_of(b"")))
        table = np.array(self.entries, ENTRY).tobytes() + FOOTER.pack(len(self.entries), HAS_CHECKSUMS, FOOTER_MAGIC)
        self._put(struct.pack("<II", SEEK_MAGIC, len(table)) + table)


class Reader:
    """Random access to one file: ``doc_ids``, ``positions`` and ``read(frame)``."""

    def __init__(self, source):
        self.source, end = source, source.size()
        count, flags, magic = FOOTER.unpack(self._at(end - FOOTER.size, FOOTER.size))
        if magic != FOOTER_MAGIC or flags != HAS_CHECKSUMS:
            raise ValueError("not a token file: no seek table with checksums at its end")
        start = end - FOOTER.size - count * ENTRY.itemsize
        self.entries = np.frombuffer(self._at(start, count * ENTRY.itemsize), ENTRY)
        ends = np.cumsum(self.entries["packed"], dtype=np.int64)
        self.positions = ends - self.entries["packed"]
        body = self._at(int(self.positions[-1]) + 8, int(self.entries["packed"][-1]) - 8)
        n = struct.unpack_from("<Q", body)[0]
        known = np.frombuffer(body, "<i8", n, 8 + n).tolist()
        self.doc_ids = [None if null else d for null, d in zip(body[8 : 8 + n], known)]

    def _at(self, position: int, n: int) -> bytes:
        self.source.seek(position)
        return self.source.read(n)

    def read(self, frame: int) -> bytes:
        return next(self.read_many([frame]))

    def read_many(self, frames: Iterable[int], most: int = READ_BYTES) -> Iterator[bytes]:
        """The ids of some frames in order; neighbours are read together, up to ``most`` bytes at a time."""
        run: list[int] = []

        def unpacked() -> Iterator[bytes]:
            start = int(self.positions[run[0]])
            end = int(self.positions[run[-1]]) + int(self.entries[run[-1]]["packed"])
            data = self._at(start, end - start)
            for frame in run:
                at, entry = int(self.positions[frame]) - start, self.entries[frame]
                yield unpack(data[at : at + int(entry["packed"])], int(entry["check"]))

        for frame in frames:
            if run and (frame != run[-1] + 1 or int(self.positions[frame]) + int(self.entries[frame]["packed"]) - int(self.positions[run[0]]) > most):
                yield from unpacked()
                run = []
            run.append(frame)
        if run:
            yield from unpacked()


def unpack(packed: bytes, check: int) -> bytes:
    ids = zstandard.ZstdDecompressor().decompress(packed)
    if check_of(ids) != check:
        raise ValueError("checksum of a frame does not match")
    return ids


def open_reader(path: str) -> Reader:
    place, name = pafs.FileSystem.from_uri(path)
    return Reader(place.open_input_file(name))


def write_token_files(docs: DataFrame, root: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Tokenize and write files in ascending ``doc_id`` order; returns one row per file.

    Rows are range-partitioned by ``doc_id`` (null first; equal ids by their text), so a file holds one range and
    file numbers ascend with it. Every task attempt writes a file of its own name and only the files of attempts
    that succeeded are named in the result, which is written down at once: a file of a lost attempt is never read.
    Files are written with ``pyarrow.fs``, so ``root`` may be any address that it and all executors can open.

    Null text is empty (its document is the end id alone); repeated rows are written each; no rows give no files.
    """
    fields = {"file_no": pa.int64(), "path": pa.string(), "first_doc": pa.int64(), "last_doc": pa.int64(),
              "n_docs": pa.int64(), "n_tokens": pa.int64(), "bytes": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer, tokens = encoder(tokenizer).encode_many, None, 0
        number = TaskContext.get().partitionId()
        path = f"{root}/part-{number:06d}-{uuid.uuid4().hex}.zst"
        for batch in batches:
            for doc_id, ids in zip(batch.column(0), encode(text.as_py() for text in batch.column(1))):
                if writer is None:
                    place, name = pafs.FileSystem.from_uri(path)
                    place.create_dir(name.rpartition("/")[0], recursive=True)
                    writer = Writer(place.open_output_stream(name, compression=None))
                ids += END
                tokens += len(ids) // 4
                writer.add(doc_id.as_py(), ids)
        if writer is not None:
            writer.finish()
            writer.out.close()
            row = [number, path, writer.docs[0], writer.docs[-1], len(writer.docs), tokens, writer.bytes]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, fields.values())], names=[*fields])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    ranged = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return staged(ranged.mapInArrow(run, FILES), "token_files")


def read_token_files(files: DataFrame) -> DataFrame:
    """Every document of the files, from the files: position among all ids, number of ids and their CRC32."""
    # One row per file: a running total over them is small.
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = files.select("path", before.alias("start"), "n_docs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, _ in zip(*(c.to_pylist() for c in batch.columns)):
                reader, out = open_reader(path), []
                for doc_id, ids in zip(reader.doc_ids, reader.read_many(range(len(reader.doc_ids)))):
                    out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
                    start += len(ids) // 4
                columns = [pa.array(c, pa.int64()) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = files.sparkSession.sparkContext.defaultParallelism * 2
    return tasks.repartition(spread).mapInArrow(run, ROWS)


def read_documents(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(doc_id, ids)`` of the wanted ``doc_id`` rows. Reads seek tables, then decompresses only their frames.

    The wanted frames of a file are read by one task in the order of the file, which it opens once.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                reader = open_reader(path)
                n = len(reader.doc_ids)
                columns = [pa.array([path] * n), pa.array(range(n), pa.int64()), pa.array(reader.doc_ids, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "frame", "doc_id"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, now = None, None
        for batch in batches:
            paths, frames = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(paths):
                end = at
                while end < len(paths) and paths[end] == paths[at]:
                    end += 1
                if paths[at] != now:
                    reader, now = open_reader(paths[at]), paths[at]
                ids = [np.frombuffer(x, "<u4").astype("i8") for x in reader.read_many(frames[at:end])]
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(at, end - at), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])
                at = end

    frames = files.select("path").mapInArrow(index, FRAMES)
    found = frames.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").select("path", "frame", "doc_id")
    ordered = found.repartition("path").sortWithinPartitions("path", "frame")
    return ordered.mapInArrow(fetch, "doc_id bigint, ids array<bigint>")


def token_round_trip(docs: DataFrame, root: str | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """Write all documents and read every one of them back; ``root`` defaults to the shared work folder."""
    root = root or work_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, root, tokenizer))
