"""Near-duplicates by SimHash: tiled exact comparison of 64-bit fingerprints.

Fingerprints are compared tile against tile with exclusive-or and bit counts; a tile pair whose population counts lie
further apart than the radius is skipped, as no fingerprint of one can be within the radius of one of the other.
Tiles are cut from cells: two fingerprints that differ in at most ``radius`` bits agree in at least one of
``radius + 1`` parts of their bits, so it is enough, and loses no link, to compare those that agree in a part.
A cell with very many fingerprints is spread over several tasks, each of which compares two slices of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acctpulse.llm.components import components
from acctpulse.llm.words import BLOCK_BYTES, word_blocks
from acctpulse.session import staged

SHINGLE, SEED, RADIUS = 3, 42, 3
TILE, CELL_ROWS = 512, 32_768
# Bits of every byte value, lowest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACE = np.arange(8) * 256


def _hashes(data: bytes, size: int, block_bytes: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles, block by block."""
    tail: list[bytes] = []
    count = 0
    for block in word_blocks(data.lower(), block_bytes):
        words = tail + block
        count += len(block)
        n = len(words) - size + 1
        if n > 0:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
            yield np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
        tail = words[-(size - 1) :] if size > 1 else []
    if 0 < count < size:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(tail), SEED)], np.uint64)


def fingerprint(data: bytes | None, size: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> int:
    """64-bit fingerprint of a text in UTF-8: a bit is 1 if set in over half of the shingles' hashes; no words: 0."""
    ones, total = np.zeros((8, 8), np.int64), 0
    for hashes in _hashes(data or b"", size, block_bytes):
        total += len(hashes)
        for part in (hashes[i : i + 65_536] for i in range(0, len(hashes), 65_536)):
            seen = np.bincount((part.astype("<u8").view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048)
            ones += seen.reshape(8, 256) @ _BITS
    bits = np.packbits(2 * ones > total, axis=1, bitorder="little") if total else np.zeros(8, np.uint8)
    return int.from_bytes(bits.tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = SHINGLE, *more: str) -> DataFrame:
    """``(doc_id, fp)`` of whole texts, and further columns; ``fp`` holds the 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), size) for t in batch.column(1)), np.uint64, batch.num_rows)
            columns = [batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", *more])

    text = F.col("text").cast("string").cast("binary").alias("data")
    given = docs.select(F.col("doc_id").cast("bigint"), text, *more)
    schema = ", ".join(["doc_id bigint", "fp bigint", *(f"{c} {given.schema[c].dataType.simpleString()}" for c in more)])
    return given.mapInArrow(run, schema)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index linked to each of ``n`` indices."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def tile_links(fps: np.ndarray, radius: int = RADIUS, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect every fingerprint with all within the radius, one per fingerprint that is not a root.

    All links of two tiles are found, but only a spanning set of them is kept, so a dense group of near copies gives
    as many links as it has members.
    """
    fps = fps.view(np.uint64)
    order = np.argsort(np.bitwise_count(fps), kind="stable")
    fps = fps[order]
    counts = np.bitwise_count(fps).astype(np.int64)
    starts = range(0, len(fps), tile)
    left, right = [], []
    for i in starts:
        one = fps[i : i + tile]
        for j in range(i, len(fps), tile):
            if counts[j] - counts[min(i + tile, len(fps)) - 1] > radius:
                break  # counts ascend: all later tiles are further away
            near = np.bitwise_count(one[:, None] ^ fps[None, j : j + tile]) <= radius
            a, b = np.nonzero(near)
            a, b = a + i, b + j
            apart = a < b
            if apart.any():
                a, b = a[apart], b[apart]
                seen, at = np.unique(np.concatenate([a, b]), return_inverse=True)
                root = roots(len(seen), at[: len(a)], at[len(a) :])
                moved = root != np.arange(len(seen))
                left.append(seen[moved])
                right.append(seen[root[moved]])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    root = roots(len(fps), np.concatenate(left), np.concatenate(right))
    moved = np.nonzero(root != np.arange(len(fps)))[0]
    return order[moved], order[root[moved]]


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fp`` that connect all within ``radius`` bits."""
    edges = [round(64 * i / (radius + 1)) for i in range(radius + 2)]
    parts = [
        F.struct(F.lit(k).alias("part"), F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("value"))
        if hi - lo < 64
        else F.struct(F.lit(k).alias("part"), F.col("fp").alias("value"))
        for k, (lo, hi) in enumerate(zip(edges, edges[1:]))
    ]
    cells = distinct.select("fp", F.explode(F.array(*parts)).alias("cell")).select("fp", "cell.*")
    crowded = cells.groupBy("part", "value").count().filter(F.col("count") > cell_rows)
    slices = F.coalesce(F.ceil(F.col("count") / cell_rows), F.lit(1)).cast("int")
    placed = cells.join(crowded, ["part", "value"], "left").select("fp", "part", "value", slices.alias("slices"))
    own = F.pmod(F.xxhash64("fp"), "slices").cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    jobs = placed.select("fp", "part", "value", own.alias("own"), other.alias("other"))
    pair = [F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")]
    work = jobs.groupBy("part", "value", *pair).agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for fps in batch.column(0):
                own = fps.values.to_numpy(zero_copy_only=False)
                a, b = tile_links(own, radius)
                if len(a):
                    left.append(own[a])
                    right.append(own[b])
            if left:
                columns = [pa.array(np.concatenate(left)), pa.array(np.concatenate(right))]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    return work.select("fps").mapInArrow(run, "a bigint, b bigint")


def _rooted(distinct: DataFrame, radius: int, cell_rows: int) -> DataFrame:
    """Distinct fingerprints ``fp`` with the ``root`` fingerprint of their component; other columns stay."""
    tree = components(fingerprint_links(distinct, radius, cell_rows))
    joined = distinct.join(tree.withColumnRenamed("node", "fp"), "fp", "left")
    return joined.select(*distinct.columns, F.coalesce("root", "fp").alias("root"))


def near_duplicates(
    docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    Rows with one fingerprint are one node, however many they are; only distinct fingerprints are compared. The
    component is the smallest ``doc_id`` that links reach. Null and empty texts have fingerprint zero and are linked
    like any other. A row without a ``doc_id`` is linked too, but gives no name: a component of such rows only has a
    null id. Repeated rows are returned each. No rows give no rows. Other columns are not read.
    """
    fps = staged(fingerprints(docs, size), "fingerprints")
    distinct = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    rooted = staged(_rooted(distinct, radius, cell_rows), "rooted")
    names = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(named, "fp").select("doc_id", shown.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row of each component, all columns: the one with the smallest id, a null id last.

    Rows are told apart by all their columns, not by their ids: rows of different components stay, whatever ids they
    share. Among rows of one id the smallest row hash decides, so reruns and other partitionings agree; of rows that are equal
    in every column one stays. Null and empty texts are copies of each other. No rows give no rows.
    """
    cells = [x for c in docs.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    row_hash = [F.xxhash64(F.lit(k), *cells).alias(name) for k, name in enumerate(("hash_1", "hash_2"))]
    rows = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), F.col("doc_id"), F.col("text"), *row_hash)
    found = staged(fingerprints(rows, size, "hash_1", "hash_2"), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash_1", "hash_2")).alias("first")
    distinct = staged(found.groupBy("fp").agg(first), "distinct")
    keep = _rooted(distinct, radius, cell_rows).groupBy("root").agg(F.min("first").alias("first"))
    keep = keep.select("first.hash_1", "first.hash_2")
    key = ["hash_1", "hash_2"]
    return rows.join(keep, key, "left_semi").dropDuplicates(key).select("row.*")
