"""Importance resampling towards a target corpus, by hashed word runs found with Aho-Corasick automata.

Texts are scanned in blocks. The distinct words of a block, each bounded by delimiters on both sides, make an automaton
whose payloads are numbers of words; a word's number leads to its CRC32 and its length. A scan emits the payloads in
text order, and the CRC32 of a run of words is composed from adjacent payloads: appending bytes to a text is a linear
map of its CRC that depends on their number only. No run of words is ever built as text. The same scan serves both
passes, counting buckets over all texts and scoring them.

A dictionary lives as long as its block, so memory is bounded by the block whatever the vocabulary of the corpus. What
the driver holds is one number per bucket.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acctpulse.llm.positions import numbered
from acctpulse.session import staged

RUNS, BUCKETS = 2, 10_000
PERCENT, LEAST_WORDS, SEED = 25, 20, 7
BLOCK_BYTES = 1 << 22
# Longer words do not go into the automaton letter by letter: a short mark stands for them.
LONG_WORD = 256
# Every ASCII character but digits and letters parts words; A-Z become small letters; other bytes stay.
_KEPT = {ord(c): ord(c.lower()) for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"}
_PLAIN = bytes(_KEPT.get(b, 32) if b < 128 else b for b in range(256))
_LONG = re.compile(f"[^ ]{{{LONG_WORD + 1},}}")
# Neither is left in a plain text: between two texts, and around the number of a long word.
_BREAK, _MARK = "\n", "\x01"


def plain(text: bytes) -> bytes:
    """A text in UTF-8 with A-Z in lower case and one space for every byte that belongs to no word."""
    return text.translate(_PLAIN)


@lru_cache(maxsize=1024)
def _append(n: int) -> np.ndarray:
    """Tables (4, 256) of the map from the CRC32 of a text to its share in the CRC32 of that text and ``n`` more bytes."""
    bits = np.uint64(1) << np.arange(32, dtype=np.uint64)
    zlib_bits = [zlib.crc32(b"\0", int(b) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF for b in bits]  # one more zero byte, without the masks
    step, whole = np.array(zlib_bits, np.uint64), bits

    def applied(op: np.ndarray, values: np.ndarray) -> np.ndarray:
        chosen = np.where((values[:, None] & bits) != 0, op[None, :], np.uint64(0))
        return np.bitwise_xor.reduce(chosen, axis=1)

    while n:
        if n & 1:
            whole = applied(step, whole)
        step = applied(step, step)
        n >>= 1
    byte = np.arange(256, dtype=np.uint64)
    return np.stack([applied(whole, byte << np.uint64(8 * k)) for k in range(4)]).astype(np.uint32)


def _appended(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Every CRC's share after as many further bytes as its length says."""
    known, which = np.unique(lengths, return_inverse=True)
    if len(known) > 512:  # many lengths, as with long words: one after another instead of one large table
        out = np.empty_like(crcs)
        for k, n in enumerate(known):
            at = which == k
            out[at] = _appended(crcs[at], np.full(int(at.sum()), n))
        return out
    tables = np.stack([_append(int(n)) for n in known]) if len(known) else np.zeros((0, 4, 256), np.uint32)
    out = np.zeros_like(crcs)
    for k in range(4):
        out ^= tables[which, k, (crcs >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def scan(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of plain texts (byte letters) in order: text number, CRC32, CRC32 with a space behind, length in bytes."""
    joined = "".join(f" {t} {_BREAK}" for t in texts)
    long_words: dict[str, str] = {}
    if _LONG.search(joined):
        joined = _LONG.sub(lambda m: long_words.setdefault(m[0], f"{_MARK}{len(long_words)}{_MARK}"), joined)
    marks = {mark: word for word, mark in long_words.items()}
    words = sorted({*joined.split()})
    automaton = ahocorasick.Automaton()
    automaton.add_word(_BREAK, -1)
    for number, word in enumerate(words):
        automaton.add_word(f" {word} ", number)
    automaton.make_automaton()
    data = [marks.get(w, w).encode("latin-1") for w in words]
    crcs = np.array([zlib.crc32(w) for w in data], np.uint32)
    spaced = np.array([zlib.crc32(w + b" ") for w in data], np.uint32)
    lengths = np.array([len(w) for w in data], np.int64)
    emitted = np.fromiter((payload for _, payload in automaton.iter(joined)), np.int64)
    found = emitted >= 0
    number, at = np.cumsum(~found)[found], emitted[found]
    return number, crcs[at], spaced[at], lengths[at]


def _cut(data: bytes, most: int) -> Iterator[bytes]:
    """A plain text in parts that end before a space."""
    at = 0
    while len(data) - at > most:
        end = data.find(b" ", at + most)
        if end < 0:
            break
        yield data[at:end]
        at = end
    yield data[at:] if at else data


def buckets(
    texts: Iterator[bytes | None], runs: int = RUNS, n_buckets: int = BUCKETS, block_bytes: int = BLOCK_BYTES
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(number of the text, bucket)`` of all features, a pair of arrays per block. Texts may reach over blocks."""
    parts: list[str] = []
    numbers: list[int] = []
    held: list[int] = []
    size = 0

    def flush() -> tuple[np.ndarray, np.ndarray]:
        part, crc, spaced, length = scan(parts)
        # Words taken over from the part before count only as beginnings of runs.
        first = np.searchsorted(part, np.arange(len(parts)))
        new = np.arange(len(part)) - first[part] >= np.array(held, np.int64)[part]
        of = np.array(numbers, np.int64)[part]
        out = [(of[new], crc[new] % n_buckets)]
        run = spaced
        for k in range(1, runs):
            whole = (part[k:] == part[:-k]) & new[k:]
            before = run[:-1]
            out.append((of[k:][whole], (_appended(before, length[k:]) ^ crc[k:])[whole] % n_buckets))
            run = _appended(before, length[k:] + 1) ^ spaced[k:]
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])

    for number, text in enumerate(texts):
        tail: list[str] = []
        for part in _cut(plain(text or b""), block_bytes):
            body = part.decode("latin-1")
            parts.append(" ".join([*tail, body]))
            numbers.append(number)
            held.append(len(tail))
            size += len(part)
            if size >= block_bytes:
                yield flush()
                parts, numbers, held, size = [], [], [], 0
            if len(part) >= block_bytes and runs > 1:  # another part may follow
                tail = [*tail, *body.rsplit(None, runs - 1)[-(runs - 1) :]][-(runs - 1) :] if body.strip() else tail
    if parts:
        yield flush()


def _texts(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*(F.col(c) for c in more), F.col("`text`").cast("string").cast("binary").alias("data"))


def bucket_counts(df: DataFrame, runs: int = RUNS, n_buckets: int = BUCKETS) -> np.ndarray:
    """Number of features in every bucket over all texts of ``df``. The driver gets one row per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for _, found in buckets((t.as_py() for t in batch.column(0)), runs, n_buckets):
                total += np.bincount(found, minlength=n_buckets)
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    counted = _texts(df).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(n_buckets, np.int64)
    for row in counted.collect():
        out[row.bucket] = row.n
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floor of 1000 times the log ratio of smoothed target and own frequency, per bucket."""
    n = float(len(own))
    ratio = (target + 1.0) * (float(own.sum()) + n) / ((own + 1.0) * (float(target.sum()) + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, runs: int = RUNS) -> DataFrame:
    """``doc_id, n_features, weight``: the floored mean of the gains of a text's features, 0 without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for of, found in buckets((t.as_py() for t in batch.column(1)), runs, len(gain)):
                n += np.bincount(of, minlength=batch.num_rows)
                # Sums of whole numbers far below 2^53: exact.
                total += np.bincount(of, weights=gain[found], minlength=batch.num_rows).astype(np.int64)
            mean = total // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(mean)], names=["doc_id", "n_features", "weight"])

    rows = _texts(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")), "doc_id")
    return rows.mapInArrow(run, "doc_id bigint, n_features bigint, weight bigint")


def resample(
    docs: DataFrame, target: DataFrame, runs: int = RUNS, n_buckets: int = BUCKETS, percent: int = PERCENT,
    least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank``, one row per row of ``docs``.

    A document's weight tells how much more its word runs belong to ``target`` than to ``docs``; with Gumbel noise drawn
    from a hash of its id it is the score, and the ``percent`` highest scores among documents with at least ``least_words``
    words are a draw without replacement by importance. ``rank`` counts from 1 and is null for what is not drawn; ties go to
    the smaller id, a null id last, then to fewer features.

    Null and empty texts have no features and weight 0 and are never drawn; a null id is hashed as an empty one; repeated
    rows are weighed and drawn each. An empty target gives every bucket its smoothed share; no rows give no rows. Other
    columns, whatever their names, are not read.
    """
    gain = gains(bucket_counts(docs, runs, n_buckets), bucket_counts(target, runs, n_buckets))
    shown = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.sha2(shown, 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / F.lit(float(1 << 32)))))
    # n words make n + (n - 1) + ... runs; the first with least_words of them:
    least = sum(max(least_words - k, 0) for k in range(runs))
    scored = weights(docs, gain, runs).select("*", (F.col("weight") + noise).alias("score"), (F.col("n_features") >= least).alias("able"))
    order = [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    placed = numbered(scored, order)
    able = placed.agg(F.count_if("able")).first()[0]
    rank = F.when(F.col("position") < able * percent // 100, F.col("position") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


SQL = r"""
WITH texts AS (
    SELECT 'own' AS side, row_number() OVER () AS row_no, doc_id, text FROM documents
    UNION ALL SELECT 'target', row_number() OVER (), NULL, text FROM benchmark
), worded AS (
    SELECT side, row_no, doc_id, coalesce(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
    FROM texts
), runs AS (
    SELECT side, row_no, unnest(words || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS run
    FROM worded
), hashed AS MATERIALIZED (
    SELECT run, xor(list_reduce(
        [4294967295::UBIGINT] || list_transform(range(0, octet_length(encode(run))),
            lambda i: ('0x' || substr(hex(encode(run)), 2 * i + 1, 2))::UBIGINT),
        lambda c, b: list_reduce([xor(c, b)] || [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0],
            lambda x, i: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT) % 10000 AS bucket
    FROM (SELECT DISTINCT run FROM runs)
), found AS MATERIALIZED (
    SELECT side, row_no, bucket FROM runs JOIN hashed USING (run)
), counted AS (
    SELECT bucket, count(*) FILTER (side = 'own') AS s, count(*) FILTER (side = 'target') AS t FROM found GROUP BY bucket
), gains AS (
    SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE
        / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counted
), weighed AS (
    SELECT row_no, count(*) AS n, sum(gain)::BIGINT AS total FROM found JOIN gains USING (bucket) WHERE side = 'own' GROUP BY row_no
), scored AS (
    SELECT doc_id, len(words) >= 20 AS able, coalesce(n, 0) AS n_features,
        coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
        ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
    FROM worded LEFT JOIN weighed USING (row_no) WHERE side = 'own'
), ranked AS (
    SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score, able,
    FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * able_docs // 100 THEN place END AS rank
FROM (
    SELECT *, count(*) FILTER (able) OVER () AS able_docs,
        row_number() OVER (ORDER BY able DESC, score DESC, doc_id NULLS LAST, n_features, weight) AS place
    FROM ranked
)
"""
