"""Importance resampling against plain Python and SQL."""

import hashlib
import math
import random
import re
import zlib

import compare
import duckdb
import numpy as np
import pytest

from acctpulse.llm import importance as I

SCHEMA = "doc_id bigint, text string, weight int, rank string"
NAMES = ["doc_id", "n_features", "rank", "score", "weight"]


def runs_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def bucket(run):
    return zlib.crc32(run.encode()) % 10_000


def brute(docs, target):
    own, theirs = [0] * 10_000, [0] * 10_000
    for counts, texts in ((own, [t for _, t in docs]), (theirs, target)):
        for text in texts:
            for run in runs_of(text)[1]:
                counts[bucket(run)] += 1
    s, t = sum(own), sum(theirs)
    rows = []
    for doc_id, text in docs:
        words, runs = runs_of(text)
        gain = [math.floor(1000 * math.log((theirs[b] + 1.0) * (s + 10_000.0) / ((own[b] + 1.0) * (t + 10_000.0)))) for b in map(bucket, runs)]
        weight = sum(gain) // len(gain) if gain else 0
        shown = "" if doc_id is None else doc_id
        h = int(hashlib.sha256(f"7:{shown}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((len(words) >= 20, score, doc_id, len(runs), weight))
    rows.sort(key=lambda r: (not r[0], -r[1], r[2] is None, r[2] or 0, r[3], r[4]))
    drawn = sum(r[0] for r in rows) * 25 // 100
    return [(r[2], r[3], i + 1 if i < drawn else None, r[1], r[4]) for i, r in enumerate(rows)]


def made(rng, n):
    words = ["alpha", "Beta", "GAMMA", "été", "Ünder", "x1", "0", "日本", "it's", "a_b", "q" * 300, "\x01", "naïve~", "İ"]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) + rng.choice(["", "\n", "  ", "-"]) for _ in range(n)]


def test_against_python_and_sql(spark):
    rng = random.Random(5)
    texts = made(rng, 150)
    docs = [(i % 140, t) for i, t in enumerate(texts)] + [(None, texts[3]), (None, None), (7, None), (9, texts[9]), (9, texts[9]), (500, "")]
    target = [*made(rng, 5), None, "alpha beta"]
    df = spark.createDataFrame([(*d, 1, "r") for d in docs], SCHEMA).repartition(4)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = compare.spark_rows(I.resample(df, goal))
    assert got == compare.rows_of(NAMES, brute(docs, target))
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.execute("create table benchmark (text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    con.executemany("insert into benchmark values (?)", [(t,) for t in target])
    assert got == compare.sql_rows(con, I.SQL)


def test_nothing(spark):
    some = spark.createDataFrame([(1, "a b c " * 20, 1, "r")], SCHEMA)
    assert I.resample(some.limit(0), some).count() == 0
    row = I.resample(some, some.limit(0)).collect()[0]
    assert (row.doc_id, row.n_features, row.rank) == (1, 119, None)
    assert (row.weight, row.score) == brute([(1, "a b c " * 20)], [])[0][4:2:-1]


@pytest.mark.parametrize("runs", [1, 2, 3])
def test_blocks_do_not_matter(runs):
    rng = random.Random(runs)
    texts = [t.encode() for t in made(rng, 30)] + [None, b"", ("word " * 3000).encode(), b"z" * 5000, b" " * 3000 + b"a b c"]

    def found(size):
        out = [[] for _ in texts]
        for of, at in I.buckets(iter(texts), runs, 997, size):
            for k, b in zip(of.tolist(), at.tolist()):
                out[k].append(b)
        return [sorted(x) for x in out]

    whole = found(1 << 22)
    assert whole == found(64) == found(700)
    words = [re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t or b"")) for t in texts]
    plain = [sorted(zlib.crc32(b" ".join(w[i : i + k])) % 997 for k in range(1, runs + 1) for i in range(len(w) - k + 1)) for w in words]
    assert whole == plain


def test_crc_of_appended_texts():
    rng = np.random.default_rng(3)
    left = [rng.bytes(int(n)) for n in rng.integers(0, 50, 300)]
    right = [rng.bytes(int(n)) for n in rng.integers(0, 700, 300)]
    crcs = np.array([zlib.crc32(x) for x in left], np.uint32)
    ends = np.array([zlib.crc32(x) for x in right], np.uint32)
    both = I._appended(crcs, np.array([len(x) for x in right])) ^ ends
    assert both.tolist() == [zlib.crc32(a + b) for a, b in zip(left, right)]
    many = I._appended(np.resize(crcs, 2000), np.arange(2000))
    assert many.tolist() == [zlib.crc32(left[i % 300] + bytes(i)) ^ zlib.crc32(bytes(i)) for i in range(2000)]
