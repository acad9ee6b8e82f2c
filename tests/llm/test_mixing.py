"""The mix against its SQL and against plain Python."""

import hashlib
import random
import re

import compare
import duckdb
import pytest

from acctpulse.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, size int, queue string, target string"


def brute(docs, weights=(5, 2, 1), share=1.5, epochs=2):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in docs]
    names = sorted({d[2] for d in docs if d[2] is not None}, key=lambda s: s.encode()) + ([None] if any(d[2] is None for d in docs) else [])
    own = {s: sum(n for n, d in zip(size, docs) if d[2] == s) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, free = {}, share * sum(size), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= epochs * own[s]}
        for s in over or free:
            target[s] = float(epochs * own[s]) if over else level * weight[s]
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    return size, own, target


def random_docs(n, seed):
    rng = random.Random(seed)
    sources = ["a", "B", "é", "", None, "hot", "hot", "hot", "hot"]
    words = ["x", "yy", "\t", "\x1f", " "]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60))), rng.choice(sources)) for i in range(n)]
    return [*docs, (None, None, "a"), (None, "x y", "hot"), (3, "x", "B"), (3, "x", "B"), (n, "w " * 4000, "é")]


@pytest.mark.parametrize("bucket_rows", [7, 50_000])
def test_mix_against_sql_and_targets(spark, bucket_rows):
    docs = random_docs(400, 2)
    df = spark.createDataFrame([(*d, 1, "q", "t") for d in docs], SCHEMA).repartition(3)
    got = mixing.mix(df, bucket_rows=bucket_rows).collect()
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", docs)
    assert compare.rows_of(["doc_id", "source", "size", "source_size", "target", "taken"], got) == compare.sql_rows(con, mixing.SQL)
    size, own, target = brute(docs)
    assert sorted(r.size for r in got) == sorted(size)
    for source, want in target.items():
        rows = [r for r in got if r.source == source]
        assert {r.source_size for r in rows} == {own[source]}
        assert rows[0].target == pytest.approx(want)
        assert abs(sum(r.taken for r in rows) - want) <= max(r.size for r in rows)
    assert all(r.taken % max(r.size, 1) == 0 and r.taken <= 2 * r.size for r in got)
    assert sum(r.taken for r in got) <= 1.5 * sum(size)


def test_mix_documents_repeats_rows(spark):
    docs = random_docs(60, 5)
    df = spark.createDataFrame([(*d, i, "q", "t") for i, d in enumerate(docs)], SCHEMA)
    taken = {}
    for r in mixing.mix(df, bucket_rows=9).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    out = mixing.mix_documents(df, bucket_rows=9)
    assert out.schema.simpleString() == df.schema.simpleString()
    rows, words = out.collect(), {}
    for r in rows:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert words == {d: n for d, n in taken.items() if n}


def test_shuffle_is_md5_of_the_id(spark):
    assert mixing._sized(spark.createDataFrame([(12, "a", None)], "doc_id bigint, text string, source string")).first().shuffle == hashlib.md5(b"12").hexdigest()


@pytest.mark.parametrize("docs", [[], [(1, None, None)], [(1, " ", "s"), (2, "", "t")]])
def test_nothing_to_mix(spark, docs):
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    assert [r.taken for r in mixing.mix(df).collect()] == [0] * len(docs)
    assert mixing.mix_documents(df).count() == 0
