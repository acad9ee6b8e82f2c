"""Merkle manifest against plain Python and SQL."""

import hashlib
import zlib

import compare
import duckdb

from acctpulse.llm import merkle as M

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree string, position int, leaf string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    return h(*map(field, (*row[:4], text)))


def climb(nodes):
    """Root and, per node, its path of (left, right) from the lowest run up."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // 3 * 3 : k // 3 * 3 + 3]
            paths[i].append(("".join(run[: k % 3]), "".join(run[k % 3 + 1 :])))
            at[i] = k // 3
        nodes = [h(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
    return nodes[0], paths


def brute(rows):
    sources = {}
    for row in rows:
        text = row[4]
        if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
            text = text.replace("\n", "")
        key = (row[1] is not None, (row[1] or "").encode())
        sources.setdefault(key, []).append((row[0] is not None, row[0] or 0, leaf(row, row[4]), leaf(row, text), row[0]))
    trees = [(k, sorted(v), *climb([x[2] for x in sorted(v)])) for k, v in sorted(sources.items())]
    if not trees:
        return []
    root, upper = climb([t[2] for t in trees])
    out = []
    for (_, leaves, subroot, paths), above in zip(trees, upper):
        for (_, _, own, claimed, doc_id), path in zip(leaves, paths):
            node = claimed
            for left, right in path + above:
                node = h(left, node, right)
            out.append((doc_id, node, own, h(*(a + b for a, b in path + above)), root, subroot, node == root))
    return out


def rows_of(n):
    texts = ["a\nb", "", None, "ünï\ncode", "plain"]
    out = [(i * 7 % 101, ["web", "news", "ßrc", ""][i % 4], [None, "en"][i % 2], i, texts[i % 5]) for i in range(n)]
    out += [(1000 + i, "hot", "en", None, f"t\n{i}") for i in range(n)]
    return out + [(None, "web", None, None, None), (None, None, "en", 1, "x\ny"), (3, "web", "en", 4, "dup\n"), (3, "web", "en", 4, "dup\n"), (5, "alone", None, 2, "\n")]


def check(spark, rows, parts):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(parts)
    got = M.verify(M.manifest(df, M.tampered(df)))
    shown = compare.spark_rows(got)
    assert shown == compare.rows_of(["doc_id", "folded_root", "leaf", "proof_sha256", "root", "subroot", "verified"], brute(rows))
    return got, shown


def test_against_python_and_sql(spark):
    rows = rows_of(60)
    got, shown = check(spark, rows, 5)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, source varchar, lang varchar, n_chars bigint, text varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", rows)
    assert shown == compare.sql_rows(con, M.SQL)
    kept = {r.verified for r in got.collect()}
    assert kept == {True, False}
    check(spark, rows, 1)


def test_one_row_one_source_and_nothing(spark):
    check(spark, [(4, "s", "en", 1, "t")], 1)
    check(spark, [(i, "s", "en", 1, "t\n") for i in range(10)], 3)
    check(spark, [(7, None, None, None, None)] * 4, 2)
    none = spark.createDataFrame([], SCHEMA)
    assert M.verify(M.manifest(none, M.tampered(none))).count() == 0


def test_long_text_and_other_fanout(spark):
    rows = [(i, "s", "en", 1, "long \n" * 200_000 if i == 2 else "t") for i in range(9)]
    check(spark, rows, 2)
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    wide = M.verify(M.manifest(df, df["text"], fanout=4))
    assert wide.count() == 9 and {r.verified for r in wide.collect()} == {True}
