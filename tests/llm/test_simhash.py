"""Fingerprints and components against plain Python over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from acctpulse.llm import simhash
from acctpulse.llm.components import components

SCHEMA = "doc_id bigint, text string, fp string, root int"


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(fps, radius=3):
    """Smallest id reachable, by search over all pairs."""
    n, name = len(fps), {}
    ids = [d for d, _ in fps]
    left = set(range(n))
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in left if (fps[x][1] ^ fps[y][1]).bit_count() <= radius}
            left -= near
            todo += near
        known = [ids[x] for x in group if ids[x] is not None]
        name |= dict.fromkeys(group, min(known) if known else None)
    return [name[i] for i in range(n)]


def near_copies(rng, count):
    base = [" ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(50)) for _ in range(300)) for _ in range(4)]
    out = []
    for _ in range(count):
        words = rng.choice(base).split(" ")
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "Changed"
        out.append(" ".join(words))
    return out


def check(spark, docs, **options):
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA).repartition(3)
    got = simhash.near_duplicates(df, **options).collect()
    fps = [(d, brute_fingerprint(t)) for d, t in docs]
    want = sorted(((d, f"{fp:016x}", c) for (d, fp), c in zip(fps, brute_components(fps))), key=repr)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == want
    return want


@pytest.mark.parametrize("cell_rows", [3, 32_768])
def test_near_duplicates_against_all_pairs(spark, cell_rows):
    rng = random.Random(11)
    texts = [None, "", " \t", "one", "One two", "A b\x0bc", "é ß ü", "x\x1fy z", *near_copies(rng, 120)]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(80)]
    docs = list(enumerate(texts)) + [(5, texts[5]), (None, "one"), (None, "nothing like it here")]
    want = check(spark, docs, cell_rows=cell_rows)
    assert len({c for _, _, c in want}) < len(want) - 20


def test_long_text_in_blocks_is_the_same():
    rng = random.Random(4)
    text = " ".join(rng.choice(["Foo", "bar\n", "\tbaz", "q" * 30]) for _ in range(3000))
    whole = brute_fingerprint(text)
    assert [simhash.fingerprint(text.encode(), 3, n) for n in (1, 10, 999, 1 << 20)] == [whole] * 4


@pytest.mark.parametrize("tile", [1, 7, 512])
def test_tiles_connect_what_all_pairs_connect(tile):
    rng = np.random.default_rng(9)
    centre = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([centre, *(centre ^ np.uint64(1 << int(b)) ^ np.uint64(1 << int(c)) for b, c in rng.integers(0, 63, (12, 2)))]))
    a, b = simhash.tile_links(fps, 3, tile)
    assert len(a) < len(fps)
    assert (np.bitwise_count(fps[a] ^ fps[b]) >= 0).all()
    label = simhash.roots(len(fps), a, b)
    whole = brute_components([(i, int(f)) for i, f in enumerate(fps)])
    groups = {}
    for x, y in zip(label.tolist(), whole):
        assert groups.setdefault(x, y) == y
    assert len(set(groups.values())) == len(groups)


def test_dense_group_gives_few_links():
    bits = np.arange(2000, dtype=np.uint64)  # all within 11 bits
    a, _ = simhash.tile_links(bits)
    assert len(a) == 1999


def test_components_of_chains(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (7, 7), (500, 400)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a bigint, b bigint").repartition(4)).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 200: 100, 300: 100, 500: 400}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_one_of_each(spark):
    rng = random.Random(2)
    texts = near_copies(rng, 30)
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "same text"), (None, "same text"), (None, None)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA)
    out = simhash.one_of_each(df)
    assert out.columns == df.columns
    fps = [(d, brute_fingerprint(t)) for d, t in docs[:30]]
    rows = out.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(set(brute_components(fps)))
    assert sorted((r.text or "") for r in rows if r.doc_id is None) == ["", "same text"]


@pytest.mark.parametrize("parts", [1, 2, 3, 7])
def test_one_of_each_loses_no_text_under_shared_ids(spark, parts):
    long_a, long_b, long_c = (" ".join(f"{w}{i}" for i in range(60)) for w in "abc")
    docs = [(1, long_a), (5, long_a), (5, long_b), (5, long_b), (None, long_b), (None, long_c), (None, long_c), (9, None), (9, "")]
    df = spark.createDataFrame([(*d, "x", k % 2) for k, d in enumerate(docs)], SCHEMA).repartition(parts)
    kept = sorted(((r.doc_id, r.text or "") for r in simhash.one_of_each(df).collect()), key=repr)
    assert kept == sorted([(1, long_a), (5, long_b), (None, long_c), (9, "")], key=repr)
    again = df.repartition(parts + 2)
    rows = [sorted(map(repr, simhash.one_of_each(x).collect())) for x in (df, again)]
    assert rows[0] == rows[1]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(df).count() == 0 and simhash.one_of_each(df).count() == 0


def test_whole_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(spark, docs)
