"""Recall against brute force, ties, duplicates and odd vectors."""

import numpy as np
import pytest

from acctpulse.llm import ann

SCHEMA = "vec_id bigint, embedding array<float>, shard int, ids string, v string"


def brute(rows, every=20, k=20):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, q in good:
        if i % every == 0:
            scores = [(-float(x @ q), j) for j, x in good if j != i and len(x) == len(q)]
            out[i] = [(j, -s) for s, j in sorted(scores)[:k]]
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1, "a", "b") for i, v in rows], SCHEMA).repartition(3)
    got = {}
    for r in ann.nearest(df, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(got[r.query_id]) == r.rank
    return got


def recall(got, want):
    hits = [len({j for j, _ in got.get(q, [])} & {j for j, _ in best}) / len(best) for q, best in want.items() if best]
    return float(np.mean(hits))


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_recall_with_many_lengths_and_duplicates(spark, spread):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)).astype(np.float32) * np.exp(spread * rng.normal(size=(1500, 1))).astype(np.float32)
    x[200:500] = x[200]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = run(spark, rows), brute(rows)
    assert set(got) == set(want) and recall(got, want) >= 0.9
    for q, best in got.items():
        assert len(best) == 20 and q not in {j for j, _ in best}
        assert [(-s, j) for j, s in best] == sorted((-s, j) for j, s in best)
        for j, s in best:
            assert s == pytest.approx(float(x[j].astype(np.float64) @ x[q].astype(np.float64)))


def test_odd_vectors_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [nan, 1.0]), (80, [1.0, None]), (100, []), (3, [inf, 1.0]), (None, [1.0, 1.0]),
            (5, [1.0, 0.0]), (4, [1.0, 0.0]), (6, [-2.0, 0.0]), (120, [1.0, 2.0, 3.0])]
    assert run(spark, rows) == {0: [(4, 1.0), (5, 1.0), (6, -2.0)]}
    assert run(spark, []) == {}


def test_recall_on_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want, got = brute(rows), {}
    for r in ann.nearest(table).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert recall(got, want) >= 0.95


@pytest.mark.parametrize("dim", [2, 4])
def test_every_node_is_reached(dim):
    for seed in range(120):
        rng = np.random.default_rng(seed)
        points = rng.normal(size=(int(rng.integers(1, 120)), dim)).astype(np.float32)
        points *= np.exp(2 * rng.normal(size=(len(points), 1))).astype(np.float32)
        edges, entry = ann.build_graph(ann.augmented(points.astype(np.float64)), degree=4, beam=8)
        assert ann.reached(edges, entry).all()
        met, _ = ann.beam_search(ann.augmented(points.astype(np.float64)), edges, entry, np.zeros((1, dim + 1), np.float32), len(points))
        assert set(met[0].tolist()) == set(range(len(points)))


def test_lost_nodes_are_linked_beyond_the_degree():
    points = np.arange(12, dtype=np.float32)[:, None]
    edges = np.array([[1, 2], *([[0, 1]] * 11)])  # 3 to 11 are never pointed at
    whole = ann.connect(points, edges, 0)
    assert ann.reached(whole, 0).all() and (whole[:, :2] == edges).all()


@pytest.mark.parametrize("n", [1, 2, 15, 150])
def test_all_candidates_if_there_are_few(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, 3)).astype(np.float32))]
    got, want = run(spark, rows, k=200, beam=200, shards=3), brute(rows, k=200)
    assert {q: {j for j, _ in best} for q, best in got.items()} == {q: {j for j, _ in best} for q, best in want.items() if best}


def test_batches_of_queries_and_several_lengths(spark):
    rng = np.random.default_rng(8)
    rows = [(20 * i, rng.normal(size=6 if i % 3 else 9).astype(np.float32).tolist()) for i in range(2500)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    try:
        got, want = run(spark, rows, shards=2), brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == set(want) and recall(got, want) >= 0.95
