"""Per-key helpers against plain Python on random rows, with one hot key."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from acctpulse.functions import keyed as K

START = datetime(2023, 11, 1)


def history(seed, n=400, keys=12):
    """Unique (key, time) rows; key 0 holds about a third of them."""
    rng = random.Random(seed)
    seen = set()
    while len(seen) < n:
        key = 0 if rng.random() < 0.33 else rng.randrange(keys)
        seen.add((key, START + timedelta(hours=rng.randrange(24 * 150))))
    return [(k, t, rng.randrange(101)) for k, t in sorted(seen)]


def frame(rows, data):
    return rows(data, "company_id long, scored_at timestamp_ntz, score int").repartition(5)


def test_previous_row_equals_lag(rows):
    for seed in range(3):
        data = history(seed)
        expected, last = {}, {}
        for k, t, s in sorted(data):
            expected[(k, t)] = last.get(k)
            last[k] = (s, t)
        for bucket in ("month", "day"):
            got = K.previous_row(frame(rows, data), "company_id", "scored_at", ["score", "scored_at"], bucket)
            found = {
                (r.company_id, r.scored_at): None if r.prev_score is None else (r.prev_score, r.prev_scored_at)
                for r in got.collect()
            }
            assert found == expected


def test_latest_k_and_nested(rows):
    data = history(7)
    newest = {}
    for k, t, s in sorted(data, key=lambda r: r[1], reverse=True):
        newest.setdefault(k, []).append((s, t))
    df = frame(rows, data)
    ranked = K.latest_k(df, "company_id", [F.desc("scored_at")], 3).collect()
    assert {(r.company_id, r.rn): (r.score, r.scored_at) for r in ranked} == {
        (k, i + 1): v for k, items in newest.items() for i, v in enumerate(items[:3])
    }
    nested = K.top_k_nested(df, "company_id", [F.desc("scored_at")], 10, ["score", "scored_at"], "items").collect()
    assert {r.company_id: [tuple(x) for x in r["items"]] for r in nested} == {k: v[:10] for k, v in newest.items()}


def test_group_limit_runs_before_the_exchange(rows):
    df = K.latest_k(frame(rows, history(1)), "company_id", [F.desc("scored_at")], 10)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_spread_semi_and_anti(rows):
    rng = random.Random(3)
    data = [(0 if rng.random() < 0.4 else rng.randrange(30), f"n{i}") for i in range(500)]
    df = rows(data, "company_id long, note_id string")
    known = rows([(k,) for k in range(0, 30, 2)] + [(0,)], "company_id long")
    kept = K.spread_semi(df, known, "company_id", F.col("note_id"), salts=4)
    gone = K.spread_semi(df, known, "company_id", F.col("note_id"), how="left_anti", salts=4)
    assert sorted(map(tuple, kept.select(*df.columns).collect())) == sorted(r for r in data if r[0] % 2 == 0)
    assert sorted(map(tuple, gone.select(*df.columns).collect())) == sorted(r for r in data if r[0] % 2)
