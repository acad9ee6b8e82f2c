"""Rollup, daily facts and snapshots against brute force on random rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from acctpulse.operators import daily as D
from acctpulse.operators.rollup import account_rollup
from acctpulse.plans.snapshots import account_states
from acctpulse.schemas import SOURCE_SCHEMAS

DAY = timedelta(days=1)
T0 = datetime(2024, 1, 1)


def world(spark, seed, n_events=300):
    """Small random sources with a hot user, idle users, orphans and empty companies."""
    rng = random.Random(seed)
    when = lambda span: T0 + timedelta(minutes=rng.randrange(span * 1440))
    companies = [
        (i, f"c{i}", rng.choice(["pro", "trial", "legacy"]), 100 * i, when(60) if rng.random() < 0.3 else None,
         when(20) if rng.random() < 0.3 else T0 - 90 * DAY)
        for i in range(8)
    ]
    users = [
        (i, f"u{i}@x", rng.choice([None, 0, 1, 2, 3, 4, 5, 99]), rng.choice(["admin", "member"]), when(30) - 20 * DAY, when(60))
        for i in range(20)
    ]
    events = [
        (i, rng.choice([3, 3, rng.randrange(22), None]), rng.choice("abcde"), when(70), None) for i in range(n_events)
    ]
    tickets = []
    for i in range(40):
        created = when(60)
        status = rng.choice(["open", "pending", "resolved"])
        resolved = created + timedelta(hours=rng.randrange(1, 400)) if status == "resolved" and rng.random() < 0.9 else None
        tickets.append((i, rng.choice([None, 0, 1, 2, 3, 7, 99]), "s", status, rng.choice(["low", "critical"]), created, resolved))
    data = {"companies": companies, "users": users, "events": events, "tickets": tickets}
    return data, {t: spark.createDataFrame(rows, SOURCE_SCHEMAS[t]).repartition(3) for t, rows in data.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_fanout_equals_the_literal_join(spark, seed):
    _, src = world(spark, seed)
    for name, df in src.items():
        df.createOrReplaceTempView(f"w_{name}")
    literal = spark.sql(
        """
        select c.id as company_id, count(distinct u.id) as total_users,
          count(distinct u.id) filter (where u.role = 'admin') as admin_count, max(u.last_login) as last_login_at,
          min(e.occurred_at) as first_event_at, max(e.occurred_at) as last_event_at, count(e.id) as total_events,
          count(distinct e.event_type) as distinct_event_types,
          count(t.id) filter (where t.status != 'resolved') as open_tickets,
          count(t.id) filter (where t.severity = 'critical' and t.status != 'resolved') as critical_tickets
        from w_companies c left join w_users u on u.company_id = c.id left join w_events e on e.user_id = u.id
          left join w_tickets t on t.company_id = c.id
        group by c.id"""
    )
    got = account_rollup(**src, as_of=T0, mode="fanout").select(*literal.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, literal.collect()))


def brute_states(data, as_of, seats, login_event, fanout):
    out = {}
    owner = {u[0]: u[2] for u in data["users"]}
    for cid, _name, _plan, _mrr, churned, created in data["companies"]:
        if created > as_of:
            continue
        mine = [e for e in data["events"] if e[1] is not None and owner.get(e[1], -1) == cid and e[3] <= as_of]
        users = [u for u in data["users"] if u[2] == cid and u[4] <= as_of]
        tickets = [t for t in data["tickets"] if t[1] == cid and t[5] <= as_of]
        live = [
            t for t in tickets
            if t[3] != "resolved" or (t[6] is not None and t[6] > as_of)
        ]
        recent = [e for e in mine if e[3].date() >= as_of.date() - timedelta(days=30)]
        active = {e[1] for e in recent} if seats == "distinct" else {(e[1], e[3].date(), e[2]) for e in recent}
        if login_event:
            logins = [e[3] for e in mine if e[2] == login_event]
        else:
            logins = [u[5] for u in data["users"] if u[2] == cid and u[5] <= as_of]
        n, n_open, n_critical = len(mine), len(live), len([t for t in live if t[4] == "critical"])
        if fanout:
            rows = max(n + len(users) - len({e[1] for e in mine}), 1)
            n, n_open, n_critical = n * max(len(tickets), 1), n_open * rows, n_critical * rows
        out[cid] = (
            churned if churned and churned <= as_of else None, len(users), len([u for u in users if u[3] == "admin"]),
            max(logins, default=None), min((e[3] for e in mine), default=None), max((e[3] for e in mine), default=None),
            n, len({e[2] for e in mine}), n_open, n_critical, len(active),
        )
    return out


@pytest.mark.parametrize(
    "seed,seats,login_event,mode",
    [(1, "distinct", "a", "exact"), (2, "daily_sum", None, "fanout"), (3, "distinct", None, "fanout"), (4, "daily_sum", "b", "exact")],
)
def test_states_equal_brute_force_at_any_time(spark, seed, seats, login_event, mode):
    data, src = world(spark, seed)
    rng = random.Random(seed)
    times = sorted({T0 + timedelta(minutes=rng.randrange(80 * 1440)) for _ in range(9)} | {T0 + 31 * DAY})
    states = account_states(**src, as_ofs=[str(t) for t in times], mode=mode, seats=seats, login_event=login_event)
    got = {(r.company_id, r.scored_at): tuple(r)[4:-1] for r in states.collect()}
    expected = {
        (cid, t): state
        for t in times
        for cid, state in brute_states(data, t, seats, login_event, mode == "fanout").items()
    }
    assert got == expected


def test_fold_equals_sequential_upserts(spark):
    _, src = world(spark, 5)
    events, users = src["events"], src["users"]
    marks = [-1, 80, 150, 151, 299]
    batches = [
        D.events_daily(events.filter(F.col("id") <= high), users, low) for low, high in zip(marks, marks[1:], strict=False)
    ]
    state = {}
    for batch in batches:
        for r in batch.collect():
            n, u = state.get(r[:3], (0, 0))
            state[r[:3]] = (n + r.event_count, max(u, r.unique_users))
    log = batches[2].unionByName(batches[0]).unionByName(batches[3]).unionByName(batches[1])
    assert {r[:3]: (r.event_count, r.unique_users) for r in D.fold_daily(log).collect()} == state


def test_watermark(spark, rows):
    _, src = world(spark, 6)
    state = rows([("tickets", 4, T0)], "table_name string, last_synced_id long, last_synced_at timestamp_ntz")
    assert D.watermark(state, "events") == -1 and D.watermark(state, "tickets") == 4
    batch = D.events_daily(src["events"], src["users"])
    moved = D.advance_watermark(state, "events", batch, T0)
    # Only events of known users with a company move the mark.
    owner = {r.id for r in src["users"].collect() if r.company_id is not None}
    top = max(r.id for r in src["events"].collect() if r.user_id in owner)
    assert sorted(tuple(r)[:2] for r in moved.collect()) == [("events", top), ("tickets", 4)]
    empty = D.events_daily(src["events"], src["users"], 10_000)
    assert sorted(tuple(r) for r in D.advance_watermark(state, "events", empty, T0).collect()) == [("tickets", 4, T0)]


def test_event_mix_ties_go_by_name(rows):
    day = T0.date()
    data = [(1, day, t, n, 1) for t, n in [("z", 5), ("a", 5), ("m", 9), ("b", 1), ("c", 1), ("d", 1)]]
    data += [(1, day - timedelta(days=31), "old", 99, 1), (1, day - timedelta(days=30), "edge", 2, 1)]
    daily = rows(data, "company_id long, event_date date, event_type string, event_count long, unique_users long")
    got = D.recent_event_mix(daily, T0).orderBy("rn").collect()
    assert [(r.event_type, r.cnt) for r in got] == [("m", 9), ("a", 5), ("z", 5), ("edge", 2), ("b", 1)]


def test_refresh_repairs_split_days(spark):
    _, src = world(spark, 7)
    late = D.events_daily(src["events"].filter("id >= 150"), src["users"])
    true = {r[:3]: tuple(r)[3:5] for r in D.events_daily(src["events"], src["users"]).collect()}
    days = {r.event_date for r in late.collect()}
    got = {r[:3]: tuple(r)[3:] for r in D.refresh_days(src["events"], src["users"], late).collect()}
    assert got == {k: v for k, v in true.items() if k[1] in days}
