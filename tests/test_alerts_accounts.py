"""Alerts, listings, details, upserts and notes on hand-made rows."""

from datetime import datetime, timedelta

import pytest

from acctpulse.operators import accounts as AC
from acctpulse.operators import alerts as AL
from acctpulse.operators import trend as T
from acctpulse.schemas import STORE_SCHEMAS
from acctpulse.sources import readers as R

NOW = datetime(2024, 1, 31, 1)
PARTS = (25, 20, 20, 4, 5)


@pytest.fixture
def accounts(rows):
    data = [
        (i, f"Co {i}", plan, 100, None, 5, 1, None, None, None, 0, 0, 0, 0, NOW)
        for i, plan in ((1, "pro"), (2, "trial"), (3, "pro"), (4, "starter"), (10, "pro"))
    ]
    return rows(data, STORE_SCHEMAS["dim_accounts"])


@pytest.fixture
def scores(rows):
    """Account 1: twelve snapshots; 2: one; 3: recovered after a drop; 4: none; 10: dropped; 99: unknown."""
    day = timedelta(days=1)
    data = [(1, 50 + i, False, PARTS, NOW - (11 - i) * day) for i in range(12)]
    data += [(2, 0, None, PARTS, NOW)]
    data += [(3, 80, False, PARTS, NOW - 9 * day), (3, 40, True, PARTS, NOW - 5 * day), (3, 90, False, PARTS, NOW)]
    data += [(10, 90, False, PARTS, NOW - 2 * day), (10, 61, True, PARTS, NOW - day)]
    data += [(99, 10, True, PARTS, NOW)]
    return rows(data, STORE_SCHEMAS["fact_health_score"]).repartition(3)


def alerts_frame(rows):
    data = [
        ("a1", 10, "score_drop", "today", False, datetime(2024, 1, 31, 0, 0)),
        ("a2", 3, "score_drop", "yesterday", True, datetime(2024, 1, 30, 23, 59)),
        ("a3", 3, "churned", "other type today", False, datetime(2024, 1, 31, 0, 30)),
        ("a4", 77, "score_drop", "unknown account", False, datetime(2024, 1, 31, 0, 50)),
        ("a5", 1, "critical_ticket", "x", None, datetime(2024, 1, 29)),
    ]
    return rows(data, STORE_SCHEMAS["alert_log"])


def test_at_risk_keeps_recovered_accounts_unless_current_only(scores, accounts):
    listed = {r.company_id: r.score for r in AL.at_risk_accounts(scores, accounts).collect()}
    assert listed == {3: 40, 10: 61}
    assert [r.company_id for r in AL.at_risk_accounts(scores, accounts, current_only=True).collect()] == [10]


def test_new_alerts_once_per_day_and_type(rows, scores, accounts):
    at_risk = AL.at_risk_accounts(scores, accounts)
    new = AL.new_alerts(at_risk, alerts_frame(rows), NOW)
    got = new.collect()
    assert [(r.company_id, r.message) for r in got] == [(3, "Co 3 (PRO) health score is 40/100 — flagged at-risk.")]
    assert tuple(AL.alert_summary(at_risk, new).first()) == (2, 1, 1)
    empty = at_risk.limit(0)
    assert tuple(AL.alert_summary(empty, AL.new_alerts(empty, alerts_frame(rows), NOW)).first()) == (0, 0, 0)


def test_digest_lines(scores, accounts):
    at_risk = AL.at_risk_accounts(scores, accounts)
    rows_ = {(r.part, r.company_id): r.line for r in AL.alert_digest(at_risk, NOW).collect()}
    assert rows_["account", 3] == "- Co 3 (PRO, score=40)" and rows_["account", 10] == "- Co 10 (PRO, score=61)"
    prompt = "\n".join([rows_["head", None], rows_["account", 3], rows_["account", 10], rows_["tail", None]])
    assert "(2 total):\n- Co 3 (PRO, score=40)\n- Co 10 (PRO, score=61)\n\nWrite" in prompt and len(rows_) == 4
    assert AL.alert_digest(at_risk, datetime(2024, 1, 31, 2)).isEmpty()
    assert AL.alert_digest(at_risk.limit(0), NOW).isEmpty()


def test_digest_has_one_shape_at_every_length(rows):
    many = rows([(i, f"Co {i}", "pro", 40, NOW) for i in range(1200)], "company_id long, company_name string, plan string, score int, scored_at timestamp_ntz")
    parts = AL.alert_digest(many, NOW).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts} == {"head": 1, "account": 1200, "tail": 1}


def test_feed_filters_orders_and_limits(rows, accounts):
    log = alerts_frame(rows)
    assert [r.alert_id for r in AL.alert_feed(log, accounts).collect()] == ["a3", "a1", "a2", "a5"]
    assert [r.alert_id for r in AL.alert_feed(log, accounts, acknowledged=False).collect()] == ["a3", "a1"]
    assert [r.alert_id for r in AL.alert_feed(log, accounts, acknowledged=True).collect()] == ["a2"]
    assert [r.alert_id for r in AL.alert_feed(log, accounts, limit=2).collect()] == ["a3", "a1"]


def test_feed_limit_with_a_hot_account(rows, accounts):
    data = [(f"h{i:03d}", 1, "x", "m", False, NOW - timedelta(minutes=i)) for i in range(300)]
    data += [(f"o{i}", 2, "x", "m", False, NOW - timedelta(minutes=i, seconds=1)) for i in range(5)]
    log = rows(data, STORE_SCHEMAS["alert_log"]).repartition(4)
    expected = [r[0] for r in sorted(data, key=lambda r: (-r[5].timestamp(), r[0]))]
    assert [r.alert_id for r in AL.alert_feed(log, accounts).collect()] == expected[:50]
    assert [r.alert_id for r in AL.alert_feed(log, accounts, limit=200).collect()] == expected[:200]
    for refused in (201, 1000, 0):
        with pytest.raises(ValueError):
            AL.alert_feed(log, accounts, limit=refused)


def test_acknowledge(rows):
    log, ids = alerts_frame(rows), rows([("a1",), ("a1",), ("zz",)], "alert_id string")
    flagged, unknown = AL.acknowledge(log, ids)
    assert {r.alert_id: r.acknowledged for r in flagged.collect()} == {
        "a1": True, "a2": True, "a3": False, "a4": False, "a5": None
    }
    assert flagged.columns == log.columns
    assert [r.alert_id for r in unknown.collect()] == ["zz"]


def test_listing_orders_and_filters(scores, accounts):
    ids = lambda df: [r.company_id for r in df.collect()]
    assert ids(AC.account_list(accounts, scores)) == [3, 1, 10, 2, 4]
    assert ids(AC.account_list(accounts, scores, order_by="nonsense")) == [3, 1, 10, 2, 4]
    assert ids(AC.account_list(accounts, scores, order_by="score_asc")) == [2, 1, 10, 3, 4]
    assert ids(AC.account_list(accounts, scores, order_by="name")) == [1, 10, 2, 3, 4]
    assert ids(AC.account_list(accounts, scores, plan="pro")) == [3, 1, 10]
    assert ids(AC.account_list(accounts, scores, plan="")) == [3, 1, 10, 2, 4]
    assert ids(AC.account_list(accounts, scores, at_risk_only=True)) == [10]


def test_detail(rows, scores, accounts):
    notes = [(f"n{i:02d}", 1, "Zoë", f'note "{i}" ✓', NOW - timedelta(hours=i)) for i in range(11)]
    notes += [("m0", 3, "Al", "one", NOW)]
    briefs = [
        (1, "new", "do", "h2", 1, 2, "m", NOW), (1, "old", "do", "h1", 1, 2, "m", NOW - timedelta(days=1))
    ]
    detail = AC.account_detail(
        accounts, scores, rows(briefs, STORE_SCHEMAS["ai_summaries"]), rows(notes, STORE_SCHEMAS["crm_notes"]),
        alerts_frame(rows),
    )
    by_id = {r.company_id: r for r in detail.collect()}
    assert sorted(by_id) == [1, 2, 3, 4, 10]
    one, four = by_id[1], by_id[4]
    assert [h.score for h in one.score_history] == list(range(61, 51, -1))
    assert (one.health_score.score, one.health_score.components.adoption) == (61, 20)
    assert one.ai_summary.summary == "new"
    assert [n.note_id for n in one.cs_notes] == [f"n{i:02d}" for i in range(10)]
    assert one.cs_notes[3].note == 'note "3" ✓'
    assert one.open_alerts == []  # an alert without a flag value is not open
    assert [a.alert_id for a in by_id[3].open_alerts] == ["a3"]
    assert (four.health_score, four.ai_summary) == (None, None)
    assert (four.score_history, four.cs_notes, four.open_alerts) == ([], [], [])


def test_upsert_keeps_missing_rows(rows):
    schema = "company_id long, v string"
    old, new = rows([(1, "a"), (2, "b")], schema), rows([(2, "B"), (3, "C")], schema)
    assert sorted(map(tuple, AC.upsert_replace(old, new, ["company_id"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]


def test_notes_accept_and_reject(rows, accounts):
    notes = rows([(1, "a", "x"), (1, "a", "y"), (55, "b", "z"), (None, "c", "w")], "company_id long, author string, note string")
    accepted, rejected = AC.add_notes(notes, accounts, NOW)
    assert sorted(r.note for r in accepted.collect()) == ["x", "y"]
    assert sorted(r.note for r in rejected.collect()) == ["w", "z"]
    assert len({r.note_id for r in accepted.collect()}) == 2


def test_flag_at_risk_touches_only_the_newest(rows):
    day = timedelta(days=1)
    data = [(1, 90, None, PARTS, NOW - 9 * day), (1, 70, False, PARTS, NOW), (2, 50, False, PARTS, NOW)]
    got = T.flag_at_risk(rows(data, STORE_SCHEMAS["fact_health_score"])).collect()
    assert {(r.company_id, r.score): r.at_risk for r in got} == {(1, 90): None, (1, 70): True, (2, 50): False}


def test_trend_history_and_state_agree(scores):
    trend = {r.company_id: r for r in T.score_trend(scores).collect()}
    assert (trend[10].score_drop, trend[10].at_risk) == (29, True)
    assert (trend[2].prev_score, trend[2].score_drop, trend[2].at_risk) == (None, None, False)
    flagged = [r for r in T.score_drop_history(scores).collect() if r.at_risk]
    assert {(r.company_id, r.current_score) for r in flagged} == {(3, 40), (10, 61)}


def test_targets(rows, accounts):
    assert [r.company_id for r in R.target_accounts(accounts).collect()] == [1, 2, 3, 4, 10]
    ids = rows([(10,), (2,), (500,)], "company_id long")
    assert [r.company_id for r in R.target_accounts(accounts, ids).collect()] == [2, 10]
