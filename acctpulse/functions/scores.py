"""Scoring rules as column expressions. All of them stay in integer arithmetic and inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from acctpulse.functions.times import AsOf, days, within

# Points of the health score and its thresholds.
LOGIN_LADDER = ((3, 25), (7, 20), (14, 15), (30, 10))  # (days since last login, points)
PLAN_POINTS = (("enterprise", 15), ("pro", 12), ("starter", 8), ("trial", 4))
OTHER_PLAN_POINTS = 4
ADOPTION_TARGET_TYPES = 5
ADOPTION_POINTS = 20
SEAT_POINTS = 20
TICKET_POINTS = 20
CRITICAL_PENALTY = 8
OPEN_PENALTY = 3
RISK_DROP = 15
RISK_DAYS = 14
BRIEF_SCORE_CHANGE = 5


def cap(value: Column, limit: int) -> Column:
    return F.least(value, F.lit(limit))


def floor0(value: Column) -> Column:
    return F.greatest(value, F.lit(0))


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def ratio_points(num: Column, den: Column, points: int) -> Column:
    """``round(num / den * points)`` with halves away from zero, 0 when there is no denominator.

    Exact for non-negative integers: no decimal or float is involved.
    """
    safe = F.nullif(den.cast("bigint"), F.lit(0).cast("bigint"))
    rounded = F.call_function("div", num * F.lit(2 * points) + safe, safe * F.lit(2))
    return F.when(den == 0, F.lit(0)).otherwise(rounded).cast("int")


def login_recency(last_login: Column, as_of: AsOf) -> Column:
    ladder = None
    for max_days, points in LOGIN_LADDER:
        fresh = within(last_login, as_of, max_days)
        ladder = F.when(fresh, points) if ladder is None else ladder.when(fresh, points)
    return ladder.otherwise(0)


def adoption_score(distinct_types: Column) -> Column:
    return cap(ratio_points(distinct_types, F.lit(ADOPTION_TARGET_TYPES), ADOPTION_POINTS), ADOPTION_POINTS)


def ticket_score(critical: Column, open_: Column) -> Column:
    penalty = critical * CRITICAL_PENALTY + floor0(open_ - critical) * OPEN_PENALTY
    return floor0(F.lit(TICKET_POINTS) - penalty).cast("int")


def plan_tier(plan: Column) -> Column:
    tiers = None
    for name, points in PLAN_POINTS:
        hit = plan == name
        tiers = F.when(hit, points) if tiers is None else tiers.when(hit, points)
    return tiers.otherwise(OTHER_PLAN_POINTS)


def seat_score(active: Column, seats: Column) -> Column:
    return cap(ratio_points(active, seats, SEAT_POINTS), SEAT_POINTS)


def is_open(status: Column) -> Column:
    return status != "resolved"


def is_open_critical(status: Column, severity: Column) -> Column:
    return is_open(status) & (severity == "critical")


def is_churned(churned_at: Column) -> Column:
    return churned_at.isNotNull()


def has_prev(prev: Column) -> Column:
    return prev.isNotNull()


def is_at_risk(
    prev: Column, cur: Column, prev_at: Column, cur_at: Column, drop: int = RISK_DROP, max_days: int = RISK_DAYS
) -> Column:
    """A previous score exists, the drop is large enough and the two snapshots are close enough."""
    hit = has_prev(prev) & ((prev - cur) >= drop) & ((cur_at - prev_at) <= days(max_days))
    return F.when(hit, True).otherwise(False)


def score_moved(latest: Column, prev: Column, threshold: int = BRIEF_SCORE_CHANGE) -> Column:
    """Strictly more than ``threshold`` points between the two newest scores; no second score passes."""
    return F.coalesce(F.abs(latest - prev) > threshold, F.lit(True))
