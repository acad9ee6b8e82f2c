"""Back-fill of the score history: the scores of all accounts at a list of times, in one pass over the data."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acctpulse.functions import scores as rules
from acctpulse.operators.scoring import health_components, score_accounts, with_total

WINDOW_DAYS = 30

# Running state of an account. Counters are changes that add up over the slots, times are running extremes.
COUNTERS = ("users", "admins", "seen_users", "events", "types", "tickets", "open", "critical", "active")
LATEST = ("last_login_at", "last_event_at")
EARLIEST = ("first_event_at",)


class Slots:
    """Ascending snapshot times; gives SQL text. Slot ``n`` stands for "after the last snapshot"."""

    def __init__(self, as_ofs: Sequence[str]):
        self.times = [f"timestamp_ntz'{t}'" for t in sorted(str(a) for a in as_ofs)]
        self.n = len(self.times)

    def _first(self, hit: Callable[[str], str], low: int = 0, high: int | None = None) -> str:
        """Index of the first snapshot time for which ``hit`` holds (``n`` if none): a bisection in CASE form."""
        high = self.n if high is None else high
        if low == high:
            return str(low)
        mid = (low + high) // 2
        return f"if({hit(self.times[mid])}, {self._first(hit, low, mid)}, {self._first(hit, mid + 1, high)})"

    def first_from(self, ts: str) -> str:
        """First snapshot at or after ``ts``; NULL counts as "since ever"."""
        return f"if({ts} is null, 0, {self._first(lambda at: f'{at} >= {ts}')})"

    def first_past_window(self, event_date: str) -> str:
        """First snapshot whose trailing window no longer reaches back to ``event_date``."""
        return self._first(lambda at: f"date_sub(date({at}), {WINDOW_DAYS}) > {event_date}")

    def rows(self) -> str:
        items = ", ".join(f"struct({i} as slot, {t} as scored_at)" for i, t in enumerate(self.times))
        return f"inline(array({items}))"


def _change(slot: str, **values: str) -> str:
    """One state change at a slot, with every state column present."""
    fields = [f"int({slot}) as slot"]
    fields += [f"bigint({values.get(c, '0')}) as {c}" for c in COUNTERS]
    fields += [f"cast({values.get(c, 'null')} as timestamp_ntz) as {c}" for c in (*LATEST, *EARLIEST)]
    return f"struct({', '.join(fields)})"


def _merge(changes: DataFrame, *keys: str) -> DataFrame:
    return changes.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in COUNTERS],
        *[F.max(c).alias(c) for c in LATEST],
        *[F.min(c).alias(c) for c in EARLIEST],
    )


def _user_changes(users: DataFrame, slots: Slots, login_event: str | None) -> DataFrame:
    changes = [_change(slots.first_from("created_at"), users="1", admins="if(role = 'admin', 1, 0)")]
    if login_event is None:
        # Without login events the stored last login is all there is; it counts from its own time on.
        changes.append(_change(slots.first_from("last_login"), last_login_at="last_login"))
    return users.selectExpr("company_id", f"inline(array({', '.join(changes)}))")


def _ticket_changes(tickets: DataFrame, slots: Slots) -> DataFrame:
    """A ticket counts from its creation; it is open until it was resolved."""
    spans = tickets.selectExpr(
        "company_id",
        "severity",
        f"{slots.first_from('created_at')} as opened",
        f"if(status <> 'resolved', {slots.n}, {slots.first_from('coalesce(resolved_at, created_at)')}) as closed",
    ).selectExpr("company_id", "severity", "opened", "closed", "if(opened < closed, 1, 0) as live")
    critical = "if(severity = 'critical', live, 0)"
    start = _change("opened", tickets="1", open="live", critical=critical)
    end = _change("closed", open="-live", critical=f"-{critical}")
    return spans.selectExpr("company_id", f"inline(if(live = 1, array({start}, {end}), array({start})))")


def _event_changes(events: DataFrame, users: DataFrame, slots: Slots, seats: str, login_event: str | None):
    """Event-driven changes from one scan. Raw events are folded per user and slot before anything else.

    ``distinct`` seats: a user is active from a slot with events until the window of their newest event so far
    closes or their next slot with events takes over. ``daily_sum`` seats: each (user, day, type) is active
    from the slot of its first event until its day leaves the window. Either way activity is a plus one at the
    start and a minus one at the end.
    """
    if seats not in ("distinct", "daily_sum"):
        raise ValueError(f"unknown seats: {seats}")
    daily = seats == "daily_sum"
    keys = ["user_id", "event_type", f"{slots.first_from('occurred_at')} as slot"]
    keys += ["date(occurred_at) as event_date"] if daily else []
    folded = (
        events.filter(f"user_id is not null and occurred_at <= {slots.times[-1]}")
        .groupBy(*[F.expr(k) for k in keys])
        .agg(F.count("id").alias("n"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"))
    )
    rows = folded.join(users.selectExpr("id as user_id", "company_id"), "user_id")

    # Windows below share the join's partitioning by user; a user has few rows (types x slots, or x days).
    if daily:
        picked = rows.selectExpr(
            "*",
            "row_number() over (partition by user_id order by slot, event_type, event_date) as seen",
            "row_number() over (partition by user_id, event_date, event_type order by slot) as pick",
            f"{slots.first_past_window('event_date')} as end",
        )
    else:
        picked = rows.selectExpr(
            "*",
            "row_number() over (partition by user_id order by slot, event_type) as seen",
            "row_number() over (partition by user_id, slot order by event_type) as pick",
            "max(last_at) over (partition by user_id, slot) as newest",
        ).selectExpr(
            "*",
            """lead(if(pick = 1, slot, null)) ignore nulls over (partition by user_id order by slot, event_type)
                 as following""",
        ).selectExpr(
            "*", f"least(coalesce(following, {slots.n}), {slots.first_past_window('date(newest)')}) as end"
        )
    active = "if(pick = 1 and slot < end, 1, 0)"
    start = _change(
        "slot", events="n", seen_users="if(seen = 1, 1, 0)", active=active, first_event_at="first_at",
        last_event_at="last_at", last_login_at=f"if(event_type = '{login_event}', last_at, null)" if login_event else "null",
    )
    stop = _change("end", active=f"-{active}")
    changes = picked.selectExpr(
        "company_id", "event_type", f"inline(if({active} = 1, array({start}, {stop}), array({start})))"
    )
    merged = _merge(changes.filter(f"slot < {slots.n}"), "company_id", "event_type", "slot")
    # A type counts once, from its first slot with events.
    first = "min(if(events > 0, slot, null)) over (partition by company_id, event_type)"
    others = [c for c in COUNTERS if c != "types"]
    return merged.selectExpr(
        "company_id", "slot", *others, *LATEST, *EARLIEST,
        f"bigint(if(event_type is not null and slot = {first}, 1, 0)) as types",
    )


def account_states(
    companies: DataFrame,
    users: DataFrame,
    events: DataFrame,
    tickets: DataFrame,
    as_ofs: Sequence[str],
    mode: str = "exact",
    seats: str = "distinct",
    login_event: str | None = None,
) -> DataFrame:
    """Account dimension (with ``active_users_30d``) as it stood at each of ``as_ofs``.

    Every source row is turned into a change at one snapshot slot (two for things that end), changes are
    added up per company and slot, and running totals over the few slots of a company give the states. Each
    source is scanned once and the work is linear in its rows, whatever the number of snapshots.
    """
    slots = Slots(as_ofs)
    users = users.filter("company_id is not null")
    branches = [
        _user_changes(users, slots, login_event),
        _ticket_changes(tickets.filter("company_id is not null"), slots),
        _event_changes(events, users, slots, seats, login_event),
    ]
    changes = reduce(DataFrame.unionByName, branches).filter(f"slot < {slots.n}")
    merged = _merge(changes, "company_id", "slot")
    grid = companies.withColumnRenamed("id", "company_id").selectExpr("*", slots.rows())
    running = "over (partition by company_id order by slot rows between unbounded preceding and current row)"
    attributes = ["company_id", "name", "plan", "mrr_cents", "churned_at", "created_at", "scored_at"]
    state = grid.join(merged, ["company_id", "slot"], "left").selectExpr(
        *attributes,
        *[f"coalesce(sum({c}) {running}, 0) as {c}" for c in COUNTERS],
        *[f"max({c}) {running} as {c}" for c in LATEST],
        *[f"min({c}) {running} as {c}" for c in EARLIEST],
    )
    n_events, rows = ("events", "1")
    if mode == "fanout":
        n_events, rows = "events * greatest(tickets, 1)", "greatest(events + users - seen_users, 1)"
    return state.filter("created_at is null or created_at <= scored_at").selectExpr(
        "company_id",
        "name as company_name",
        "plan",
        "mrr_cents",
        "if(churned_at <= scored_at, churned_at, null) as churned_at",
        "users as total_users",
        "admins as admin_count",
        "last_login_at",
        "first_event_at",
        "last_event_at",
        f"{n_events} as total_events",
        "types as distinct_event_types",
        f"open * {rows} as open_tickets",
        f"critical * {rows} as critical_tickets",
        "active as active_users_30d",
        "scored_at",
    )


def score_snapshots(
    companies: DataFrame,
    users: DataFrame,
    events: DataFrame,
    tickets: DataFrame,
    as_ofs: Sequence[str],
    mode: str = "exact",
    seats: str = "distinct",
    login_event: str | None = None,
) -> DataFrame:
    """Score snapshots of every account at each of ``as_ofs``, not flagged yet."""
    states = account_states(companies, users, events, tickets, as_ofs, mode, seats, login_event)
    at = F.col("scored_at")
    seated = states.withColumn("seat_score", rules.seat_score(F.col("active_users_30d"), F.col("total_users")))
    health = with_total(health_components(seated, None, at, keep=("scored_at",)))
    return score_accounts(health, at)
