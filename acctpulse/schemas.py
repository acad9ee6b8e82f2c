"""Table schemas and value domains.

Timestamps are ``TIMESTAMP_NTZ`` holding UTC, so results never depend on the session time zone.
Counts are ``BIGINT``, score points ``INT``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import types as T

_LONG, _INT, _STR, _BOOL = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType()
_TS, _DATE = T.TimestampNTZType(), T.DateType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


COMPONENTS = _schema(login_recency=_INT, adoption=_INT, ticket_health=_INT, mrr_tier=_INT, seat_util=_INT)

SOURCE_SCHEMAS: dict[str, T.StructType] = {
    "companies": _schema(id=_LONG, name=_STR, plan=_STR, mrr_cents=_LONG, churned_at=_TS, created_at=_TS),
    "users": _schema(id=_LONG, email=_STR, company_id=_LONG, role=_STR, created_at=_TS, last_login=_TS),
    "events": _schema(id=_LONG, user_id=_LONG, event_type=_STR, occurred_at=_TS, metadata=_STR),
    "tickets": _schema(
        id=_LONG, company_id=_LONG, subject=_STR, status=_STR, severity=_STR, created_at=_TS, resolved_at=_TS
    ),
}

STORE_SCHEMAS: dict[str, T.StructType] = {
    "dim_accounts": _schema(
        company_id=_LONG, company_name=_STR, plan=_STR, mrr_cents=_LONG, churned_at=_TS,
        total_users=_LONG, admin_count=_LONG, last_login_at=_TS, first_event_at=_TS, last_event_at=_TS,
        total_events=_LONG, distinct_event_types=_LONG, open_tickets=_LONG, critical_tickets=_LONG, synced_at=_TS,
    ),
    "fact_events_daily": _schema(
        company_id=_LONG, event_date=_DATE, event_type=_STR, event_count=_LONG, unique_users=_LONG
    ),
    "crm_notes": _schema(note_id=_STR, company_id=_LONG, author=_STR, note=_STR, created_at=_TS),
    "fact_health_score": _schema(
        company_id=_LONG, score=_INT, at_risk=_BOOL, components=COMPONENTS, scored_at=_TS
    ),
    "ai_summaries": _schema(
        company_id=_LONG, summary=_STR, recommended_action=_STR, prompt_hash=_STR,
        input_tokens=_LONG, output_tokens=_LONG, model=_STR, generated_at=_TS,
    ),
    "alert_log": _schema(
        alert_id=_STR, company_id=_LONG, alert_type=_STR, message=_STR, acknowledged=_BOOL, created_at=_TS
    ),
    "daily_log": _schema(
        company_id=_LONG, event_date=_DATE, event_type=_STR, event_count=_LONG, unique_users=_LONG, max_id=_LONG
    ),
    # Folded events of each batch: exact facts of split days, and what the next fold of the activity adds.
    "user_days": _schema(
        user_id=_LONG, event_date=_DATE, event_type=_STR, events=_LONG, max_id=_LONG, first_at=_TS, last_at=_TS
    ),
    # Activity per user and type over all folded user days, replaced by each fold: a run adds what is new to it.
    "user_activity": _schema(user_id=_LONG, event_type=_STR, events=_LONG, first_at=_TS, last_at=_TS),
    "chat_messages": _schema(company_id=_LONG, text=_STR, created_at=_TS),
    "alert_digests": _schema(part=_STR, company_id=_LONG, line=_STR),
    "alert_acks": _schema(alert_id=_STR, acknowledged_at=_TS),
    "sync_state": _schema(table_name=_STR, last_synced_id=_LONG, last_synced_at=_TS),
    "brief_queue": _schema(company_id=_LONG, prompt_hash=_STR, gate=_STR, prompt=_STR),
    "responses": _schema(
        company_id=_LONG, prompt_hash=_STR, text=_STR, input_tokens=_LONG, output_tokens=_LONG, error=_STR
    ),
    # Newest two snapshots and newest flagged one per account, replaced by each scoring run: a run never rescans the history.
    "score_state": _schema(
        company_id=_LONG, score=_INT, at_risk=_BOOL, components=COMPONENTS, scored_at=_TS,
        prev_score=_INT, prev_scored_at=_TS, last_flagged_score=_INT, last_flagged_at=_TS,
    ),
}


class Day(NamedTuple):
    """The day of a row, and the column that a table is partitioned by below its batches: the day, or the first of its month."""

    column: str
    day: str
    monthly: bool = False

    @property
    def partition(self) -> str:
        return f"cast(trunc({self.day}, 'MM') as date)" if self.monthly else self.day


STORE_DAYS = {
    "daily_log": Day("event_date", "event_date"),
    "user_days": Day("event_date", "event_date"),
    "fact_health_score": Day("scored_date", "to_date(scored_at)"),
    # Few rows a day.
    "alert_log": Day("created_month", "to_date(created_at)", monthly=True),
}
# Tables of which the newest batch alone counts.
STATE_TABLES = ("dim_accounts", "score_state", "user_activity")

KNOWN_COLUMNS: dict[str, tuple[str, ...]] = {name: tuple(s.names) for name, s in SOURCE_SCHEMAS.items()}

# Enumerated domains and score bounds of the data model.
PLANS = ("trial", "starter", "pro", "enterprise")
ROLES = ("admin", "member", "viewer")
TICKET_STATUSES = ("open", "pending", "resolved")
TICKET_SEVERITIES = ("low", "medium", "high", "critical")
SCORE_RANGE = (0, 100)
