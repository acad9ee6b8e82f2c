"""Read views over a store: listing, detail, feed."""

from __future__ import annotations

from pyspark.sql import DataFrame

from acctpulse.operators import accounts as AC
from acctpulse.operators import alerts as AL
from acctpulse.plans.run import alert_rows
from acctpulse.sources.store import Store


def list_accounts(
    store: Store, plan: str | None = None, at_risk_only: bool = False, order_by: str = "score_desc"
) -> DataFrame:
    """Account listing; the newest score comes from the state table, one row per account."""
    return AC.account_list(store.read("dim_accounts"), store.read("score_state"), plan, at_risk_only, order_by)


def get_accounts(store: Store, ids: DataFrame | None = None) -> DataFrame:
    return AC.account_detail(
        store.read("dim_accounts"), store.read("fact_health_score"), store.read("ai_summaries"),
        store.read("crm_notes"), alert_rows(store), ids,
    )


def list_alerts(store: Store, acknowledged: bool | None = None, limit: int = 50) -> DataFrame:
    return AL.alert_feed(alert_rows(store), store.read("dim_accounts"), acknowledged, limit)
