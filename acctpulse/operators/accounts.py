"""Account listing, nested account detail, account upsert and notes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acctpulse.functions.keyed import latest_k, latest_per_key, spread_semi, top_k_nested
from acctpulse.functions.text import content_hash
from acctpulse.functions.times import AsOf, as_of_col
from acctpulse.sources.readers import existing, where_opt

SCORE_HISTORY = 10
NOTES_SHOWN = 10
OPEN_ALERTS_SHOWN = 5

LIST_ORDERS = {
    "score_desc": lambda: F.desc_nulls_last("latest_score"),
    "score_asc": lambda: F.asc_nulls_last("latest_score"),
    "name": lambda: F.asc_nulls_last("company_name"),
}


def account_list(
    accounts: DataFrame,
    scores: DataFrame,
    plan: str | None = None,
    at_risk_only: bool = False,
    order_by: str = "score_desc",
) -> DataFrame:
    """Accounts with their newest score. Unknown orders fall back to score, highest first.

    Equal scores go by id, which also lets the range partitioner split a score shared by many accounts.
    """
    newest = latest_per_key(scores, "company_id", F.desc_nulls_first("scored_at")).select(
        "company_id", F.col("score").alias("latest_score"), "at_risk", "scored_at", "components"
    )
    listed = where_opt(accounts, plan=plan).join(newest, "company_id", "left")
    order = LIST_ORDERS.get(order_by, LIST_ORDERS["score_desc"])()
    return (
        where_opt(listed, at_risk_only=at_risk_only)
        .select(
            "company_id", "company_name", "plan", "mrr_cents", "churned_at", "total_users", "open_tickets",
            "critical_tickets", "last_login_at", "synced_at", "latest_score", "at_risk", "scored_at", "components",
        )
        .orderBy(order, F.asc("company_id"))
    )


def score_history(scores: DataFrame, k: int = SCORE_HISTORY) -> DataFrame:
    """Newest ``k`` snapshots per account, one row each, with their rank."""
    return latest_k(scores, "company_id", [F.desc_nulls_first("scored_at")], k)


def account_detail(
    accounts: DataFrame,
    scores: DataFrame,
    briefs: DataFrame,
    notes: DataFrame,
    alerts: DataFrame,
    ids: DataFrame | None = None,
) -> DataFrame:
    """Nested detail per account: newest score, score history, newest brief, notes and open alerts.

    Every list is cut to its newest rows before it is collected. All branches are partitioned by company, so
    they join without another exchange. ``ids`` restricts every branch to some companies, after its cut.
    """
    wanted = None if ids is None else ids.select("company_id").distinct()
    if wanted is not None:
        accounts = existing(accounts, wanted)
    newest_score = [F.desc_nulls_first("scored_at")]
    recent = top_k_nested(
        scores, "company_id", newest_score, SCORE_HISTORY, ["score", "at_risk", "components", "scored_at"], "recent",
        only=wanted,
    )
    history = F.transform(
        "recent", lambda x: F.struct(*[x[f].alias(f) for f in ("score", "at_risk", "scored_at")])
    )
    brief_fields = ["summary", "recommended_action", "model", "input_tokens", "output_tokens", "generated_at"]
    newest_brief = latest_per_key(briefs, "company_id", F.desc_nulls_first("generated_at"))
    newest_brief = newest_brief if wanted is None else existing(newest_brief, wanted)
    brief = newest_brief.select("company_id", F.struct(*brief_fields).alias("ai_summary"))
    cs_notes = top_k_nested(
        notes, "company_id", [F.desc_nulls_first("created_at"), F.asc("note_id")], NOTES_SHOWN,
        ["note_id", "author", "note", "created_at"], "cs_notes", only=wanted,
    )
    open_alerts = top_k_nested(
        alerts.filter(~F.col("acknowledged")), "company_id",
        [F.desc_nulls_first("created_at"), F.asc("alert_id")], OPEN_ALERTS_SHOWN,
        ["alert_id", "alert_type", "message", "acknowledged", "created_at"], "open_alerts", only=wanted,
    )
    joined = accounts
    for branch in (recent, brief, cs_notes, open_alerts):
        joined = joined.join(branch, "company_id", "left")
    return joined.select(
        *accounts.columns,
        F.get("recent", F.lit(0)).alias("health_score"),
        _or_empty(history).alias("score_history"),
        "ai_summary",
        _or_empty(F.col("cs_notes")).alias("cs_notes"),
        _or_empty(F.col("open_alerts")).alias("open_alerts"),
    )


def _or_empty(items):
    return F.coalesce(items, F.array())


def upsert_replace(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows win; old rows whose key is not in the new batch survive."""
    kept = old.join(new.select(*keys), list(keys), "left_anti")
    return new.unionByName(kept.select(*new.columns))


def add_notes(notes: DataFrame, accounts: DataFrame, as_of: AsOf | None = None) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``: a note is accepted when its account exists.

    Notes carry free text and one account may have very many, so the check is a salted semi join.
    """
    if as_of is not None:
        notes = notes.withColumn("created_at", as_of_col(as_of))
    if "note_id" not in notes.columns:
        key = content_hash(F.col("company_id"), F.col("author"), F.col("created_at"), F.col("note"))
        notes = notes.withColumn("note_id", key)
    by = F.col("note_id")
    return (
        spread_semi(notes, accounts, "company_id", by),
        spread_semi(notes, accounts, "company_id", by, how="left_anti"),
    )
