"""At-risk scan, de-duplicated alerts, digest text and alert feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acctpulse.functions.keyed import latest_k, latest_per_key
from acctpulse.functions.text import alert_message, chat_message, content_hash, plan_label
from acctpulse.functions.times import AsOf, as_of_col, same_day
from acctpulse.sources.readers import only_flagged

SCORE_DROP = "score_drop"
FEED_MAX = 200

# Text of the digest prompt around the account list.
DIGEST_HEAD = (
    "You are a Customer Success AI assistant. Write a brief, plain-English daily digest \n"
    "for the CS team about at-risk accounts. Be concise, actionable, and professional.\n"
    "\n"
    "AT-RISK ACCOUNTS TODAY ("
)
DIGEST_TOTAL = " total):"
DIGEST_TAIL = "\nWrite 3-5 sentences summarizing the situation and recommending prioritization."


def at_risk_accounts(scores: DataFrame, accounts: DataFrame, current_only: bool = False) -> DataFrame:
    """Newest *flagged* snapshot per account with name and plan.

    An account that recovered keeps its older flagged snapshot, so it is still listed; ``current_only``
    looks at the newest snapshot of all instead.
    """
    newest_first = F.desc_nulls_first("scored_at")
    if current_only:
        newest = only_flagged(latest_per_key(scores, "company_id", newest_first))
    else:
        newest = latest_per_key(only_flagged(scores), "company_id", newest_first)
    names = accounts.select("company_id", "company_name", "plan")
    return newest.join(names, "company_id").select("company_id", "company_name", "plan", "score", "scored_at")


def alerted_today(alerts: DataFrame, as_of: AsOf, alert_type: str = SCORE_DROP) -> DataFrame:
    """Companies with an alert of this type on the as-of day or later."""
    hit = (F.col("alert_type") == alert_type) & same_day(F.col("created_at"), as_of)
    return alerts.filter(hit).select("company_id").distinct()


def new_alerts(at_risk: DataFrame, alerts: DataFrame, as_of: AsOf, alert_type: str = SCORE_DROP) -> DataFrame:
    """Alert rows for at-risk accounts that had none of this type today."""
    fresh = at_risk.join(alerted_today(alerts, as_of, alert_type), "company_id", "left_anti")
    message = alert_message(F.col("company_name"), F.col("plan"), F.col("score"))
    rows = fresh.select(
        "company_id",
        F.lit(alert_type).alias("alert_type"),
        message.alias("message"),
        F.lit(False).alias("acknowledged"),
        as_of_col(as_of).alias("created_at"),
    )
    return rows.select(alert_id(), "*")


def alert_id() -> Column:
    """Natural key of an alert: company, type and day, plus the text for types that may repeat in a day."""
    day = F.to_date("created_at")
    return content_hash(F.col("company_id"), F.col("alert_type"), day, F.col("message")).alias("alert_id")


def alert_summary(at_risk: DataFrame, new: DataFrame) -> DataFrame:
    """Counters of an alert scan: found, newly logged, skipped as duplicates."""
    tags = at_risk.select(F.lit(1).alias("found"), F.lit(0).alias("logged")).unionByName(
        new.select(F.lit(0).alias("found"), F.lit(1).alias("logged"))
    )
    found, logged = F.count_if(F.col("found") == 1), F.count_if(F.col("logged") == 1)
    return tags.agg(
        found.alias("at_risk_found"),
        logged.alias("new_alerts_logged"),
        (found - logged).alias("skipped_duplicate"),
    )


def digest_due(as_of: AsOf) -> Column:
    """The digest goes out with the first scans after midnight."""
    return F.hour(as_of_col(as_of)) < 2


def alert_digest(at_risk: DataFrame, as_of: AsOf) -> DataFrame:
    """Digest prompt as lines ``(part, company_id, line)``, the same at every length of the list.

    The prompt is the ``head`` line, the ``account`` lines in id order and the ``tail`` line, joined by line ends; head and
    tail are the only rows that do not belong to an account. No rows when nobody is at risk or the digest is not due.
    """
    line = F.concat(
        F.lit("- "), F.col("company_name"), F.lit(" ("), plan_label(F.col("plan")), F.lit(", score="),
        F.col("score").cast("string"), F.lit(")"),
    )
    due = at_risk.filter(digest_due(as_of))
    accounts = due.select(F.lit("account").alias("part"), "company_id", line.alias("line"))
    head = F.concat(F.lit(DIGEST_HEAD), F.col("n").cast("string"), F.lit(DIGEST_TOTAL))
    nobody = F.lit(None).cast("bigint").alias("company_id")
    frame = F.inline(F.array(*(
        F.struct(F.lit(part).alias("part"), nobody, text.alias("line"))
        for part, text in (("head", head), ("tail", F.lit(DIGEST_TAIL)))
    )))
    return accounts.unionByName(due.agg(F.count("*").alias("n")).filter("n > 0").select(frame))


def chat_messages(at_risk: DataFrame, as_of: AsOf) -> DataFrame:
    """Chat message of every account that was newly logged."""
    text = chat_message(F.col("company_name"), F.col("plan"), F.col("score"))
    return at_risk.select("company_id", text.alias("text"), as_of_col(as_of).alias("created_at"))


def alert_feed(
    alerts: DataFrame, accounts: DataFrame, acknowledged: bool | None = None, limit: int = 50
) -> DataFrame:
    """Newest alerts with account names. Alerts of unknown accounts are left out before the limit applies.

    The newest ``limit`` alerts overall hold at most ``limit`` of any account, so the log is cut per account
    in the map tasks and only the remainder meets the accounts. A limit above ``FEED_MAX`` is refused.
    """
    if not 1 <= limit <= FEED_MAX:
        raise ValueError(f"limit must lie between 1 and {FEED_MAX}, not {limit}")
    if acknowledged is not None:
        alerts = alerts.filter(F.col("acknowledged") == acknowledged)
    newest_first = [F.desc_nulls_first("created_at"), F.asc("alert_id")]
    newest = latest_k(alerts, "company_id", newest_first, limit).drop("rn")
    return (
        newest.join(accounts.select("company_id", "company_name"), "company_id")
        .select("alert_id", "company_id", "company_name", "alert_type", "message", "acknowledged", "created_at")
        .orderBy(*newest_first)
        .limit(limit)
    )


def acknowledge(alerts: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(alerts with the flag set for ids, ids that match no alert)``."""
    acks = ids.select("alert_id").distinct()
    flagged = alerts.join(acks.withColumn("_ack", F.lit(True)), "alert_id", "left").select(
        *[
            F.coalesce(F.col("_ack"), F.col("acknowledged")).alias(c) if c == "acknowledged" else F.col(c)
            for c in alerts.columns
        ]
    )
    return flagged, acks.join(alerts, "alert_id", "left_anti")
