"""Declared constraints of the data model as counting jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acctpulse.schemas import PLANS, ROLES, SCORE_RANGE, TICKET_SEVERITIES, TICKET_STATUSES

NOT_NULL = {
    "companies": ("name", "plan"),
    "users": ("email", "role"),
    "events": ("event_type",),
    "tickets": ("subject", "status", "severity"),
    "fact_events_daily": ("company_id", "event_date", "event_type"),
    "fact_health_score": ("company_id", "score"),
    "crm_notes": ("company_id", "author", "note"),
    "alert_log": ("company_id", "alert_type"),
}
# Links that may be NULL in the source; such rows belong to no account and are left out of every measure.
LINKS = {"users": ("company_id",), "events": ("user_id",), "tickets": ("company_id",)}
DOMAINS = {
    ("companies", "plan"): PLANS,
    ("users", "role"): ROLES,
    ("tickets", "status"): TICKET_STATUSES,
    ("tickets", "severity"): TICKET_SEVERITIES,
}
UNIQUE = {
    "companies": ("id",),
    "users": ("id",),
    "events": ("id",),
    "tickets": ("id",),
    "dim_accounts": ("company_id",),
    "fact_events_daily": ("company_id", "event_date", "event_type"),
}
FOREIGN = (("users", "company_id", "companies"), ("events", "user_id", "users"), ("tickets", "company_id", "companies"))


def row_rules(table: str) -> dict[str, Column]:
    """Rules a single row can break: a NULL breaks NOT NULL only."""
    rules = {f"{table}.{c} not null": F.col(c).isNull() for c in NOT_NULL.get(table, ())}
    rules |= {f"{table}.{c} present": F.col(c).isNull() for c in LINKS.get(table, ())}
    for (owner, column), allowed in DOMAINS.items():
        if owner == table:
            rules[f"{table}.{column} in domain"] = ~F.col(column).isin(*allowed)
    if table == "fact_health_score":
        rules["fact_health_score.score in range"] = ~F.col("score").between(*SCORE_RANGE)
    return rules


def row_violations(table: str, df: DataFrame) -> DataFrame:
    """All row rules of a table in one scan."""
    rules = row_rules(table)
    counts = df.agg(*[F.count_if(broken).alias(name) for name, broken in rules.items()])
    return counts.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("violations")) for n in rules]))
    )


def duplicate_keys(table: str, df: DataFrame) -> DataFrame:
    """Number of key values that occur more than once."""
    keys = UNIQUE[table]
    repeated = df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    return repeated.agg(F.count("*").alias("violations")).select(
        F.lit(f"{table}.({', '.join(keys)}) unique").alias("rule"), "violations"
    )


def orphans(table: str, df: DataFrame, column: str, parent: str, parents: DataFrame) -> DataFrame:
    """Rows whose foreign key has no parent. Counted per key value first, so hot keys are single rows."""
    per_key = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    missing = per_key.join(parents.select(F.col("id").alias(column)), column, "left_anti")
    return missing.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(
        F.lit(f"{table}.{column} references {parent}").alias("rule"), "violations"
    )


def constraint_report(tables: dict[str, DataFrame]) -> DataFrame:
    """``(rule, violations)`` for every declared rule of the given tables."""
    parts = [row_violations(t, df) for t, df in tables.items() if row_rules(t)]
    parts += [duplicate_keys(t, df) for t, df in tables.items() if t in UNIQUE]
    parts += [
        orphans(t, tables[t], column, parent, tables[parent])
        for t, column, parent in FOREIGN
        if t in tables and parent in tables
    ]
    return reduce(DataFrame.unionByName, parts)
