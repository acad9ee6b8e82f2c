"""Text, JSON and hashing expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Component order in rendered JSON (shorter keys first, then alphabetical).
COMPONENT_JSON_ORDER = ("adoption", "mrr_tier", "seat_util", "login_recency", "ticket_health")


def plan_label(plan: Column) -> Column:
    return F.upper(plan)


def dollars(cents: Column) -> Column:
    """Cents as whole dollars, halves to even."""
    return F.bround(cents.cast("decimal(18,0)") / F.lit(100).cast("decimal(3,0)"), 0).cast("bigint").cast("string")


def joined(items: Column, separator: str, default: str) -> Column:
    """Array of strings as one text; empty or missing arrays give ``default``."""
    return F.coalesce(F.nullif(F.array_join(items, separator), F.lit("")), F.lit(default))


def components_json(components: Column) -> Column:
    """The component struct as JSON text with ``", "`` and ``": "`` separators; ``{}`` when absent."""
    parts = [
        F.concat(F.lit(f'"{key}": '), F.coalesce(components[key].cast("string"), F.lit("null")))
        for key in COMPONENT_JSON_ORDER
    ]
    body = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    return F.when(components.isNull(), F.lit("{}")).otherwise(body)


def content_hash(*cols: Column) -> Column:
    """SHA-256 over a tuple of values.

    Each value is hashed first, so separators inside free text cannot make two tuples collide; NULL is
    distinct from every value.
    """
    parts = [F.coalesce(F.sha2(c.cast("string"), 256), F.lit("-")) for c in cols]
    return F.sha2(F.concat_ws("|", *parts), 256)


# The phrases and texts of the next three functions.


def trend_phrase(cur: Column, prev: Column) -> Column:
    """How the score moved; a previous score of 0 counts as no previous score."""
    known = F.coalesce(prev != 0, F.lit(False))
    moved = F.concat(F.lit(" from "), prev.cast("string"), F.lit(" to "), cur.cast("string"))
    return (
        F.when(known & (cur > prev), F.concat(F.lit("improved"), moved))
        .when(known & (cur < prev), F.concat(F.lit("declined"), moved))
        .otherwise(F.concat(F.lit("stable at "), F.coalesce(cur.cast("string"), F.lit("None"))))
    )


def alert_message(name: Column, plan: Column, score: Column) -> Column:
    return F.concat(
        name, F.lit(" ("), plan_label(plan), F.lit(") health score is "), score.cast("string"),
        F.lit("/100 — flagged at-risk."),
    )


def chat_message(name: Column, plan: Column, score: Column) -> Column:
    """The longer notification text for a chat channel (rows only; nothing is posted)."""
    return F.concat(
        F.lit("🔴 *At-Risk Account Alert*\n*"), name, F.lit("* ("), plan_label(plan), F.lit(") — Health Score: "),
        score.cast("string"), F.lit("/100\nImmediate CS follow-up recommended."),
    )
