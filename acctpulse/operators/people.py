"""Exact distinct people over any days from mergeable bitmaps, without the events.

A bitmap holds 32,768 consecutive user ids in 4 KiB, so accounts whose users' ids lie together take a few of them a day. Where
an account's ids are scattered over a wide range, its user days are the smaller form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acctpulse.functions.times import AsOf
from acctpulse.operators.daily import events_with_company, with_seats
from acctpulse.sources.readers import trailing


def daily_people(user_rows: DataFrame, users: DataFrame) -> DataFrame:
    """``company_id, event_date, bucket, people``: who was active on a day, a bit per user. Of (user, day, type) rows."""
    owned = events_with_company(user_rows.select("user_id", "event_date"), users)
    return owned.groupBy("company_id", "event_date", F.bitmap_bucket_number("user_id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("user_id")).alias("people")
    )


def merge_people(people: DataFrame) -> DataFrame:
    """Bitmaps of any number of batches as one per account, day and bucket."""
    return people.groupBy("company_id", "event_date", "bucket").agg(F.bitmap_or_agg("people").alias("people"))


def active_people(people: DataFrame, as_of: AsOf) -> DataFrame:
    """Distinct people of the trailing window: days are merged bit by bit in the map tasks, then bits are counted."""
    merged = trailing(people, "event_date", as_of).groupBy("company_id", "bucket").agg(F.bitmap_or_agg("people").alias("people"))
    return merged.groupBy("company_id").agg(F.sum(F.bitmap_count("people")).alias("active_users_30d"))


def seat_utilization_people(accounts: DataFrame, people: DataFrame, as_of: AsOf) -> DataFrame:
    return with_seats(accounts, active_people(people, as_of)).select(
        "company_id", "total_users", "active_users_30d", "seat_score"
    )
