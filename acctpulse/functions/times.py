"""As-of literals and calendar predicates. Nothing in the package reads the wall clock."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

AsOf = datetime | str | Column


def as_of_col(as_of: AsOf) -> Column:
    """The run time as a ``TIMESTAMP_NTZ`` expression; literals fold to constants and reach the scan."""
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("timestamp_ntz")


def day(ts: Column) -> Column:
    return F.to_date(ts)


def days(n: int) -> Column:
    return F.make_dt_interval(F.lit(n))


def within(ts: Column, as_of: AsOf, n_days: int) -> Column:
    """``ts`` is no older than ``n_days`` before ``as_of`` (inclusive, exact to the microsecond)."""
    return ts >= as_of_col(as_of) - days(n_days)


def trailing_start(as_of: AsOf, n_days: int = 30) -> Column:
    """First calendar day of the trailing window (inclusive)."""
    return F.date_sub(F.to_date(as_of_col(as_of)), n_days)


def same_day(ts: Column, as_of: AsOf) -> Column:
    """``ts`` falls on the as-of day or later."""
    return ts >= F.to_date(as_of_col(as_of)).cast("timestamp_ntz")


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def instant(ts: str | Column) -> Column:
    """A UTC time without a zone as an instant, as watermarks need it, in any session zone."""
    return F.from_utc_timestamp(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"), F.current_timezone())


def utc_day(at: str | Column) -> Column:
    """UTC day of an instant, in any session zone."""
    return F.to_date(F.to_utc_timestamp(at, F.current_timezone()))
