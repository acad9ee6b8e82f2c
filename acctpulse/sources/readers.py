"""Source scans: Parquet datasets or JDBC tables behind one signature."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acctpulse.functions.times import AsOf, trailing_start
from acctpulse.schemas import KNOWN_COLUMNS, SOURCE_SCHEMAS

# Ids may start at 0, so "nothing synced yet" is one below.
NO_MARK = -1


def jdbc_options(
    url: str, table: str, lower: int, upper: int, partitions: int, fetch_size: int = 10_000
) -> dict[str, str]:
    """Options of a JDBC scan split over id ranges, so that executors read in parallel."""
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": "id",
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
        "fetchsize": str(fetch_size),
        "preferTimestampNTZ": "true",
    }


def read_source(
    spark: SparkSession,
    location: str,
    table: str,
    fmt: str = "parquet",
    options: Mapping[str, str] | None = None,
    known_only: bool = True,
) -> DataFrame:
    """Scan one of the four source tables; ``known_only`` leaves out the surplus columns of a drifted source.

    ``parquet`` reads ``<location>/<table>``; ``jdbc`` takes everything from :func:`jdbc_options`. A known column that the
    source lacks raises, as a query naming it would: read as NULL it would empty every result without a sign.
    """
    reader = spark.read.format(fmt).options(**(options or {}))
    df = reader.load() if fmt == "jdbc" else reader.load(f"{location.rstrip('/')}/{table}")
    surplus = [] if known_only else [c for c in df.columns if c not in KNOWN_COLUMNS[table]]
    known = project_known(df, [*KNOWN_COLUMNS[table], *surplus], table)
    return known.withColumns({f.name: F.col(f"`{f.name}`").cast(f.dataType) for f in SOURCE_SCHEMAS[table]})


def read_sources(
    spark: SparkSession,
    location: str,
    fmt: str = "parquet",
    options: Mapping[str, Mapping[str, str]] | None = None,
    known_only: bool = True,
) -> dict[str, DataFrame]:
    """All source tables; ``options`` holds the reader options of each, as JDBC needs them."""
    return {
        table: read_source(spark, location, table, fmt, (options or {}).get(table), known_only) for table in SOURCE_SCHEMAS
    }


def project_known(df: DataFrame, known: Sequence[str], table: str = "source") -> DataFrame:
    """The known columns; a missing one raises."""
    missing = [c for c in known if c not in df.columns]
    if missing:
        raise ValueError(f"{table} lacks the columns {', '.join(missing)}")
    return df.select(*(f"`{c}`" for c in known))


def select_renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Projection with renames, ``{source name: result name}``."""
    return df.select(*[F.col(src).alias(dst) for src, dst in names.items()])


def incremental(events: DataFrame, hwm: int | Column = NO_MARK) -> DataFrame:
    """Rows past the mark. A plain comparison on ``id``: it prunes row groups and pushes into JDBC."""
    return events.filter(F.col("id") > F.lit(hwm).cast("bigint"))


def where_eq(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.filter(F.col(column) == F.lit(value))


def where_opt(df: DataFrame, plan: str | None = None, at_risk_only: bool = False) -> DataFrame:
    """Optional predicates: an absent parameter (or an empty plan) adds none."""
    if plan:
        df = where_eq(df, "plan", plan)
    return only_flagged(df) if at_risk_only else df


def only_flagged(df: DataFrame) -> DataFrame:
    """Rows whose flag is true; NULL does not pass."""
    return df.filter(F.col("at_risk"))


def existing(df: DataFrame, accounts: DataFrame, key: str = "company_id") -> DataFrame:
    """Rows whose account is known."""
    return df.join(accounts.select(key), key, "left_semi")


def target_accounts(accounts: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Account ids in ascending order: all of them, or the known ones among ``ids``."""
    targets = accounts.select("company_id")
    if ids is not None:
        targets = existing(targets, ids)
    return targets.orderBy("company_id")


def trailing(df: DataFrame, date_col: str, as_of: AsOf, n_days: int = 30) -> DataFrame:
    """Rows of the trailing window: no older than ``n_days`` calendar days, no upper bound."""
    return df.filter(F.col(date_col) >= trailing_start(as_of, n_days))


def ordered(df: DataFrame, *cols: str) -> DataFrame:
    """Sort for presentation only; no operator depends on row order."""
    return df.orderBy(*cols)


def count_rows(df: DataFrame, name: str = "count") -> DataFrame:
    return df.agg(F.count("*").alias(name))
