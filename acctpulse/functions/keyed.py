"""Per-key helpers that stay safe when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_k(df: DataFrame, key: str, order: Sequence[Column], k: int, rank: str = "rn") -> DataFrame:
    """Newest ``k`` rows per key with their rank.

    ``row_number() <= k`` is planned with a group limit *before* the exchange, so every map task sends at
    most ``k`` rows per key: a hot key never gathers in one task.
    """
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def latest_per_key(df: DataFrame, key: str, *order: Column) -> DataFrame:
    return latest_k(df, key, order, 1).drop("rn")


def top_k_nested(
    df: DataFrame,
    key: str,
    order: Sequence[Column],
    k: int,
    fields: Sequence[str],
    name: str,
    only: DataFrame | None = None,
) -> DataFrame:
    """Newest ``k`` rows per key as one ordered array of structs; lists are cut before they are collected.

    ``only`` keeps some keys, after the cut: at most ``k`` rows of a hot key are left by then.
    """
    item = F.struct("rn", *fields)
    ranked = latest_k(df, key, order, k)
    if only is not None:
        ranked = ranked.join(only.select(key), key, "left_semi")
    nested = ranked.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))
    keep = F.transform("items", lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    return nested.select(key, keep.alias(name))


def previous_row(df: DataFrame, key: str, ts: str, cols: Sequence[str], bucket: str = "month") -> DataFrame:
    """Add ``prev_<col>`` from the preceding row of the same key, over the whole history.

    A plain ``lag`` would sort all rows of a key in one task. Here rows are windowed per (key, calendar
    bucket), and the first row of a bucket takes the last values of the preceding non-empty bucket. Those
    come from an aggregation that combines in the map tasks, so only one row per bucket is carried over.
    """
    bucketed = df.withColumn("_bucket", F.date_trunc(bucket, F.col(ts)))
    w = Window.partitionBy(key, "_bucket").orderBy(ts)
    inside = bucketed.select(
        "*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in cols], F.row_number().over(w).alias("_pos")
    )
    last = bucketed.groupBy(F.col(key).alias("_key"), F.col("_bucket").alias("_b")).agg(
        *[F.max_by(c, ts).alias(f"_last_{c}") for c in cols]
    )
    by_bucket = Window.partitionBy("_key").orderBy("_b")
    carry = last.select("_key", "_b", *[F.lag(f"_last_{c}").over(by_bucket).alias(f"_carry_{c}") for c in cols])
    on = (F.col(key) == F.col("_key")) & (F.col("_bucket") == F.col("_b"))
    prev = [
        F.when(F.col("_pos") == 1, F.col(f"_carry_{c}")).otherwise(F.col(f"prev_{c}")).alias(f"prev_{c}") for c in cols
    ]
    return inside.join(carry, on, "left").select(*df.columns, *prev)


def spread_semi(
    df: DataFrame, lookup: DataFrame, key: str, spread_by: Column, how: str = "left_semi", salts: int = 32
) -> DataFrame:
    """Semi or anti join of wide rows against a key list, with the wide side salted.

    The rows of a hot key go to ``salts`` partitions; the key list (one narrow row per key) is repeated once
    per salt. ``spread_by`` must be a value of the row itself, so a re-run task salts the same way.
    """
    keys = lookup.select(key).distinct().withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    return salted.join(keys, [key, "_salt"], how).drop("_salt")
