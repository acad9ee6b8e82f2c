"""Places of rows in a global order, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from acctpulse.session import staged

# monotonically_increasing_id: the partition above the lowest 33 bits, the row's place in it below.
_LOW = 33


def numbered(rows: DataFrame, order: list[Column], group: str | None = None) -> DataFrame:
    """``rows`` with ``position``, a row's place (from 0) within its ``group`` in the given ``order``.

    One range-partitioned sort by group, order and a number given to every row beforehand, so neither a hot group nor
    many equal rows end up in one task. The sorted rows are written down with their place in their partition; the number
    of a group's rows in each partition, one row per partition and group, gives what lies before it. ``group`` must not
    be null. Equal rows get their places in any order.
    """
    keys = [F.col(group)] if group else []
    fixed = staged(rows.withColumn("_tie", F.monotonically_increasing_id()), "unordered")
    placed = fixed.orderBy(*keys, *order, "_tie").drop("_tie").withColumn("_place", F.monotonically_increasing_id())
    placed = staged(placed, "ordered").select(
        "*", F.shiftright("_place", _LOW).alias("_part"), F.col("_place").bitwiseAND(F.lit((1 << _LOW) - 1)).alias("_row")
    )
    by = [group, "_part"] if group else ["_part"]
    parts = placed.groupBy(*by).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    # A row per partition and group that has rows there.
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_offset")
    found = placed.join(parts.select(*by, offset), by)
    return found.withColumn("position", F.col("_offset") + F.col("_row")).select(*rows.columns, "position")
