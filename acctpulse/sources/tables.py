"""Source and dimension tables laid out so that readers and writers touch only what they need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acctpulse.operators.accounts import upsert_replace
from acctpulse.session import staged

BUCKETS = 64


def write_clustered(events: DataFrame, path: str, files: int | None = None) -> None:
    """Append events in files of disjoint ranges of ``id``, each sorted by it.

    The smallest and largest id of files and row groups then tell a reader of ``id > mark`` what it can skip.
    """
    parts = [files] if files else []
    events.repartitionByRange(*parts, "id").sortWithinPartitions("id").write.mode("append").parquet(path)


def _bucket(keys: Sequence[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")


def read_buckets(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a table kept in hash buckets; None if there is no such table."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def upsert_buckets(path: str, new: DataFrame, keys: Sequence[str], buckets: int = BUCKETS) -> None:
    """Upsert rows into a table kept in hash buckets of its key: new rows win, rows of other keys survive.

    Only the buckets that hold a new key are read and replaced (dynamic partition overwrite), so a few new rows rewrite that
    share of the files. The merged buckets are written to the work folder first: the table is never read while its partitions
    change, and after a failure the same upsert can simply run again. The number of buckets is fixed with the first write.
    Null keys are a key of their own only to the hash; like in any upsert by equality, they replace nothing.
    """
    spark = new.sparkSession
    rows = new.select("*", _bucket(keys, buckets))
    old = read_buckets(spark, path)
    if old is not None:
        touched = rows.select("bucket").distinct()
        rows = staged(upsert_replace(old.join(touched, "bucket", "left_semi"), rows, keys), "merged")
    # A bucket's rows in one file; a bucket larger than the advisory size in several.
    out = rows.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("bucket").parquet(path)
