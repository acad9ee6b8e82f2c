"""Analytics tables as partitioned Parquet, and a small table of the batches that count.

A step writes its rows of each table under ``batch=<writer>-<sequence>`` and then appends one file to ``commits`` that names
all of them. A reader semi-joins a table with its committed batches on the partition column, so it sees all tables of a step
or none, and opens the files of those batches only. Writing a batch replaces its own partition as a whole: a step that died
before its commit simply runs again.

Tables that are read by day are partitioned by it (alerts by month) below the batch, so a filter on the day opens only those
partitions. State
tables show their newest batch alone. A later batch may take the place of earlier ones (a compaction); its commit says so in
the same file. A sequence below a writer's newest is an error: it is never skipped.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acctpulse.schemas import STATE_TABLES, STORE_DAYS, STORE_SCHEMAS

RUN, COMPACTION = "run", "compaction"
# A commit may carry what is known of its batch: counters, its newest event and the mark that its writer started from.
INFO = {
    "events": "bigint", "late_events": "bigint", "orphan_events": "bigint", "newest_id": "bigint", "newest_at": "timestamp_ntz",
    "floor_id": "bigint",
}
COMMITS = "table_name string, batch string, writer string, sequence bigint, visible boolean, " + ", ".join(
    f"{name} {kind}" for name, kind in INFO.items()
)


def batch_name(sequence: int, writer: str = RUN) -> str:
    return f"{writer}-{sequence}"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._known: set[str] = set()

    # --- batches -----------------------------------------------------------------------------------------------

    def commits(self) -> DataFrame:
        """One row per table and commit, and one with ``visible`` false for each batch that another took the place of."""
        return self._table("commits", COMMITS)

    def _table(self, name: str, schema: T.StructType | str) -> DataFrame:
        path = f"{self.root}/{name}"
        if name not in self._known:  # an empty folder where there is none yet
            self.spark.createDataFrame([], schema).coalesce(1).write.mode("ignore").parquet(path)
            self._known.add(name)
        return self.spark.read.schema(schema).parquet(path)

    def _own(self, table: str, writer: str | None = None) -> DataFrame:
        own = self.commits().filter(F.col("table_name") == table)
        return own if writer is None else own.filter(F.col("writer") == writer)

    def visible(self, table: str) -> DataFrame:
        """``batch`` of every batch of a table that counts."""
        shown = self._own(table).groupBy("batch").agg(F.min("visible").alias("shown"), F.max("sequence").alias("sequence"))
        shown = shown.filter("shown")
        if table in STATE_TABLES:
            shown = shown.groupBy().agg(F.max_by("batch", F.struct("sequence", "batch")).alias("batch"))
        return shown.select("batch").filter("batch IS NOT NULL")

    def committed(self, table: str, sequence: int, writer: str = RUN) -> bool:
        """Whether this batch is stored. Raises if a later one of its writer is, but not this one."""
        same = F.max(F.col("sequence") == sequence)
        newest, known = self._own(table, writer).agg(F.max("sequence"), same).first()
        if not known and newest is not None and sequence < newest:
            raise ValueError(f"{table}: batch {sequence} of writer {writer} lies before its newest, {newest}")
        return bool(known)

    def next_sequence(self, table: str, writer: str) -> int:
        newest = self._own(table, writer).agg(F.max("sequence")).first()[0]
        return 0 if newest is None else newest + 1

    def commit(
        self, sequence: int, tables: Sequence[str], writer: str = RUN, info: Mapping[str, object] | None = None,
        more: DataFrame | None = None,
    ) -> None:
        """Make the staged batches of ``tables`` visible together, with what is known of them, in one file.

        ``more`` adds ``(table_name, batch, visible)`` rows to it: batches that go with this commit, or, where ``visible`` is
        false, that this one takes the place of.
        """
        known = [(info or {}).get(name) for name in INFO]
        rows = self.spark.createDataFrame([(t, batch_name(sequence, writer), writer, sequence, True, *known) for t in tables], COMMITS)
        if more is not None:
            rows = rows.unionByName(more.withColumn("writer", F.lit(writer)), allowMissingColumns=True)
        rows.coalesce(1).write.mode("append").parquet(f"{self.root}/commits")

    # --- rows --------------------------------------------------------------------------------------------------

    def schema(self, table: str) -> T.StructType:
        return STORE_SCHEMAS[table]

    def _stored_schema(self, table: str) -> T.StructType:
        """Columns in the files and in the paths below a batch."""
        schema = T.StructType([*self.schema(table)])
        day = STORE_DAYS.get(table)
        return schema.add(day.column, T.DateType()) if day and day.column not in schema.names else schema

    def path(self, table: str, sequence: int, writer: str = RUN) -> str:
        return f"{self.root}/{table}/batch={batch_name(sequence, writer)}"

    def stage(self, table: str, df: DataFrame, sequence: int, writer: str = RUN) -> DataFrame:
        """Write the rows of a batch (invisible until committed) and return them read back from the files."""
        rows, day = df.select(*self.schema(table).names), STORE_DAYS.get(table)
        if day and day.column not in rows.columns:
            rows = rows.withColumn(day.column, F.expr(day.partition))
        return self._write(table, rows, sequence, writer)

    def _write(self, table: str, rows: DataFrame, sequence: int, writer: str) -> DataFrame:
        target, day = self.path(table, sequence, writer), STORE_DAYS.get(table)
        out = rows.write.mode("overwrite").option("partitionOverwriteMode", "static")
        (out.partitionBy(day.column) if day else out).parquet(target)
        return self.spark.read.schema(self._stored_schema(table)).parquet(target).select(*self.schema(table).names)

    def read(self, table: str, since: date | str | None = None, batches: DataFrame | None = None) -> DataFrame:
        """The rows that count; ``since`` leaves out earlier days of a table kept by day, ``batches`` all but some batches."""
        schema = T.StructType([*self._stored_schema(table), T.StructField("batch", T.StringType())])
        rows = self._table(table, schema)
        if since is not None:
            day, first = STORE_DAYS[table], date.fromisoformat(str(since))
            # The first condition names a partition column, so files of earlier ones are not even listed.
            rows = rows.filter(F.col(day.column) >= F.lit(first.replace(day=1) if day.monthly else first))
            rows = rows.filter(F.expr(day.day) >= F.lit(first))
        shown = self.visible(table) if batches is None else batches.select("batch")
        return rows.join(shown, "batch", "left_semi").select(*self.schema(table).names)

    def read_batch(self, table: str, sequence: int, writer: str = RUN) -> DataFrame:
        """The rows of one batch; none if it was never committed."""
        own = self._own(table, writer).filter((F.col("sequence") == sequence) & F.col("visible")).select("batch").distinct()
        return self.read(table, batches=own)

    def append(self, table: str, df: DataFrame, sequence: int, writer: str = RUN) -> bool:
        """Stage and commit one batch; False if this very batch is stored already."""
        if self.committed(table, sequence, writer):
            return False
        self.stage(table, df, sequence, writer)
        self.commit(sequence, [table], writer)
        return True
