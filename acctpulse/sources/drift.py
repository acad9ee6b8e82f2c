"""Schema drift: columns a source has beyond the known ones, and files of one source that differ. Reported, never fatal."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acctpulse.schemas import KNOWN_COLUMNS, SOURCE_SCHEMAS


def unknown_columns(df: DataFrame, known: Sequence[str]) -> list[str]:
    return sorted(set(df.columns) - set(known))


def schema_drift(tables: Mapping[str, DataFrame], known: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """``(table_name, column_name)`` of every unknown column, from the schemas alone.

    A table without a known-column entry has only unknown columns.
    """
    known = KNOWN_COLUMNS if known is None else known
    found = [(name, column) for name, df in tables.items() for column in unknown_columns(df, known.get(name, ()))]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(found, "table_name string, column_name string")


def file_columns(spark: SparkSession, location: str) -> DataFrame:
    """``column_name, type, n_files, first_file`` over all Parquet files under a location.

    The tasks read the files' footers and nothing else; ``first_file`` is the first by path that has the column with this
    type. ``location`` must be an address that ``pyarrow.fs`` can open on the executors.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(location)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                place, name = pafs.FileSystem.from_uri(path)
                with place.open_input_file(name) as source:
                    rows += [(path, field.name, str(field.type)) for field in pq.read_schema(source)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["path", "column_name", "type"])

    found = files.select("path").mapInArrow(run, "path string, column_name string, type string")
    return found.groupBy("column_name", "type").agg(F.count("*").alias("n_files"), F.min("path").alias("first_file"))


def read_drifting(spark: SparkSession, location: str, table: str) -> DataFrame:
    """The known columns of a source table whose files have different schemas.

    A column that a file lacks is null in its rows, surplus columns are not read, and narrower types are widened. A known
    column that no file has raises, as for a source of one schema.
    """
    found = file_columns(spark, location).select("column_name").distinct()
    known = spark.createDataFrame([(c,) for c in KNOWN_COLUMNS[table]], "column_name string")
    missing = sorted(r.column_name for r in known.join(found, "column_name", "left_anti").collect())  # known columns at most
    if missing:
        raise ValueError(f"{table} lacks the columns {', '.join(missing)}")
    return spark.read.schema(SOURCE_SCHEMAS[table]).parquet(location)
