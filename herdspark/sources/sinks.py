"""Report, contract and manifest writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from herdspark.functions.values import quoted


class WriteError(RuntimeError):
    """A write was refused or did not read back as written."""


def write_report(df: DataFrame, path: str, format: str = "csv", order: Sequence[str] = ()) -> str:
    """Write a non-empty result, sorted inside its files; an existing path is an error."""
    if df.isEmpty():
        raise WriteError(f"nothing to write to {path}")
    rows = df.sortWithinPartitions(*[quoted(c) for c in order or df.columns])
    writer = rows.write.mode("errorifexists")
    writer.csv(path, header=True) if format == "csv" else writer.format(format).save(path)
    return path


def write_contracted(df: DataFrame, path: str, columns: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """Write exactly the agreed columns, read them back and compare columns and rows."""
    if list(df.columns) != list(columns):
        raise WriteError(f"columns {df.columns} differ from the contract {list(columns)}")
    # Rows are counted while they are written, so the plan runs once.
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    stored = df.sparkSession.read.parquet(path)
    if sorted(stored.columns) != sorted(columns):
        raise WriteError(f"{path} reads back with columns {stored.columns}")
    written, read = seen.get["rows"], stored.count()
    if written != read:
        raise WriteError(f"{path} reads back {read} rows of {written}")
    return stored.select(*[quoted(c) for c in columns])


SPLIT_COLUMNS = ("key", "split", "random_seed", "split_version")
FOLD_COLUMNS = ("key", "training_fold", "random_seed", "fold_version")


def write_manifest(manifest: DataFrame, key: str, path: str, kind: str = "split") -> DataFrame:
    """A split or fold manifest, partitioned by its label so that readers prune."""
    columns = SPLIT_COLUMNS if kind == "split" else FOLD_COLUMNS
    rows = manifest.select(quoted(key).alias("key"), *[F.col(c) for c in columns[1:]])
    return write_contracted(rows, path, columns, ["split" if kind == "split" else "training_fold"])


def lock_selection(selection: DataFrame, path: str) -> DataFrame:
    """Write the selection once; a second lock on the same path is refused."""
    selection.write.mode("errorifexists").parquet(path)
    return selection.sparkSession.read.parquet(path)


def read_locked(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
