"""Table scans with typed errors, line tables, inventories and fingerprints."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from herdspark.functions.values import WHITESPACE, quoted


class LoadError(RuntimeError):
    """A table cannot be loaded; ``code`` says why."""

    def __init__(self, code: str, detail: str):
        super().__init__(f"{code}: {detail}")
        self.code = code


@dataclass(frozen=True)
class Loaded:
    """A lazy table with the facts of its load."""

    table: DataFrame
    path: str
    format: str
    columns: tuple[str, ...]
    loaded_at: str

    def facts(self) -> DataFrame:
        """Rows, columns and bytes; bytes come from the file listing, not from content."""
        files = self.table.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(self.path)
        size = files.agg(F.coalesce(F.sum("length"), F.lit(0))).scalar()
        return self.table.agg(F.count(F.lit(1)).alias("rows")).select(
            "rows", F.lit(len(self.columns)).alias("columns"), size.alias("bytes"),
            F.lit(self.format).alias("format"), F.lit(self.loaded_at).alias("loaded_at"),
        )


READERS = ("csv", "parquet")


def load_table(
    spark: SparkSession,
    path: str,
    format: str | None = None,
    schema: T.StructType | str | None = None,
    columns: Sequence[str] | None = None,
    required: Sequence[str] = (),
    row_limit: int | None = None,
) -> Loaded:
    """A1: CSV or Parquet scan with projection, required columns and a row limit.

    CSV is read as text columns unless a schema is given; nothing is inferred.
    """
    kind = format or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in READERS:
        raise LoadError("UNSUPPORTED_FORMAT", f"{kind} ({path})")
    if row_limit is not None and row_limit < 1:
        raise LoadError("INVALID_ROW_LIMIT", str(row_limit))
    try:
        reader = spark.read if schema is None else spark.read.schema(schema)
        df = reader.parquet(path) if kind == "parquet" else reader.csv(path, header=True, mode="FAILFAST")
    except AnalysisException as error:
        code = "MISSING_FILE" if error.getCondition() == "PATH_NOT_FOUND" else "UNREADABLE"
        raise LoadError(code, path) from error
    absent = [c for c in (*required, *(columns or ())) if c not in df.columns]
    if absent:
        raise LoadError("MISSING_COLUMNS", ", ".join(dict.fromkeys(absent)))
    if columns is not None:
        df = df.select(*[quoted(c) for c in columns])
    if df.isEmpty():
        raise LoadError("EMPTY", path)
    if row_limit is not None:
        df = df.limit(row_limit)
    now = dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds")
    return Loaded(df, path, kind, tuple(df.columns), now)


def line_table(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_number, line): physical lines numbered per file.

    Lines are numbered inside each read block, whose size Spark bounds, and the
    blocks' starting numbers come from a small count per block.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__order"), F.col("value").alias("line"),
    )
    counts = lines.groupBy("file", "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file", "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    local = F.row_number().over(Window.partitionBy("file", "__block").orderBy("__order"))
    return lines.withColumn("__rn", local).join(starts, ["file", "__block"]).select(
        "file", (F.col("__start") + F.col("__rn")).alias("line_number"), "line"
    )


def sheet_table(spark: SparkSession, path: str, header_row: int = 1, separator: str = ",") -> DataFrame:
    """A3: a sheet export as text columns with its ordinal ``source_row_number``.

    Headers are stripped and must differ; rows whose cells are all missing are
    dropped. A record is one physical line.
    """
    lines = line_table(spark, path)
    head = lines.filter(F.col("line_number") == header_row).select("line").distinct().take(2)
    if len(head) != 1:
        raise LoadError("HEADER_NOT_FOUND", f"row {header_row} of {path}")
    text = head[0]["line"].lstrip("﻿")
    names = spark.range(1).select(
        F.from_csv(F.lit(text), ", ".join(f"c{i} string" for i in range(text.count(separator) + 1)), {"sep": separator}).alias("h")
    ).first()["h"]
    headers = [(n or "").strip() or f"__blank_{i + 1}" for i, n in enumerate(names) if n is not None or i <= text.count(separator)]
    while headers and headers[-1].startswith("__blank_") and len(headers) > 1 and not text.endswith(separator):
        headers.pop()
    repeated = sorted({h for h in headers if headers.count(h) > 1})
    if repeated:
        raise LoadError("DUPLICATE_HEADERS", ", ".join(repeated))
    fields = ", ".join("`" + h.replace("`", "``") + "` string" for h in headers)
    cells = F.from_csv(F.col("line"), fields, {"sep": separator, "nullValue": ""})
    rows = lines.filter(F.col("line_number") > header_row).select(F.col("line_number").alias("source_row_number"), cells.alias("__c"))
    out = rows.select("source_row_number", "__c.*")
    filled = F.lit(False)
    for h in headers:
        filled = filled | quoted(h).isNotNull()
    return out.filter(filled)


def blank_lines(spark: SparkSession, path: str) -> DataFrame:
    """A4: blank physical lines after each file's header."""
    lines = line_table(spark, path).filter("line_number > 1")
    return lines.agg(F.count_if(F.btrim(F.col("line"), F.lit(WHITESPACE)) == "").alias("blank_lines"))


def row_text(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """All cells of a row as one text; a null differs from every value."""
    return F.concat_ws("|", *[F.coalesce(quoted(c).cast("string"), F.lit("\\N")) for c in columns or df.columns])


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A10: row count and an order-free sum of row hashes.

    The same rows give the same fingerprint whatever their order or partitioning.
    """
    part = F.conv(F.substring(F.md5(row_text(df, columns)), 1, 8), 16, 10).cast(T.DecimalType(38, 0))
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(part), F.lit(0).cast(T.DecimalType(38, 0))).cast("string").alias("checksum")
    )


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Size, time and SHA-256 of every file below a path.

    The listing reads no content. Each task streams its own files in blocks, so
    a file of any size needs constant memory.
    """
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        .select("path", "length", F.col("modificationTime").alias("modified"))
    )
    fields = "path string, length bigint, modified timestamp, sha256 string"
    return listing.repartition("path").mapInPandas(_hashed, fields)


def _hashed(batches: Iterator) -> Iterator:
    import hashlib

    from pyarrow import fs

    for batch in batches:
        digests = []
        for uri in batch["path"]:
            system, local = fs.FileSystem.from_uri(uri)
            digest = hashlib.sha256()
            with system.open_input_stream(local) as stream:
                while block := stream.read(1 << 20):
                    digest.update(block)
            digests.append(digest.hexdigest().upper())
        yield batch.assign(sha256=digests)


def tree_checksum(inventory: DataFrame, root: str) -> DataFrame:
    """One checksum over the relative paths and hashes of a folder."""
    relative = F.regexp_replace("path", r"^.*" + root.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    return fingerprint(inventory.select(relative.alias("path"), "sha256"))
