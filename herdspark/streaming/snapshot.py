"""Live owner-scoped view of a changing collection, kept as a log of merged parts.

Every micro-batch adds a part with the newest version of each record in it. As soon
as ``fan`` parts of one level are there, the batch that brought the last one merges
them into a part of the next level, so a view reads fewer than ``fan`` parts of a
level and a version is rewritten once a level. A generation is a manifest that
names its parts; it appears as one file, written after all of them, so readers see
the generation before or the one after, never a mixture. The stream itself keeps
no state: which version is newest is settled by (time, sequence) in the log.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Parts of one level that are merged into one of the next.
FAN = 8
#: Generations whose parts are not deleted yet, for views that are still being read.
KEPT_GENERATIONS = 8


@dataclass(frozen=True)
class Generation:
    """What a manifest says: the parts with their levels, oldest first, and how far the stream has come.

    ``newest`` is the newest time seen in microseconds, kept only for a view that forgets removals.
    """

    number: int
    progress: str
    batch: int
    newest: int | None
    late: int
    parts: Sequence[tuple[str, int]]


MANIFEST = (
    "number bigint, progress string, batch bigint, newest bigint, late bigint, parts array<struct<folder: string, level: int>>"
)


def _found(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, in order."""
    place = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return sorted(f.getPath().toString() for f in files or [])


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def generations(spark: SparkSession, path: str, last: int = 1) -> list[Generation]:
    """The last generations of a view, the newest first; none before the first batch."""
    files = _found(spark, f"{path}/manifest/*/part-*")[-last:]
    if not files:
        return []
    rows = spark.read.schema(MANIFEST).parquet(*files).collect()
    found = [Generation(*r[:5], [(p["folder"], p["level"]) for p in r["parts"]]) for r in rows]
    return sorted(found, key=lambda g: -g.number)


def _swap(spark: SparkSession, path: str, to: Generation) -> None:
    """Make a generation the current one."""
    text = json.dumps(asdict(to) | {"parts": [{"folder": folder, "level": level} for folder, level in to.parts]})
    manifest = spark.range(1, numPartitions=1).select(F.from_json(F.lit(text), MANIFEST).alias("m")).select("m.*")
    manifest.write.mode("overwrite").parquet(f"{path}/manifest/{to.number:012d}")


def _read(spark: SparkSession, path: str, parts: Sequence[tuple[str, int]]) -> DataFrame:
    return spark.read.parquet(*[f"{path}/parts/{folder}" for folder, _ in parts])


def latest_versions(rows: DataFrame, key: str, time: str, sequence: str) -> DataFrame:
    """L1: the newest version of every record; of equal (time, sequence) that of the later generation.

    Partial aggregation leaves one row per record and task, so a record with very many versions is no hot key.
    """
    order = [c for c in (time, sequence, "__generation") if c in rows.columns]
    fields = F.struct(*[F.col(c) for c in rows.columns if c != key])
    newest = F.max_by(fields, F.struct(*[F.col(c) for c in order]))
    return rows.groupBy(key).agg(newest.alias("__v")).select(key, "__v.*")


def _older(time: str, newest: int | None, keep: timedelta) -> Column:
    """Whether a row is further behind the newest time than ``keep``; rows without a time are not."""
    if newest is None:
        return F.lit(False)
    return F.coalesce(F.unix_micros(time) < newest - keep // timedelta(microseconds=1), F.lit(False))


def _merged(
    spark: SparkSession, path: str, held: Generation, key: str, time: str, sequence: str,
    fan: int, removed: str | None, keep_removed: timedelta | None,
) -> Generation:
    """Merge full levels, from the lowest up."""
    level = 0
    while True:
        run = [p for p in held.parts if p[1] == level]
        if len(run) < fan:
            return held
        rows = latest_versions(_read(spark, path, run), key, time, sequence)
        # Only where no other part is left can none hold an older version that would show again.
        if removed is not None and keep_removed is not None and len(run) == len(held.parts):
            rows = rows.filter(~(F.coalesce(F.col(removed), F.lit(False)) & _older(time, held.newest, keep_removed)))
        folder = f"{held.number:012d}-{level + 1}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{path}/parts/{folder}")
        above = [p for p in held.parts if p[1] > level]
        held = replace(held, parts=[*above, (folder, level + 1)])
        level += 1


def _prune(spark: SparkSession, path: str) -> None:
    """Delete what the last generations do not name, parts of broken attempts included."""
    kept = generations(spark, path, KEPT_GENERATIONS)
    named = {folder for g in kept for folder, _ in g.parts}
    for part in _found(spark, f"{path}/parts/*"):
        if part.rsplit("/", 1)[1] not in named:
            _delete(spark, part)
    for manifest in _found(spark, f"{path}/manifest/*"):
        if int(manifest.rsplit("/", 1)[1]) < kept[-1].number:
            _delete(spark, manifest)


def start_live_view(
    changes: DataFrame, path: str, checkpoint: str, key: str, time: str, sequence: str,
    fan: int = FAN, removed: str | None = None, keep_removed: timedelta | None = None,
) -> StreamingQuery:
    """L1: keep the log at ``path`` up to date; a batch adds one part, and merges levels that are full.

    A batch that runs again after its generation was written changes nothing; one that broke before is
    done anew in folders of its own. One stream writes a view at a time.

    ``removed`` names a boolean column: a record whose newest version sets it is gone. Removals stay in the
    log, as an older version may still arrive. With ``keep_removed`` (for a time column that is a
    timestamp) they are dropped once they are older than that against the newest time seen, when all parts become one. Versions that arrive later than that are refused and counted in the
    manifest, so a record that was forgotten never shows again.
    """
    if fan < 2:
        raise ValueError("at least two parts are merged")

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = generations(spark, path)
        held = last[0] if last else Generation(0, "", -1, None, 0, [])
        if held.progress == checkpoint and batch_id <= held.batch:
            return
        number = held.number + 1
        folder = f"{number:012d}-0-{uuid.uuid4().hex}"
        rows, seen = batch, None
        if keep_removed is not None:
            seen, late = Observation(), _older(time, held.newest, keep_removed)
            rows = batch.observe(seen, F.max(F.unix_micros(time)).alias("newest"), F.count_if(late).alias("late")).filter(~late)
        fresh = latest_versions(rows, key, time, sequence)
        fresh.withColumn("__generation", F.lit(number).cast("bigint")).write.parquet(f"{path}/parts/{folder}")
        to = replace(held, number=number, progress=checkpoint, batch=batch_id, parts=[*held.parts, (folder, 0)])
        if seen is not None:
            times = [t for t in (held.newest, seen.get["newest"]) if t is not None]
            to = replace(to, newest=max(times, default=None), late=held.late + seen.get["late"])
        to = _merged(spark, path, to, key, time, sequence, fan, removed, keep_removed)
        _swap(spark, path, to)
        if to.parts[-1][1]:
            _prune(spark, path)

    return (
        changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)
        .trigger(availableNow=True).start()
    )


def live_view(
    spark: SparkSession, path: str, key: str, time: str, sequence: str,
    owner_column: str | None = None, owner: str | None = None, removed: str | None = None,
) -> DataFrame:
    """L1: the current records of the newest generation, strictly of one owner if given.

    ``removed`` names a boolean column of the changes: a record whose newest
    version sets it is gone, as a listener that lists the collection anew no
    longer shows it.
    """
    last = generations(spark, path)
    if not last:
        raise ValueError(f"no generation in {path}")
    rows = latest_versions(_read(spark, path, last[0].parts), key, time, sequence).drop("__generation")
    if removed is not None:
        rows = rows.filter(~F.coalesce(F.col(removed), F.lit(False))).drop(removed)
    return rows if owner is None else rows.filter(F.col(owner_column) == owner)


def compact_live_view(spark: SparkSession, path: str, target: str, key: str, time: str, sequence: str) -> DataFrame:
    """L1: a copy of the view as one part in a new folder; removals stay, for later views to see them."""
    held = generations(spark, path)[0]
    rows = latest_versions(_read(spark, path, held.parts), key, time, sequence)
    folder = f"{1:012d}-0-{uuid.uuid4().hex}"
    rows.withColumn("__generation", F.lit(1).cast("bigint")).write.parquet(f"{target}/parts/{folder}")
    copy = Generation(1, "", -1, held.newest, held.late, [(folder, 0)])
    _swap(spark, target, copy)
    return live_view(spark, target, key, time, sequence)
