"""Key audits, guarded joins and lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdspark.functions.text import contains_any
from herdspark.functions.values import missing_blank, quoted, stripped


def key_counts(df: DataFrame, keys: Mapping[str, Column], name: str) -> DataFrame:
    """Rows per key; partial aggregation keeps a hot key small before the shuffle."""
    return df.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(F.count(F.lit(1)).alias(name))


def _paired(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
    """Full outer join of two key-count tables; null key parts meet each other."""
    tagged_left = left.withColumn("side", F.lit(0)).withColumnRenamed("n", "l").withColumn("r", F.lit(0).cast("bigint"))
    tagged_right = right.withColumn("side", F.lit(1)).withColumnRenamed("n", "r").withColumn("l", F.lit(0).cast("bigint"))
    # One grouped union instead of a null-safe outer join, which Spark cannot hash.
    return tagged_left.unionByName(tagged_right).groupBy(*names).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))


def composite_join_audit(
    left: DataFrame, right: DataFrame, left_keys: Mapping[str, Column], right_keys: Mapping[str, Column]
) -> DataFrame:
    """G1: what joining on composite keys would do, from key counts alone."""
    names = list(left_keys)
    both = _paired(key_counts(left, left_keys, "n"), key_counts(right, right_keys, "n"), names)
    l, r = F.col("l"), F.col("r")
    some_missing = F.lit(False)
    for n in names:
        some_missing = some_missing | F.col(n).isNull()
    zero = F.lit(0)
    stats = both.agg(
        F.sum("l").alias("left_rows"),
        F.sum("r").alias("right_rows"),
        F.count_if(l > 0).alias("left_unique_keys"),
        F.count_if(r > 0).alias("right_unique_keys"),
        F.coalesce(F.sum(F.when(some_missing, l)), zero).alias("left_missing_keys"),
        F.coalesce(F.sum(F.when(some_missing, r)), zero).alias("right_missing_keys"),
        F.coalesce(F.sum(F.when(l > 1, l)), zero).alias("left_duplicate_key_rows"),
        F.coalesce(F.sum(F.when(r > 1, r)), zero).alias("right_duplicate_key_rows"),
        F.count_if((l > 0) & (r > 0)).alias("matches"),
        F.count_if((l > 0) & (r == 0)).alias("left_only_keys"),
        F.count_if((l == 0) & (r > 0)).alias("right_only_keys"),
        (F.count_if((l > 1) & (r > 1)) > 0).alias("many_to_many"),
    )
    l_unique, r_unique = F.col("left_duplicate_key_rows") == 0, F.col("right_duplicate_key_rows") == 0
    complete = (F.col("matches") == F.col("left_rows")) & (F.col("matches") == F.col("right_rows"))
    return stats.withColumns(
        {
            "left_match_percentage": F.round(F.try_divide(F.col("matches") * 100.0, F.col("left_rows")), 6),
            "right_match_percentage": F.round(F.try_divide(F.col("matches") * 100.0, F.col("right_rows")), 6),
            "cardinality": F.when(F.col("many_to_many"), "MANY_TO_MANY").when(l_unique & r_unique, "ONE_TO_ONE")
            .when(l_unique | r_unique, "ONE_TO_MANY").otherwise("UNCLEAR"),
            "join_safety": F.when(F.col("many_to_many"), "MANY_TO_MANY_RISK")
            .when(l_unique & r_unique & complete, "SAFE_ONE_TO_ONE")
            .when(l_unique & r_unique, "POSSIBLE_WITH_LIMITATIONS")
            .when(l_unique | r_unique, "SAFE_ONE_TO_MANY").otherwise("UNCLEAR"),
        }
    )


def single_join_audit(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """One key, missing keys left out, duplicate surplus counted."""
    def counts(df: DataFrame, key: str) -> DataFrame:
        text = quoted(key).cast("string")
        return df.groupBy(F.when(~missing_blank(quoted(key)), text).alias("key")).agg(F.count(F.lit(1)).alias("n"))

    both = _paired(counts(left, left_key), counts(right, right_key), ["key"])
    l, r, known = F.col("l"), F.col("r"), F.col("key").isNotNull()
    zero = F.lit(0)
    stats = both.agg(
        F.sum("l").alias("left_rows"),
        F.sum("r").alias("right_rows"),
        F.count_if(known & (l > 0)).alias("left_unique_keys"),
        F.count_if(known & (r > 0)).alias("right_unique_keys"),
        F.coalesce(F.sum(F.when(known & (l > 1), l - 1)), zero).alias("left_duplicate_surplus"),
        F.coalesce(F.sum(F.when(known & (r > 1), r - 1)), zero).alias("right_duplicate_surplus"),
        F.coalesce(F.sum(F.when(~known, l)), zero).alias("left_missing_keys"),
        F.coalesce(F.sum(F.when(~known, r)), zero).alias("right_missing_keys"),
        F.coalesce(F.sum(F.when(known & (r > 0), l)), zero).alias("matched_left_rows"),
        F.count_if(known & (l > 0) & (r == 0)).alias("unmatched_left_keys"),
        F.count_if(known & (l == 0) & (r > 0)).alias("unmatched_right_keys"),
        (F.count_if(known & (l > 1) & (r > 1)) > 0).alias("many_to_many"),
    )
    unique = (F.col("left_duplicate_surplus") == 0) & (F.col("right_duplicate_surplus") == 0)
    return stats.withColumns(
        {
            "left_match_percentage": F.coalesce(
                F.try_divide(F.col("matched_left_rows") * 100.0, F.col("left_rows")), F.lit(0.0)
            ),
            "join_safety": F.when(F.col("many_to_many"), "MANY_TO_MANY_RISK").when(unique, "SAFE_ONE_TO_ONE")
            .otherwise("POSSIBLE_WITH_LIMITATIONS"),
        }
    )


def identity_check(left: DataFrame, right: DataFrame, keys: Sequence[str], shared: Sequence[str] | None = None) -> DataFrame:
    """Key overlap and, per shared column, how many aligned rows differ.

    Rows are aligned by key. Only keys that are unique on both sides can be
    aligned, so repeated keys are counted and left out of the comparison.
    """
    shared = list(shared or [c for c in left.columns if c in right.columns and c not in keys])
    l_values = F.struct(*[quoted(c) for c in shared])

    def per_key(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{name}n"), F.first(l_values).alias(f"{name}v"))

    joined = per_key(left, "l").join(per_key(right, "r"), list(keys), "full_outer").fillna(0, ["ln", "rn"])
    aligned = (F.col("ln") == 1) & (F.col("rn") == 1)
    aggregates = [
        F.count_if(F.col("ln") > 0).alias("left_keys"),
        F.count_if(F.col("rn") > 0).alias("right_keys"),
        F.count_if((F.col("ln") > 0) & (F.col("rn") > 0)).alias("shared_keys"),
        F.coalesce(F.sum(F.greatest(F.col("ln") - 1, F.lit(0))), F.lit(0)).alias("left_duplicates"),
        F.coalesce(F.sum(F.greatest(F.col("rn") - 1, F.lit(0))), F.lit(0)).alias("right_duplicates"),
        F.count_if(aligned).alias("aligned_rows"),
        *[
            F.count_if(aligned & ~F.col("lv")[c].eqNullSafe(F.col("rv")[c])).alias(f"m{i}")
            for i, c in enumerate(shared)
        ],
    ]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("mismatches")) for i, c in enumerate(shared)])
    head = ["left_keys", "right_keys", "shared_keys", "left_duplicates", "right_duplicates", "aligned_rows"]
    return joined.agg(*aggregates).select(*head, F.explode(cells).alias("c")).select(*head, "c.*")


def one_to_one_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join that fails when a key repeats on either side.

    The proof is a count per key on each side, read as a one-row subquery.
    """
    def most(df: DataFrame) -> Column:
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        return counts.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).scalar()

    repeated = (most(left) > 1) | (most(right) > 1)
    guard = F.when(repeated, F.raise_error(F.lit("keys are not unique: " + ", ".join(keys))).cast("boolean")).otherwise(
        F.lit(True)
    )
    return left.join(right, list(keys), "inner").filter(guard)


def manifest_partition(df: DataFrame, manifest: DataFrame, key: str, split: str, wanted: str) -> DataFrame:
    """The rows a manifest assigns to one split."""
    chosen = manifest.filter(F.col(split) == wanted).select(key)
    return df.join(chosen, key, "left_semi")


def looked_up_rows(df: DataFrame, key: Column, dimension: DataFrame, dimension_key: str, how: str = "left") -> DataFrame:
    """Join a dimension; rows without a key are not sent to the join, where all would meet in one task.

    They are united with the others afterwards, with nulls for the dimension. With
    ``how="inner"`` rows whose key names nothing are dropped, rows without a key are kept.
    """
    joined = df.filter(key.isNotNull()).join(dimension, key == F.col(dimension_key), how)
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in dimension.schema.fields]
    return joined.unionByName(df.filter(key.isNull()).select("*", *nothing))


def with_optional_dimension(
    fact: DataFrame, dimension: DataFrame, foreign: str, key: str, prefix: str
) -> DataFrame:
    """Attach a dimension; a row is dropped only when it names a missing one."""
    named = dimension.select(*[F.col(c).alias(f"{prefix}{c}") for c in dimension.columns])
    fk = F.nullif(stripped(F.col(foreign).cast("string")), F.lit(""))
    dimensions = named.withColumn("__dk", F.col(f"{prefix}{key}").cast("string"))
    return looked_up_rows(fact, fk, dimensions, "__dk", "inner").drop("__dk")


def status_by_any_key(
    animals: DataFrame,
    records: DataFrame,
    animal_keys: Sequence[str],
    record_keys: Sequence[str],
    identity: str,
    status: Column,
    time: Column,
    record_id: str,
    default: str = "Healthy",
) -> DataFrame:
    """Latest non-blank status over records that share any key.

    Both sides are spread over their keys and met by one equi-join; the latest
    status per key is reduced first, so a hot key crosses the shuffle once per
    task rather than once per record.
    """
    latest = F.max_by(F.struct(F.col("__status").alias("status")), F.struct("__time", F.col(record_id)))
    spread = (
        records.select(
            record_id, status.alias("__status"), time.alias("__time"),
            F.explode(F.array_distinct(F.array(*[stripped(F.col(k).cast("string")) for k in record_keys]))).alias("__key"),
        )
        .filter("__key is not null and __key <> '' and __status is not null and __status <> ''")
        .groupBy("__key")
        .agg(latest.alias("__s"), F.max(F.struct("__time", F.col(record_id))).alias("__t"))
    )
    owners = animals.select(
        identity,
        F.explode(F.array_distinct(F.array(*[stripped(F.col(k).cast("string")) for k in animal_keys]))).alias("__key"),
    ).filter("__key is not null and __key <> ''")
    found = owners.join(spread, "__key").groupBy(identity).agg(F.max_by("__s", "__t").alias("__s"))
    return animals.join(found, identity, "left").withColumn(
        "latest_status", F.coalesce(F.col("__s.status"), F.lit(default))
    ).drop("__s")


def id_coverage(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column) -> DataFrame:
    """Identifiers only one side has, as (side, id) rows."""
    l = left.select(left_key.alias("id")).filter("id is not null").distinct()
    r = right.select(right_key.alias("id")).filter("id is not null").distinct()
    return l.join(r, "id", "left_anti").select(F.lit("left_only").alias("side"), "id").unionByName(
        r.join(l, "id", "left_anti").select(F.lit("right_only").alias("side"), "id")
    )


def display_target(
    records: DataFrame, animals: DataFrame, batches: DataFrame
) -> DataFrame:
    """The shown name of a record's batch or animal, with a fallback text."""
    a = animals.select(F.col("id").alias("__a"), F.format_string("%s (%s)", "animal_name", "animal_id").alias("__animal"))
    b = batches.select(F.col("id").alias("__b"), F.concat(F.lit("Batch: "), F.col("batch_name")).alias("__batch"))
    joined = looked_up_rows(looked_up_rows(records, F.col("livestock_id"), a, "__a"), F.col("batch_id"), b, "__b")
    is_batch = F.coalesce(F.col("target_type") == "Batch", F.lit(False)) | (
        F.coalesce(stripped(F.col("batch_id").cast("string")), F.lit("")) != ""
    )
    name = F.when(is_batch, F.coalesce("__batch", F.lit("Unknown Batch"))).otherwise(
        F.coalesce("__animal", F.lit("Unknown Animal"))
    )
    return joined.withColumn("target_name", name).drop("__a", "__b", "__animal", "__batch")


def search_display(records: DataFrame, needle: str, columns: Sequence[str] = ("vaccine_name", "target_name")) -> DataFrame:
    """C4: search over the shown name as well as the record's own text."""
    return records.filter(contains_any([F.col(c) for c in columns], needle))


def attach_fold(df: DataFrame, folds: DataFrame, key: str, fold: str = "fold") -> DataFrame:
    """Fold by row key; a row without one fails any job over the result.

    The check is a filter, so it runs even if nobody reads the fold.
    """
    joined = df.join(folds.select(key, fold), key, "left")
    missing = F.raise_error(F.concat(F.lit("no fold for "), F.col(key).cast("string"))).cast("boolean")
    return joined.filter(F.when(F.col(fold).isNull(), missing).otherwise(F.lit(True)))


def without_removed(
    tables: Mapping[str, tuple[DataFrame, str]], removed: DataFrame, removed_key: str, owner: str | None = None
) -> dict[str, DataFrame]:
    """Every table without the rows of removed parents, as anti joins.

    With ``owner``, rows go only where their owner is the parent's owner.
    """
    out = {}
    for name, (table, key) in tables.items():
        gone = removed.select(F.col(removed_key).alias("__gone"), *([F.col(owner).alias("__owner")] if owner else []))
        condition = F.col(key) == F.col("__gone")
        if owner:
            condition = condition & (F.col(owner) == F.col("__owner"))
        out[name] = table.join(gone, condition, "left_anti")
    return out


def key_set_difference(left: DataFrame, right: DataFrame) -> dict[str, DataFrame]:
    """Key sets shared, left-only and right-only."""
    return {
        "shared": left.intersect(right),
        "left_only": left.subtract(right),
        "right_only": right.subtract(left),
    }
