"""Loads, line tables, fingerprints, inventories and guarded writes."""

import hashlib

import pytest
from pyspark.sql import functions as F

from herdspark.sources import sinks, tables


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_load_errors(spark, tmp_path):
    good = write(tmp_path / "a.csv", "a,b\n1,2\n3,4\n")
    loaded = tables.load_table(spark, good, columns=["b"], required=["a"], row_limit=1)
    assert loaded.columns == ("b",) and loaded.table.count() == 1
    facts = tables.load_table(spark, good).facts().first()
    assert (facts["rows"], facts["columns"], facts["bytes"], facts["format"]) == (2, 2, 12, "csv")
    for kwargs, code in (
        (dict(path=str(tmp_path / "none.csv")), "MISSING_FILE"),
        (dict(path=good, format="xlsx"), "UNSUPPORTED_FORMAT"),
        (dict(path=good, required=["z"]), "MISSING_COLUMNS"),
        (dict(path=good, row_limit=0), "INVALID_ROW_LIMIT"),
        (dict(path=write(tmp_path / "e.csv", "a,b\n")), "EMPTY"),
    ):
        with pytest.raises(tables.LoadError) as error:
            tables.load_table(spark, **kwargs)
        assert error.value.code == code


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    path = write(tmp_path / "big.csv", "h\n" + "".join(f"row {i}\n" for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = tables.line_table(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    found = {r["line_number"]: r["line"] for r in rows}
    assert len(found) == 2001 and found[1] == "h" and all(found[i + 2] == f"row {i}" for i in range(2000))


def test_sheet(spark, tmp_path):
    path = write(tmp_path / "s.csv", 'title,,\n Animal ID ,"THI, Range",x.y%\n1,"T0 (≤75)",\n,,\n\n2,,5\n')
    sheet = tables.sheet_table(spark, path, header_row=2)
    assert sheet.columns == ["source_row_number", "Animal ID", "THI, Range", "x.y%"]
    assert [tuple(r) for r in sheet.orderBy("source_row_number").collect()] == [(3, "1", "T0 (≤75)", None), (6, "2", None, "5")]
    with pytest.raises(tables.LoadError, match="DUPLICATE_HEADERS"):
        tables.sheet_table(spark, write(tmp_path / "d.csv", "a, a\n1,2\n"))
    with pytest.raises(tables.LoadError, match="HEADER_NOT_FOUND"):
        tables.sheet_table(spark, path, header_row=99)
    assert tables.blank_lines(spark, write(tmp_path / "b.csv", "h\n\n1\n \t\n2\n")).first()["blank_lines"] == 2


def test_fingerprint_ignores_order_but_not_content(spark):
    df = spark.range(500).select("id", F.when(F.col("id") > 3, F.col("id").cast("string")).alias("v"))
    base = tables.fingerprint(df).first()
    assert tables.fingerprint(df.orderBy(F.desc("id")).repartition(9)).first() == base
    assert tables.fingerprint(df.withColumn("v", F.coalesce("v", F.lit("")))).first() != base


def test_inventory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    write(tmp_path / "x.txt", "hello")
    write(tmp_path / "sub" / "y.txt", "world" * 1000)
    rows = {r["path"].rsplit("/", 1)[1]: r for r in tables.file_inventory(spark, str(tmp_path)).collect()}
    assert rows["x.txt"]["sha256"] == hashlib.sha256(b"hello").hexdigest().upper() and rows["y.txt"]["length"] == 5000
    first = tables.tree_checksum(tables.file_inventory(spark, str(tmp_path)), str(tmp_path)).first()
    write(tmp_path / "x.txt", "hallo")
    assert tables.tree_checksum(tables.file_inventory(spark, str(tmp_path)), str(tmp_path)).first() != first


def test_guarded_writes(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    path = sinks.write_report(df.coalesce(1), str(tmp_path / "r"))
    assert [r["k"] for r in spark.read.csv(path, header=True).collect()] == ["1", "2"]
    with pytest.raises(sinks.WriteError):
        sinks.write_report(df.limit(0), str(tmp_path / "none"))
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        sinks.write_report(df, path)
    with pytest.raises(sinks.WriteError, match="differ from the contract"):
        sinks.write_contracted(df, str(tmp_path / "c"), ["v", "k"])
    assert sinks.write_contracted(df, str(tmp_path / "c"), ["k", "v"], ["v"]).columns == ["k", "v"]
    manifest = df.select("k", F.lit("train").alias("split"), F.lit(42).alias("random_seed"), F.lit("v1").alias("split_version"))
    assert sinks.write_manifest(manifest, "k", str(tmp_path / "m")).count() == 2
    locked = sinks.lock_selection(df, str(tmp_path / "lock"))
    assert locked.count() == 2 and sinks.read_locked(spark, str(tmp_path / "lock")).count() == 2
