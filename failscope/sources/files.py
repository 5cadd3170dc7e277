"""Readers and writers of the exchange files: JSON lines, CSV, JSON maps, Markdown, split files with a manifest."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope.operators.windows import last_wins

PREDICTION = "map<string, struct<action: string, confidence: double, tokens: bigint, finish_reason: string>>"


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system that the cluster knows is there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: str, missing: str = "fail") -> DataFrame:
    """JSON lines with a stated schema; blank lines are skipped; missing="empty" gives no rows where there is no file."""
    if missing == "empty" and not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def read_jsonl_last(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """JSON lines of which the last record of each key counts: order is file name, then place in the file."""
    rows = spark.read.text(path).filter(F.trim("value") != "")
    parsed = rows.select(F.from_json("value", schema).alias("r"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    return last_wins(parsed.select("r.*", "file", "block", "place"), keys, ["file", "block", "place"]).drop("file", "block", "place")


def read_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """CSV with a header as texts; a byte order mark is no part of the first name; required columns are checked."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path}: no columns {missing}")
    return df


def read_splits(spark: SparkSession, paths: dict[str, str], required: list[str]) -> DataFrame | None:
    """Frozen split files as one table with a split column; None unless all are there."""
    if not all(_exists(spark, p) for p in paths.values()):
        return None
    out = None
    for split, p in paths.items():
        df = read_csv(spark, p, required).select(*required, F.lit(split).alias("split"))
        out = df if out is None else out.unionByName(df)
    return out


def read_json_maps(spark: SparkSession, pattern: str, value: str = PREDICTION) -> DataFrame:
    """(trace_id, value fields) of JSON objects keyed by id in several files; of equal ids the later file name wins."""
    rows = spark.read.option("wholetext", True).text(pattern).select(F.explode(F.from_json("value", value)).alias("trace_id", "v"), F.col("_metadata.file_name").alias("file"))
    return last_wins(rows.select("trace_id", "v.*", "file"), ["trace_id"], ["file"]).drop("file")


def latest(pattern: str, spark: SparkSession | None = None) -> str | None:
    """The last path of a glob in name order, on the file system of the pattern (on this machine without a session)."""
    if spark is None:
        found = sorted(str(p) for p in Path().glob(pattern)) if not os.path.isabs(pattern) else sorted(str(p) for p in Path("/").glob(pattern.lstrip("/")))
        return found[-1] if found else None
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = sorted(s.getPath().toString() for s in (p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or []))
    return found[-1] if found else None


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_ordered_jsonl(df: DataFrame, order: DataFrame, key: str, path: str) -> None:
    """Records in the order of a reference (key, pos): sorted by range, so part files follow each other in name order."""
    joined = df.join(order.select(key, "pos"), key).repartitionByRange("pos").sortWithinPartitions("pos")
    joined.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_nested_jsonl(traces: DataFrame, steps: DataFrame, path: str) -> None:
    """One record a trace with its ordered steps as an array."""
    columns = [c for c in steps.columns if c != "trace_id"]
    nested = steps.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct(F.col("step_index"), *[c for c in columns if c != "step_index"]))).alias("steps"))
    traces.join(nested, "trace_id", "left").withColumn("steps", F.coalesce("steps", F.array().cast(nested.schema["steps"].dataType))).write.mode("overwrite").json(path)


def write_markdown(views: DataFrame, title: str, body: str, path: str) -> None:
    """A Markdown section a row."""
    views.select(F.concat(F.lit("## "), F.col(title), F.lit("\n\n"), F.col(body), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, sort: list[str] | None = None) -> None:
    """Rebuild a parquet table; rows sorted inside files, so that row groups can be skipped."""
    (df.sortWithinPartitions(*sort) if sort else df).write.mode("overwrite").parquet(path)


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str], order: list[str]) -> None:
    """Insert or replace by key: old and new rows in one last-wins aggregation.

    The table is written beside the old one, which is moved aside and deleted only when the new one stands in
    its place; a run that was killed between the two is put right by the next.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at, nxt, old = (jvm.org.apache.hadoop.fs.Path(path + x) for x in ("", ".next", ".old"))
    fs = at.getFileSystem(conf)
    if not fs.exists(at) and fs.exists(old):
        fs.rename(old, at)
    both = spark.read.parquet(path).unionByName(new) if fs.exists(at) else new
    last_wins(both, keys, order).write.mode("overwrite").parquet(path + ".next")
    fs.delete(old, True)
    if fs.exists(at):
        fs.rename(at, old)
    fs.rename(nxt, at)
    fs.delete(old, True)


def sha256_of(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def content_hash(df: DataFrame, columns: list[str]):
    """Hash of a table's content whatever its order: the sum of row hashes, as one row."""
    row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns])
    return df.agg(F.sum(row.cast("decimal(38,0)")).alias("content_hash"), F.count(F.lit(1)).alias("n_rows"))


def write_split_files(df: DataFrame, label: str, folder: str, seed: int = 42) -> dict:
    """A CSV file for each split, staged and then renamed together, and a manifest of bytes, rows and label counts.

    For split files of labels (one short row a trace); each file is written by Spark and joined from its parts.
    """
    stage = Path(folder + ".staging")
    shutil.rmtree(stage, ignore_errors=True)
    manifest: dict = {"schema_version": "1", "seed": seed, "splits": {}}
    try:
        df.repartition("split").sortWithinPartitions("split", "trace_id").write.partitionBy("split").option("header", True).csv(str(stage / "parts"))
        counts = df.groupBy("split", label).agg(F.count(F.lit(1)).alias("n")).collect()  # labels by splits
        total = sum(r["n"] for r in counts)
        for split in sorted({r["split"] for r in counts}):
            target = stage / f"{split}.csv"
            with target.open("wb") as out:
                for i, part in enumerate(sorted((stage / "parts" / f"split={split}").glob("*.csv"))):
                    lines = part.read_bytes().split(b"\n", 1)
                    out.write((lines[0] + b"\n" if i == 0 else b"") + lines[1])
            n = sum(r["n"] for r in counts if r["split"] == split)
            manifest["splits"][split] = {"file": f"{split}.csv", "sha256": sha256_of(str(target)), "rows": n, "pct": round(100 * n / total, 2), "label_counts": {str(r[label]): r["n"] for r in counts if r["split"] == split}}
        manifest["total_rows"] = total
        shutil.rmtree(stage / "parts")
        (stage / "manifest.json").write_text(json.dumps(manifest, indent=1, sort_keys=True))
        shutil.rmtree(folder, ignore_errors=True)
        stage.rename(folder)
    finally:
        shutil.rmtree(stage, ignore_errors=True)
    return manifest


def verify_manifest(folder: str) -> list[str]:
    """What a manifest says that the files beside it don't bear out."""
    manifest = json.loads(Path(folder, "manifest.json").read_text())
    return [s for s, x in manifest["splits"].items() if not Path(folder, x["file"]).exists() or sha256_of(str(Path(folder, x["file"]))) != x["sha256"]]


def table_report(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """(table_name, n_rows, n_columns) of the parquet tables of a folder; a missing one is an error."""
    absent = [n for n in names if not _exists(spark, f"{folder}/{n}.parquet")]
    if absent:
        raise FileNotFoundError(f"missing tables: {absent}")
    out = None
    for n in names:
        df = spark.read.parquet(f"{folder}/{n}.parquet")
        row = df.agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))
        out = row if out is None else out.unionByName(row)
    return out


