"""Resumable and incremental work as Structured Streaming: logs of results, running totals, error side outputs.

Watermarked windows (`windowed_counts`) are an extension beyond resumable logs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = "trace_id string, action string, model string, input_tokens bigint, output_tokens bigint, latency double, success boolean, error string, ts timestamp"


def read_log(spark: SparkSession, path: str, schema: str = RESULT) -> DataFrame:
    """An append-only log of JSON lines as a stream."""
    return spark.readStream.schema(schema).json(path)


def append_new(stream: DataFrame, keys: list[str], target: str, checkpoint: str, errors: str | None = None):
    """Records of keys not seen before go to `target`; records with an error go to `errors` and don't count as seen.

    A key that is done is skipped for ever: each micro-batch leaves out what earlier batches stored, and keeps the
    earliest of its own rows. A batch writes a folder of its own number, so a batch that is repeated after a
    failure replaces what it wrote. The query runs until its input is used up and can be started again.
    """

    def split(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        good = batch.filter("error is null")
        rest = [c for c in good.columns if c not in keys]
        one = good.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("ts", F.xxhash64(*rest))).alias("r")).select(*[F.col(k) for k in keys], "r.*").select(*good.columns)
        if version:
            done = spark.read.schema(good.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(target).withColumn("file_", F.input_file_name())
            one = one.join(done.filter(~F.col("file_").contains(f"/batch={version}/")).select(*keys), keys, "left_anti")
        one.write.mode("overwrite").parquet(f"{target}/batch={version}")
        if errors:
            batch.filter("error is not null").write.mode("overwrite").parquet(f"{errors}/batch={version}")

    return stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_totals(stream: DataFrame, by: list[str]) -> DataFrame:
    """Calls, tokens and successes so far; for output mode complete."""
    return stream.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.sum(F.coalesce(F.col("success"), F.lit(False)).cast("int")).alias("n_success"))


def windowed_counts(stream: DataFrame, width: str = "1 hour", delay: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", width), "action").agg(F.count(F.lit(1)).alias("n"))


def orphan_deltas(changes: DataFrame, state_path: str, checkpoint: str):
    """Fold micro-batches of reference deltas (operators.integrity.STATE) into a stored state, version by version."""
    from failscope.operators.integrity import STATE, fold

    spark = changes.sparkSession

    def merge(batch: DataFrame, version: int) -> None:
        new = batch.select(*STATE)
        if version:
            new = fold(spark.read.parquet(f"{state_path}/v={version - 1}"), new)
        else:
            new = fold(new)
        new.write.mode("overwrite").parquet(f"{state_path}/v={version}")

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
