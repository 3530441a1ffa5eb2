"""The annotation queue and its merge, kept up to date from a stream of files.

A micro-batch only reads its own new rows plus the key columns of what exists.
Each batch owns one output partition named after its number, so a replayed batch
replaces its own result and nothing is queued or merged twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pacelens.operators import annotate


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def _existing(spark: SparkSession, path: str, like: DataFrame, before: int) -> DataFrame:
    """Rows written by earlier batches; none before the first one."""
    probe = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not probe.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(probe):
        return spark.createDataFrame([], like.schema)
    return spark.read.parquet(path).where(F.col("batch") < before).select(*like.columns)


def _write_batch(df: DataFrame, path: str, batch: int) -> None:
    df.withColumn("batch", F.lit(batch).cast("bigint")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("batch").parquet(path)


def queue_positions(plies: DataFrame, done: Callable[[], DataFrame], out: str, checkpoint: str, keys: Sequence[str] = ("fen_before",)) -> StreamingQuery:
    """Queue every new position once, leaving out those already annotated.

    ``done`` is called per batch so that annotations finished meanwhile count.
    """
    keys = list(keys)

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = annotate.todo(batch, done(), keys)
        queued = _existing(spark, out, fresh, number)
        _write_batch(fresh.join(queued, keys, "left_anti"), out, number)

    return plies.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def collect_annotations(results: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append each batch of engine results, stamped with the batch as load order."""

    def run(batch: DataFrame, number: int) -> None:
        _write_batch(batch.withColumn("load_seq", F.lit(number).cast("bigint")), out, number)

    return results.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_annotations(spark: SparkSession, out: str, keys: Sequence[str] = ("fen_before",)) -> DataFrame:
    """Current annotations: the last loaded row of every key."""
    return annotate.merge([spark.read.parquet(out).drop("batch")], keys)
