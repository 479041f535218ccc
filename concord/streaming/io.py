"""Running streams over files: sources, epoch logs and state snapshots under the checkpoint folder."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from concord.session import scratch


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None, glob: str | None = None
) -> DataFrame:
    """A Parquet folder as a stream. ``files_per_trigger`` bounds the rows of one micro-batch."""
    reader = spark.readStream.schema(schema).format("parquet")
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def run_available(
    stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append"
) -> None:
    """Process what is there now, batch by batch, and stop."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def epoch_log(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Drain a stream into ``<scratch>/log/epoch=N`` folders and return them as a table with ``epoch``.

    A repeated batch overwrites its own epoch, so every row is there exactly once.
    """
    spark = stream.sparkSession
    root = scratch(spark, label)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/log/epoch={epoch}")

    run_available(stream, f"{root}/checkpoint", write, mode)
    schema = T.StructType(list(stream.schema.fields) + [T.StructField("epoch", T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{root}/log")


def newest_epoch(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last version of every key of an update-mode log."""
    rest = [c for c in log.columns if c not in keys and c != "epoch"]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("r")).select(*keys, "r.*")
