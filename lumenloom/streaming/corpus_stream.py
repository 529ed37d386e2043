"""Structured Streaming forms: file source to running counts and seen-key deduplication.

Every query drains what is there (available-now) and can be resumed from its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normal_form
from ..session import shared_path


def document_stream(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """The table as a stream of its files; the schema comes from the files that are there."""
    path = f"{sf_dir}/{name}.parquet*"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 64).parquet(path)


def running_counts(stream: DataFrame, by: str) -> DataFrame:
    return stream.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


def first_copies(stream: DataFrame) -> DataFrame:
    """Each normal form once; state grows with the distinct keys, so bound it by partition or time in long runs."""
    return stream.withColumn("key", F.sha2(normal_form(F.coalesce("text", F.lit(""))), 256)).dropDuplicates(["key"])


def class_quota(stream: DataFrame, by: str, quota: int) -> DataFrame:
    """The first ``quota`` rows of each class over the whole stream; the state is one counter a class."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)

    def take(key, batches, state):
        seen = state.get[0] if state.exists else 0
        for pdf in batches:
            kept = pdf.iloc[: max(0, quota - seen)]
            seen += len(kept)
            yield kept
        state.update((seen,))

    return stream.groupBy(by).applyInPandasWithState(take, columns, "seen long", "append", "NoTimeout")


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Run a streaming query over what is there and return its result table.

    Each batch's result is written to the shared folder, so nothing is gathered in the driver; in
    complete mode the last batch's result stands for all.
    """
    spark = stream.sparkSession
    out, state = shared_path(spark, "drained"), shared_path(spark, "stream-state")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{'all' if mode == 'complete' else f'batch={number}'}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/*")
