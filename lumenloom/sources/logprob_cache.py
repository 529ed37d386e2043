"""The reference's token log-probabilities, kept in a layout that joins without a shuffle.

Rows are (key, pos, tokens): a document's key, a position, and the top tokens there as an array of
struct(id, lp). They are bucketed and sorted by (key, pos), one file a bucket, so two caches of the
same number of buckets join bucket by bucket.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path

BUCKETS = 64
_KEYS = ("key", "pos")


def write_cache(rows: DataFrame, name: str | None = None, path: str | None = None, buckets: int = BUCKETS) -> str:
    """Write ``rows`` (key, pos, tokens) as a bucketed table, whose name is returned; a table of that name is replaced.

    Without ``path`` the files lie in the shared folder. One position of one key is one row: of
    repeated ones the first by value is kept.
    """
    spark = rows.sparkSession
    name = name or f"lumenloom_logprobs_{uuid.uuid4().hex}"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    one = rows.groupBy(*_KEYS).agg(F.min("tokens").alias("tokens"))
    dealt = one.repartition(buckets, *_KEYS).sortWithinPartitions(*_KEYS)
    out = dealt.write.format("parquet").option("compression", "zstd").option("path", path or shared_path(spark, "logprobs"))
    out.bucketBy(buckets, *_KEYS).sortBy(*_KEYS).saveAsTable(name)
    return name


def read_cache(spark: SparkSession, name: str) -> DataFrame:
    """The table's rows; raises if the reference was not scored yet."""
    if not spark.catalog.tableExists(name):
        raise FileNotFoundError(f"{name} is missing: score the reference first")
    return spark.table(name)


def extend_cache(spark: SparkSession, name: str, rows: DataFrame, buckets: int = BUCKETS) -> str:
    """A new table of ``name``'s rows and ``rows``; where both have a position, ``rows`` has it. The old table stays."""
    old = read_cache(spark, name)
    return write_cache(old.join(rows.select(*_KEYS), list(_KEYS), "left_anti").unionByName(rows.select(*_KEYS, "tokens")), buckets=buckets)


def join_cached(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """(key, pos, reference, candidate) of the positions both have; no exchange if both are caches of as many buckets."""
    left = reference.select(*_KEYS, F.col("tokens").alias("reference"))
    right = candidate.select(*_KEYS, F.col("tokens").alias("candidate"))
    return left.hint("merge").join(right, list(_KEYS))
