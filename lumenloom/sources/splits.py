"""Splits on disk: the sides of all documents with a digest of every class, checked when they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import SplitError
from ..session import small_side
from .artifacts import STAMP, current, new_version, stamp

_ROWS = ("doc_id", "corpus_class", "doc_index", "side")


def split_digest(parts: DataFrame) -> DataFrame:
    """(corpus_class, total, n_train, d1, d2): counts and an order-free digest of each class's rows."""
    plain = [F.col("doc_id").cast("string"), F.col("corpus_class"), F.col("doc_index").cast("long"), F.col("side")]
    return parts.groupBy("corpus_class").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("side") == "train").alias("n_train"),
        F.bit_xor(F.xxhash64(F.lit(1), *plain)).alias("d1"),
        F.bit_xor(F.xxhash64(F.lit(2), *plain)).alias("d2"),
    )


def save_splits(parts: DataFrame, path: str, fingerprint: str, phase: str = "splits") -> None:
    """``parts`` (doc_id, corpus_class, doc_index, side) and their digests as one version of an artifact; both or neither are seen."""
    with new_version(parts.sparkSession, path) as at:
        stamp(parts.select(*_ROWS), fingerprint, phase).write.option("compression", "zstd").partitionBy("corpus_class").parquet(f"{at}/rows")
        # from what was written, so it is what a reader finds
        split_digest(_typed(parts.sparkSession, f"{at}/rows")).withColumn("fingerprint", F.lit(fingerprint)).coalesce(1).write.parquet(f"{at}/digest")


def _typed(spark: SparkSession, path: str) -> DataFrame:
    """Rows with their types whatever a folder's name looks like: classes are text, indices integers."""
    stamps = ", ".join(f"{c} string" for c in STAMP)
    kind = dict(spark.read.parquet(path).dtypes)["doc_id"]
    rows = spark.read.schema(f"doc_id {kind}, doc_index int, side string, {stamps}, corpus_class string").parquet(path)
    return rows.select(*_ROWS)


def load_splits(spark: SparkSession, path: str, fingerprint: str | None = None) -> DataFrame:
    """(doc_id, corpus_class, doc_index, side), checked against the digests and, if given, the fingerprint.

    Raises SplitError for rows that were added, lost or changed, and for another configuration's split.
    """
    at = current(spark, path)
    if at is None:
        raise FileNotFoundError(f"{path} is missing: run the split first")
    stored = spark.read.parquet(f"{at}/digest")
    if fingerprint is not None:
        other = stored.where(F.col("fingerprint") != fingerprint).limit(1).collect()
        if other:
            raise SplitError(f"{path} was made under {other[0].fingerprint}, not {fingerprint}")
    rows = _typed(spark, f"{at}/rows")
    # one row a class
    found = split_digest(rows).alias("l")
    same = F.lit(True)
    for c in ("total", "n_train", "d1", "d2"):
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    both = found.join(small_side(stored).alias("r"), F.col("l.corpus_class").eqNullSafe(F.col("r.corpus_class")), "full")
    bad = both.where(~same).select(F.coalesce("l.corpus_class", "r.corpus_class").alias("c")).limit(5).collect()
    if bad:
        raise SplitError(f"{path} does not hold what was saved, in {sorted(str(r.c) for r in bad)}")
    return rows
