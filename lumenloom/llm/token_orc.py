"""Token-ID output: ORC files in document order, with row indexes and Bloom filters on ids.

Layout. Documents are dealt by ranges of doc_id (bounds from quantiles of the id column alone),
sorted within a part, encoded, and written by the ORC writer: integer run-length encoding,
row indexes every ``STRIDE`` rows, stripes of ``STRIPE`` bytes, a Bloom filter on doc_id. Each
row carries its part and the ids before it in that part; where a part starts follows from one
sum a part, so a document's global start needs no global sort or window.

Reading. Stripes are read in parallel; a filter on doc_id skips files and stripes by their
statistics and row groups by the index and Bloom filter.

Defined results: null text is empty and still gets the end id. Null ids come first. Rows that
share a doc_id are ordered by text (null and empty first), so equal rows are interchangeable.
An empty table writes no rows. Other columns are ignored.
"""

from __future__ import annotations

from itertools import pairwise
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_path, trimmed
from .tokens import encoder, row_slices

STRIDE = 10_000
STRIPE = 64 << 20
#: Least documents of a part. Beyond its square, parts grow in number and in size alike, by the
#: square root of the rows: a part is sorted with spilling and streamed, the bounds stay small.
PART_ROWS = 8_000


def id_ranges(docs: DataFrame, part_rows: int = PART_ROWS) -> list[int]:
    """Upper bounds (inclusive) of all but the last range of doc_id; reads that column only."""
    rows = docs.select("doc_id").where(F.col("doc_id").isNotNull())
    n = rows.count()
    parts = -(-n // max(part_rows, isqrt(n)))
    if parts < 2:
        return []
    cuts = rows.stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (4 * parts))
    return sorted({int(c) for c in cuts})


def range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` lie below ``value``, by binary search; 0 for null."""
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    table = F.lit(bounds).cast("array<bigint>")
    return F.aggregate(
        F.lit(steps), F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) < value, at + step).otherwise(at)
    )


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, bounds: list[int] | None = None) -> None:
    """Encode ``docs`` (doc_id, text) and write ORC rows (part, doc_id, local_start, n_tokens, ids)."""
    bounds = id_ranges(docs) if bounds is None else bounds
    part = range_of(F.col("doc_id"), bounds) if bounds else F.lit(0)
    dealt = (
        docs.select("doc_id", "text")
        .withColumn("part", part.cast("int"))
        .repartitionById(len(bounds) + 1, F.col("part"))
        .sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), F.coalesce("text", F.lit("")))
    )
    id_type = docs.schema["doc_id"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        encode = encoder(tokenizer, False)
        tail = int(end_id).to_bytes(4, "little")
        now, start = None, 0
        for batch in batches:
            parts = batch.column(2).to_pylist()
            for lo, hi in row_slices(batch.column(1)):
                got = [b + tail for b in encode(batch.column(1).slice(lo, hi - lo))]
                starts = []
                for p, b in zip(parts[lo:hi], got, strict=True):
                    if p != now:
                        now, start = p, 0
                    starts.append(start)
                    start += len(b) // 4
                sizes = np.array([len(b) // 4 for b in got], dtype=np.int64)
                flat = np.frombuffer(b"".join(got), dtype="<u4").astype(np.int32)
                offsets = np.zeros(len(got) + 1, dtype=np.int32)
                np.cumsum(sizes, out=offsets[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(2).slice(lo, hi - lo),
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(starts, pa.int64()),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    ],
                    ["part", "doc_id", "local_start", "n_tokens", "ids"],
                )

    schema = T.StructType([T.StructField("part", T.IntegerType()), id_type])
    schema = schema.add("local_start", "long").add("n_tokens", "long").add("ids", T.ArrayType(T.IntegerType()))
    (
        dealt.mapInArrow(trimmed(run), schema)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(STRIDE))
        .option("orc.stripe.size", str(STRIPE))
        .option("compression", "lz4")  # the run-length bits are dense already
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows with their global ``start``. ``doc_ids`` is pushed down to statistics and Bloom filters."""
    rows = spark.read.orc(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    at = F.lit(0).cast("long")
    # one sum a part: about the square root of the rows
    total, before = 0, []
    for part, n in sorted((r.part, r.n) for r in sums.collect()):
        before.append((part, total))
        total += n
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(doc_ids))
    if before:
        dense = {p: b for p, b in before}
        at = F.get(F.lit([dense.get(i, 0) for i in range(before[-1][0] + 1)]).cast("array<bigint>"), F.col("part"))
    return rows.withColumn("start", at + F.col("local_start"))


def token_digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the ids read back."""

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(2)
            flat = np.asarray(ids.flatten()).astype("<u4")
            sizes = np.diff(np.asarray(ids.offsets))
            cuts = np.concatenate([[0], np.cumsum(sizes)]) * 4
            blob = memoryview(flat.tobytes())
            crcs = [zlib.crc32(blob[a:b]) for a, b in pairwise(cuts.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes.astype(np.int64)), pa.array(crcs, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    schema = T.StructType([tokens.schema["doc_id"]]).add("start", "long").add("n_tokens", "long").add("ids_crc32", "long")
    return tokens.select("doc_id", "start", "ids").mapInArrow(trimmed(run), schema)


def tokens_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write ``docs`` as ORC under the shared folder, read the files back, and digest every row.

    ``release_all`` deletes the files; the result reads them until then.
    """
    path = shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return token_digests(read_tokens(docs.sparkSession, path))
