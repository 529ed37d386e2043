"""Media columns: FLAC streams stored in a binary column, read back as PCM blocks and features.

``round_trip`` writes the streams to the shared folder, wave by wave, decodes what it reads back
into a table of PCM blocks by sample offset (``write_pcm``), and takes the features from the last
block of each stream. ``read_samples`` reads only the blocks that a range of samples touches.

Defined results: null or empty text gives a payload of 64 zero bytes. Equal texts give equal
streams. Null ids and repeated rows pass through. An empty table gives no rows; other columns
are ignored. Texts are encoded whole, in chunks of about ``CHUNK`` bytes (a longer text alone).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, release, release_path, shared_path, trimmed

CHUNK = 1 << 20
PAD = 64


def _chunks(values: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    start, size = 0, 0
    for i, v in enumerate(values):
        if i > start and size + len(v) > CHUNK:
            yield start, values[start:i]
            start, size = i, 0
        size += len(v)
    if start < len(values):
        yield start, values[start:]


def encode_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of ``docs`` (doc_id, text): the UTF-8 bytes, zero-padded, as FLAC."""

    def run(batches):
        import pyarrow as pa

        from .flac import encode

        for batch in batches:
            raw = [t.encode() if t else b"" for t in batch.column(1).to_pylist()]
            for at, part in _chunks(raw):
                media = encode([p + bytes(-len(p) % PAD or (0 if p else PAD)) for p in part])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.array([len(p) for p in part], pa.int64()), pa.array(media, pa.binary())],
                    ["doc_id", "n_bytes", "media"],
                )

    schema = T.StructType([docs.schema["doc_id"]]).add("n_bytes", "long").add("media", "binary")
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), schema)


#: What the last block of each stream tells of the whole stream.
TOLD = [
    ("n_bytes", "long"),
    ("payload_bytes", "long"),
    ("payload_sha256", "string"),
    ("media_bytes", "long"),
    ("media_sha256", "string"),
    ("feature", "string"),
]


def pcm_blocks(media: DataFrame) -> DataFrame:
    """The frames of ``media`` (doc_id, n_bytes, media) as PCM blocks, in sample order within a stream.

    (doc_id, first_sample, n_samples, pcm), with ``pcm`` as unsigned 8-bit samples and
    ``first_sample`` as the seekable offset in the stream. The last block of a stream also has its
    n_bytes, payload_bytes, payload_sha256, media_bytes, media_sha256 and ``feature`` (frames, peak,
    energy and zero crossings of the signed samples); the others have nulls there. A stream
    without samples is one empty block.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from .flac import decode, seek_points

        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
        names = ["doc_id", "first_sample", "n_samples", "pcm", *(name for name, _ in TOLD)]
        for batch in batches:
            streams = batch.column(2).to_pylist()
            sizes = batch.column(1).to_pylist()
            for at, part in _chunks(streams):
                owner, rows = [], []
                for i, (stream, payload) in enumerate(zip(part, decode(part), strict=True), at):
                    frames = seek_points(stream)[0]
                    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64) - 128
                    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
                    feature = f"frames={len(frames)};peak={int(np.abs(x).max(initial=0))};energy={int((x * x).sum())};crossings={crossings}"
                    for first, _, n in frames or [(0, 0, 0)]:
                        owner.append(i)
                        rows.append((first, n, payload[first : first + n], *[None] * len(TOLD)))
                    whole = (sizes[i], len(payload), hashlib.sha256(payload).hexdigest(), len(stream), hashlib.sha256(stream).hexdigest(), feature)
                    rows[-1] = rows[-1][:3] + whole
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names
                )

    schema = T.StructType([media.schema["doc_id"]]).add("first_sample", "long").add("n_samples", "long").add("pcm", "binary")
    for name, kind in TOLD:
        schema = schema.add(name, kind)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(trimmed(run), schema)


def write_pcm(media: DataFrame, path: str, ordered: bool = True) -> None:
    """Decode ``media`` (doc_id, n_bytes, media) and write its PCM blocks as Parquet.

    ``ordered`` sorts each file by (doc_id, first_sample), so that page and row-group bounds lead a
    reader to its blocks; without it the blocks stay in the order of ``media``.
    """
    blocks = pcm_blocks(media)
    if ordered:
        blocks = blocks.sortWithinPartitions("doc_id", "first_sample")
    blocks.write.option("compression", "zstd").parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """One row for each stream of the PCM blocks at ``path``, from its last block alone.

    ``tail_crc32`` is that of the last 64 samples, read from the block that holds them (blocks of
    streams that ``encode_texts`` makes are multiples of 64 samples).
    """
    last = spark.read.parquet(path).where("media_sha256 is not null")
    tail = F.crc32(F.substring("pcm", -PAD, PAD)).alias("tail_crc32")
    return last.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", tail, "media_bytes", "media_sha256", "feature")


#: ``round_trip`` goes in this many waves, so that what is on disk at a time is a share of all.
WAVES = 3


def round_trip(docs: DataFrame, waves: int = WAVES) -> DataFrame:
    """Streams of ``docs`` written to the shared folder, decoded from there into a table of PCM blocks, and features from it.

    Every row is in one wave; a wave's streams and blocks are deleted once its features are
    written. To keep them, write ``encode_texts`` and ``write_pcm`` to places of your own.
    """
    spark, out = docs.sparkSession, None
    for k in range(waves):
        part = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(waves)) == k) if waves > 1 else docs
        stored = materialize(encode_texts(part), "flac")
        path = shared_path(spark, "pcm")
        write_pcm(stored, path, ordered=False)
        release(stored)
        features = materialize(read_features(spark, path), "flac-features")
        release_path(spark, path)
        out = features if out is None else out.union(features)
    return out


def read_samples(spark: SparkSession, path: str, doc_id: int, first: int, count: int) -> bytes:
    """Samples ``first`` to ``first + count`` of one document, from the blocks that hold them."""
    from .flac import BLOCK

    stop = first + count
    rows = (
        spark.read.parquet(path)
        .where((F.col("doc_id") == doc_id) & (F.col("first_sample") > first - BLOCK) & (F.col("first_sample") < stop))
        .orderBy("first_sample")
        .collect()
    )
    return b"".join(bytes(r.pcm[max(0, first - r.first_sample) : max(0, stop - r.first_sample)]) for r in rows)
