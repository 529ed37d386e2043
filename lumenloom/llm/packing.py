"""Best-fit packing: bounded-space online best-fit over a bitset of free space.

Documents are encoded, ended with an end id and cut into pieces of at most ``capacity`` ids (a
longer document's first piece is the short one). Only piece lengths move: they are dealt by a
hash into groups of about ``GROUP_TOKENS`` ids, sorted within a group by falling length, and
packed online. At most ``OPEN_BINS`` bins are open; bit f of an integer says that some open bin
has f ids free, so the tightest fit is the lowest set bit from the piece's length on. When
one bin too many would be open the fullest closes; a full bin closes at once.

Defined results: null text is one end id. Repeated rows are separate documents. Null ids are
kept. An empty table gives no rows; other columns are ignored. Reruns give the same bins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, trimmed
from .tokens import encoder, row_slices

CAPACITY = 2048
OPEN_BINS = 8192
#: Ids a packing group is aimed at: the groups' last bins are a vanishing share of all.
GROUP_TOKENS = 32 << 20


def best_fit(lengths: Iterable[int], capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> Iterator[tuple[int, int]]:
    """(bin, offset) for each length in turn; every length is from 1 to ``capacity``."""
    free_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by free space
    bits, is_open, made = 0, 0, 0
    for length in lengths:
        fit = bits >> length
        if fit:
            free = length + (fit & -fit).bit_length() - 1
            stack = free_bins[free]
            number = stack.pop()
            if not stack:
                bits ^= 1 << free
        else:
            if is_open >= open_bins:  # the fullest closes first
                full = (bits & -bits).bit_length() - 1
                free_bins[full].pop()
                if not free_bins[full]:
                    bits ^= 1 << full
                is_open -= 1
            number, free = made, capacity
            made, is_open = made + 1, is_open + 1
        yield number, capacity - free
        free -= length
        if free:
            free_bins[free].append(number)
            bits |= 1 << free
        else:
            is_open -= 1


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of ``docs`` (doc_id, text)."""

    def run(batches):
        import zlib

        import pyarrow as pa

        encode = encoder(tokenizer, True)
        tail = int(end_id).to_bytes(4, "little")
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = []
            for lo, hi in row_slices(batch.column(1)):
                for doc, got in zip(ids[lo:hi], encode(batch.column(1).slice(lo, hi - lo)), strict=True):
                    got += tail
                    n = len(got) // 4
                    first = n % capacity or capacity
                    cuts = [0, *range(first, n + 1, capacity)]
                    for i in range(len(cuts) - 1):
                        a, b = cuts[i], cuts[i + 1]
                        rows.append((doc, i, a, b - a, zlib.crc32(got[4 * a : 4 * b])))
            if rows:
                a, b, c, d, e = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, batch.schema.field(0).type), pa.array(b, pa.int32()), pa.array(c, pa.int64()), pa.array(d, pa.int64()), pa.array(e, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    schema = T.StructType([docs.schema["doc_id"]]).add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), schema)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """``pieces`` with sequence_id and offset; ``pieces`` should be cheap to read twice."""
    total = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / group_tokens))
    key = F.pmod(F.xxhash64("doc_id", "piece", "length", "ids_crc32"), F.lit(groups)).cast("int")
    dealt = (
        pieces.withColumn("grp", key)
        .repartition(groups, "grp")
        .sortWithinPartitions("grp", F.col("length").desc(), "ids_crc32", "doc_id", "piece")
    )
    schema = T.StructType([*pieces.schema.fields]).add("sequence_id", "long").add("offset", "long")
    at = pieces.columns.index("length")

    def run(batches):
        import pyarrow as pa

        now, feed, bins = None, [], None

        def lengths():
            while True:
                yield feed.pop()

        for batch in batches:
            length, group = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            seq, off = [], []
            for n, g in zip(length, group, strict=True):
                if g != now:
                    now, bins = g, best_fit(lengths(), capacity, open_bins)
                feed.append(n)
                number, offset = next(bins)
                seq.append((g << 40) | number)
                off.append(offset)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(seq, pa.int64()), pa.array(off, pa.int64())],
                [*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    return dealt.mapInArrow(trimmed(run), schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Every piece of ``docs`` with its place: encoded once, packed from the written lengths."""
    return pack_pieces(materialize(cut_pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity, open_bins)
