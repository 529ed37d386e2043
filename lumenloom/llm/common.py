"""Shared pieces of the training-data operators: shared storage, word patterns, numpy hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, passing, release, release_all, shared_dir, shared_path, shuffles_dropped  # noqa: F401  (shared with the rest of the library)
from ..session import _delete as release_path  # noqa: F401

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


@contextmanager
def scratch(spark: SparkSession, tag: str) -> Iterator[str]:
    """The name of a warehouse table that is dropped at the end, or on a failure."""
    name = f"lumenloom_{tag}_{uuid.uuid4().hex}"
    try:
        yield name
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def trimmed(run):
    """``run`` over Arrow batches, giving freed memory back to the system when a task ends.

    Workers outlive their tasks, so what the allocators keep would count against the next stage.
    """

    @wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return task


def own_names(run):
    """For operators that return the columns of their first argument: no other column's name can clash inside."""

    @wraps(run)
    def call(docs: DataFrame, *args, **kwargs) -> DataFrame:
        names = docs.columns
        plain = [c if c in ("doc_id", "text", "source", "n_chars") else f"extra{i}" for i, c in enumerate(names)]
        return run(docs.toDF(*plain), *args, **kwargs).toDF(*names)

    return call


def small_side(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """``df`` marked for broadcast if a count shows at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def connected_components(edges: DataFrame, tag: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst); a component is its smallest node.

    Alternating large-star and small-star contraction. Every step is a partial aggregation
    plus an equi-join, so a hub with very many neighbours is combined before the shuffle and
    its join partition can be split. Each round is written to the shared folder. Self links
    and null ends are ignored; no edges give no rows. Raises if it has not settled after
    ``max_rounds``, which needs a path longer than 2**max_rounds.
    """
    src, dst = F.col("src"), F.col("dst")
    now = materialize(
        edges.where(src.isNotNull() & dst.isNotNull() & (src != dst))
        .select(F.greatest(src, dst).alias("src"), F.least(src, dst).alias("dst"))
        .distinct(),
        tag,
    )
    digest = lambda df: tuple(
        df.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst"))).first()
    )
    seen = digest(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.union(now.select("dst", "src"))
        low = both.groupBy("src").agg(F.min("dst").alias("m")).select(
            F.col("src").alias("u"), F.least("m", "src").alias("m")
        )
        large = (
            both.join(low, both.src == low.u)
            .where((F.col("dst") > F.col("u")) & (F.col("dst") != F.col("m")))
            .select(F.col("dst").alias("src"), F.col("m").alias("dst"))
            .distinct()
        )
        # every edge now points from the larger end to the smaller one
        root = large.groupBy("src").agg(F.min("dst").alias("m")).withColumnRenamed("src", "u")
        small = (
            large.join(root, large.src == root.u)
            .where(F.col("dst") != F.col("m"))
            .select(F.col("dst").alias("src"), F.col("m").alias("dst"))
            .union(root.select(F.col("u").alias("src"), F.col("m").alias("dst")))
            .distinct()
        )
        old, now = now, materialize(small, tag)
        release(old)
        last, seen = seen, digest(now)
        if seen == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    named = now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    roots = now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return named.union(roots)


# ---------------------------------------------------------------------------------------
# numpy: words and rolling hashes over the concatenated UTF-8 bytes of many texts

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Odd multiplier of the rolling hashes and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64, element by element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, _U(base), dtype=np.uint64)
    out[:1] = 1
    np.multiply.accumulate(out, out=out)
    return out


class Rolling:
    """Hashes of byte ranges: hash of ``data[a:b]`` from prefix sums, equal for equal bytes."""

    _up = powers(_BASE, 1)
    _down = powers(_INVERSE, 1)

    def __init__(self, data: np.ndarray) -> None:
        n = len(data) + 1
        if len(Rolling._up) < n:
            Rolling._up, Rolling._down = powers(_BASE, n), powers(_INVERSE, n)
        self.sums = np.zeros(n, dtype=np.uint64)
        np.cumsum(_BYTE[data] * Rolling._up[: n - 1], out=self.sums[1:])

    def ranges(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64((self.sums[b] - self.sums[a]) * Rolling._down[a] + (b - a).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word with A-Z lower-cased, number of the text it is in).

    ``data`` holds the texts one after another, text i at ``offsets[i]:offsets[i + 1]``.
    """
    space = _SPACE[data]
    first = np.ones(len(data), dtype=bool)
    first[1:] = space[:-1]
    starts = offsets[:-1]
    first[starts[starts < len(data)]] = True
    begin = np.flatnonzero(first & ~space)
    last = np.ones(len(data), dtype=bool)
    last[:-1] = space[1:]
    ends = offsets[1:]
    last[ends[ends > 0] - 1] = True
    end = np.flatnonzero(last & ~space) + 1
    return Rolling(_LOWER[data]).ranges(begin, end), np.searchsorted(offsets, begin, side="right") - 1


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingle hashes of each text, sorted by (text, hash), and their texts.

    A text of fewer than n words gives its whole sequence as one shingle; none without words.
    """
    words, doc = word_hashes(data, offsets)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.zeros(len(count) + 1, dtype=np.int64)
    np.cumsum(count, out=first[1:])
    out = np.zeros(max(len(words) - n + 1, 0), dtype=np.uint64)
    for i in range(n):
        out = mix64(out * _U(_BASE) + words[i : i + len(out)]) if len(out) else out
    at = np.arange(len(out))
    whole = doc[: len(out)] == doc[n - 1 :] if len(out) else np.zeros(0, dtype=bool)
    hashes, owner = out[whole], doc[at[whole]]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.array(
            [int(mix64(_fold(words[first[d] : first[d + 1]]))) for d in short], dtype=np.uint64
        )
        hashes, owner = np.concatenate([hashes, extra]), np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        fresh = np.ones(len(hashes), dtype=bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[fresh], owner[fresh]
    return hashes, owner


def _fold(words: np.ndarray) -> np.uint64:
    value = _U(len(words))
    with np.errstate(over="ignore"):
        for w in words:
            value = mix64(np.array([value * _U(_BASE) + w], dtype=np.uint64))[0]
    return value


def text_chunks(column, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Split an Arrow string or binary column into (first row, bytes, offsets) of about ``most`` bytes.

    Nulls count as empty. A longer text is a chunk of its own.
    """
    import pyarrow as pa

    for piece in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        base = 0
        piece = piece.fill_null("" if pa.types.is_string(piece.type) or pa.types.is_large_string(piece.type) else b"")
        big = pa.types.is_large_string(piece.type) or pa.types.is_large_binary(piece.type)
        _, where, blob = piece.buffers()
        offsets = np.frombuffer(where, dtype=np.int64 if big else np.int32)[piece.offset : piece.offset + len(piece) + 1].astype(np.int64)
        data = np.frombuffer(blob, dtype=np.uint8) if blob is not None else np.zeros(0, dtype=np.uint8)
        row = 0
        while row < len(piece):
            stop = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
            stop = min(max(stop, row + 1), len(piece))
            yield base + row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
            row = stop
        base += len(piece)
