"""Repeated-substring removal by column-wise multi-document construction.

A byte goes if it lies in a string of ``length`` bytes that also starts elsewhere. With
``least_words`` a maximal run of such bytes goes only if it holds that many whole words.

Bringing repeats together. Every string of ``length`` bytes picks its anchor: the least-hashed
``GRAM``-byte string inside it, leftmost of equals. Equal strings pick equal anchors at equal
distance, so only strings of one anchor group need comparing; consecutive strings with the same
anchor form a segment, and anchors that occur once are dropped.

Construction. The segments of a group, aligned at the anchor, are the documents of a
collection. Columns are inserted from the right, one symbol per document and round. A round
re-sorts the collection stably by the inserted symbol, which turns the order of the suffixes
behind it into the order of the longer ones (the Burrows-Wheeler step), and updates the common
prefix of neighbours as one more than the least one between them in the old order. A string
repeats when a neighbour shares at least ``length`` symbols; one construction answers several
lengths, as segments reach as far as the longest. State is the order and the common prefixes, a
few bytes a document; the columns themselves are read one after another, from a sequential
external file once they pass ``FILE_BYTES``.

Hot groups. A group of more than ``GROUP_SEGMENTS`` segments is split, by the same rule for any
size: its string starts are cut into chunks of 16 (then of 1), all strings of a chunk hold the
same core of bytes, and the group falls apart by core. Equal pieces are one row with a count,
combined before the shuffle. The parts go through the same construction.

Inserting one symbol of whole documents each round, as the published construction does, takes as
many passes over the collection as its longest document has bytes; anchoring bounds the
rounds by twice the string length. See the README for figures.

Defined results: null text is empty; texts under ``length`` bytes lose nothing. Equal texts of
``length`` bytes or more lose everything, repeated rows included (they are separate documents).
Null ids pass through. An empty table gives no rows. ``strip_repeats`` keeps all columns, whatever
their names, and drops bytes of characters cut in two. Very long texts are handled in tiles.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Rolling, materialize, release, scratch, shuffles_dropped, text_chunks, trimmed

LENGTH = 400
#: A passage: 50 words, taken to be at least 200 bytes (three letters and a space a word).
PASSAGE_BYTES, PASSAGE_WORDS = 200, 50
GRAM = 50
GROUP_SEGMENTS = 20_000
#: Chunks of string starts that hot groups are cut into, one level after the other.
HOT_CHUNKS = (16, 1)
#: Column matrices above this go to a temporary file of the task's own, written and read in sequence.
FILE_BYTES = 32 << 20
BATCH_SEGMENTS = 4096
TILE = 4 << 20
_U = np.uint64
_LOW = (1 << 24) - 1


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, anchor position, first and last string start) of every segment."""
    parts = []
    for lo in range(0, max(len(data) - length + 1, 0), TILE):
        hi = min(lo + TILE + length - 1, len(data))
        piece = data[lo:hi]
        at = np.arange(len(piece) - gram + 1)
        hashes = Rolling(piece).ranges(at, at + gram)
        least = _sliding_least((hashes & ~_U(_LOW)) | at.astype(np.uint64), length - gram + 1)
        where = (least & _U(_LOW)).astype(np.int64)
        # strings that start and end in one text
        start = np.arange(len(where)) + lo
        text = np.searchsorted(offsets, start, side="right") - 1
        valid = start + length <= offsets[text + 1]
        fresh = valid.copy()
        fresh[1:] &= (where[1:] != where[:-1]) | ~valid[:-1]
        stops = valid.copy()
        stops[:-1] &= (where[1:] != where[:-1]) | ~valid[1:]
        a, b = np.flatnonzero(fresh), np.flatnonzero(stops)
        base = offsets[text[a]]
        parts.append((text[a], hashes[where[a]], where[a] + lo - base, a + lo - base, b + lo - base))
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def repeats(group: np.ndarray, lead: np.ndarray, last: np.ndarray, segments: list[bytes], lengths: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each of ``lengths``: (segment, first, last) runs of string starts that repeat within their group.

    ``group`` numbers are sorted. A segment's string starts run from ``lead`` to ``last``, counted
    from its anchor (so at most 0); its bytes begin at ``lead``.
    """
    rows = len(segments)
    sizes = np.fromiter(map(len, segments), dtype=np.int64, count=rows)
    left, right = int(lead.min()), int((lead + sizes).max())
    width, starts = right - left, int(last.max()) - left + 1
    at = lead - left
    path = None
    if rows * width > FILE_BYTES:
        handle, path = tempfile.mkstemp(prefix="columns-")
        os.close(handle)
        columns = np.memmap(path, dtype=np.uint8, mode="w+", shape=(width, rows))
    else:
        columns = np.zeros((width, rows), dtype=np.uint8)
    try:
        for lo in range(0, rows, 8192):
            hi = min(lo + 8192, rows)
            grid = np.zeros((hi - lo, width), dtype=np.uint8)
            flat = np.frombuffer(b"".join(segments[lo:hi]), dtype=np.uint8)
            inside = np.arange(width) - at[lo:hi, None]
            grid[(inside >= 0) & (inside < sizes[lo:hi, None])] = flat
            columns[:, lo:hi] = grid.T
        flags = _rounds(columns, group, at, sizes, last - left, starts, lengths)
    finally:
        del columns
        if path:
            os.unlink(path)
    out = []
    for found in flags:
        edge = np.zeros((rows, starts + 2), dtype=np.int8)
        edge[:, 1:-1] = found
        step = np.diff(edge, axis=1)
        who, first = np.nonzero(step == 1)
        _, stop = np.nonzero(step == -1)
        out.append((who, first + left, stop - 1 + left))
    return out


def _rounds(columns: np.ndarray, group: np.ndarray, at: np.ndarray, sizes: np.ndarray, last: np.ndarray, starts: int, lengths: tuple[int, ...]) -> np.ndarray:
    """Insert all columns from the right; which string starts (length by segment by column) repeat."""
    width, rows = columns.shape
    flags = np.zeros((len(lengths), rows, starts), dtype=bool)
    order = np.arange(rows)
    common = np.zeros(rows + 1, dtype=np.int32)  # with the neighbour before; the end is a stop
    base = group.astype(np.int64) * 257
    stop = at + sizes
    for c in range(width - 1, -1, -1):
        held = (c >= at) & (c < stop)
        symbol = np.where(held, columns[c], 256) + base
        key = symbol[order]
        if (key[1:] >= key[:-1]).all():
            perm = np.arange(rows)
        else:
            perm = np.argsort(key, kind="stable")
        key, order = key[perm], order[perm]
        same = np.flatnonzero((key[1:] == key[:-1]) & held[order[1:]]) + 1
        new = np.zeros(rows + 1, dtype=np.int32)
        before, now = perm[same - 1], perm[same]
        near = now == before + 1
        new[same[near]] = common[now[near]] + 1
        far = ~near
        if far.any():
            cuts = np.stack([before[far] + 1, now[far] + 1], 1).ravel()
            new[same[far]] = np.minimum.reduceat(common, cuts)[::2] + 1
        common = new
        if c < starts:
            best = np.maximum(common[:-1], common[1:])
            for k, length in enumerate(lengths):
                hit = order[best >= length]
                hit = hit[(at[hit] <= c) & (c <= last[hit])]
                flags[k, hit, c] = True
    return flags


def _pieces(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(fp, anchor, place, first, last) of every segment of ``texts`` (fp, data)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row, data, offsets in text_chunks(batch.column(1)):
                text, anchor, place, first, last = anchors(data, offsets, length, gram)
                if len(text):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(text + row)), pa.array(anchor.view(np.int64)), pa.array(place), pa.array(first), pa.array(last)],
                        ["fp", "anchor", "place", "first", "last"],
                    )

    return texts.select("fp", "data").mapInArrow(trimmed(run), "fp binary, anchor long, place long, first long, last long")


def _repeated_runs(segments: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(fp, l, a, b): byte ranges of repeated strings of l bytes, from segments sorted by anchor.

    ``lead`` and ``end`` are the first and last string start counted from ``place``.
    """

    def run(batches):
        import pyarrow as pa

        def solve(rows):
            anchor = [r[0] for r in rows]
            group = np.cumsum([0, *(x != y for x, y in zip(anchor[1:], anchor, strict=False))])
            place, lead, end = (np.array([r[i] for r in rows], dtype=np.int64) for i in (2, 3, 4))
            found = repeats(group, lead, end, [r[5] for r in rows], lengths)
            for length, (who, a, b) in zip(lengths, found, strict=True):
                if len(who):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([rows[i][1] for i in who], pa.binary()), pa.array(np.full(len(who), length, dtype=np.int32)), pa.array(a + place[who]), pa.array(b + place[who] + length)],
                        ["fp", "l", "a", "b"],
                    )

        done, now = [], []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if now and now[-1][0] != row[0]:
                    if len(now) > 1:
                        if done and len(done) + len(now) > BATCH_SEGMENTS:
                            yield from solve(done)
                            done = []
                        done += now
                    now = []
                now.append(row)
        if len(now) > 1:
            done += now
        if done:
            yield from solve(done)

    return segments.select("anchor", "fp", "place", "lead", "end", "piece").mapInArrow(trimmed(run), "fp binary, l int, a long, b long")


def _hot_runs(segments: DataFrame, length: int, bound: int, parts: int) -> tuple[DataFrame, list[DataFrame]]:
    """The same for hot groups, which are cut by cores; and the written tables that the result reads."""
    written, runs = [], None
    open_ = segments.select(F.col("anchor").cast("string").cast("binary").alias("anchor"), "fp", "place", "lead", "end", "piece")
    for width in HOT_CHUNKS:
        # string starts of one chunk share the bytes from its last start to where its first string ends
        chunk = F.floor(F.col("lead") / width)
        starts = open_.withColumn("chunk", F.explode(F.sequence(chunk, F.floor(F.col("end") / width)))).withColumn("low", F.col("chunk") * width)
        lead, end = F.greatest("low", "lead"), F.least(F.col("low") + width - 1, F.col("end"))
        cut = starts.select("anchor", "fp", "place", "chunk", lead.alias("lead"), end.alias("end"), F.col("lead").alias("was"), "low", "piece").select(
            "anchor", "fp", "place", "chunk", "lead", "end",
            F.expr(f"substring(piece, cast(low + {width - 1} - was as int) + 1, {length - width + 1})").alias("core"),
            F.expr(f"substring(piece, cast(lead - was as int) + 1, cast(end - lead as int) + {length})").alias("piece"),
        )
        keyed = cut.withColumn("anchor", F.unhex(F.md5(F.concat("anchor", F.encode(F.concat_ws("/", "chunk", F.hex("core")), "utf-8")))))
        keyed = keyed.drop("core").withColumn("id", F.unhex(F.md5(F.concat("anchor", F.encode(F.concat_ws("/", "lead", "end"), "utf-8"), "piece"))))
        keyed = materialize(keyed, "hot-chunks")
        once = materialize(
            keyed.groupBy("id").agg(F.count("*").alias("copies"), *[F.any_value(c).alias(c) for c in ("anchor", "lead", "end", "piece")]), "hot-pieces"
        )
        written += [keyed, once]
        sizes = materialize(once.groupBy("anchor").agg(F.count("*").alias("n")), "hot-sizes")
        written.append(sizes)
        sized = once.join(sizes, "anchor")
        if width > 1:
            ready = sized.where(F.col("n") <= bound)
        else:
            ready = sized  # strings of one start and core are equal: one row each
        several = once.where("copies > 1").select("id", F.col("lead").alias("a"), (F.col("end") + length).alias("b"))
        alone = ready.select("anchor", F.col("id").alias("fp"), F.lit(0).cast("long").alias("place"), "lead", "end", "piece")
        found = _repeated_runs(alone.repartition(parts, "anchor").sortWithinPartitions("anchor", "fp"), (length,)).select(F.col("fp").alias("id"), "a", "b")
        here = keyed.join(found.union(several), "id").select("fp", F.lit(length).alias("l"), (F.col("a") + F.col("place")).alias("a"), (F.col("b") + F.col("place")).alias("b"))
        runs = here if runs is None else runs.union(here)
        if width > 1:
            rest = sizes.where(F.col("n") > bound).select("anchor")
            open_ = keyed.join(rest, "anchor", "left_semi").select("anchor", "fp", "place", "lead", "end", "piece")
            if rest.isEmpty():
                break
    return runs, written


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _merged(spans: list[tuple[int, int]], data: bytes, least_words: int) -> list[tuple[int, int]]:
    """The union of sorted ``spans``, less what holds fewer than ``least_words`` whole words."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return [(a, b) for a, b in out if _whole_words(data, a, b) >= least_words] if least_words else out


def _whole_words(data: bytes, a: int, b: int) -> int:
    piece = data[a:b]
    n = len(piece.split())
    if n and a and not data[a - 1 : a].isspace() and not piece[:1].isspace():
        n -= 1
    if n and b < len(data) and not data[b : b + 1].isspace() and not piece[-1:].isspace():
        n -= 1
    return n


def repeated_spans(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, least_words: int = 0, passage: tuple[int, int] | None = None, group_segments: int = GROUP_SEGMENTS
) -> DataFrame:
    """One row for each distinct text of ``docs`` (text): what is removed, written to the shared folder.

    Columns: fp, n_bytes, n_removed, n_spans, kept_sha256, n_passages, n_passage_bytes, cuts. The
    passage columns tell the runs that ``passage`` (bytes, words) gives in place of (length,
    least_words); without it they repeat those. Working tables are dropped before it returns.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    passage = passage or (length, least_words)
    lengths = tuple(sorted({length, passage[0]}))
    short, far = lengths[0], lengths[-1]
    gram = min(gram, short)
    written: list[DataFrame] = []

    def keep(df: DataFrame, tag: str) -> DataFrame:
        written.append(materialize(df, tag))
        return written[-1]

    with scratch(spark, "texts") as name:
        # distinct texts, bucketed by digest once, so the later joins do not move them again
        distinct = (
            docs.select(text_key(F.col("text")).alias("fp"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
            .groupBy("fp")
            .agg(F.any_value("data").alias("data"), F.count("*").alias("copies"))
        )
        with shuffles_dropped(spark):
            distinct.write.bucketBy(parts, "fp").sortBy("fp").saveAsTable(name)
        texts = spark.table(name)
        pieces = keep(_pieces(texts.where(F.length("data") >= short), short, gram), "anchors")
        # written first, so that both sides of the join are plain exchanges and a hot anchor's rows can be split
        often = keep(pieces.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "anchor-counts")
        sized = keep(pieces.join(often, "anchor"), "repeated-anchors")
        release(pieces)
        release(often)
        cut = F.expr(f"substring(data, cast(first as int) + 1, cast(last - first as int) + {far})")
        segments = sized.join(texts.select("fp", "data"), "fp").select(
            "anchor", "fp", "place", (F.col("first") - F.col("place")).alias("lead"), (F.col("last") - F.col("place")).alias("end"), "n", cut.alias("piece")
        )
        runs = _repeated_runs(
            segments.where(F.col("n") <= group_segments).repartition(parts, "anchor").sortWithinPartitions("anchor", "fp", "place", "lead"), lengths
        )
        if not sized.where(F.col("n") > group_segments).isEmpty():
            hot = keep(segments.where(F.col("n") > group_segments), "hot-segments")
            for one in lengths:
                fits = F.least(F.col("end"), F.col("lead") + F.length("piece") - one)  # strings of a longer length may not fit
                more, tables = _hot_runs(hot.withColumn("end", fits).where("end >= lead"), one, group_segments, parts)
                written += tables
                runs = runs.union(more)
        runs = keep(runs, "runs")
        for df in written:
            if df is not runs:
                release(df)
        spans = runs.groupBy("fp").agg(F.sort_array(F.collect_list(F.struct("l", "a", "b"))).alias("spans"))
        judged = texts.select("fp", "data", "copies").join(spans, "fp", "left").select("fp", "data", "copies", "spans")
        out = materialize(_judged(judged, length, least_words, passage), "repeats")
    release(runs)
    return out


def _judged(rows: DataFrame, length: int, least_words: int, passage: tuple[int, int]) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        pairs = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pairs]
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                out = []
                for fp, data, copies, spans in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):

                    def found(size, words, data=data, copies=copies, spans=spans):
                        if copies > 1 and len(data) >= size:
                            return _merged([(0, len(data))], data, words)
                        return _merged([(s["a"], s["b"]) for s in spans or [] if s["l"] == size], data, words)

                    cuts, told = found(length, least_words), found(*passage)
                    kept, at = [], 0
                    for a, b in cuts:
                        kept.append(data[at:a])
                        at = b
                    rest = b"".join([*kept, data[at:]])
                    out.append((fp, len(data), len(data) - len(rest), len(cuts), hashlib.sha256(rest).hexdigest(), len(told), sum(b - a for a, b in told), [{"a": a, "b": b} for a, b in cuts]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    names = ["fp", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_bytes", "cuts"]
    return rows.mapInArrow(
        trimmed(run),
        "fp binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_bytes long, cuts array<struct<a: bigint, b: bigint>>",
    )


def judge_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, passage: tuple[int, int] | None = (PASSAGE_BYTES, PASSAGE_WORDS)) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, n_passage_bytes) for every row of ``docs`` (doc_id, text).

    The passage columns count the runs of at least ``passage`` (bytes, words) that repeat.
    """
    found = repeated_spans(docs, length, gram, passage=passage)
    keys = docs.select("doc_id", text_key(F.col("text")).alias("fp"))
    return keys.join(found, "fp").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_bytes")


def strip_repeats(docs: DataFrame, length: int = PASSAGE_BYTES, gram: int = GRAM, least_words: int = PASSAGE_WORDS) -> DataFrame:
    """Every row of ``docs`` with its repeated passages taken out of ``text`` (and ``n_chars`` renewed).

    Every passage of ``least_words`` words and ``length`` bytes that repeats goes, wherever it stands.
    """
    found = repeated_spans(docs, length, gram, least_words).where("n_removed > 0").select("fp", "cuts")
    # columns go by place, so none of the input's names can clash with those of the join
    names = [f"c{i}" for i in range(len(docs.columns))]
    text_at, size_at = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    joined = docs.toDF(*names).withColumn("fp", text_key(F.col(names[text_at]))).join(found, "fp", "left").select(*names, "cuts")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            cuts = batch.column(len(names)).to_pylist()
            columns = list(batch.columns[:-1])
            if any(cuts):
                texts = columns[text_at].to_pylist()
                sizes = columns[size_at].to_pylist() if size_at is not None else []
                for i, gone in enumerate(cuts):
                    if gone:
                        data, at, kept = texts[i].encode(), 0, []
                        for x in gone:
                            kept.append(data[at : x["a"]])
                            at = x["b"]
                        texts[i] = b"".join([*kept, data[at:]]).decode("utf-8", "ignore")
                        if size_at is not None:
                            sizes[i] = len(texts[i])
                columns[text_at] = pa.array(texts, columns[text_at].type)
                if size_at is not None:
                    columns[size_at] = pa.array(sizes, columns[size_at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    out = joined.mapInArrow(trimmed(run), T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema, strict=True)]))
    return out.toDF(*docs.columns)
