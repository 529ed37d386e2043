"""Benchmark passages in documents: Wu-Manber multi-pattern search whose symbols are words.

The patterns are the windows of the benchmark's items: every run of ``window`` consecutive words,
or all words of an item that has fewer. For each pattern length there is a table of shifts by the
hash of a block of words: how far the search may move on after it has seen that block at its place,
``length - block + 1`` where no pattern holds the block. Words that are jumped over are never
hashed. Where the shift is 0, patterns whose last and first blocks hash alike are the candidates,
and their bytes are compared with the text's, so hashes never decide.

The search is a map over the documents: nothing is shuffled, so copies and frequent passages weigh
no more than other texts. A task walks along many stretches of text at once. The tables are built
from parts of the benchmark of at most ``PART_BYTES`` of text and sent to the executors; a larger
benchmark is searched for part by part and the findings of a document are put together after.

Null, empty and wordless texts have no words and no hits. An item without words has no windows.
Rows of the benchmark that share an id are one item; those without an id hit words but are listed
nowhere. Repeated documents are rows of their own. No documents give no rows; an empty benchmark
leaves every document clean.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, text_chunks, trimmed

#: Benchmark text that one set of tables is built from, about; only one longer item makes a larger one.
PART_BYTES = 4 << 20
#: Words of a block, fewer for patterns that have fewer.
BLOCK = 2
#: Window ends that one of the stretches searched side by side has at most.
STRETCH = 128
#: Candidates that are compared at once.
AT_ONCE = 1 << 20

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
#: Bytes of words, once lower-cased: digits, letters and everything beyond ASCII.
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_U = np.uint64
_FILL = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_PAD = 8


class Words:
    """The words of several texts, lower-cased, each followed by one space, after one another.

    ``begin`` and ``end`` are places in ``flat``; text i has the words ``first[i]`` to ``first[i + 1] - 1``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        apart = _LOW[np.insert(data, offsets[1:], 0)]  # a byte that belongs to no word behind each text
        inside = _IN_WORD[apart]
        stop = np.zeros(len(apart), dtype=bool)
        stop[1:] = inside[:-1] & ~inside[1:]
        apart[stop] = 32
        kept = apart[inside | stop]
        self.flat = np.concatenate([np.full(_PAD, 32, dtype=np.uint8), kept, np.zeros(_PAD, dtype=np.uint8)])
        self.end = np.flatnonzero(kept == 32) + _PAD
        self.begin = np.empty_like(self.end)
        self.begin[:1], self.begin[1:] = _PAD, self.end[:-1] + 1
        behind = np.searchsorted(np.flatnonzero(stop), offsets[1:] + np.arange(len(offsets) - 1), side="right")
        self.first = np.concatenate([[0], behind]).astype(np.int64)
        # eight bytes from any place on
        self.eight = np.ndarray(len(self.flat) - 7, dtype="<u8", buffer=self.flat, strides=(1,))

    def symbol(self, w: np.ndarray) -> np.ndarray:
        """A number for each word: its length with its first and last eight bytes."""
        b, e = self.begin[w], self.end[w]
        size = e - b
        head = self.eight[b] & _FILL[np.minimum(size, 8)]
        tail = np.where(size > 8, self.eight[e - 8], head)
        with np.errstate(over="ignore"):
            return mix64(head * _U(0x9E3779B97F4A7C15) + mix64(tail + size.astype(np.uint64)))

    def block(self, last: np.ndarray, size: int) -> np.ndarray:
        """The hash of the ``size`` words that end with ``last``."""
        out = self.symbol(last)
        with np.errstate(over="ignore"):
            for back in range(1, size):
                out = mix64(out * _U(0xD6E8FEB86659FD93) + self.symbol(last - back))
        return out


def _pair_key(suffix: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(suffix * _U(0xA0761D6478BD642F) + prefix)


class Patterns:
    """The tables for all windows of one length, in words."""

    def __init__(self, words: Words, starts: np.ndarray, owner: np.ndarray, length: int) -> None:
        self.length, self.size = length, min(BLOCK, length)
        seen: dict[bytes, int] = {}
        number = np.empty(len(starts), dtype=np.int64)
        for k, (a, b) in enumerate(zip(words.begin[starts], words.end[starts + length - 1], strict=True)):
            number[k] = seen.setdefault(words.flat[a : b + 1].tobytes(), len(seen))
        _, one = np.unique(number, return_index=True)  # a window of each pattern
        at = starts[one]
        order = np.lexsort((owner, number))
        pairs = np.unique(np.stack([number[order], owner[order]]), axis=1)
        self.items = pairs[1]
        self.item_at = np.searchsorted(pairs[0], np.arange(len(seen) + 1))
        self.bits = int(np.clip(np.ceil(np.log2(8 * max(1, len(seen)))), 10, 24))
        self.shift = np.full(1 << self.bits, length - self.size + 1, dtype=np.uint8 if length < 256 else np.int32)
        for j in range(self.size - 1, length):  # later places allow smaller shifts and overwrite
            self.shift[self.cell(words.block(at + j, self.size))] = length - 1 - j
        keys = _pair_key(words.block(at + length - 1, self.size), words.block(at + self.size - 1, self.size))
        order = np.argsort(keys, kind="stable")
        self.keys, self.pattern = keys[order], order
        self.text = np.concatenate([np.frombuffer(b"".join(seen), dtype=np.uint8), np.zeros(_PAD, dtype=np.uint8)])
        sizes = np.array([len(x) for x in seen], dtype=np.int64)
        self.text_at = np.concatenate([[0], np.cumsum(sizes)])

    def cell(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> _U(64 - self.bits)).astype(np.int64)

    def occurrences(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of every occurrence that lies within one text."""
        n, first, stop = self.length, words.first[:-1], words.first[1:]
        some = stop - first >= n
        begin, last = first[some] + n - 1, stop[some] - 1
        pieces = (last - begin) // STRETCH + 1
        text = np.repeat(np.arange(len(begin)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = begin[text] + nth * STRETCH
        limit = np.minimum(at + STRETCH - 1, last[text])
        ends, hashes = [], []
        while len(at):
            h = words.block(at, self.size)
            step = self.shift[self.cell(h)].astype(np.int64)
            hit = step == 0
            if hit.any():
                ends.append(at[hit])
                hashes.append(h[hit])
                step[hit] = 1
            at = at + step
            going = at <= limit
            if not going.all():
                at, limit = at[going], limit[going]
        if not ends:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        start = np.concatenate(ends) - n + 1
        keys = _pair_key(np.concatenate(hashes), words.block(start + self.size - 1, self.size))
        low = np.searchsorted(self.keys, keys, side="left")
        count = np.searchsorted(self.keys, keys, side="right") - low
        start, low, count = start[count > 0], low[count > 0], count[count > 0]
        out = []
        whole = np.cumsum(count)
        i = 0
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(whole, (whole[i - 1] if i else 0) + AT_ONCE, side="right")))
            c = count[i:j]
            nth = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
            out.append(self._compared(words, np.repeat(start[i:j], c), self.pattern[np.repeat(low[i:j], c) + nth]))
            i = j
        if not out:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])

    def _compared(self, words: Words, start: np.ndarray, pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those whose bytes are the same."""
        there, here = words.begin[start], self.text_at[pattern]
        size = self.text_at[pattern + 1] - here
        same = words.end[start + self.length - 1] + 1 - there == size
        start, pattern, there, here, size = (x[same] for x in (start, pattern, there, here, size))
        ours = np.ndarray(len(self.text) - 7, dtype="<u8", buffer=self.text, strides=(1,))
        done = 0
        while len(start) and (size > done).any():
            left = np.clip(size - done, 0, 8)
            at = np.minimum(done, size)  # what has ended compares nothing
            same = ((words.eight[np.minimum(there + at, len(words.eight) - 1)] ^ ours[here + at]) & _FILL[left]) == 0
            same |= left == 0
            start, pattern, there, here, size = (x[same] for x in (start, pattern, there, here, size))
            done += 8
        return start, pattern


class Searcher:
    """All tables of a part of the benchmark, with the names of its items."""

    def __init__(self, items: list[tuple[str | None, str]], window: int) -> None:
        blobs = [(t or "").encode("utf-8", "replace") for _, t in items]
        names: dict[str | None, int] = {}
        item = np.array([names.setdefault(name, len(names)) for name, _ in items], dtype=np.int64)
        self.names = list(names)
        words = Words(np.frombuffer(b"".join(blobs), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in blobs])]).astype(np.int64))
        count = words.first[1:] - words.first[:-1]
        self.tables = []
        for length in sorted({int(x) for x in np.minimum(count, window)} - {0}):
            mine = np.flatnonzero(np.minimum(count, window) == length)
            windows = count[mine] - length + 1
            nth = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
            self.tables.append(Patterns(words, np.repeat(words.first[mine], windows) + nth, np.repeat(item[mine], windows), length))

    def search(self, words: Words) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """(which words are hit, (text, item) of each item in a text, as two arrays a table)."""
        edge = np.zeros(len(words.end) + 1, dtype=np.int64)
        found = []
        for table in self.tables:
            start, pattern = table.occurrences(words)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + table.length, -1)
            text = np.searchsorted(words.first, start, side="right") - 1
            pair = np.unique(text * len(table.item_at) + pattern)
            text, pattern = pair // len(table.item_at), pair % len(table.item_at)
            count = table.item_at[pattern + 1] - table.item_at[pattern]
            nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            found.append((np.repeat(text, count), table.items[np.repeat(table.item_at[pattern], count) + nth]))
        return np.cumsum(edge[:-1]) > 0, found

    def judged(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list, list, list, list]:
        """For each text: words, hit words, runs of hit words as (first, last), sorted names of its items."""
        words = Words(data, offsets)
        hit, found = self.search(words)
        texts = len(offsets) - 1
        n_words = words.first[1:] - words.first[:-1]
        place = np.flatnonzero(hit)
        text = np.searchsorted(words.first, place, side="right") - 1
        n_hit = np.bincount(text, minlength=texts)
        new = np.ones(len(place), dtype=bool)
        new[1:] = (place[1:] != place[:-1] + 1) | (text[1:] != text[:-1])
        head = np.flatnonzero(new)
        tail = np.concatenate([head[1:] - 1, [len(place) - 1]]) if len(head) else head
        spans: list[list] = [[] for _ in range(texts)]
        for t, a, b in zip(text[head].tolist(), (place[head] - words.first[text[head]]).tolist(), (place[tail] - words.first[text[head]]).tolist(), strict=True):
            spans[t].append({"first": a, "last": b})
        names: list[set] = [set() for _ in range(texts)]
        for owner, item in found:
            for t, i in zip(owner.tolist(), item.tolist(), strict=True):
                if self.names[i] is not None:
                    names[t].add(self.names[i])
        return n_words.tolist(), n_hit.tolist(), spans, [sorted(x) for x in names]


_FOUND = "n_words long, n_hit long, spans array<struct<first:long,last:long>>, items array<string>"


def _findings(docs: DataFrame, text: str, searcher: Searcher) -> DataFrame:
    """``docs`` without its text, with what one searcher finds; its columns are named c0, c1, ..., then ``text``."""
    import pyarrow as pa

    carry = docs.drop(text)
    schema = ", ".join([*(f"{c} {k}" for c, k in carry.dtypes), _FOUND])
    found_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for row, data, offsets in text_chunks(column):
                n_words, n_hit, spans, items = searcher.judged(data, offsets)
                rest = batch.slice(row, len(n_words))
                arrays = [rest.column(i) for i, c in enumerate(rest.schema.names) if c != text]
                arrays += [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, found_type), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*(c for c in rest.schema.names if c != text), "n_words", "n_hit", "spans", "items"])

    return docs.mapInArrow(trimmed(run), schema)


def _merged_spans(spans):
    """Sorted runs, joined where they overlap or meet."""
    ordered = F.array_sort(spans)
    add = lambda done, x: F.when(
        (F.size(done) > 0) & (x["first"] <= F.element_at(done, -1)["last"] + 1),
        F.concat(
            F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
            F.array(F.struct(F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["last"], x["last"]).alias("last"))),
        ),
    ).otherwise(F.concat(done, F.array(x)))
    empty = F.array().cast("array<struct<first:bigint,last:bigint>>")
    return F.aggregate(ordered, empty, add)


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` without its text, with n_words, n_hit, spans (runs of hit words, first and last from 0) and items (ids as text, sorted).

    Columns of ``docs`` that have one of these names give way to them.
    """
    keep = [c for c in docs.columns if c not in (text, "n_words", "n_hit", "spans", "items")]
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("_text"))
    tests = benchmark.select(F.col(item_id).cast("string").alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("body")).where(F.length("body") > 0)
    size = F.octet_length("body")
    # parts by running size over hash buckets: few numbers, however long the benchmark
    total = tests.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    parts = max(1, -(-2 * total // part_bytes)) if total > part_bytes else 1
    dealt = tests.withColumn("part", F.pmod(F.xxhash64("id", "body"), F.lit(parts)))
    searcher = lambda k: Searcher([(r.id, r.body) for r in (dealt.where(F.col("part") == k) if parts > 1 else dealt).select("id", "body").collect()], window)
    back = lambda df: df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "n_words", "n_hit", "spans", "items")
    if parts == 1:
        return back(_findings(plain, "_text", searcher(0)))
    # every row gets a number that stays the same, then each part's findings are put together by it
    numbered = materialize(plain.withColumn("_row", F.monotonically_increasing_id()), "leaks")
    found = None
    for k in range(parts):
        one = materialize(_findings(numbered.select("_row", "_text"), "_text", searcher(k)), "leaks-part")
        found = one if found is None else found.union(one)
    merged = found.groupBy("_row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    whole = merged.withColumn("spans", _merged_spans(F.col("all")))
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"] + 1)
    return back(numbered.drop("_text").join(whole.withColumn("n_hit", covered).drop("all"), "_row"))
