"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

The global order of n-grams is that of their 64-bit hashes. It is cut into fragments, each a
range of the order, and a document's set into one segment a fragment.

Candidates. Sizes fall into classes such that two sets within the threshold lie in the same or
neighbouring classes. Two such sets differ in at most H elements (H follows from the class), so
of H + s fragments at least s hold equal segments. A set therefore announces a digest of each
non-empty segment, for its class and the one below, with its need: s less its empty segments. A
set stays while at least that many of its digests have another holder, checked twice; so a
shared passage or a frequent n-gram makes no candidate, and no qualifying pair is missed. Sets
with s or more empty segments also announce their first elements in the global order (a
prefix filter) and need one holder, which settles pairs whose equal segments are all empty.
Sets sharing a digest are tied to the least of them (a star, not all pairs), and the connected
groups of stars are the units of counting.

Counting. A unit's sets are cut into blocks, bounded in documents and in elements, and every
pair of blocks is one task's run: it counts partial overlaps fragment by fragment, sums them
per pair, and tests ``100 * overlap >= percent * union`` exactly. Only a spanning forest of the
links and the number of links of each set leave the task.

Equal sets are one class from the start (128-bit set digest), so copies are never compared.

Defined results: a null or wordless text has an empty set, links with nothing and is its own
component (its doc_id, null if that is null). A null doc_id takes part, and the component is
named by the smallest non-null id. Rows repeating an id are separate documents. Ties do not
arise: components do not depend on order. Other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, materialize, mix64, own_names, passing, release, shingle_hashes, small_side, text_chunks, trimmed

BLOCK_DOCS = 512
BLOCK_ELEMENTS = 1 << 20
#: Shared elements counted at once; bounds the memory of one fragment's incidence matrix.
FRAGMENT_ELEMENTS = 4096
#: A candidate list of at most this many rows is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 500_000
_U = np.uint64


@lru_cache(maxsize=8)
def size_classes(percent: int, most: int = 1 << 34) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least size, fragments, spare fragments s) of every class of set sizes."""
    low, frag, spare = [1], [], []
    while low[-1] <= most:
        low.append(low[-1] * 100 // percent + 1)
        differ = (low[-1] - 1) * (100 - percent) // percent
        s = 2
        for _ in range(4):  # a quarter, and as many spare fragments as a set of the class usually leaves empty
            f = differ + s
            s = 2 + differ // 4 + int(round(1.5 * f * np.exp(-low[-2] / f)))
        frag.append(differ + s)
        spare.append(s)
    return np.array(low[:-1]), np.array(frag), np.array(spare)


#: Bits of a digest and of a set's number in an announcement. Clashing digests only add candidates.
#: Two linked sets of one number would look like one holder and lose their link unless others tie
#: their unit: one chance in 2**47 a linked pair.
DIGEST_BITS, NODE_BITS, NEED_BITS = 48, 47, 15


def segment_digests(hashes: np.ndarray, owner: np.ndarray, docs: int, percent: int) -> tuple[np.ndarray, ...]:
    """(digest, document, role, need) rows announced by sets given as sorted (document, hash) arrays."""
    low, frag, spare = size_classes(percent)
    n = np.bincount(owner, minlength=docs)
    first = np.cumsum(n) - n
    own = np.searchsorted(low, n, side="right") - 1
    value = mix64(hashes)
    out, docs_out, roles, needs = [], [], [], []
    for role in (0, 1):
        c = own - role
        live = (c >= 0) & (n > 0)
        take = live[owner]
        h, d, v = hashes[take], owner[take], value[take]
        if not len(h):
            continue
        at = ((h >> _U(32)) * frag[np.maximum(c, 0)][d].astype(np.uint64)) >> _U(32)
        fresh = np.ones(len(h), dtype=bool)
        fresh[1:] = (at[1:] != at[:-1]) | (d[1:] != d[:-1])
        begin = np.flatnonzero(fresh)
        total = np.add.reduceat(v, begin)
        tag = (c[d[begin]].astype(np.uint64) << _U(40)) + at[begin]
        empty = frag[np.maximum(c, 0)] - np.bincount(d[begin], minlength=docs)
        need = np.maximum(spare[np.maximum(c, 0)] - empty, 1)
        out.append(mix64(total + mix64(tag)))
        docs_out.append(d[begin])
        roles.append(np.full(len(begin), role))
        needs.append(need[d[begin]])
        sparse = np.flatnonzero(live & (empty >= spare[np.maximum(c, 0)]))
        if len(sparse):
            prefix = n[sparse] - -(-n[sparse] * percent // 100) + 1
            index = np.repeat(first[sparse] - (np.cumsum(prefix) - prefix), prefix) + np.arange(prefix.sum())
            tag = (c[owner[index]].astype(np.uint64) << _U(40)) + _U((1 << 40) - 1)
            out.append(mix64(hashes[index] ^ mix64(tag)))
            docs_out.append(owner[index])
            roles.append(np.full(len(index), role))
            needs.append(np.ones(len(index), dtype=np.int64))
    if not out:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(c) for c in (out, docs_out, roles, needs))


def set_digests(hashes: np.ndarray, owner: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, two 64-bit halves of a digest) of each set."""
    n = np.bincount(owner, minlength=docs)
    high, low = np.zeros(docs, dtype=np.uint64), np.zeros(docs, dtype=np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        begin = (np.cumsum(n) - n)[full]
        high[full] = mix64(np.add.reduceat(mix64(hashes ^ _U(0xA5A5A5A5A5A5A5A5)), begin) + n[full].astype(np.uint64))
        low[full] = mix64(np.add.reduceat(mix64(hashes + _U(0x1234567)), begin) ^ n[full].astype(np.uint64))
    return n, high, low


def document_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, node, fp): ``node`` is half of the set's digest ``fp``; null for an empty set."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at, data, offsets in text_chunks(batch.column(1)):
                rows = len(offsets) - 1
                n, high, low = set_digests(*shingle_hashes(data, offsets, words), rows)
                fp = [f"{a:016x}{b:016x}" if k else None for a, b, k in zip(high.tolist(), low.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, rows), pa.array(n.astype(np.int64)), pa.array(short_node(high), mask=n == 0), pa.array(fp, pa.string())],
                    ["doc_id", "n_shingles", "node", "fp"],
                )

    schema = T.StructType([docs.schema["doc_id"]]).add("n_shingles", "long").add("node", "long").add("fp", "string")
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), schema)


def announce(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(digest, key) rows of all sets; ``key`` packs node, role and need into one number.

    Equal sets that meet in one task announce once.
    """

    def run(batches):
        import pyarrow as pa

        seen: set[int] = set()
        for batch in batches:
            for _, data, offsets in text_chunks(batch.column(0)):
                hashes, owner = shingle_hashes(data, offsets, words)
                rows = len(offsets) - 1
                n, high, _ = set_digests(hashes, owner, rows)
                fresh = np.zeros(rows, dtype=bool)
                for i, h in enumerate(high.tolist()):
                    if n[i] and h not in seen:
                        seen.add(h)
                        fresh[i] = True
                if len(seen) > 1_000_000:  # only saves repeats
                    seen.clear()
                keep = fresh[owner]
                digest, d, role, need = segment_digests(hashes[keep], owner[keep], rows, percent)
                digest = (digest >> _U(64 - DIGEST_BITS)).astype(np.int64)
                need = np.minimum(need, (1 << NEED_BITS) - 1)
                key = (short_node(high[d]) << (NEED_BITS + 1)) | (role << NEED_BITS) | need
                for lo in range(0, len(digest), 1 << 18):
                    part = slice(lo, lo + (1 << 18))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(digest[part]), pa.array(key[part])], ["digest", "key"]
                    )

    return docs.select("text").mapInArrow(trimmed(run), "digest long, key long")


def short_node(high: np.ndarray) -> np.ndarray:
    return (high >> _U(64 - NODE_BITS)).astype(np.int64)


def candidate_units(announced: DataFrame) -> DataFrame:
    """(node, unit): groups of sets connected by shared digests; sets without a partner are left out."""
    node = F.shiftright("key", NEED_BITS + 1)
    need = F.col("key").bitwiseAND((1 << NEED_BITS) - 1)
    held = Window.partitionBy("digest")
    rows, before = announced, None
    for _ in range(2):
        shared = materialize(
            rows.withColumns({"node": node, "least": F.min(node).over(held), "most": F.max(node).over(held)})
            .where("least != most")
            .select("digest", "key", "least")
            .distinct(),
            "shared",
        )
        if before is not None:
            release(before)
        before = shared
        enough = shared.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= need).select("key")
        rows = shared.join(enough, "key", "left_semi").select("digest", "key")
    stars = rows.select(node.alias("src"), F.min(node).over(held).alias("dst")).where("src != dst").distinct()
    return connected_components(stars, "candidates").withColumnRenamed("component", "unit")


def count_blocks(units: DataFrame, docs: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """(src, dst, links) rows: links of a spanning forest (dst not null) and link counts per block."""
    one = sets.where("fp is not null").groupBy("fp", "node").agg(
        F.min(F.struct("doc_id", "n_shingles")).alias("one"), F.count("*").alias("copies")
    )
    wanted = materialize(
        one.join(units, "node").select("fp", "unit", "copies", F.col("one.doc_id").alias("doc_id"), F.col("one.n_shingles").alias("n")),
        "wanted",
    )
    plan = wanted.groupBy("unit").agg(F.count("*").alias("sets"), F.sum("n").alias("elements")).where("sets > 1").select(
        "unit",
        F.greatest(F.ceil(F.col("sets") / BLOCK_DOCS), F.ceil(F.col("elements") / BLOCK_ELEMENTS)).cast("int").alias("blocks"),
    )
    chosen = wanted.join(plan, "unit").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    chosen = materialize(chosen, "chosen")
    side = small_side(chosen, BROADCAST_ROWS)
    # null ids name no row; their sets are found by the null-safe test
    found = docs.select("doc_id", "text").join(side, docs["doc_id"].eqNullSafe(side["doc_id"])).select(
        "fp", "unit", "copies", "blocks", "block", "text"
    )

    def read_sets(batches):
        import pyarrow as pa

        for batch in batches:
            fps = batch.column(0).to_pylist()
            for at, data, offsets in text_chunks(batch.column(5)):
                rows = len(offsets) - 1
                hashes, owner = shingle_hashes(data, offsets, words)
                n, high, low = set_digests(hashes, owner, rows)
                ends = np.cumsum(n)
                keep, blobs = [], []
                for i in range(rows):
                    if n[i] and f"{int(high[i]):016x}{int(low[i]):016x}" == fps[at + i]:
                        keep.append(at + i)
                        blobs.append(hashes[ends[i] - n[i] : ends[i]].tobytes())
                if keep:
                    kept = batch.select(range(5)).take(pa.array(keep))
                    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(blobs, pa.binary())], [*kept.schema.names, "items"])

    with_sets = found.mapInArrow(trimmed(read_sets), "fp string, unit long, copies long, blocks int, block int, items binary")
    pairs = with_sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "unit", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "fp", "copies", "items"
    )
    keys = ["unit", "a", "b"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.repartition(parts, *keys).sortWithinPartitions(*keys, "fp")

    def run(batches):
        import pyarrow as pa

        def emit(rows):
            if rows:
                a, b, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.int64())], ["src", "dst", "links"])

        now, run_rows, out = None, [], []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(7)]
            for unit, a, b, block, fp, copies, items in zip(*columns, strict=True):
                if (unit, a, b) != now:
                    out += _links(now, run_rows, percent)
                    now, run_rows = (unit, a, b), []
                if not run_rows or run_rows[-1][1] != fp:  # rows that repeat an id and a text
                    run_rows.append((block, fp, copies, np.frombuffer(items, dtype=np.uint64)))
            if len(out) > 50_000:
                yield from emit(out)
                out = []
        yield from emit(out + _links(now, run_rows, percent))

    return dealt.mapInArrow(trimmed(run), "src string, dst string, links long")


def fragment_overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Overlap sizes of all pairs, counted fragment by fragment of the element order and summed."""
    both = left if right is None else left + right
    sizes = np.array([len(s) for s in both])
    items = np.concatenate(both)
    owner = np.repeat(np.arange(len(both)), sizes)
    order = np.argsort(items, kind="stable")
    items, owner = items[order], owner[order]
    fresh = np.ones(len(items), dtype=bool)
    fresh[1:] = items[1:] != items[:-1]
    number = np.cumsum(fresh) - 1
    shared = np.bincount(number)[number] > 1
    number, owner = number[shared], owner[shared]
    rows = len(left)
    total = np.zeros((rows, rows if right is None else len(right)), dtype=np.int32)
    if not len(number):
        return total
    number = np.cumsum(np.concatenate([[0], np.diff(number) != 0]).astype(np.int64))
    for lo in range(0, int(number[-1]) + 1, FRAGMENT_ELEMENTS):
        a, b = np.searchsorted(number, [lo, lo + FRAGMENT_ELEMENTS])
        width = int(number[b - 1]) - lo + 1
        grid = np.zeros((len(both), width), dtype=np.float32)
        grid[owner[a:b], number[a:b] - lo] = 1
        total += (grid[:rows] @ (grid[:rows] if right is None else grid[rows:]).T).astype(np.int32)
    return total


def _links(key, rows: list, percent: int) -> list[tuple[str, str | None, int]]:
    """Rows of one pair of blocks: a forest of its links, and each set's links to documents."""
    if key is None or len(rows) < 2:
        return []
    _, a, b = key
    left = [r for r in rows if r[0] == a]
    right = None if a == b else [r for r in rows if r[0] == b]
    if not left or (right is not None and not right):
        return []
    overlap = fragment_overlaps([r[3] for r in left], None if right is None else [r[3] for r in right])
    nx = np.array([len(r[3]) for r in left])
    ny = nx if right is None else np.array([len(r[3]) for r in right])
    linked = 100 * overlap.astype(np.int64) >= percent * (nx[:, None] + ny[None, :] - overlap)
    if right is None:
        np.fill_diagonal(linked, False)
    if not linked.any():
        return []
    nodes = left if right is None else left + right
    wx = np.array([r[2] for r in left])
    out = []
    if right is None:
        degree = linked @ wx
        adjacent = linked
    else:
        wy = np.array([r[2] for r in right])
        degree = np.concatenate([linked @ wy, linked.T @ wx])
        m = len(left)
        adjacent = np.zeros((len(nodes), len(nodes)), dtype=bool)
        adjacent[:m, m:], adjacent[m:, :m] = linked, linked.T
    out += [(nodes[i][1], None, int(degree[i])) for i in np.flatnonzero(degree)]
    seen = np.zeros(len(nodes), dtype=bool)
    for root in range(len(nodes)):
        if seen[root] or not adjacent[root].any():
            continue
        seen[root] = True
        front = np.array([root])
        while len(front):
            reach = adjacent[front].any(0) & ~seen
            front = np.flatnonzero(reach)
            seen[front] = True
            out += [(nodes[i][1], nodes[root][1], 0) for i in front]
    return out


def _judged(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, fp, component, component_id, n_links) for every row; ``component`` is null for an empty set."""
    sets = materialize(document_sets(docs, words), "sets")
    with passing(docs.sparkSession) as keep:
        units = keep(materialize(candidate_units(announce(docs, words, percent)), "units"))
    with passing(docs.sparkSession) as keep:
        links = keep(materialize(count_blocks(units, docs, sets, words, percent), "links"))
    release(units)
    parts = connected_components(links.where("dst is not null").select("src", "dst"), "linked")
    degrees = links.where("dst is null").groupBy("src").agg(F.sum("links").alias("others"))
    classes = (
        sets.where("fp is not null")
        .groupBy("fp")
        .agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"))
        .join(parts.withColumnRenamed("node", "fp"), "fp", "left")
        .withColumn("component", F.coalesce("component", "fp"))
        .join(degrees.withColumnRenamed("src", "fp"), "fp", "left")
    )
    named = classes.groupBy("component").agg(F.min("low").alias("component_id"))
    by_set = classes.join(named, "component").select(
        "fp", "component", "component_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    return sets.join(by_set, "fp", "left").select(
        "doc_id",
        "n_shingles",
        "fp",
        "component",
        F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row of ``docs`` (doc_id, text).

    ``n_links`` counts the other documents a document is linked with, copies included.
    """
    return _judged(docs, words, percent).select("doc_id", "n_shingles", "component_id", "n_links")


def _with_set(docs: DataFrame, words: int) -> DataFrame:
    """``docs`` with the digest ``_fp`` of each row's set."""
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lo, data, offsets in text_chunks(batch.column(at)):
                n, high, low = set_digests(*shingle_hashes(data, offsets, words), len(offsets) - 1)
                fp = [f"{a:016x}{b:016x}" if k else None for a, b, k in zip(high.tolist(), low.tolist(), n.tolist(), strict=True)]
                part = batch.slice(lo, len(fp))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fp, pa.string())], [*part.schema.names, "_fp"])

    return docs.mapInArrow(trimmed(run), T.StructType([*docs.schema.fields]).add("_fp", "string"))


@own_names
def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without near copies: of each component one row stays, that with the smallest doc_id.

    Null ids come last; of rows that repeat the id, or have none, the one with the smallest set
    digest stays, then that with the smallest text. Rows without a near copy stay, whatever their id.
    """
    with passing(docs.sparkSession) as keep:
        judged = keep(materialize(_judged(docs, words, percent), "judged"))
    linked = judged.where("n_links > 0")
    ids = (
        judged.where("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.count("*").alias("n"), F.max("n_links").alias("links"), F.max("component_id").alias("low"))
        .where("links > 0")
    )
    # an id of one row decides by itself
    go = ids.where("n = 1 and doc_id != low").select(F.col("doc_id").alias("_id"))
    again = materialize(ids.where("n > 1").select(F.col("doc_id").alias("_id")), "again")
    rows = docs.join(small_side(materialize(go, "go")), docs["doc_id"] == F.col("_id"), "left_anti")
    if again.isEmpty() and linked.where("doc_id is null").isEmpty():
        return rows
    # rows whose id repeats or is null are told apart by their sets
    again = small_side(again)
    plain = docs["doc_id"] == F.col("_id")
    look = _with_set(docs.where("doc_id is null").union(docs.join(again, plain, "left_semi")), words)
    first = (
        linked.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("component")
        .agg(F.min("fp").alias("_set"), F.first("doc_id").alias("_id"))
        .select("_set", "_id", F.lit(True).alias("_first"))
    )
    verdicts = (
        linked.where("doc_id is null")
        .select("doc_id", "fp")
        .union(linked.join(again, linked["doc_id"] == F.col("_id"), "left_semi").select("doc_id", "fp"))
        .distinct()
        .join(first, F.col("fp").eqNullSafe(F.col("_set")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
        .select(F.col("doc_id").alias("_of"), F.col("fp").alias("_set"), F.coalesce("_first", F.lit(False)).alias("_stays"))
    )
    side = small_side(materialize(verdicts, "verdicts"))
    met = look.join(side, (F.col("_fp") == F.col("_set")) & look["doc_id"].eqNullSafe(F.col("_of")), "left")
    whole = F.struct(*[F.col(c) for c in docs.columns])
    # combined before the shuffle, so very many copies meet no single task
    one = met.where("_stays").groupBy("_of", "_fp").agg(F.min_by(whole, F.coalesce("text", F.lit(""))).alias("_row")).select("_row.*")
    alone = rows.where("doc_id is not null").join(again, plain, "left_anti")
    return alone.union(met.where("_stays is null").select(docs.columns)).union(one)
