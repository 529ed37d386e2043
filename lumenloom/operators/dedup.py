"""Exact and near-duplicate detection by portable MinHash and banding.

Documents without words have no signature, so they are only ever exact duplicates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as hs
from ..functions import text as tx
from ..session import cut_lineage, release, small_side


def first_seen(docs: DataFrame, full: bool = False) -> DataFrame:
    """(doc_id, key, duplicate): later arrivals of a normal form already seen.

    ``full`` also decomposes, drops combining marks and folds case, at the cost of an Arrow UDF.
    """
    form = tx.strip_marks if full else tx.normal_form
    keyed = docs.select("doc_id", F.sha2(form(F.coalesce("text", F.lit(""))), 256).alias("key"))
    # the first arrival comes from a combined minimum, so a key held by very many rows meets no single task
    first = keyed.groupBy("key").agg(F.min("doc_id").alias("first"))
    return keyed.join(first, "key").select("doc_id", "key", (F.col("doc_id") != F.col("first")).alias("duplicate"))


def signatures(docs: DataFrame, count: int = 64, n: int = 13) -> DataFrame:
    """(doc_id, signature): the least value of each permutation over the document's shingles.

    Made within the row, so nothing is shuffled and rows that share an id or have none keep their
    own. The minima of many rows are taken at once over an Arrow batch.
    """
    import numpy as np
    import pyarrow as pa

    hashes = tx.let(tx.words(F.col("text")), lambda w: F.transform(tx.shingles(w, n), lambda s: F.md5(s)))
    family = [(np.uint64(a), np.uint64(b)) for a, b in hs.permutations(count)]
    prime = np.uint64(hs.PRIME)

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            digests = lists.flatten()
            if not len(digests):
                continue
            # eight digits of each digest, read as a number
            text = np.frombuffer(digests.buffers()[2], dtype=np.uint8)
            begin = np.frombuffer(digests.buffers()[1], dtype=np.int32)[digests.offset : digests.offset + len(digests)]
            x = np.zeros(len(digests), dtype=np.uint64)
            for k in range(8):
                digit = text[begin + k].astype(np.uint64)
                x = (x << np.uint64(4)) | np.where(digit >= 97, digit - np.uint64(87), digit - np.uint64(48))
            x %= prime
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            some = np.flatnonzero(sizes > 0)
            at = (np.cumsum(sizes) - sizes)[some]
            least = np.stack([np.minimum.reduceat((x * a + b) % prime, at) for a, b in family], axis=1).astype(np.int64)
            offsets = pa.array(np.arange(0, least.size + 1, count, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.ListArray.from_arrays(offsets, pa.array(least.ravel()))], names=["doc_id", "signature"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", hashes.alias("h")).mapInArrow(run, f"doc_id {kind}, signature array<bigint>")


def signature_classes(sigs: DataFrame) -> DataFrame:
    """(signature, rep, members): documents of equal signature, named by the first."""
    return sigs.groupBy("signature").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members"))


def candidate_pairs(sigs: DataFrame, rows: int = 4) -> DataFrame:
    """(doc_a, doc_b, agreement) of class representatives that share a band.

    Documents of equal signature meet in ``signature_classes`` only, so a group of copies costs
    its size and not its square. This lists what a band proposes, so a band that very many
    different signatures share gives all its pairs; decisions use ``near_groups``, which does not.
    """
    sigs = signature_classes(sigs).select(F.col("rep").alias("doc_id"), "signature")
    size = F.size("signature")
    # only ids meet in the bands; signatures are fetched for the distinct pairs
    bands = sigs.select(
        "doc_id",
        F.posexplode(
            F.transform(F.sequence(F.lit(0), (size / rows).cast("int") - 1), lambda b: F.array_join(F.slice("signature", b * rows + 1, rows), "|"))
        ).alias("band", "key"),
    )
    left, right = bands.alias("l"), bands.alias("r")
    pairs = (
        left.join(right, (F.col("l.band") == F.col("r.band")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.doc_id") < F.col("r.doc_id")))
        .select(F.col("l.doc_id").alias("doc_a"), F.col("r.doc_id").alias("doc_b"))
        .distinct()
    )
    named = lambda x, y: sigs.select(F.col("doc_id").alias(x), F.col("signature").alias(y))
    equal = F.size(F.filter(F.zip_with("a", "b", lambda x, y: x == y), lambda x: x))
    return pairs.join(named("doc_a", "a"), "doc_a").join(named("doc_b", "b"), "doc_b").select("doc_a", "doc_b", (equal / F.size("a")).alias("agreement"))


#: Members up to which all pairs of a band are compared; larger bands are refined first.
HOT_BAND = 1000
#: Refinements before what is still hot is compared around its first member.
REFINEMENTS = 2


def _positions(count: int, rows: int) -> list[list[int]]:
    return [list(range(b * rows, (b + 1) * rows)) for b in range(count // rows)]


def _refined(hot: DataFrame, sigs: DataFrame, count: int, parts: int) -> DataFrame:
    """(key, used, doc_id) of the members of ``hot`` by each of ``parts`` segments of the positions they may differ in.

    Two signatures that differ in fewer than ``parts`` positions agree in a whole segment.
    """
    free = F.filter(F.sequence(F.lit(0), F.lit(count - 1)), lambda p: ~F.array_contains("used", p))
    rows = hot.join(sigs, "doc_id").withColumn("free", free)
    size = F.size("free")
    # segment s holds free[floor(s n / parts)] up to free[floor((s + 1) n / parts)]
    cut = lambda s: F.floor(s * size / parts).cast("int")
    segments = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda s: F.slice("free", cut(s) + 1, cut(s + 1) - cut(s)))
    each = rows.select("key", "used", "doc_id", "signature", F.posexplode(segments).alias("s", "segment"))
    values = F.transform("segment", lambda p: F.get("signature", p))
    return each.select(F.xxhash64("key", "s", values).alias("key"), F.concat("used", "segment").alias("used"), "doc_id")


def _agreeing(pairs: DataFrame, sigs: DataFrame, least_equal: int) -> DataFrame:
    """(group, doc_id), two rows for each of the distinct ``pairs`` that agree in enough positions."""
    side = lambda x: sigs.select(F.col("doc_id").alias(x), F.col("signature").alias(f"s_{x}"))
    found = pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(_equal("s_a", "s_b") >= least_equal)
    return found.select(F.xxhash64("a", "b", F.lit("pair")).alias("group"), F.explode(F.array("a", "b")).alias("doc_id"))


def _equal(x: str, y: str) -> Column:
    return F.size(F.filter(F.zip_with(x, y, lambda a, b: a == b), lambda e: e))


def _around_first(hot: DataFrame, sigs: DataFrame, count: int, least_equal: int, at_once: int) -> DataFrame:
    """(group, doc_id) for groups that stay large: real clusters of different signatures.

    Members within half the allowed distance of the group's first agree with one another, so they
    are one set. Only members further away are compared with all, dealt by salt to bounded tasks.
    """
    members = cut_lineage(hot.select("key", "doc_id").distinct().join(sigs, "doc_id"))
    first = members.groupBy("key").agg(F.min_by(F.struct("doc_id", "signature"), "doc_id").alias("f")).select("key", F.col("f.signature").alias("s_first"))
    near = count - (count - least_equal) // 2
    judged = cut_lineage(members.join(small_side(first, row_bytes=count * 16), "key").select("key", "doc_id", "signature", (_equal("signature", "s_first") >= near).alias("ball")))
    ball = judged.where("ball").select(F.xxhash64("key", F.lit("ball")).alias("group"), "doc_id")
    out = judged.where("not ball")
    sizes = out.groupBy("key").agg(F.ceil(F.count("*") / at_once).cast("int").alias("salts"))
    left = out.join(small_side(sizes), "key").select("key", F.pmod(F.xxhash64("doc_id"), "salts").alias("salt"), F.col("doc_id").alias("x"), F.col("signature").alias("s_x"))
    right = judged.join(small_side(sizes), "key").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1)).alias("salt"), F.col("doc_id").alias("y"), F.col("signature").alias("s_y"))
    pairs = left.join(right, ["key", "salt"]).where((F.col("x") != F.col("y")) & (_equal("s_x", "s_y") >= least_equal))
    a, b = F.least("x", "y"), F.greatest("x", "y")
    links = pairs.select(a.alias("a"), b.alias("b")).distinct().select(F.xxhash64("a", "b", F.lit("pair")).alias("group"), F.explode(F.array("a", "b")).alias("doc_id"))
    return ball.union(links)


def near_groups(sigs: DataFrame, least: float = 0.8, rows: int = 4, hot: int = HOT_BAND) -> DataFrame:
    """(group, doc_id): sets of class representatives that share a band and agree at least ``least`` with one another.

    Every such pair is within a set, most sets are pairs. A band of up to ``hot`` members has all
    its pairs compared. In a larger one, two that agree enough also agree in one of the segments
    that the other positions are cut into, so it falls apart by segment at a cost linear in its
    size; what is a true cluster even so is told around its first member. No pair is lost, and no
    band is compared pair by pair because it is merely frequent.
    """
    reps = cut_lineage(signature_classes(sigs).select(F.col("rep").alias("doc_id"), "signature"))
    some = reps.select(F.size("signature").alias("n")).first()
    if some is None:
        return reps.select(F.lit(0).cast("long").alias("group"), "doc_id")
    count = some.n
    least_equal = math.ceil(round(least * count, 9))
    bands = F.array(*[F.struct(F.lit(b).alias("band"), F.array(*[F.lit(p) for p in used]).alias("used")) for b, used in enumerate(_positions(count, rows))])
    values = F.transform("x.used", lambda p: F.get("signature", p))
    keyed = reps.select("doc_id", "signature", F.explode(bands).alias("x")).select(F.xxhash64("x.band", values).alias("key"), F.col("x.used").alias("used"), "doc_id")
    found = None
    for level in range(REFINEMENTS + 1):
        keyed = cut_lineage(keyed)
        sizes = cut_lineage(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
        few = keyed.select("key", "doc_id").join(sizes.where(F.col("n") <= hot).select("key"), "key")
        pairs = few.alias("l").join(few.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.doc_id") < F.col("r.doc_id")))
        told = cut_lineage(_agreeing(pairs.select(F.col("l.doc_id").alias("a"), F.col("r.doc_id").alias("b")), reps, least_equal))
        found = told if found is None else found.union(told)
        large = sizes.where(F.col("n") > hot).select("key")
        if large.isEmpty():
            release(keyed)
            release(sizes)
            return found.distinct()
        still = keyed.join(small_side(large), "key")
        if level == REFINEMENTS:
            return found.union(_around_first(still, reps, count, least_equal, hot)).distinct()
        keyed = _refined(still, reps, count, count - least_equal + 1)
    raise AssertionError("unreachable")


def pair_groups(pairs: DataFrame) -> DataFrame:
    """(group, doc_id), two rows for each of ``pairs`` (doc_a, doc_b). Raises if a pair is not in arrival order."""
    wrong = pairs.where(F.col("doc_a") >= F.col("doc_b")).limit(1).collect()
    if wrong:
        raise RuntimeError(f"pair {wrong[0].doc_a}, {wrong[0].doc_b} is not in arrival order")
    return pairs.select(F.xxhash64("doc_a", "doc_b", F.lit("pair")).alias("group"), F.explode(F.array("doc_a", "doc_b")).alias("doc_id"))


def _copies(sigs: DataFrame) -> DataFrame:
    """Documents whose signature an earlier one has; they are duplicates in either mode."""
    reps = signature_classes(sigs).where("members > 1")
    return sigs.join(reps, "signature").where(F.col("doc_id") != F.col("rep")).select("doc_id", F.lit(True).alias("copy"))


def pairwise_verdict(docs: DataFrame, sigs: DataFrame, pairs: DataFrame, least: float = 0.8) -> DataFrame:
    """``pairwise_groups`` of those ``pairs`` (doc_a, doc_b, agreement) that agree at least ``least``."""
    return pairwise_groups(docs, sigs, pair_groups(pairs.where(F.col("agreement") >= least)))


def pairwise_groups(docs: DataFrame, sigs: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc_id, duplicate): an earlier arrival is in a set of ``groups`` (group, doc_id) with it. One pass; chains all go."""
    first = groups.groupBy("group").agg(F.min("doc_id").alias("first"))
    hit = groups.join(first, "group").where(F.col("doc_id") > F.col("first")).select("doc_id", F.lit(True).alias("hit")).distinct()
    return (
        docs.select("doc_id").join(hit, "doc_id", "left").join(_copies(sigs), "doc_id", "left")
        .select("doc_id", F.coalesce("hit", "copy", F.lit(False)).alias("duplicate"))
    )


def settled(groups: DataFrame) -> DataFrame:
    """(doc_id, gone = true) of the documents of ``groups`` (group, doc_id) that an earlier kept one of a common set makes a duplicate.

    Each round keeps every document that is the first of all its sets, and drops it together with
    all the others of those sets, which are gone; so the table shrinks by whole neighbourhoods and
    a chain takes half as many rounds as it has links. A set of n documents costs n rows a round.
    """
    open_rows = cut_lineage(groups.select("group", "doc_id").distinct())
    gone = []
    while not open_rows.isEmpty():
        first = open_rows.groupBy("group").agg(F.min("doc_id").alias("first"))
        led = open_rows.join(first, "group")
        kept = led.groupBy("doc_id").agg(F.bool_and(F.col("doc_id") == F.col("first")).alias("lead")).where("lead").select("doc_id")
        taken = led.join(kept.withColumnRenamed("doc_id", "first"), "first").where(F.col("doc_id") != F.col("first"))
        lost = cut_lineage(taken.select("doc_id").distinct())
        gone.append(lost)
        done = kept.union(lost)
        old, open_rows = open_rows, cut_lineage(open_rows.join(done, "doc_id", "left_anti"))
        release(old)
        if len(gone) == 32:
            gone = [cut_lineage(_all(gone))]
    return (_all(gone) if gone else open_rows.select("doc_id")).select("doc_id", F.lit(True).alias("gone"))


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def arrival_verdict(docs: DataFrame, sigs: DataFrame, pairs: DataFrame, least: float = 0.8) -> DataFrame:
    """``arrival_groups`` of those ``pairs`` (doc_a, doc_b, agreement) that agree at least ``least``."""
    return arrival_groups(docs, sigs, pair_groups(pairs.where(F.col("agreement") >= least)))


def arrival_groups(docs: DataFrame, sigs: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc_id, duplicate) as arrivals decide one after another: only kept documents make later ones duplicates.

    A copy's fate is its representative's: either that is kept, or what made it a duplicate
    does the same to the copy.
    """
    found = docs.select("doc_id").join(settled(groups), "doc_id", "left").join(_copies(sigs), "doc_id", "left")
    return found.select("doc_id", F.coalesce("copy", "gone", F.lit(False)).alias("duplicate"))
