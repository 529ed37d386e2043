"""The prefix trie of conversations, built level by level: equal first turns are stored once.

A turn is its role and text, held as a SHA-256 digest with the text's length; texts themselves are
read once and not shuffled. At each depth the live conversations are grouped by (parent node, next
turn); a group is a node, named by the smallest conversation in it. Conversations that go on share
the next level; one that is alone in its node is done, as the rest of it is a chain that its own
turns describe. Conversations that are equal as a whole go as one, with their number, so copies of
a long conversation do not keep levels alive. There are as many rounds as different conversations
share first turns. Then joins from the deepest level up add leaves and savings to the parents.

Hot groups: nodes are partial aggregations; their names go back to the conversations by a broadcast
of the shared nodes while those are few and else by a join that can be split. Places in a
conversation come from counted ranges, so one of very many turns takes many tasks. Ids that end at
one node are written in order into pieces of at most ``PIECE`` ids, and one task runs over a node's
pieces as a stream.

Rows without a conv_id are left out. Null role or text is empty. Turns are ordered by turn, null
first, rows of equal turn by their digest; equal rows are turns of their own. No conversations give
no nodes. Remainders are truncated, as in SQL.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from ..session import small_side
from .common import materialize, release, trimmed

#: Turns that a live conversation carries along, fetched anew after as many levels.
AHEAD = 8
#: Ids in a piece of a node's list.
PIECE = 4096
#: Turns in a block of running sums.
RUN = 4096
NOTHING = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 0, len, key, cp): every turn at its place, ``cp`` the code points of its text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("key"), F.length(text).alias("cp"))
    return ranked(rows, ["conv_id"], ["turn", "key"], "pos", total="len").drop("turn")


def grafted(turns: DataFrame, pool: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, members): each conversation c with the first h turns of c - c % ``pool`` in place of its own first h.

    ``h`` is crc32 of the decimal c, modulo ``heads``; of a shorter first conversation all turns are
    taken, of a missing one none. turns: (c, pos from 1, key, cp); members: (c, len), also those left
    without turns.
    """
    convs = turns.groupBy("conv_id").agg(F.max("len").alias("len"))
    h = lambda c: F.crc32(c.cast("string").cast("binary")) % heads
    first = turns.where((F.col("conv_id") % pool == 0) & (F.col("pos") < heads)).select(F.col("conv_id").alias("base"), "pos", "key", "cp")
    base_len = convs.where(F.col("conv_id") % pool == 0).select(F.col("conv_id").alias("base"), F.col("len").alias("base_len"))
    c = F.col("conv_id")
    meta = (
        convs.select(c, "len", h(c).alias("h"), (c - c % pool).alias("base"))
        .join(base_len, "base", "left")
        .select("conv_id", "base", "h", F.least("h", F.coalesce("base_len", F.lit(0))).alias("g"), "len")
    )
    meta = materialize(meta.withColumn("new_len", F.col("g") + F.greatest(F.col("len") - F.col("h"), F.lit(0))), "graft")
    # a pool has as many conversations as its width, so a first conversation goes to no more
    head = meta.where("g > 0").join(first, "base").where("pos < g").select("conv_id", (F.col("pos") + 1).alias("pos"), "key", "cp")
    own = turns.where(F.col("pos") >= h(c)).join(meta.select("conv_id", "h", "g"), "conv_id")
    tail = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("g") + 1).alias("pos"), "key", "cp")
    members = meta.select(c.alias("c"), F.col("new_len").alias("len"))
    return head.union(tail).withColumnRenamed("conv_id", "c"), members


def _id_hash(ids: Column) -> Column:
    return F.sha2(ids.cast("string"), 256)


def list_hashes(groups: DataFrame) -> DataFrame:
    """(rep, ends): SHA-256 of the decimal ids ``c`` of each ``rep``, ascending, with commas between.

    A list is never held as a whole: pieces are made where ranges of (rep, c) lie, then one task
    streams over the pieces of a rep in order.
    """
    import pyarrow as pa

    def pieces(batches):
        rep, first, ids = None, None, []
        out = []

        def close():
            if ids:
                out.append((rep, first, ",".join(ids)))

        for batch in batches:
            for r, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if r != rep or len(ids) == PIECE:
                    close()
                    rep, first, ids = r, c, []
                ids.append(str(c))
            if len(out) >= 64:
                yield _rows(out)
                out.clear()
        close()
        if out:
            yield _rows(out)

    def _rows(out):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())], names=["rep", "first", "piece"])

    def hashes(batches):
        rep, state, out = None, None, []
        for batch in batches:
            for r, p in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if r != rep:
                    if state is not None:
                        out.append((rep, state.hexdigest()))
                    rep, state = r, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(p.encode())
            if len(out) >= 10_000:
                yield _named(out)
                out = []
        if state is not None:
            out.append((rep, state.hexdigest()))
        if out:
            yield _named(out)

    def _named(out):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], names=["rep", "ends"])

    cut = groups.select("rep", "c").repartitionByRange("rep", "c").sortWithinPartitions("rep", "c").mapInArrow(trimmed(pieces), "rep long, first long, piece string")
    return cut.repartition("rep").sortWithinPartitions("rep", "first").mapInArrow(trimmed(hashes), "rep long, ends string")


def _running_savings(turns: DataFrame, chains: DataFrame) -> DataFrame:
    """Rows of ``chains`` (c, start, k, ...) with each of their turns from start on, and ``saved`` from there to the end."""
    rows = turns.join(chains, "c").where(F.col("pos") >= F.col("start")).withColumn("run", F.floor(F.col("pos") / RUN))
    within = Window.partitionBy("c", "run").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    runs = rows.groupBy("c", "run").agg(F.sum("cp").alias("s"))
    after = runs.select("c", "run", F.coalesce(F.sum("s").over(Window.partitionBy("c").orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("after"))
    both = rows.withColumn("upto", F.sum("cp").over(within)).join(after, ["c", "run"])
    return both.withColumn("saved", (F.col("k") - 1) * (F.col("upto") + F.col("after")))


def build_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """The nodes of the trie over ``turns`` (c, pos from 1, key, cp) of ``members`` (c, len; one row a conversation).

    Returns, as long: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, and ends_sha256.
    """
    turns = materialize(turns, "turns")
    places = turns.groupBy("c").agg(F.bit_xor(F.xxhash64("pos", "key")).alias("d1"), F.bit_xor(F.xxhash64(F.lit(7), "key", "pos")).alias("d2"))
    named = materialize(members.join(places, "c", "left").select("c", "len", F.coalesce("d1", F.lit(0)).alias("d1"), F.coalesce("d2", F.lit(0)).alias("d2")), "members")
    classes = materialize(named.groupBy("len", "d1", "d2").agg(F.min("c").alias("rep"), F.count("*").alias("k")), "classes")
    copied = named.join(small_side(classes.where("k > 1").select("len", "d1", "d2", "rep")), ["len", "d1", "d2"]).select("rep", "c")
    ends = materialize(list_hashes(copied), "ends")

    def ahead(live: DataFrame, depth: int) -> DataFrame:
        """``live`` with its turns of the levels from ``depth`` on."""
        part = turns.where(F.col("pos").between(depth, depth + AHEAD - 1)).groupBy("c").agg(F.array_sort(F.collect_list(F.struct("pos", "key", "cp"))).alias("t"))
        return live.join(part, "c")

    whole = classes.agg(F.min("rep").alias("root"), F.sum("k").alias("n"), F.max(F.when(F.col("len") == 0, F.struct("rep", "k"))).alias("e")).first()
    spark = turns.sparkSession
    schema = "conv_id long, depth long, parent_conv_id long, n_convs long, cp long, ender long, ender_k long"
    if whole.root is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    root = spark.createDataFrame([(whole.root, 0, None, whole.n, 0, whole.e.rep if whole.e else None, whole.e.k if whole.e else None)], schema)

    # down: one round a level, while different conversations share nodes
    live = classes.where("len > 0").select(F.col("rep").alias("c"), "k", "len", F.lit(whole.root).alias("node"))
    groups: list[DataFrame] = []
    while True:
        depth = len(groups) + 1
        if (depth - 1) % AHEAD == 0:
            old, live = live, materialize(ahead(live.drop("t"), depth), "live")
            release(old)
        step = live.select("c", "k", "len", "node", F.element_at("t", (depth - 1) % AHEAD + 1).alias("x"))
        level = materialize(
            step.groupBy("node", F.col("x.key").alias("key")).agg(
                F.min("c").alias("conv_id"),
                F.sum("k").alias("n_convs"),
                F.count("*").alias("reps"),
                F.max("x.cp").cast("long").alias("cp"),
                F.max("len").alias("len"),
                F.max(F.when(F.col("len") == depth, F.struct("c", "k"))).alias("e"),
            ),
            "level",
        )
        groups.append(level)
        shared = level.where("reps > 1").select(F.col("node").alias("n"), F.col("key").alias("kk"), "conv_id")
        if shared.isEmpty():
            break
        at = F.element_at("t", (depth - 1) % AHEAD + 1)["key"]
        further = live.where(F.col("len") > depth).join(small_side(shared), (F.col("node") == F.col("n")) & (at == F.col("kk")))
        old, live = live, materialize(further.select("c", "k", "len", F.col("conv_id").alias("node"), "t"), "live")
        release(old)
    release(live)

    # chains: conversations, or classes of equal ones, from where they are alone
    chains = None
    for i, level in enumerate(groups):
        one = level.where("reps = 1").select(F.col("conv_id").alias("c"), F.lit(i + 1).cast("long").alias("start"), F.col("node").alias("parent"), F.col("n_convs").alias("k"), "len")
        chains = one if chains is None else chains.union(one)
    chains = materialize(chains, "chains")
    many = materialize(_running_savings(turns, chains.where("k > 1")).join(small_side(ends), F.col("c") == F.col("rep")).drop("rep"), "copies")
    tops = (
        chains.where("k = 1").select("start", "parent", F.lit(0).cast("long").alias("saved"))
        .union(many.where("pos = start").select("start", "parent", "saved"))
    )
    tops = materialize(tops.groupBy("start", "parent").agg(F.count("*").alias("kids"), F.sum("saved").alias("saved")), "tops")

    # up: a level's sums are joined to the level above
    rolled: list[DataFrame] = []
    below = None
    for depth in range(len(groups) - 1, -1, -1):
        if depth:
            nodes = groups[depth - 1].where("reps > 1").select(
                "conv_id", F.lit(depth).cast("long").alias("depth"), F.col("node").alias("parent_conv_id"), "n_convs", "cp", F.col("e.c").alias("ender"), F.col("e.k").alias("ender_k")
            )
        else:
            nodes = root
        kids = tops.where(F.col("start") == depth + 1).select("parent", "kids", F.col("kids").alias("leaves"), "saved")
        if below is not None:
            kids = kids.union(below.select(F.col("parent_conv_id").alias("parent"), F.lit(1).cast("long"), "n_leaves", "saved_tokens"))
        sums = kids.groupBy("parent").agg(F.sum("kids").alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("under"))
        below = materialize(
            nodes.join(sums, F.col("conv_id") == F.col("parent"), "left").select(
                *nodes.columns,
                F.coalesce("n_children", F.lit(0)).alias("n_children"),
                F.coalesce("leaves", F.lit(1)).alias("n_leaves"),
                ((F.col("n_convs") - 1) * F.col("cp") + F.coalesce("under", F.lit(0))).alias("saved_tokens"),
            ),
            "rolled",
        )
        rolled.append(below)
    for level in (*groups, named, classes, tops):
        release(level)

    nodes = rolled[0]
    for level in rolled[1:]:
        nodes = nodes.union(level)
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    few = nodes.where("coalesce(ender_k, 0) <= 1").withColumn("ends_sha256", F.when(F.col("ender").isNull(), NOTHING).otherwise(_id_hash(F.col("ender"))))
    more = nodes.where("ender_k > 1").join(ends.withColumnRenamed("ends", "ends_sha256"), F.col("ender") == F.col("rep"))
    links = lambda rows, hash_of, saved: rows.select(
        F.col("c").alias("conv_id"),
        F.col("pos").cast("long").alias("depth"),
        F.when(F.col("pos") == F.col("start"), F.col("parent")).otherwise(F.col("c")).alias("parent_conv_id"),
        F.col("k").alias("n_convs"),
        (F.col("pos") < F.col("len")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        saved.cast("long").alias("saved_tokens"),
        F.when(F.col("pos") == F.col("len"), hash_of).otherwise(NOTHING).alias("ends_sha256"),
    )
    single = turns.select("c", "pos").join(chains.where("k = 1"), "c").where(F.col("pos") >= F.col("start"))
    return (
        few.select(*out).union(more.select(*out))
        .union(links(single, _id_hash(F.col("c")), F.lit(0)))
        .union(links(many, F.col("ends"), F.col("saved")))
    )
