"""Places within groups of any size: exact ranks and exact first rows, without a window over a group.

A window over a class puts the whole class into one task. Here rows are dealt by ranges of
(group, order), so a class takes as many tasks as its rows need; what a range has of a class is
counted, and the counts before it are its offset. Where the order is a digest, whose values are
spread evenly, not even that is needed: counts by its leading digits say where the quota ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, small_side

_SHIFT = 33  # monotonically_increasing_id: partition above, row below


def _same(left: str, right: str, by: list[str]) -> Column:
    on = F.lit(True)
    for c in by:
        on = on & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return on


def ranked(df: DataFrame, by: list[str], order: list[Column | str], name: str = "rank", total: str | None = None) -> DataFrame:
    """``df`` with ``name``: each row's place (long, from 0) in its ``by`` group by ``order``, ascending; ``total`` names the group's size.

    Rows that ``order`` does not tell apart get consecutive places in any order. Nulls are a group
    of their own and sort first. An empty table gives an empty result. The rows are written once to
    the shared folder, in order, so places stay the same if a task runs again.
    """
    # the ranges are found from a sample first, so what the rows cost is paid once
    df = materialize(df, "unranked")
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    named = {f"_k{i}": k for i, k in enumerate(keys)}
    sort = [*by, *named]
    dealt = materialize(
        df.withColumns(named).repartitionByRange(*sort).sortWithinPartitions(*sort).drop(*named).withColumn("_m", F.monotonically_increasing_id()), "ranked"
    ).withColumn("_p", F.shiftright("_m", _SHIFT))
    # one row for a group and a range: as many as groups and ranges together
    pieces = dealt.groupBy(*by, "_p").agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    group = Window.partitionBy(*(by or [F.lit(0)]))
    pieces = pieces.withColumns(
        {
            "_before": F.coalesce(F.sum("_n").over(group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_total": F.sum("_n").over(group),
        }
    )
    pieces = small_side(materialize(pieces.select(*by, "_p", (F.col("_before") - F.col("_first")).alias("_shift"), "_total"), "offsets"))
    out = dealt.alias("l").join(pieces.alias("r"), _same("l", "r", [*by, "_p"]))
    extra = [F.col("_total").alias(total)] if total else []
    return out.select(*[F.col(f"l.`{c}`") for c in df.columns], (F.col("_m") + F.col("_shift")).alias(name), *extra)


def _quota_ends(marked: DataFrame, by: list[str], quota: DataFrame | int) -> DataFrame:
    """(by..., _cut, _left): the digest bucket in which a group's quota ends, and how much of it is left there."""
    group = Window.partitionBy(*(by or [F.lit(0)]))
    counts = marked.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    if isinstance(quota, int):
        counts = counts.withColumn("_q", F.lit(quota).cast("long"))
    else:
        wanted = quota.select(*by, F.col("quota").cast("long").alias("_q"))
        counts = counts.alias("l").join(small_side(wanted).alias("r"), _same("l", "r", by)).select("l.*", "_q")
    # at most 16 ** digits rows a group
    before = F.coalesce(F.sum("_n").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = counts.withColumn("_before", before).where(F.col("_before") < F.col("_q"))
    return small_side(ends.groupBy(*by).agg(F.max("_b").alias("_cut"), F.max_by(F.col("_q") - F.col("_before"), "_b").alias("_left")))


def quota_flag(df: DataFrame, by: list[str], digest: Column, ties: list[str], quota: DataFrame | int, name: str = "within", digits: int = 4) -> DataFrame:
    """``df`` with ``name``: whether a row is among its ``by`` group's first in the order of (``digest``, ``ties``).

    ``digest`` is a hexadecimal text whose values are spread evenly, such as MD5 of the row's key.
    ``quota`` is a number for all groups, or a table (by..., quota) of one row a group; groups that
    it does not list, or lists with 0 or less, have none. Rows are counted by the digest's first
    ``digits`` digits; only the bucket in which a quota ends is ordered, one in 16 ** ``digits``
    of the group. Rows equal in digest and ties are taken in any order.
    """
    marked = df.withColumns({"_d": digest, "_b": F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")})
    ends = _quota_ends(marked, by, quota)
    near = marked.alias("l").join(ends.alias("r"), _same("l", "r", by), "left").select("l.*", "_cut", "_left")
    place = F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_d", *ties))
    at_end = F.coalesce(F.col("_b") == F.col("_cut"), F.lit(False))
    rest = near.where(~at_end).select(*df.columns, F.coalesce(F.col("_b") < F.col("_cut"), F.lit(False)).alias(name))
    edge = near.where(at_end).withColumn("_r", place).select(*df.columns, (F.col("_r") <= F.col("_left")).alias(name))
    return rest.union(edge)


def first_rows(df: DataFrame, by: list[str], digest: Column, ties: list[str], quota: DataFrame | int, digits: int = 4) -> DataFrame:
    """The rows that ``quota_flag`` marks: exactly each group's quota, or all it has."""
    return quota_flag(df, by, digest, ties, quota, "_in", digits).where("_in").drop("_in")


def batches(df: DataFrame, size: int, order: list[Column | str], name: str = "batch") -> DataFrame:
    """``df`` with ``name``: the number (long, from 0) of the batch of ``size`` rows it is in by ``order``; the last may be smaller."""
    return ranked(df, [], order, "_place").withColumn(name, F.floor(F.col("_place") / size)).drop("_place")
