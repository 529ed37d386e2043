"""Mixing sources to target weights [native]: Sainte-Laguë apportionment of equal-token blocks.

Targets. Sources in code-point order (null last) weigh 1, 2, 3, 1, ... and share the whole
word count by weight; no target passes ``MOST`` times its source's size, the excess going to
the others by weight (a water level, found from running sums over the sources).

Quotas. The total is cut into blocks of equal size. Blocks go to sources by the highest
quotients target / (2k + 1), starting from the rounded shares and settling the few left over
by an explicit ranking of the next quotients. Each source's quota is divided over its shards
(hash groups of about ``SHARD_BLOCKS`` blocks) the same way.

Selection. A shard's documents lie in seeded order on a line of words cut into blocks. A quota
of q blocks over n is q div n whole passes plus q mod n blocks, those with the lowest seeded
digest; a document takes what they cover of it. So no document passes ``MOST`` times its size.

Defined results: null or empty texts have size 0 and take 0. Null sources form one source.
Repeated rows are separate documents that tie in seeded order, so together they take the
same. An empty table gives no rows. Other columns are carried by ``apply_mix`` only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, own_names

MOST = 3
SHARD_BLOCKS = 512
SEED = "mix-1"


def highest_quotients(groups: DataFrame, by: list[str], key: str, share: str, seats: str) -> DataFrame:
    """``groups`` with ``quota``: ``seats`` seats dealt by Sainte-Laguë to the rows of each ``by`` group.

    ``share`` is the (non-negative) vote count and ``seats`` is equal within a group; ties go to
    the lower ``key``. Only the seats that rounding leaves open are ranked: at most a few a row.
    """
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    start = groups.withColumns({"_all": F.sum(share).over(w), "_rows": F.count("*").over(w)}).withColumn(
        "_low",
        F.when(
            F.col("_all") > 0,
            # below the divisor total / (seats + rows) no rounded share can exceed its final seats
            F.greatest(F.lit(0), F.floor(F.col(share) * F.col(seats) / F.col("_all") - F.lit(0.5)) - F.col("_rows") * F.col(share) / F.col("_all")).cast("long"),
        ).otherwise(F.lit(0)),
    )
    open_ = start.withColumn("_open", F.col(seats) - F.sum("_low").over(w)).withColumn(
        "_next",
        F.when(
            (F.col("_all") > 0) & (F.col(share) > 0),
            (F.ceil((F.col("_open") + F.col("_rows")) * F.col(share) / F.col("_all")) + 4).cast("int"),
        ).otherwise(F.lit(0)),
    )
    ranked = (
        open_.where("_next > 0")
        .select(*by, key, "_open", share, F.col("_low"), F.explode(F.sequence(F.lit(0), F.col("_next") - 1)).alias("_j"))
        .withColumn("_q", F.col(share) / (2 * (F.col("_low") + F.col("_j")) + 1))
        .withColumn(
            "_rank",
            F.row_number().over(w.orderBy(F.col("_q").desc(), F.col(key), F.col("_j"))),
        )
        .where(F.col("_rank") <= F.col("_open"))
        .groupBy(*by, key)
        .agg(F.count("*").alias("_won"))
    )
    return (
        start.join(ranked, [*by, key], "left")
        .withColumn("quota", F.col("_low") + F.coalesce("_won", F.lit(0)))
        .drop("_all", "_rows", "_low", "_won")
    )


def source_targets(sized: DataFrame) -> DataFrame:
    """(skey, source_size, weight, target, total) of each source of ``sized`` (skey, source, size)."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(0))
    sources = (
        sized.groupBy("skey", "source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", 1 + (F.row_number().over(order) - 1) % 3)
        .withColumns({"total": F.sum("source_size").over(whole), "_w": F.sum("weight").over(whole)})
        .withColumn("_ratio", F.col("source_size") / F.col("weight"))
    )
    before = Window.partitionBy(F.lit(0)).orderBy("_ratio", "skey").rowsBetween(Window.unboundedPreceding, -1)
    levels = sources.withColumns(
        {
            "_c": F.coalesce(F.sum("source_size").over(before), F.lit(0)) * MOST,
            "_wc": F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    ).withColumn("_level", (F.col("total") - F.col("_c")) / (F.col("_w") - F.col("_wc")))
    free = F.col("_level") <= F.col("_ratio") * MOST
    level = F.first(F.when(free, F.col("_level")), ignorenulls=True).over(
        Window.partitionBy(F.lit(0)).orderBy("_ratio", "skey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return levels.withColumns({"_free": free, "_final": level}).select(
        "skey",
        "source_size",
        "weight",
        F.when(
            F.col("_final").isNotNull() & (F.col("_ratio") * MOST >= F.col("_final")), F.col("weight") * F.col("_final")
        )
        .otherwise((F.col("source_size") * MOST).cast("double"))
        .alias("target"),
        "total",
    )


def mix_sources(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, source) with size, source_size, target and taken."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = materialize(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.concat(F.lit("v"), F.col("source")), F.lit("w")).alias("skey"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(text))).alias("h"),
        ),
        "mix",
    )
    targets = source_targets(sized).withColumn(
        "block", F.least(F.greatest(F.floor(F.col("total") / (1 << 20)), F.lit(16)), F.lit(4096)).cast("long")
    ).withColumn("blocks", F.floor(F.col("total") / F.col("block")))
    quotas = highest_quotients(targets, [], "skey", "target", "blocks").withColumn(
        "shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / (F.col("block") * SHARD_BLOCKS))).cast("long")
    )
    quotas = materialize(quotas.select("skey", "source_size", "target", "block", "quota", "shards"), "mix-quota")
    # one row a source; the hot source's rows are split by the skew join
    dealt = sized.join(quotas.select("skey", "shards"), "skey").withColumn(
        "shard", F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), F.col("shards"))
    )
    shards = (
        dealt.groupBy("skey", "shard")
        .agg(F.sum("size").alias("shard_size"))
        .join(quotas, "skey")
        .withColumnRenamed("quota", "source_quota")
    )
    shards = highest_quotients(shards, ["skey"], "shard", "shard_size", "source_quota")
    n = F.ceil(F.col("shard_size") / F.col("block"))
    rest = F.when(F.col("n") > 0, F.col("q") % F.col("n")).otherwise(F.lit(0)).cast("int")
    drawn = F.array_sort(
        F.transform(
            F.sequence(F.lit(0).cast("long"), F.col("n") - 1),
            lambda i: F.struct(
                F.md5(F.concat_ws("|", F.lit(seed), F.col("skey"), F.col("shard").cast("string"), i.cast("string"))).alias("d"), i.alias("i")
            ),
        )
    )
    shards = (
        shards.withColumn("n", n)
        .withColumn("q", F.least("quota", F.col("n") * MOST))
        .select(
            "skey",
            "shard",
            "source_size",
            "target",
            "block",
            F.when(F.col("n") > 0, F.floor(F.col("q") / F.col("n"))).otherwise(F.lit(0)).alias("passes"),
            F.when(
                F.col("n") > 0, F.array_sort(F.transform(F.slice(drawn, F.lit(1), rest), lambda x: x["i"]))
            )
            .otherwise(F.array().cast("array<bigint>"))
            .alias("chosen"),
        )
    )
    line = Window.partitionBy("skey", "shard").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("stop", F.sum("size").over(line)).withColumn("start", F.col("stop") - F.col("size"))

    def covered(x):
        """Words of chosen blocks before position ``x`` of the shard's line."""
        i = F.floor(x / F.col("block"))
        return F.col("block") * F.size(F.filter("chosen", lambda c: c < i)) + F.when(
            F.array_contains("chosen", i), x % F.col("block")
        ).otherwise(F.lit(0))

    return placed.join(shards, ["skey", "shard"]).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        F.when(F.col("size") == 0, F.lit(0).cast("long"))
        .otherwise(F.col("passes") * F.col("size") + covered(F.col("stop")) - covered(F.col("start")))
        .cast("long")
        .alias("taken"),
        "h",
    )


@own_names
def apply_mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: whole copies, then the first words of a last one.

    Rows that take no words go, empty texts among them.
    """
    keyed = docs.withColumn(
        "_h",
        F.md5(
            F.concat_ws(
                "|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(F.coalesce("text", F.lit("")))
            )
        ),
    ).withColumn("_n", F.row_number().over(Window.partitionBy("_h").orderBy("doc_id")))
    mix = mix_sources(docs, seed).select(F.col("h").alias("_h"), "size", "taken").withColumn(
        "_n", F.row_number().over(Window.partitionBy("_h").orderBy("taken"))
    )
    piece = F.array_join(
        F.slice(F.regexp_extract_all("text", F.lit(f"(?s)([\\x20\\x09-\\x0D]*{WORD})"), F.lit(1)), F.lit(1), F.col("_k").cast("int")), ""
    )
    text = F.when(F.col("_k") < F.col("size"), piece).otherwise(F.col("text"))
    return (
        keyed.join(mix.where("taken > 0"), ["_h", "_n"])
        .withColumn(
            "_k",
            F.explode(
                F.transform(
                    F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size"))),
                    lambda i: F.least(F.col("size"), F.col("taken") - (i - 1) * F.col("size")),
                )
            ),
        )
        .withColumn("text", text)
        .select(*[F.length("text").cast("long").alias("n_chars") if c == "n_chars" else c for c in docs.columns])
    )
