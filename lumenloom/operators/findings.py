"""The report's findings as rules over the gates: one row a sentence, a null result stated first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _number(c: str, places: int = 4) -> Column:
    return F.coalesce(F.format_string(f"%.{places}f", F.col(c).cast("double")), F.lit("n/a"))


def findings(headroom: DataFrame, gate: DataFrame, starved: DataFrame, n_results: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(position, topic, finding) of what the gates say; topics without anything to say have no row.

    ``headroom``: the preferred family's row (status, relative_headroom, gate_open), or none;
    ``gate``: one row (status, weakened, max_cramers_v, mean_jaccard), or none; ``starved``: one row
    (n_starved, starved_share); ``n_results``: one row (n), how many first-tier results there are.
    """
    spark = headroom.sparkSession
    one = spark.range(1).select(F.lit(1).alias("_one"))

    def row(df: DataFrame, prefix: str) -> DataFrame:
        return df.limit(1).select(F.lit(1).alias("_one"), *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns])

    # each is one row at most
    facts = one
    for df, prefix in ((headroom, "h"), (gate, "g"), (starved, "s"), (n_results, "r")):
        facts = facts.join(F.broadcast(row(df, prefix)), "_one", "left")
    calibration = (
        F.when(F.coalesce(F.col("h_status") != "computed", F.lit(True)), "Headroom is unknown: results for the contaminated oracle and the baseline are not both there. Nothing is concluded.")
        .when(~F.coalesce(F.col("h_gate_open"), F.lit(False)), F.concat(F.lit("Null result: calibrating on the evaluation data itself recovers "), _number("h_relative_headroom"), F.lit(f" of the difference, under the threshold of {threshold:.2f}. The choice of calibration text is not the lever here, and the other variants were not run.")))
        .otherwise(F.concat(F.lit("There is headroom: the contaminated oracle recovers "), _number("h_relative_headroom"), F.lit(" of the difference, an upper bound for any legitimate calibration.")))
    )
    routing = F.when(F.col("g_weakened"), "Routing of the language classes and of the control cannot be told apart, which weakens the coverage mechanism whatever calibration does.").when(
        F.col("g_status") == "differs", F.concat(F.lit("Experts are used differently by language (largest Cramer's V "), _number("g_max_cramers_v"), F.lit(", mean top-32 Jaccard "), _number("g_mean_jaccard"), F.lit("), which the coverage mechanism needs."))
    )
    experts = F.when(F.col("s_n_starved") > 0, F.concat(F.col("s_n_starved").cast("string"), F.lit(" experts carry Malay tokens that English calibration hardly reaches ("), _number("s_starved_share"), F.lit(" of all Malay tokens).")))
    provisional = F.when(F.coalesce(F.col("r_n"), F.lit(0)) == 0, "First-tier results are absent, so every number above is provisional.")
    topics = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(t).alias("topic"), s.alias("finding")) for i, (t, s) in enumerate((("calibration", calibration), ("routing", routing), ("experts", experts), ("provisional", provisional)))])
    return facts.select(F.explode(topics).alias("x")).select("x.*").where("finding is not null")


def gate_readback(gate: DataFrame | None, spark) -> DataFrame:
    """The stored routing gate's row, or one that says it is unavailable."""
    none = spark.range(1).select(F.lit("unavailable").alias("status"), F.lit(None).cast("boolean").alias("weakened"), F.lit(None).cast("double").alias("max_cramers_v"), F.lit(None).cast("double").alias("mean_jaccard"))
    if gate is None:
        return none
    kept = gate.select("status", "weakened", "max_cramers_v", "mean_jaccard").limit(1)
    return kept if not kept.isEmpty() else none
