"""Evaluation statistics: token KL, bootstrap, perplexity, accuracy, throughput, headroom."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import philox_numpy, poisson_steps, row_words, scope
from ..functions.special import rank_survival

EPS = 1e-12


def tail_mass(logprobs: Column) -> Column:
    """Probability outside a top-K list, from 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.aggregate(logprobs, F.lit(0.0), lambda a, x: a + F.exp(x))))


def top_logprobs(logits: Column, k: int) -> Column:
    """array of struct(id, lp): log-softmax of the ``k`` largest logits; lower id of equals."""
    from ..functions.text import let

    wide = F.transform(logits, lambda v: v.cast("double"))
    return let(
        wide,
        lambda x: let(
            F.array_max(x),
            lambda m: let(
                m + F.ln(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - m))),
                lambda z: F.transform(
                    F.slice(F.array_sort(F.transform(x, lambda v, i: F.struct((-v).alias("n"), i.alias("i")))), 1, k),
                    lambda s: F.struct(s["i"].alias("id"), (-s["n"] - z).alias("lp")),
                ),
            ),
        ),
    )


def token_kl(reference: Column, candidate: Column, eps: float = EPS) -> Column:
    """struct(kl, tail) of two arrays of struct(id, lp): summed over the reference's ids.

    An id the candidate lacks gets the candidate's tail over the square of its list's length.
    """
    from ..functions.text import let

    lps = lambda x: F.transform(x, lambda s: s["lp"])

    def with_tails(t):
        floor = F.greatest(t["c"], F.lit(eps)) / F.greatest(F.size(candidate) * F.size(candidate), F.lit(1))
        known = F.map_from_arrays(F.transform(candidate, lambda s: s["id"]), F.transform(candidate, lambda s: F.exp(s["lp"])))

        def summed(m):
            # plus of one reference id; a probability that underflows adds nothing
            part = lambda s: F.when(F.exp(s["lp"]) > 0, F.exp(s["lp"]) * F.ln(F.exp(s["lp"]) / F.greatest(F.coalesce(F.try_element_at(m, s["id"]), floor), F.lit(eps)))).otherwise(0.0)
            return F.aggregate(reference, F.lit(0.0), lambda a, s: a + part(s))

        return F.struct(let(known, summed).alias("kl"), F.greatest(t["r"], t["c"]).alias("tail"))

    return let(F.struct(tail_mass(lps(reference)).alias("r"), tail_mass(lps(candidate)).alias("c")), with_tails)


def kl_summary(rows: DataFrame, by: list[str], kl: str = "kl", tail: str = "tail") -> DataFrame:
    std = F.coalesce(F.stddev_samp(kl), F.lit(0.0))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_tokens"),
        F.avg(kl).alias("kl_mean"),
        std.alias("kl_std"),
        (std / F.sqrt(F.count("*").cast("double"))).alias("kl_sem"),
        F.avg(tail).alias("mean_tail_mass"),
        F.max(tail).alias("max_tail_mass"),
        F.percentile(kl, F.lit(0.5)).alias("kl_p50"),
        F.percentile(kl, F.lit(0.99)).alias("kl_p99"),
    )


def tier1_row(rows: DataFrame, by: list[str], side: str, left: str, right: str, pair: str, resamples: int = 1000, seed: int = 0, key: list[str] | None = None) -> DataFrame:
    """One wide row a ``by`` group: both sides' summaries with intervals under bm_ and en_, and the paired difference.

    ``rows``: by..., side, pair, kl, tail. A group that has one side only keeps nulls for the other.
    """
    summary = kl_summary(rows, [*by, side]).join(bootstrap_interval(rows, [*by, side], "kl", resamples, seed=seed, key=key), [*by, side])
    names = [c for c in summary.columns if c not in (*by, side)]
    # one row a group and side
    wide = summary.groupBy(*by).agg(*[F.max(F.when(F.col(side) == s, F.col(c))).alias(f"{p}_{c}") for s, p in ((left, "bm"), (right, "en")) for c in names])
    interval = paired_interval(rows, side, left, right, pair, by, resamples=resamples, seed=seed)
    out = wide.join(interval, by, "left")
    return out.withColumns(
        {
            "bm_en_delta": F.col("bm_kl_mean") - F.col("en_kl_mean"),
            "bm_en_ratio": F.when(F.col("en_kl_mean") > 0, F.col("bm_kl_mean") / F.col("en_kl_mean")),
            "delta_excludes_zero": F.coalesce("delta_excludes_zero", F.lit(False)),
        }
    )


def kl_delta(rows: DataFrame, side: str, left: str, right: str, by: list[str], kl: str = "kl") -> DataFrame:
    """Means of both sides, their difference and ratio (null if the right mean isn't positive)."""
    mean = lambda s: F.avg(F.when(F.col(side) == s, F.col(kl)))
    wide = rows.groupBy(*by).agg(
        mean(left).alias("bm_kl_mean"),
        mean(right).alias("en_kl_mean"),
        F.count_if(F.col(side) == left).alias("n_bm_tokens"),
        F.count_if(F.col(side) == right).alias("n_en_tokens"),
    )
    return wide.withColumns(
        {
            "bm_en_delta": F.col("bm_kl_mean") - F.col("en_kl_mean"),
            "bm_en_ratio": F.when(F.col("en_kl_mean") > 0, F.col("bm_kl_mean") / F.col("en_kl_mean")),
        }
    )


#: Groups whose sums a task holds before it passes them on.
_HELD_GROUPS = 2048


def _resampled(rows: DataFrame, by: list[str], key: list[str], values: list[str], resamples: int, seed: int) -> DataFrame:
    """(by..., b, n, s_<value>...): Poisson(1) weights of every row summed for each resample, with the weighted sums.

    A row draws from its ``key``, so draws are the same however rows are partitioned. A task adds
    its rows to one array of sums a group; only those arrays are shuffled, not a row for each
    resample, and no group is held by one task.
    """
    import pyarrow as pa

    words = row_words(*[F.col(f"`{k}`") for k in key])
    plain = rows.select(*[F.col(f"`{b}`").alias(f"g{i}") for i, b in enumerate(by)], *[F.col(f"`{v}`").cast("double").alias(f"v{i}") for i, v in enumerate(values)], words[0].alias("w0"), words[1].alias("w1"))
    kinds = [k for _, k in plain.dtypes[: len(by)]]
    steps, key_words, blocks = np.array(poisson_steps(), dtype=np.uint64), scope(seed, "bootstrap"), -(-resamples // 4)

    def run(batches):
        held: dict[tuple, np.ndarray] = {}

        def rows_of(held):
            groups = list(held)
            sums = np.stack([held[g] for g in groups])  # group, 1 + values, resamples
            arrays = [pa.array([g[i] for g in groups for _ in range(resamples)], type=kind) for i, kind in enumerate(types)]
            arrays += [pa.array(np.tile(np.arange(resamples, dtype=np.int32), len(groups))), pa.array(sums[:, 0].ravel().astype(np.int64))]
            arrays += [pa.array(sums[:, 1 + i].ravel()) for i in range(len(values))]
            return pa.RecordBatch.from_arrays(arrays, names=[*(f"g{i}" for i in range(len(by))), "b", "n", *(f"s{i}" for i in range(len(values)))])

        types = []
        for batch in batches:
            types = [batch.schema.field(i).type for i in range(len(by))]
            v = np.stack([batch.column(len(by) + i).to_numpy(zero_copy_only=False) for i in range(len(values))]) if values else np.zeros((0, batch.num_rows))
            w0, w1 = (batch.column(len(by) + len(values) + i).to_numpy(zero_copy_only=False).astype(np.uint64) for i in (0, 1))
            names = list(zip(*(batch.column(i).to_pylist() for i in range(len(by))), strict=True)) if by else [()] * batch.num_rows
            where: dict[tuple, list[int]] = {}
            for at, name in enumerate(names):
                where.setdefault(name, []).append(at)
            for name, places in where.items():
                for low in range(0, len(places), 512):
                    at = np.array(places[low : low + 512])
                    drawn = philox_numpy([w0[at][:, None], w1[at][:, None], np.arange(blocks, dtype=np.uint64)[None, :], np.zeros((1, 1), dtype=np.uint64)], key_words)
                    # word 4 b + i is resample 4 b + i
                    weight = np.searchsorted(steps, drawn.transpose(1, 2, 0).reshape(len(at), -1)[:, :resamples], side="right").astype(np.float64)
                    part = np.concatenate([weight.sum(axis=0)[None, :], v[:, at] @ weight])
                    held[name] = held[name] + part if name in held else part
            if len(held) >= _HELD_GROUPS:
                yield rows_of(held)
                held = {}
        if held:
            yield rows_of(held)

    schema = ", ".join([*(f"g{i} {k}" for i, k in enumerate(kinds)), "b int, n long", *(f"s{i} double" for i in range(len(values)))])
    sums = plain.mapInArrow(run, schema).groupBy(*[f"g{i}" for i in range(len(by))], "b").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(values))])
    return sums.select(*[F.col(f"g{i}").alias(b) for i, b in enumerate(by)], "b", "n", *[F.col(f"s{i}").alias(f"s_{v}") for i, v in enumerate(values)])


def bootstrap_interval(
    rows: DataFrame, by: list[str], value: str, resamples: int = 1000, confidence: float = 0.95, seed: int = 0, key: list[str] | None = None
) -> DataFrame:
    """Percentile interval of the mean of ``value`` in each group by a Poisson bootstrap.

    ``key`` names what tells rows apart (all columns if None); rows equal there draw alike.
    Null values count for nothing.
    """
    some = rows.where(F.col(value).isNotNull())
    means = _resampled(some, by, key or rows.columns, [value], resamples, seed).withColumn("m", F.try_divide(f"s_{value}", F.col("n")))
    alpha = (1 - confidence) / 2
    return means.groupBy(*by).agg(F.percentile("m", F.lit(alpha)).alias("ci_low"), F.percentile("m", F.lit(1 - alpha)).alias("ci_high"))


def paired_interval(
    rows: DataFrame,
    side: str,
    left: str,
    right: str,
    pair: str,
    by: list[str],
    value: str = "kl",
    resamples: int = 1000,
    confidence: float = 0.95,
    seed: int = 0,
) -> DataFrame:
    """Interval of the difference of both sides' means, with both sides of a ``pair`` drawn together.

    Only pairs with a value on either side count; a side's several values of one pair are averaged.
    ``delta_excludes_zero`` says that the whole interval is on one side of zero.
    """
    mean = lambda s: F.avg(F.when(F.col(side) == s, F.col(value)))
    wide = rows.groupBy(*by, pair).agg((mean(left) - mean(right)).alias("d")).where("d is not null")
    means = _resampled(wide, by, [*by, pair], ["d"], resamples, seed).withColumn("m", F.try_divide("s_d", F.col("n")))
    alpha = (1 - confidence) / 2
    low, high = F.percentile("m", F.lit(alpha)), F.percentile("m", F.lit(1 - alpha))
    out = means.groupBy(*by).agg(low.alias("bm_en_delta_ci_low"), high.alias("bm_en_delta_ci_high"))
    return out.withColumn("delta_excludes_zero", (F.col("bm_en_delta_ci_low") > 0) | (F.col("bm_en_delta_ci_high") < 0))


def perplexity(rows: DataFrame, by: list[str], nll: str = "nll") -> DataFrame:
    """exp of the mean negative log-likelihood (at most e^70), with its deviation and counts."""
    return rows.where(F.col(nll).isNotNull()).groupBy(*by).agg(
        F.exp(F.least(F.avg(nll), F.lit(70.0))).alias("perplexity"),
        F.avg(nll).alias("mean_nll"),
        F.coalesce(F.stddev_samp(nll), F.lit(0.0)).alias("nll_std"),
        F.count("*").alias("n_tokens"),
    )


def perplexity_delta(measured: DataFrame, reference: DataFrame, on: str) -> DataFrame:
    ref = reference.select(on, F.col("perplexity").alias("reference_perplexity"), F.col("mean_nll").alias("_ref"))
    return measured.join(ref, on, "left").withColumns(
        {
            "ppl_delta": F.col("perplexity") - F.col("reference_perplexity"),
            "ppl_delta_pct": 100 * F.try_divide(F.col("perplexity") - F.col("reference_perplexity"), F.col("reference_perplexity")),
            "nll_delta": F.col("mean_nll") - F.col("_ref"),
        }
    ).drop("_ref")


def accuracy(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Share and binomial standard error of each 0/1 metric; without keys one row."""
    aggs = [F.count("*").alias("n")]
    for m in metrics:
        p = F.avg(F.col(m).cast("double"))
        aggs += [p.alias(f"{m}_accuracy"), F.sqrt(p * (1 - p) / F.count(F.col(m))).alias(f"{m}_se")]
    return rows.groupBy(*[b for b in by if b in rows.columns]).agg(*aggs)


def best_option(scores: Column) -> Column:
    """0-based index of the highest score; the first of equals."""
    return F.array_max(F.transform(scores, lambda s, i: F.struct(s.alias("s"), (-i).alias("n"))))["n"] * -1


def throughput_regression(rows: DataFrame, reference: DataFrame, on: list[str], tolerance: float = 0.05) -> DataFrame:
    """Relative change to the reference; if measured by more than one instrument nothing is compared."""
    instruments = rows.select("measured_by").union(reference.select("measured_by")).agg((F.countDistinct("measured_by") > 1).alias("mixed"))
    ref = reference.select(*on, F.col("output_tokens_per_sec").alias("_ref"))
    # one row, one flag
    joined = rows.join(ref, on, "left").join(F.broadcast(instruments))
    change = F.when(~F.col("mixed"), F.try_divide(F.col("output_tokens_per_sec") - F.col("_ref"), F.col("_ref")))
    return joined.withColumn("throughput_vs_reference", change).withColumn(
        "regression_flagged", F.coalesce(F.abs("throughput_vs_reference") > tolerance, F.lit(False))
    ).drop("_ref", "mixed")


def loadtest_summary(requests: DataFrame, by: list[str]) -> DataFrame:
    """Tokens and requests a second of wall time, mean and 99th-percentile latency, from a request log."""
    wall = (F.max("finished_s") - F.min("started_s")).cast("double")
    return requests.groupBy(*by).agg(
        F.count("*").alias("n_requests"),
        F.try_divide(F.sum("tokens"), wall).alias("output_tokens_per_sec"),
        F.try_divide(F.count("*"), wall).alias("request_throughput"),
        F.avg("latency_ms").alias("ttft_mean_ms"),
        F.percentile("latency_ms", F.lit(0.99)).alias("ttft_p99_ms"),
    )


def headroom(rows: DataFrame, by: str = "family", metric: str = "bm_en_delta", least: float = 0.1) -> DataFrame:
    """Baseline against oracle in each family: absolute and relative headroom and whether the gate opens.

    A baseline that isn't significantly different from zero has no relative headroom and keeps the
    gate shut. Families without either variant are unavailable. ``preferred`` marks the one reported.
    """
    mean = lambda v: F.avg(F.when(F.col("variant") == v, F.col(metric)))
    per = rows.groupBy(by).agg(
        mean("baseline_en").alias("baseline_en"),
        mean("oracle_contaminated").alias("oracle_contaminated"),
        F.coalesce(F.bool_or(F.when(F.col("variant") == "baseline_en", F.col("delta_excludes_zero"))), F.lit(True)).alias("baseline_significant"),
    )
    known = F.col("baseline_en").isNotNull() & F.col("oracle_contaminated").isNotNull()
    absolute = F.col("baseline_en") - F.col("oracle_contaminated")
    relative = F.when(F.col("baseline_significant") & known, F.coalesce(F.try_divide(absolute, F.abs("baseline_en")), F.lit(0.0)))
    out = per.withColumns(
        {"status": F.when(known, "computed").otherwise("unavailable"), "absolute_headroom": absolute, "relative_headroom": relative}
    ).withColumn("gate_open", F.coalesce(F.col("relative_headroom") >= least, F.lit(False)))
    order = Window.partitionBy(F.lit(0)).orderBy((F.col("status") != "computed").cast("int"), (~F.contains(by, F.lit("w4a4"))).cast("int"), by)
    return out.withColumn("preferred", (F.row_number().over(order) == 1) & (F.col("status") == "computed"))


def select_winner(rows: DataFrame, metric: str = "bm_en_delta", order: str = "checkpoint") -> DataFrame:
    """The uncontaminated row with the smallest absolute ``metric``; the first of equals."""
    return rows.where("variant <> 'oracle_contaminated'").orderBy(F.abs(metric), order).limit(1)


def language_shares(profiles: DataFrame, expert: str, group: str, groups: list[str], value: str) -> DataFrame:
    """Tokens of each expert by group, missing as 0, and each group's share."""
    wide = profiles.groupBy(expert).agg(*[F.coalesce(F.sum(F.when(F.col(group) == g, F.col(value))), F.lit(0)).alias(g) for g in groups])
    whole = Window.partitionBy(F.lit(0))  # one row an expert
    return wide.withColumns({f"{g}_share": F.coalesce(F.try_divide(g, F.sum(g).over(whole)), F.lit(0.0)) for g in groups})


def average_rank(value: str, by: list[str]) -> Column:
    n = Window.partitionBy(*by, value)
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(n) - 1) / 2


def rank_p_value(rho: float, n: int) -> float:
    """Two-sided p of a rank correlation by Student's t with n - 2 degrees of freedom.

    It is the regularised incomplete beta I(1 - rho^2; (n - 2) / 2, 1 / 2), from the power series of its
    complement, or of itself where that converges faster.
    """
    if n < 3:
        return math.nan
    y = min(rho * rho, 1.0)

    def series(x: float, a: float, b: float) -> float:
        if x <= 0:
            return 0.0
        term = total = 1.0
        k = 0
        while term > total * 1e-17:
            term *= x * (a + b + k) / (a + 1 + k)
            total += term
            k += 1
        front = a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a + 1) - math.lgamma(b)
        return math.exp(front) * total

    half = (n - 2) / 2
    if y >= 1:
        return 0.0
    return max(0.0, 1 - series(y, 0.5, half)) if y < 0.5 else series(1 - y, half, 0.5)


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row: rank correlation and its two-sided p, null where either column is constant."""
    ranked = rows.withColumns({"_rx": average_rank(x, [F.lit(0)]), "_ry": average_rank(y, [F.lit(0)])})
    varied = (F.stddev_samp("_rx") > 0) & (F.stddev_samp("_ry") > 0)
    n = F.count("*")
    cov = F.avg(F.col("_rx") * F.col("_ry")) - F.avg("_rx") * F.avg("_ry")
    row = ranked.agg(n.alias("n"), F.when(varied, F.try_divide(cov, F.stddev_pop("_rx") * F.stddev_pop("_ry"))).alias("spearman_rho"))
    return row.withColumn("spearman_p", rank_survival(F.col("spearman_rho"), F.col("n")))
