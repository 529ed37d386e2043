"""Router and profile operators: activation counts, divergences, coverage and greedy selection.

Long form throughout: one row for each (class, layer, expert); an expert that was never chosen
is a zero row where a statistic needs it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import order_key
from ..functions.special import chi2_survival
from ..session import materialize, release
from .ranks import first_rows

EPS = 1e-10


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits."""
    from ..functions.text import let

    scaled = lambda x: let(F.array_max(x), lambda m: F.transform(x, lambda v: F.exp(v.cast("double") - m.cast("double"))))
    return let(scaled(logits), lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, v: a + v), lambda s: F.transform(e, lambda v: v / s)))


def entropy(probs: Column) -> Column:
    return F.aggregate(probs, F.lit(0.0), lambda a, p: a - p * F.ln(F.greatest(p, F.lit(1e-12))))


def chosen_experts(probs: Column, k: int) -> Column:
    """Numbers of the ``k`` most probable experts; the lower number of equals."""
    pairs = F.transform(probs, lambda p, i: F.struct((-p).alias("p"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda x: x["i"])


def observe(tokens: DataFrame, k: int = 6, by: tuple[str, ...] = ("corpus_class", "layer_index")) -> tuple[DataFrame, DataFrame]:
    """(counts, totals) of ``tokens`` (by..., logits): chosen experts a group, and tokens with their mean entropy."""
    p = tokens.select(*by, softmax(F.col("logits")).alias("p"))
    counts = (
        p.select(*by, F.explode_outer(chosen_experts(F.col("p"), k)).alias("expert_id"))
        .where("expert_id is not null")
        .groupBy(*by, "expert_id")
        .agg(F.count("*").alias("token_count"))
    )
    totals = p.select(*by, entropy(F.col("p")).alias("h")).groupBy(*by).agg(F.count("*").alias("n_tokens"), F.avg("h").alias("mean_routing_entropy"))
    return counts, totals


def zero_filled(counts: DataFrame, experts: int, by: tuple[str, ...]) -> DataFrame:
    """A row for every expert of every group; the expert list is a generated range."""
    groups = counts.select(*by).distinct()
    grid = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(experts - 1))).alias("expert_id"))
    return grid.join(counts, [*by, "expert_id"], "left").withColumn("token_count", F.coalesce("token_count", F.lit(0)))


def frequencies(counts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    total = F.sum("token_count").over(Window.partitionBy(*by))
    return counts.withColumn("activation_frequency", F.coalesce(F.try_divide("token_count", total), F.lit(0.0)))


def pairwise(counts: DataFrame, experts: int, top: int = 32) -> DataFrame:
    """Divergences of every two classes on each layer from ``counts`` (corpus_class, layer_index, expert_id, token_count).

    Smoothed KL both ways, Jensen-Shannon, top-``top`` Jaccard, chi-squared and Cramér's V over the
    experts that either class used; fewer than two such experts give 0.
    """
    by = ("corpus_class", "layer_index")
    full = frequencies(zero_filled(counts, experts, by), by)
    group = Window.partitionBy(*by)
    clipped = F.greatest(F.col("activation_frequency"), F.lit(EPS))
    full = full.withColumns(
        {
            "p": clipped / F.sum(clipped).over(group),
            "n": F.sum("token_count").over(group),
            "top": F.row_number().over(group.orderBy(F.col("activation_frequency").desc(), F.col("expert_id").desc())) <= top,
        }
    )
    left = full.select("layer_index", "expert_id", *[F.col(c).alias(f"{c}_a") for c in ("corpus_class", "p", "n", "top", "token_count")])
    right = full.select("layer_index", "expert_id", *[F.col(c).alias(f"{c}_b") for c in ("corpus_class", "p", "n", "top", "token_count")])
    # one row an expert for each pair of classes; classes are few
    both = left.join(right, ["layer_index", "expert_id"]).where("corpus_class_a < corpus_class_b")
    pa, pb, ca, cb = (F.col(c) for c in ("p_a", "p_b", "token_count_a", "token_count_b"))
    mid = (pa + pb) / 2
    used = (ca + cb) > 0
    whole = F.col("n_a") + F.col("n_b")
    ea, eb = (ca + cb) * F.col("n_a") / whole, (ca + cb) * F.col("n_b") / whole
    chi = F.when(used, F.try_divide((ca - ea) * (ca - ea), ea) + F.try_divide((cb - eb) * (cb - eb), eb))
    stats = both.groupBy(F.col("corpus_class_a").alias("class_a"), F.col("corpus_class_b").alias("class_b"), "layer_index").agg(
        F.sum(pa * F.ln(pa / pb)).alias("kl_a_to_b"),
        F.sum(pb * F.ln(pb / pa)).alias("kl_b_to_a"),
        (F.sum(pa * F.ln(pa / mid)) / 2 + F.sum(pb * F.ln(pb / mid)) / 2).alias("jensen_shannon"),
        F.try_divide(F.count_if(F.col("top_a") & F.col("top_b")), F.count_if(F.col("top_a") | F.col("top_b"))).alias("top32_jaccard"),
        F.count_if(used).alias("used_experts"),
        F.coalesce(F.sum(chi), F.lit(0.0)).alias("chi2_all"),
        F.max("n_a").alias("n_tokens_a"),
        F.max("n_b").alias("n_tokens_b"),
    )
    chi2 = F.when(F.col("used_experts") >= 2, F.col("chi2_all")).otherwise(F.lit(0.0))
    return stats.withColumn("chi2", chi2).withColumns(
        {
            "cramers_v": F.coalesce(F.sqrt(F.try_divide("chi2", F.col("n_tokens_a") + F.col("n_tokens_b"))), F.lit(0.0)),
            "p_value": chi2_survival(F.col("chi2"), F.col("used_experts") - 1),
        }
    )


def chi2_p_value(chi2: float, dof: int) -> float:
    """Survival function of chi-squared for one value: the regularised upper incomplete gamma Q(dof/2, chi2/2)."""
    a, x = dof / 2, chi2 / 2
    if dof <= 0 or x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return min(1.0, scale * h)


def routing_gate(pairs: DataFrame, languages: list[str], control: str, min_v: float = 0.05, max_jaccard: float = 0.95) -> DataFrame:
    """One row: do the languages route differently from the control class?"""
    a, b = F.col("class_a"), F.col("class_b")
    kept = pairs.where((a.isin(languages) & (b == control)) | (b.isin(languages) & (a == control)))
    row = kept.agg(F.count("*").alias("n_comparisons"), F.max("cramers_v").alias("max_cramers_v"), F.avg("top32_jaccard").alias("mean_jaccard"), F.min("p_value").alias("min_p_value"))
    differs = (F.col("max_cramers_v") >= min_v) | (F.col("mean_jaccard") <= max_jaccard)
    return row.withColumns(
        {
            "status": F.when(F.col("n_comparisons") == 0, "indeterminate").when(differs, "differs").otherwise("same"),
            "weakened": F.when(F.col("n_comparisons") == 0, True).otherwise(~differs),
        }
    )


# ---------------------------------------------------------------------------- profiles


def document_profiles(profiles: DataFrame) -> DataFrame:
    """(doc_id, expert_id, tokens) summed over layers."""
    return profiles.groupBy("doc_id", "expert_id").agg(F.sum("token_count").alias("tokens"))


def expert_totals(profiles: DataFrame, experts: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Zero-filled (by..., expert_id, tokens)."""
    spark = profiles.sparkSession
    sums = profiles.groupBy(*by, "expert_id").agg(F.sum("tokens").alias("tokens"))
    if by:
        grid = profiles.select(*by).distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(experts - 1))).alias("expert_id"))
    else:
        grid = spark.range(experts).select(F.col("id").cast("int").alias("expert_id"))
    return grid.join(sums, [*by, "expert_id"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))


def gini(values: str, by: list[str]) -> tuple[Column, Column]:
    """(rank column, aggregate) for the Gini coefficient of ``values`` within ``by`` groups."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(values))
    n = F.count("*")
    agg = F.when(F.sum(values) > 0, 2 * F.sum(F.col("_i") * F.col(values)) / (n * F.sum(values)) - (n + 1) / n).otherwise(F.lit(0.0))
    return rank, agg


def coverage_stats(selected: DataFrame, profiles: DataFrame, experts: int, by: tuple[str, ...], floor: float = 0.9) -> DataFrame:
    """One row for each ``by`` group of ``selected`` (by..., doc_id): what the chosen documents cover.

    ``comparable`` says that at least ``floor`` of the documents have profiles; a group without any
    is unmeasured: its statistics are null.
    """
    chosen = selected.select(*by, "doc_id").distinct()
    sizes = chosen.groupBy(*by).agg(F.count("*").alias("n_selected"))
    covered = chosen.join(profiles, "doc_id")
    profiled = covered.groupBy(*by).agg(F.countDistinct("doc_id").alias("n_docs_with_profile"))
    totals = expert_totals(covered, experts, by)
    rank, coefficient = gini("tokens", list(by))
    pct = lambda q: F.percentile("tokens", F.lit(q))
    stats = totals.withColumn("_i", rank).groupBy(*by).agg(
        F.min("tokens").alias("min_expert_tokens"),
        pct(0.1).alias("p10_expert_tokens"),
        pct(0.5).alias("median_expert_tokens"),
        F.avg("tokens").alias("mean_expert_tokens"),
        F.max("tokens").alias("max_expert_tokens"),
        F.avg((F.col("tokens") == 0).cast("double")).alias("frac_experts_unseen"),
        coefficient.alias("gini_coefficient"),
    )
    share = F.coalesce("n_docs_with_profile", F.lit(0)) / F.col("n_selected")
    return (
        sizes.join(profiled, list(by), "left")
        .join(stats, list(by), "left")
        .withColumns(
            {
                "n_docs_with_profile": F.coalesce("n_docs_with_profile", F.lit(0)),
                "profile_coverage_frac": share,
                "min_expert_tokens_per_profiled_doc": F.try_divide("min_expert_tokens", F.col("n_docs_with_profile")),
                "comparable": share >= floor,
            }
        )
    )


def coverage_curve(profiles: DataFrame, counts: list[int], experts: int, seed: int = 42, trials: int = 5) -> DataFrame:
    """Mean and deviation over seeded trials of what ``n`` documents cover, for each n of ``counts``."""
    docs = profiles.select("doc_id").distinct()
    drawn = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    key = order_key(seed, "curve", F.col("trial").cast("string"), F.col("doc_id").cast("string"))
    # the largest sample of each trial, then ranks within it
    most = first_rows(drawn, ["trial"], key, ["doc_id"], max(counts))
    ranked = most.withColumn("_r", F.row_number().over(Window.partitionBy("trial").orderBy(key, "doc_id")))
    sizes = F.array(*[F.lit(n) for n in counts])
    samples = ranked.select("doc_id", "trial", F.explode(F.filter(sizes, lambda n: n >= F.col("_r"))).alias("n_samples"))
    enough = ranked.groupBy("trial").agg(F.max("_r").alias("_have"))
    totals = expert_totals(samples.join(profiles, "doc_id"), experts, ("n_samples", "trial"))
    per = totals.groupBy("n_samples", "trial").agg(
        F.min("tokens").alias("low"), F.percentile("tokens", F.lit(0.1)).alias("p10"), F.avg((F.col("tokens") == 0).cast("double")).alias("zero")
    )
    return (
        per.join(enough, "trial")
        .where("_have >= n_samples")
        .groupBy("n_samples")
        .agg(
            F.avg("low").alias("min_expert_tokens_mean"),
            F.stddev_samp("low").alias("min_expert_tokens_std"),
            F.avg("p10").alias("p10_expert_tokens_mean"),
            F.stddev_samp("p10").alias("p10_expert_tokens_std"),
            F.avg("zero").alias("frac_experts_unseen_mean"),
            F.count("*").alias("n_trials"),
        )
    )


def saturation(profiles: DataFrame, n: int, experts: int) -> float:
    """The larger of 1 and ``n`` times the mean document's tokens over the experts; ``profiles`` is (doc_id, expert_id, tokens)."""
    per = profiles.where(F.col("expert_id").between(0, experts - 1)).groupBy("doc_id").agg(F.sum("tokens").alias("t"))
    row = per.agg(F.count("*").alias("docs"), F.sum("t").alias("tokens")).first()
    return max(1.0, n * float(row.tokens) / row.docs / experts) if row.docs else 1.0


def greedy_order(
    profiles: list[list[float]],
    n: int,
    saturation: float | None = None,
    covered: list[float] | None = None,
    bound: tuple[float, int] | None = None,
    ids: list[int] | None = None,
) -> list[dict]:
    """Coverage-greedy picks of dense ``profiles`` and their trace, by lazy evaluation.

    Gain is the sum over experts of min(cover + profile, tau) - min(cover, tau), with tau the
    larger of 1 and n times the mean document's tokens over the experts; the lower document wins ties.
    ``covered`` is what earlier picks cover; picks end before one that does not come before
    ``bound`` (gain, id) in that order, with ``ids`` those of the documents.
    """
    import heapq

    p = np.asarray(profiles, dtype=float)
    docs, experts = p.shape
    tau = max(1.0, n * p.sum() / docs / experts) if saturation is None else saturation
    cover = np.zeros(experts) if covered is None else np.array(covered, dtype=float)
    # rounded, so that equal gains are equal whatever order they were summed in
    gain = lambda d: round(float((np.minimum(cover + p[d], tau) - np.minimum(cover, tau)).sum()), 9)
    heap = list(zip((-(np.minimum(cover + p, tau) - np.minimum(cover, tau)).sum(axis=1).round(9)).tolist(), range(docs), [0] * docs, strict=True))
    heapq.heapify(heap)
    out, rescored = [], 0
    while heap and len(out) < min(n, docs):
        value, d, stamp = heapq.heappop(heap)
        if stamp < len(out):
            rescored += 1
            heapq.heappush(heap, (-gain(d), d, len(out)))
            continue
        if bound is not None and (value, ids[d]) > (-bound[0], bound[1]):
            break
        cover += p[d]
        out.append(
            {
                "step": len(out),
                "doc_index": d,
                "min_coverage": float(cover.min()),
                "p10_coverage": float(np.percentile(cover, 10)),
                "mean_coverage": float(cover.mean()),
                "saturated_coverage": float(np.minimum(cover, tau).sum()),
                "experts_unseen": int((cover == 0).sum()),
                "rescored": rescored,
            }
        )
        rescored = 0
    return out


_TRACE = "step long, doc_id long, min_coverage double, p10_coverage double, mean_coverage double, saturated_coverage double, experts_unseen long, rescored long"


def _dense(column, experts: int) -> np.ndarray:
    """Rows of (expert, tokens) lists as rows x experts; experts outside the range count for nothing."""
    out = np.zeros((len(column), experts))
    for i, cells in enumerate(column):
        for cell in cells:
            if 0 <= cell["expert_id"] < experts:
                out[i, cell["expert_id"]] += cell["tokens"]
    return out


def coverage_greedy(profiles: DataFrame, experts: int, n: int, per_task: int = 20_000) -> DataFrame:
    """Trace of ``n`` exact greedy picks among all documents of ``profiles`` (doc_id, expert_id, tokens).

    Up to ``per_task`` documents are one task's lazy greedy. Of more, all tasks score their own
    documents against what is covered, and the ``per_task`` best compete in one task: as gains only
    fall, a pick that gains more than the best of the others was scored is that of all. Where none
    does any more, all are scored again. No task holds more than about ``per_task`` profiles.
    """
    pool = materialize(profiles.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("expert_id", "tokens"))).alias("cells")), "profiles")
    tau = saturation(pool.select("doc_id", F.explode("cells").alias("x")).select("doc_id", "x.*"), n, experts)
    names = [c.split()[0] for c in _TRACE.split(", ")]
    made: list[dict] = []

    def traced(covered: list[float], gone: int, bound: tuple[float, int] | None):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("doc_id", ignore_index=True)
            ids = [int(d) for d in pdf["doc_id"]]
            rows = greedy_order(_dense(pdf["cells"], experts), n - gone, tau, covered, bound, ids) if ids else []
            named = [{**{k: v for k, v in r.items() if k != "doc_index"}, "doc_id": ids[r["doc_index"]], "step": r["step"] + gone} for r in rows]
            return pd.DataFrame(named, columns=names)

        return run

    left = pool.count()
    if left <= per_task:
        return pool.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(traced([0.0] * experts, 0, None), _TRACE)
    kind = dict(pool.dtypes)["cells"]
    while len(made) < min(n, left):
        taken = [r["doc_id"] for r in made]  # at most n
        cover = np.zeros(experts)
        if taken:
            for row in pool.where(F.col("doc_id").isin(taken)).collect():
                cover += _dense([row.cells], experts)[0]

        def score(batches, cover=cover, taken=frozenset(taken)):
            for pdf in batches:
                p = _dense(pdf["cells"], experts)
                gain = (np.minimum(cover + p, tau) - np.minimum(cover, tau)).sum(axis=1).round(9)
                yield pdf.assign(gain=gain)[~pdf["doc_id"].isin(taken)]

        scored = materialize(pool.mapInPandas(score, f"doc_id long, cells {kind}, gain double"), "scored")
        best = materialize(scored.orderBy(F.desc("gain"), "doc_id").limit(per_task + 1), "best")
        edge = best.orderBy("gain", F.desc("doc_id")).select("gain", "doc_id").first()
        bound = (edge.gain, edge.doc_id) if best.count() > per_task else None
        rows = best.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(traced(cover.tolist(), len(made), bound), _TRACE).orderBy("step").collect()
        made += [r.asDict() for r in rows]
        release(scored)
        release(best)
    return profiles.sparkSession.createDataFrame([tuple(r[c] for c in names) for r in made], _TRACE)
