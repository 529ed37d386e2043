"""Queries over ``embeddings``, ``lineitem``, ``events``, ``labels``, ``orders`` and ``part``.

The tables stand in for router logits, sparse expert profiles, load tests, results, runs and
modules. Comments name the survey ids a query covers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus
from ..operators import evalstats as ev
from ..operators import recipes as rc
from ..operators import routing as rt
from ..functions import draws as dw
from ..functions import text as tx
from ..session import table
from ..sources import artifacts
from .corpus_queries import SPLIT, parted

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
EXPERTS = 64


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, *but: str) -> DataFrame:
    """Doubles to six places."""
    return df.select(*[F.round(c, 6).alias(c) if k == "double" and c not in but else F.col(c) for c, k in df.dtypes])


# ------------------------------------------------------------------------------- routing


def router_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("corpus_class"), (F.col("vec_id") % 2).cast("int").alias("layer_index"), "vec_id", F.col("embedding").alias("logits")
    )


ROUTER = """
tok AS (SELECT vec_id, 'c' || label AS corpus_class, (vec_id % 2)::INT AS layer_index, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
ex AS (SELECT vec_id, corpus_class, layer_index, list_transform(x, lambda v: exp(v - list_max(x))) AS e FROM tok),
pr AS (SELECT vec_id, corpus_class, layer_index, list_transform(e, lambda v: v / list_sum(e)) AS p FROM ex),
lng AS (SELECT vec_id, corpus_class, layer_index, unnest(p) AS p, unnest(range(len(p)))::INT AS expert_id FROM pr),
top AS (SELECT * FROM lng QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, expert_id) <= 6),
cnt AS (SELECT corpus_class, layer_index, expert_id, count(*) AS token_count FROM top GROUP BY ALL),
ent AS (SELECT corpus_class, layer_index, count(DISTINCT vec_id) AS n_tokens, -sum(p * ln(greatest(p, 1e-12))) / count(DISTINCT vec_id) AS mean_routing_entropy FROM lng GROUP BY ALL)"""


@register("router_topk_counts", f"WITH {ROUTER} SELECT * FROM cnt")
def router_topk_counts(spark, sf_dir):  # A5 W3 M8 A8
    return rt.observe(router_tokens(spark, sf_dir))[0]


@register(
    "router_frequency",
    f"WITH {ROUTER} SELECT *, round(token_count / sum(token_count) OVER (PARTITION BY corpus_class, layer_index), 6) AS activation_frequency FROM cnt",
)
def router_frequency(spark, sf_dir):  # A6 W5
    return rounded(rt.frequencies(rt.observe(router_tokens(spark, sf_dir))[0], ("corpus_class", "layer_index")))


@register("router_entropy", f"WITH {ROUTER} SELECT corpus_class, layer_index, n_tokens, round(mean_routing_entropy, 6) AS mean_routing_entropy FROM ent")
def router_entropy(spark, sf_dir):  # A7 M8
    return rounded(rt.observe(router_tokens(spark, sf_dir))[1])


PAIRS = f"""{ROUTER},
grid AS (SELECT g.*, e.expert_id, coalesce(c.token_count, 0) AS n FROM (SELECT DISTINCT corpus_class, layer_index FROM cnt) g, (SELECT unnest(range({EXPERTS}))::INT AS expert_id) e
  LEFT JOIN cnt c ON c.corpus_class = g.corpus_class AND c.layer_index = g.layer_index AND c.expert_id = e.expert_id),
f AS (SELECT *, greatest(n / sum(n) OVER w, 1e-10) AS q, sum(n) OVER w AS tot, n / sum(n) OVER w AS fr FROM grid WINDOW w AS (PARTITION BY corpus_class, layer_index)),
d AS (SELECT *, q / sum(q) OVER w AS p, row_number() OVER (PARTITION BY corpus_class, layer_index ORDER BY fr DESC, expert_id DESC) <= 32 AS top FROM f WINDOW w AS (PARTITION BY corpus_class, layer_index)),
j AS (SELECT a.corpus_class AS class_a, b.corpus_class AS class_b, a.layer_index, a.p AS pa, b.p AS pb, a.n AS ca, b.n AS cb, a.tot AS na, b.tot AS nb, a.top AS ta, b.top AS tb
  FROM d a JOIN d b ON a.layer_index = b.layer_index AND a.expert_id = b.expert_id AND a.corpus_class < b.corpus_class),
pw AS (SELECT class_a, class_b, layer_index, sum(pa * ln(pa / pb)) AS kl_a_to_b, sum(pb * ln(pb / pa)) AS kl_b_to_a,
  sum(pa * ln(pa / ((pa + pb) / 2))) / 2 + sum(pb * ln(pb / ((pa + pb) / 2))) / 2 AS jensen_shannon,
  count(*) FILTER (ta AND tb) / count(*) FILTER (ta OR tb) AS top32_jaccard,
  CASE WHEN count(*) FILTER (ca + cb > 0) >= 2 THEN sum(power(ca - (ca + cb) * na / (na + nb), 2) / ((ca + cb) * na / (na + nb)) + power(cb - (ca + cb) * nb / (na + nb), 2) / ((ca + cb) * nb / (na + nb))) FILTER (ca + cb > 0) ELSE 0 END AS chi2,
  max(na)::BIGINT AS n_tokens_a, max(nb)::BIGINT AS n_tokens_b, (count(*) FILTER (ca + cb > 0) - 1) / 2 AS a, chi2 / 2 AS x FROM j GROUP BY ALL),
pv AS (SELECT *, sqrt(chi2 / (n_tokens_a + n_tokens_b)) AS cramers_v, CASE WHEN a <= 0 OR x <= 0 THEN 1 ELSE
  greatest(0, 1 - list_sum(list_transform(range(0, (4 * x + 1000)::BIGINT), lambda k: exp((a + k) * ln(x) - x - lgamma(a + k + 1))))) END AS p_value FROM pw)"""


@register(
    "routing_pairwise",
    f"WITH {PAIRS} SELECT class_a, class_b, layer_index, n_tokens_a, n_tokens_b, {', '.join(f'round({c}, 6) AS {c}' for c in ('kl_a_to_b', 'kl_b_to_a', 'jensen_shannon', 'top32_jaccard', 'chi2', 'cramers_v', 'p_value'))} FROM pv",
)
def routing_pairwise(spark, sf_dir):  # A11 A12 A13 M6 M7 J5 F9 O1
    return rounded(rt.pairwise(rt.observe(router_tokens(spark, sf_dir))[0], EXPERTS).drop("used_experts", "chi2_all"))


@register(
    "routing_gate",
    f"""WITH {PAIRS}, g AS (SELECT * FROM pv WHERE (class_a IN ('c1', 'c2', 'c3') AND class_b = 'c0') OR (class_b IN ('c1', 'c2', 'c3') AND class_a = 'c0')),
a AS (SELECT count(*) AS n_comparisons, round(max(cramers_v), 6) AS max_cramers_v, round(avg(top32_jaccard), 6) AS mean_jaccard, round(min(p_value), 6) AS min_p_value FROM g)
SELECT *, CASE WHEN n_comparisons = 0 THEN 'indeterminate' WHEN max_cramers_v >= 0.05 OR mean_jaccard <= 0.95 THEN 'differs' ELSE 'same' END AS status,
  NOT (n_comparisons > 0 AND (max_cramers_v >= 0.05 OR mean_jaccard <= 0.95)) AS weakened FROM a""",
)
def routing_gate(spark, sf_dir):  # A14 F8
    pairs = rt.pairwise(rt.observe(router_tokens(spark, sf_dir))[0], EXPERTS)
    return rounded(rt.routing_gate(pairs, ["c1", "c2", "c3"], "c0"))


# ------------------------------------------------------------------------------- profiles


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, corpus_class, layer_index, expert_id, token_count)."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        F.col("l_returnflag").alias("corpus_class"),
        F.col("l_linenumber").alias("layer_index"),
        (F.col("l_suppkey") % EXPERTS).cast("int").alias("expert_id"),
        F.col("l_quantity").cast("long").alias("token_count"),
    )


PROFILE = f"""
prof AS (SELECT l_orderkey AS doc_id, l_returnflag AS corpus_class, (l_suppkey % {EXPERTS})::INT AS expert_id, l_quantity::BIGINT AS token_count FROM lineitem),
dp AS (SELECT doc_id, expert_id, sum(token_count)::BIGINT AS tokens FROM prof GROUP BY ALL)"""


@register("profiles_dense", f"WITH {PROFILE} SELECT doc_id, string_agg(expert_id || ':' || tokens, ',' ORDER BY expert_id) AS profile FROM dp GROUP BY doc_id")
def profiles_dense(spark, sf_dir):  # A9 S17
    sums = rt.document_profiles(profiles(spark, sf_dir))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("expert_id", "tokens"))), lambda x: F.concat(x["expert_id"].cast("string"), F.lit(":"), x["tokens"].cast("string")))
    return sums.groupBy("doc_id").agg(F.array_join(cells, ",").alias("profile"))


COVER = f"""{PROFILE},
sel AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a' ELSE 'b' END AS variant FROM (SELECT DISTINCT doc_id FROM prof UNION SELECT -1)),
tot AS (SELECT v.variant, e.expert_id, coalesce(sum(t.tokens), 0)::BIGINT AS tokens FROM (SELECT DISTINCT variant FROM sel) v, (SELECT unnest(range({EXPERTS}))::INT AS expert_id) e
  LEFT JOIN (SELECT variant, expert_id, tokens FROM sel JOIN dp USING (doc_id)) t ON t.variant = v.variant AND t.expert_id = e.expert_id GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY tokens) AS i FROM tot),
st AS (SELECT variant, min(tokens) AS min_expert_tokens, quantile_cont(tokens, 0.1) AS p10_expert_tokens, quantile_cont(tokens, 0.5) AS median_expert_tokens, avg(tokens) AS mean_expert_tokens,
  max(tokens) AS max_expert_tokens, avg((tokens = 0)::INT::DOUBLE) AS frac_experts_unseen, 2 * sum(i * tokens) / (count(*) * sum(tokens)) - (count(*) + 1) / count(*) AS gini_coefficient FROM rk GROUP BY variant),
sz AS (SELECT variant, count(DISTINCT doc_id) AS n_selected, count(DISTINCT doc_id) FILTER (doc_id IN (SELECT doc_id FROM dp)) AS n_docs_with_profile FROM sel GROUP BY variant)"""


@register(
    "coverage_stats",
    f"""WITH {COVER} SELECT variant, n_selected, n_docs_with_profile, min_expert_tokens, max_expert_tokens,
  {', '.join(f'round({c}, 6) AS {c}' for c in ('p10_expert_tokens', 'median_expert_tokens', 'mean_expert_tokens', 'frac_experts_unseen', 'gini_coefficient'))},
  round(n_docs_with_profile / n_selected, 6) AS profile_coverage_frac, round(min_expert_tokens / n_docs_with_profile, 6) AS min_expert_tokens_per_profiled_doc, n_docs_with_profile / n_selected >= 0.9 AS comparable
FROM sz JOIN st USING (variant)""",
)
def coverage_stats(spark, sf_dir):  # A15 A16 A34 G15 J2 W6
    p = rt.document_profiles(profiles(spark, sf_dir))
    ids = p.select("doc_id").distinct().union(spark.range(1).select(F.lit(-1).cast("long")))
    chosen = ids.withColumn("variant", F.when(F.col("doc_id") % 3 == 0, "a").otherwise("b"))
    return rounded(rt.coverage_stats(chosen, p, EXPERTS, ("variant",)))


CURVE = ", ".join(f"({n})" for n in (16, 64, 256))


@register(
    "coverage_curve",
    f"""WITH {PROFILE}, tr AS (SELECT doc_id, t AS trial FROM (SELECT DISTINCT doc_id FROM dp), range(5) x(t)),
rn AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY md5('42|curve|' || trial || '|' || doc_id), doc_id) AS r FROM tr),
s AS (SELECT n AS n_samples, trial, doc_id FROM rn, (VALUES {CURVE}) v(n) WHERE r <= n),
tot AS (SELECT g.n_samples, g.trial, e.expert_id, coalesce(sum(t.tokens), 0) AS tokens FROM (SELECT DISTINCT n_samples, trial FROM s) g, (SELECT unnest(range({EXPERTS}))::INT AS expert_id) e
  LEFT JOIN (SELECT n_samples, trial, expert_id, tokens FROM s JOIN dp USING (doc_id)) t ON t.n_samples = g.n_samples AND t.trial = g.trial AND t.expert_id = e.expert_id GROUP BY ALL),
per AS (SELECT n_samples, trial, min(tokens)::DOUBLE AS low, quantile_cont(tokens::DOUBLE, 0.1) AS p10, avg((tokens = 0)::INT::DOUBLE) AS zero FROM tot GROUP BY ALL)
SELECT n_samples, round(avg(low), 6) AS min_expert_tokens_mean, round(stddev_samp(low), 6) AS min_expert_tokens_std, round(avg(p10), 6) AS p10_expert_tokens_mean,
  round(stddev_samp(p10), 6) AS p10_expert_tokens_std, round(avg(zero), 6) AS frac_experts_unseen_mean, count(*) AS n_trials FROM per GROUP BY n_samples""",
)
def coverage_curve(spark, sf_dir):  # A10 P7
    return rounded(rt.coverage_curve(rt.document_profiles(profiles(spark, sf_dir)), [16, 64, 256], EXPERTS))


def _greedy_sql(steps: int, pool: str) -> str:
    """The trace of ``steps`` exact picks; ``pool`` gives the candidates' doc_id, after the CTEs of ``PROFILE``."""
    ctes = [
        f"{PROFILE}",
        f"pool AS ({pool})",
        f"pp AS MATERIALIZED (SELECT dp.* FROM dp JOIN pool USING (doc_id))",
        f"tau AS (SELECT greatest(1, {steps}::DOUBLE * sum(tokens) / count(DISTINCT doc_id) / {EXPERTS}) AS t FROM pp)",
        f"c0 AS (SELECT unnest(range({EXPERTS}))::INT AS expert_id, 0::DOUBLE AS c)",
        "k0 AS (SELECT -1::BIGINT AS doc_id WHERE false)",
    ]
    outs = []
    for s in range(1, steps + 1):
        ctes.append(
            f"b{s} AS MATERIALIZED (SELECT doc_id, sum(least(c + tokens, t) - least(c, t)) AS g FROM pp JOIN c{s - 1} USING (expert_id), tau WHERE doc_id NOT IN (SELECT doc_id FROM k{s - 1}) GROUP BY doc_id ORDER BY round(g, 9) DESC, doc_id LIMIT 1)"
        )
        ctes.append(f"k{s} AS (SELECT doc_id FROM k{s - 1} UNION ALL SELECT doc_id FROM b{s})")
        ctes.append(f"c{s} AS MATERIALIZED (SELECT c.expert_id, c.c + coalesce(p.tokens, 0) AS c FROM c{s - 1} c LEFT JOIN (SELECT expert_id, tokens FROM pp WHERE doc_id = (SELECT doc_id FROM b{s})) p USING (expert_id))")
        outs.append(
            f"SELECT {s - 1}::BIGINT AS step, (SELECT doc_id FROM b{s}) AS doc_id, min(c) AS min_coverage, round(quantile_cont(c, 0.1), 6) AS p10_coverage, round(avg(c), 6) AS mean_coverage, round(sum(least(c, t)), 6) AS saturated_coverage, count(*) FILTER (c = 0) AS experts_unseen FROM c{s}, tau"
        )
    return "WITH " + ",\n".join(ctes) + "\n" + "\nUNION ALL ".join(outs)


def greedy_pool(spark: SparkSession, sf_dir: str, target: int) -> DataFrame:
    """Profiles of a class-balanced pool; an order's priority stands in for its class."""
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("corpus_class"), F.lit("train").alias("side"))
    sums = rt.document_profiles(profiles(spark, sf_dir))
    known = docs.join(sums.select("doc_id").distinct(), "doc_id", "left_semi")
    return sums.join(corpus.candidate_pool(known, target).select("doc_id"), "doc_id", "left_semi")


@register(
    "coverage_greedy_trace",
    _greedy_sql(
        8,
        """SELECT o_orderkey AS doc_id FROM orders WHERE o_orderkey IN (SELECT doc_id FROM dp)
QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42|pool|' || o_orderpriority || '|' || o_orderkey), o_orderkey) <= (SELECT floor(50000 / count(DISTINCT o_orderpriority)) FROM orders)""",
    ),
)
def coverage_greedy_trace(spark, sf_dir):  # I1 P3 M9 M10 W8 O8
    return rounded(rt.coverage_greedy(greedy_pool(spark, sf_dir, 50_000), EXPERTS, 8).drop("rescored"))


@register(
    "variant_coverage_greedy",
    f"""WITH {SPLIT}, picked AS ({_greedy_sql(16, f"""WITH {SPLIT} SELECT doc_id FROM split WHERE side = 'train' AND doc_id IN (SELECT doc_id FROM dp)
QUALIFY row_number() OVER (PARTITION BY corpus_class ORDER BY md5('42|pool|' || corpus_class || '|' || doc_id), doc_id) <= (SELECT floor(50000 / count(DISTINCT corpus_class)) FROM split WHERE side = 'train')""")})
SELECT split.*, 'coverage_greedy' AS variant, false AS contaminated FROM split WHERE doc_id IN (SELECT doc_id FROM picked)""",
)
def variant_coverage_greedy(spark, sf_dir):  # P4 I1
    return corpus.variant(parted(spark, sf_dir), "coverage_greedy", 16, profiles=rt.document_profiles(profiles(spark, sf_dir)), experts=EXPERTS)


@register(
    "expert_language_pivot",
    f"""WITH {PROFILE}, w AS (SELECT expert_id, coalesce(sum(token_count) FILTER (corpus_class = 'N'), 0)::BIGINT AS english, coalesce(sum(token_count) FILTER (corpus_class = 'A'), 0)::BIGINT AS malay,
  coalesce(sum(token_count) FILTER (corpus_class = 'R'), 0)::BIGINT AS other FROM prof GROUP BY 1),
s AS (SELECT *, malay / sum(malay) OVER () AS mf, english / sum(english) OVER () AS ef FROM w)
SELECT expert_id, english, malay, other, round(mf, 6) AS malay_frequency, round(ef, 6) AS english_frequency, round(mf - ef, 6) AS malay_preference, round(ln((mf + 1e-12) / (ef + 1e-12)), 6) AS log_ratio FROM s""",
)
def expert_language_pivot(spark, sf_dir):  # A24 M21 W5
    return rounded(_preference(profiles(spark, sf_dir)))


def _preference(p: DataFrame) -> DataFrame:
    bucket = F.when(F.col("corpus_class") == "N", "english").when(F.col("corpus_class") == "A", "malay").otherwise("other")
    shares = ev.language_shares(p.withColumn("lang", bucket), "expert_id", "lang", ["english", "malay", "other"], "token_count")
    m, e = F.col("malay_share"), F.col("english_share")
    return shares.select(
        "expert_id", "english", "malay", "other", m.alias("malay_frequency"), e.alias("english_frequency"), (m - e).alias("malay_preference"), F.ln((m + 1e-12) / (e + 1e-12)).alias("log_ratio")
    )


@register(
    "top_preferences",
    f"""WITH {PROFILE}, w AS (SELECT expert_id, sum(token_count) FILTER (corpus_class = 'A') AS m, sum(token_count) FILTER (corpus_class = 'N') AS e FROM prof GROUP BY 1),
s AS (SELECT expert_id, round(coalesce(m, 0) / sum(m) OVER () - coalesce(e, 0) / sum(e) OVER (), 6) AS malay_preference FROM w) SELECT * FROM s ORDER BY malay_preference DESC, expert_id LIMIT 30""",
)
def top_preferences(spark, sf_dir):  # O2 O6
    return rounded(_preference(profiles(spark, sf_dir)).select("expert_id", "malay_preference")).orderBy(F.col("malay_preference").desc(), "expert_id").limit(30)


@register(
    "expert_spearman",
    f"""WITH {PROFILE}, w AS (SELECT expert_id, coalesce(sum(token_count) FILTER (corpus_class = 'A'), 0) AS m, coalesce(sum(token_count) FILTER (corpus_class = 'N'), 0) AS e FROM prof GROUP BY 1),
r AS (SELECT rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2 AS rx, rank() OVER (ORDER BY e) + (count(*) OVER (PARTITION BY e) - 1) / 2 AS ry FROM w)
, c AS (SELECT count(*) AS n, corr(rx, ry) AS rho FROM r), b AS (SELECT *, rho * rho AS y, (n - 2) / 2 AS h FROM c)
SELECT n, round(rho, 6) AS spearman_rho, round(1 - list_sum(list_transform(range(0, 20000), lambda k: exp(0.5 * ln(y) + h * ln(1 - y) + lgamma(h + 0.5 + k) + k * ln(y) - lgamma(1.5 + k) - lgamma(h)))), 6) AS spearman_p FROM b""",
)
def expert_spearman(spark, sf_dir):  # A25 W7
    return rounded(ev.spearman(_preference(profiles(spark, sf_dir)), "malay", "english"))


@register(
    "starved_experts",
    f"""WITH {PROFILE}, w AS (SELECT expert_id, coalesce(sum(token_count) FILTER (corpus_class = 'A'), 0) AS m, coalesce(sum(token_count) FILTER (corpus_class = 'N'), 0) AS e FROM prof GROUP BY 1),
s AS (SELECT m / sum(m) OVER () AS mf, e / sum(e) OVER () AS ef, m FROM w) SELECT count(*) AS n_starved, coalesce(sum(m), 0)::BIGINT AS malay_tokens FROM s WHERE mf - ef > 0 AND ef < 0.015""",
)
def starved_experts(spark, sf_dir):  # F11
    return _preference(profiles(spark, sf_dir)).where("malay_preference > 0 and english_frequency < 0.015").agg(
        F.count("*").alias("n_starved"), F.coalesce(F.sum("malay"), F.lit(0)).alias("malay_tokens")
    )


# ------------------------------------------------------------------------- token KL and scores

K = 16


def kl_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token KL of each vector against its rounded self."""
    e = table(spark, sf_dir, "embeddings")
    coarse = F.transform("embedding", lambda v: F.round(v.cast("double"), 1))
    both = e.select("vec_id", "label", ev.top_logprobs(F.col("embedding"), K).alias("r"), ev.top_logprobs(coarse, K).alias("c"))
    return both.select("vec_id", "label", ev.token_kl(F.col("r"), F.col("c")).alias("k")).select(
        "vec_id", "label", F.when(F.col("label") < 5, "bm").otherwise("en").alias("side"), "k.kl", "k.tail"
    )


KL = f"""
x AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS r, list_transform(embedding, lambda v: round(v::DOUBLE, 1)) AS c FROM embeddings),
z AS (SELECT *, list_max(r) + ln(list_sum(list_transform(r, lambda v: exp(v - list_max(r))))) AS zr, list_max(c) + ln(list_sum(list_transform(c, lambda v: exp(v - list_max(c))))) AS zc FROM x),
lr AS (SELECT vec_id, label, unnest(range(len(r))) AS id, unnest(r) - zr AS lp FROM z),
lc AS (SELECT vec_id, unnest(range(len(c))) AS id, unnest(c) - zc AS lp FROM z),
tr AS (SELECT * FROM lr QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY lp DESC, id) <= {K}),
tc AS (SELECT * FROM lc QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY lp DESC, id) <= {K}),
mr AS (SELECT vec_id, greatest(0, least(1, 1 - sum(exp(lp)))) AS t FROM tr GROUP BY 1), mc AS (SELECT vec_id, greatest(0, least(1, 1 - sum(exp(lp)))) AS t FROM tc GROUP BY 1),
kl AS (SELECT tr.vec_id, label, CASE WHEN label < 5 THEN 'bm' ELSE 'en' END AS side,
  sum(exp(tr.lp) * ln(exp(tr.lp) / greatest(coalesce(exp(tc.lp), greatest(mc.t, 1e-12) / {K * K}), 1e-12))) AS kl, max(greatest(mr.t, mc.t)) AS tail
  FROM tr LEFT JOIN tc ON tr.vec_id = tc.vec_id AND tr.id = tc.id JOIN mr ON mr.vec_id = tr.vec_id JOIN mc ON mc.vec_id = tr.vec_id GROUP BY ALL)"""


@register("token_kl", f"WITH {KL} SELECT vec_id, label, side, round(kl, 6) AS kl, round(tail, 6) AS tail FROM kl")
def token_kl(spark, sf_dir):  # A18 M5 J3 J4 W4
    return rounded(kl_rows(spark, sf_dir))


SUMMARY = "count(*) AS n_tokens, round(avg(kl), 6) AS kl_mean, round(coalesce(stddev_samp(kl), 0), 6) AS kl_std, round(coalesce(stddev_samp(kl), 0) / sqrt(count(*)), 6) AS kl_sem, round(avg(tail), 6) AS mean_tail_mass, round(max(tail), 6) AS max_tail_mass, round(quantile_cont(kl, 0.5), 6) AS kl_p50, round(quantile_cont(kl, 0.99), 6) AS kl_p99"


@register("kl_summary", f"WITH {KL} SELECT side, {SUMMARY} FROM kl GROUP BY side")
def kl_summary(spark, sf_dir):  # A19 R2
    return rounded(ev.kl_summary(kl_rows(spark, sf_dir), ["side"]))


@register("kl_per_class", f"WITH {KL} SELECT label, {SUMMARY} FROM kl GROUP BY label")
def kl_per_class(spark, sf_dir):  # A21
    return rounded(ev.kl_summary(kl_rows(spark, sf_dir), ["label"]))


def interval_sql(rows: str, by: str, value: str, key: str, low: str, high: str, resamples: int = 200, tag: str = "") -> str:
    """Percentiles of the resampled means of ``rows`` (by, value, key as text) as CTE ends<tag>, with the same draws as the operator."""
    words = f"(SELECT {by}, {value}, b, ('0x' || substr(md5({key}), 1, 8))::BIGINT AS w0, ('0x' || substr(md5({key}), 9, 8))::BIGINT AS w1 FROM {rows}, range({resamples // 4}) t(b))"
    drawn = dw.philox_sql(words, ("w0", "w1", "b", "0"), dw.scope(0, "bootstrap"), f"{by}, {value}, b")
    return f"""drawn{tag} AS MATERIALIZED ({drawn}),
flat{tag} AS (SELECT {by}, {value}, 4 * b + unnest([0, 1, 2, 3]) AS r, unnest([c0, c1, c2, c3]) AS w FROM drawn{tag}),
weighed{tag} AS (SELECT {by}, {value}, r, {' + '.join(f'(w >= {s})::INT' for s in dw.poisson_steps())} AS n FROM flat{tag}),
means{tag} AS (SELECT {by}, r, sum(n * {value}) / nullif(sum(n), 0) AS m FROM weighed{tag} GROUP BY ALL),
ends{tag} AS (SELECT {by}, quantile_cont(m, 0.025) AS {low}, quantile_cont(m, 0.975) AS {high} FROM means{tag} GROUP BY ALL)"""


@register(
    "kl_intervals",
    f"""WITH {KL}, {interval_sql("kl", "side", "kl", "vec_id::VARCHAR", "ci_low", "ci_high")} SELECT side, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM ends""",
)
def kl_intervals(spark, sf_dir):  # A19 A20 P6 M2
    return rounded(ev.bootstrap_interval(kl_rows(spark, sf_dir), ["side"], "kl", resamples=200, key=["vec_id"]))


@register(
    "kl_delta_interval",
    f"""WITH {KL}, pairs AS (SELECT 'all' AS grp, vec_id >> 1 AS pair, avg(kl) FILTER (vec_id % 2 = 0) - avg(kl) FILTER (vec_id % 2 = 1) AS d FROM kl GROUP BY ALL),
{interval_sql("(SELECT * FROM pairs WHERE d IS NOT NULL)", "grp", "d", "grp || '|' || pair", "lo", "hi")}
SELECT grp, round(lo, 6) AS bm_en_delta_ci_low, round(hi, 6) AS bm_en_delta_ci_high, lo > 0 OR hi < 0 AS delta_excludes_zero FROM ends""",
)
def kl_delta_interval(spark, sf_dir):  # A20 M2
    # neighbouring vectors stand in for the two sides of an aligned pair
    rows = kl_rows(spark, sf_dir).withColumns({"side": F.when(F.col("vec_id") % 2 == 0, "bm").otherwise("en"), "pair": F.shiftright("vec_id", 1)})
    return rounded(ev.paired_interval(rows.withColumn("grp", F.lit("all")), "side", "bm", "en", "pair", ["grp"], resamples=200))


@register(
    "kl_delta",
    f"""WITH {KL}, m AS (SELECT (label % 5)::INT AS grp, avg(kl) FILTER (side = 'bm') AS b, avg(kl) FILTER (side = 'en') AS e, count(*) FILTER (side = 'bm') AS n_bm_tokens, count(*) FILTER (side = 'en') AS n_en_tokens FROM kl GROUP BY 1)
SELECT grp, round(b, 6) AS bm_kl_mean, round(e, 6) AS en_kl_mean, n_bm_tokens, n_en_tokens, round(b - e, 6) AS bm_en_delta, round(CASE WHEN e > 0 THEN b / e END, 6) AS bm_en_ratio FROM m""",
)
def kl_delta(spark, sf_dir):  # A20
    rows = kl_rows(spark, sf_dir).withColumn("grp", (F.col("label") % 5).cast("int"))
    return rounded(ev.kl_delta(rows, "side", "bm", "en", ["grp"]))


@register(
    "perplexity_by_class",
    "SELECT event_type AS corpus_class, round(exp(least(avg(value / 50), 70)), 6) AS perplexity, round(avg(value / 50), 6) AS mean_nll, round(coalesce(stddev_samp(value / 50), 0), 6) AS nll_std, count(*) AS n_tokens FROM events WHERE value IS NOT NULL GROUP BY 1",
)
def perplexity_by_class(spark, sf_dir):  # A22 M18 R4 F15
    return rounded(ev.perplexity(_nll(spark, sf_dir), ["corpus_class"]))


def _nll(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("corpus_class"), (F.col("value") / 50).alias("nll"), "user_id")


@register(
    "ppl_delta",
    """WITH a AS (SELECT event_type AS corpus_class, avg(value / 50) AS n FROM events GROUP BY 1), b AS (SELECT event_type AS corpus_class, avg(value / 50) AS n FROM events WHERE user_id % 2 = 0 AND event_type <> (SELECT min(event_type) FROM events) GROUP BY 1)
SELECT a.corpus_class, round(exp(a.n), 6) AS perplexity, round(exp(b.n), 6) AS reference_perplexity, round(exp(a.n) - exp(b.n), 6) AS ppl_delta, round(100 * (exp(a.n) - exp(b.n)) / exp(b.n), 6) AS ppl_delta_pct, round(a.n - b.n, 6) AS nll_delta FROM a LEFT JOIN b USING (corpus_class)""",
)
def ppl_delta(spark, sf_dir):  # J7 M19 S26
    rows = _nll(spark, sf_dir)
    first = rows.agg(F.min("corpus_class")).first()[0]
    ref = ev.perplexity(rows.where((F.col("user_id") % 2 == 0) & (F.col("corpus_class") != first)), ["corpus_class"])
    return rounded(ev.perplexity_delta(ev.perplexity(rows, ["corpus_class"]), ref, "corpus_class").drop("mean_nll", "nll_std", "n_tokens"))


@register(
    "accuracy_by_group",
    "SELECT lang, count(*) AS n, round(avg(quality), 6) AS quality_accuracy, round(sqrt(avg(quality) * (1 - avg(quality)) / count(quality)), 6) AS quality_se, round(avg(toxic), 6) AS toxic_accuracy, round(sqrt(avg(toxic) * (1 - avg(toxic)) / count(toxic)), 6) AS toxic_se FROM labels JOIN documents USING (doc_id) GROUP BY lang",
)
def accuracy_by_group(spark, sf_dir):  # A23 M20 R6
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rounded(ev.accuracy(rows, ["lang", "no_such_key"], ["quality", "toxic"]))


@register("mc_first_token", "SELECT vec_id, (list_position(embedding[1:4], list_max(embedding[1:4])) - 1)::INT AS best, chr(65 + list_position(embedding[1:4], list_max(embedding[1:4])) - 1) AS letter FROM embeddings")
def mc_first_token(spark, sf_dir):  # O10
    best = ev.best_option(F.slice("embedding", 1, 4))
    return table(spark, sf_dir, "embeddings").select("vec_id", best.cast("int").alias("best"), F.char(best + 65).alias("letter"))


# ------------------------------------------------------------------------------- throughput


def throughput(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value is not null")
    return e.groupBy(F.col("event_type").alias("checkpoint"), (F.col("user_id") % 4).alias("concurrency")).agg(F.avg("value").alias("output_tokens_per_sec")).withColumn("measured_by", F.lit("probe"))


THROUGHPUT = "tp AS (SELECT event_type AS checkpoint, user_id % 4 AS concurrency, avg(value) AS v FROM events WHERE value IS NOT NULL GROUP BY ALL)"


@register(
    "throughput_regression",
    f"""WITH {THROUGHPUT}, ref AS (SELECT concurrency, v FROM tp WHERE checkpoint = (SELECT min(checkpoint) FROM tp) AND concurrency < 3)
SELECT tp.checkpoint, tp.concurrency, round(tp.v, 6) AS output_tokens_per_sec, 'probe' AS measured_by, round((tp.v - ref.v) / ref.v, 6) AS throughput_vs_reference, coalesce(abs((tp.v - ref.v) / ref.v) > 0.05, false) AS regression_flagged FROM tp LEFT JOIN ref USING (concurrency)""",
)
def throughput_regression(spark, sf_dir):  # J8 G14 R3 F13
    rows = throughput(spark, sf_dir)
    first = rows.agg(F.min("checkpoint")).first()[0]
    ref = rows.where((F.col("checkpoint") == first) & (F.col("concurrency") < 3))
    return rounded(ev.throughput_regression(rows, ref, ["concurrency"]))


@register(
    "loadtest_summary",
    """WITH r AS (SELECT event_type AS checkpoint, epoch(ts)::BIGINT AS s, value, event_id FROM events)
SELECT checkpoint, count(*) AS n_requests, round(sum(event_id % 100) / (max(s) - min(s)), 6) AS output_tokens_per_sec, round(count(*) / (max(s) - min(s)), 6) AS request_throughput, round(avg(value), 6) AS ttft_mean_ms, round(quantile_cont(value, 0.99), 6) AS ttft_p99_ms FROM r GROUP BY 1""",
)
def loadtest_summary(spark, sf_dir):  # A29
    at = F.col("ts").cast("timestamp").cast("long")
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("checkpoint"), at.alias("started_s"), at.alias("finished_s"), F.col("value").alias("latency_ms"), (F.col("event_id") % 100).alias("tokens"))
    return rounded(ev.loadtest_summary(e, ["checkpoint"]))


@register("state_arm", "SELECT CASE WHEN event_id % 2 = 0 THEN 'fp32' ELSE 'bf16' END AS state, user_id % 4 AS concurrency, round(avg(value), 6) AS mean_throughput FROM events GROUP BY ALL")
def state_arm(spark, sf_dir):  # A28 X5
    state = F.when(F.col("event_id") % 2 == 0, "fp32").otherwise("bf16")
    return rounded(table(spark, sf_dir, "events").groupBy(state.alias("state"), (F.col("user_id") % 4).alias("concurrency")).agg(F.avg("value").alias("mean_throughput")))


@register(
    "metric_flatten",
    "SELECT event_id, 'k' AS metric, json_extract(props, '$.k')::DOUBLE AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL",
)
def metric_flatten(spark, sf_dir):  # S22 S23 S24 T31 F14
    return artifacts.finite_metrics(artifacts.flatten_json(table(spark, sf_dir, "events"), "props", ["event_id"]))


# ------------------------------------------------------------------------------- decisions


HEAD = """h AS (SELECT CASE WHEN o_custkey % 2 = 0 THEN 'w4a4_mech' ELSE 'w4a16_ship' END AS family, CASE o_orderstatus WHEN 'O' THEN 'baseline_en' WHEN 'F' THEN 'oracle_contaminated' ELSE 'bm_only' END AS variant,
  o_totalprice / 100000 + CASE o_orderstatus WHEN 'O' THEN 0.3 ELSE 0 END AS d, o_orderkey AS checkpoint FROM orders)"""


def kl_results(spark, sf_dir) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.when(F.col("o_custkey") % 2 == 0, "w4a4_mech").otherwise("w4a16_ship").alias("family"),
        F.when(s == "O", "baseline_en").when(s == "F", "oracle_contaminated").otherwise("bm_only").alias("variant"),
        (F.col("o_totalprice") / 100000 + F.when(s == "O", 0.3).otherwise(0)).alias("bm_en_delta"),
        F.lit(True).alias("delta_excludes_zero"),
        F.col("o_orderkey").alias("checkpoint"),
    )


@register(
    "headroom",
    f"""WITH {HEAD}, m AS (SELECT family, avg(d) FILTER (variant = 'baseline_en') AS b, avg(d) FILTER (variant = 'oracle_contaminated') AS o FROM h GROUP BY 1)
SELECT family, round(b, 6) AS baseline_en, round(o, 6) AS oracle_contaminated, true AS baseline_significant, 'computed' AS status, round(b - o, 6) AS absolute_headroom, round((b - o) / abs(b), 6) AS relative_headroom, (b - o) / abs(b) >= 0.1 AS gate_open, family = 'w4a4_mech' AS preferred FROM m""",
)
def headroom(spark, sf_dir):  # A26 J9 M22
    return rounded(ev.headroom(kl_results(spark, sf_dir)))


@register("select_winner", f"WITH {HEAD} SELECT family, variant, round(d, 6) AS bm_en_delta, checkpoint FROM h WHERE variant <> 'oracle_contaminated' ORDER BY abs(d), checkpoint LIMIT 1")
def select_winner(spark, sf_dir):  # I5 F12 O4
    return rounded(ev.select_winner(kl_results(spark, sf_dir)).drop("delta_excludes_zero"))


@register("delta_by_variant", f"WITH {HEAD} SELECT variant, round(avg(d), 6) AS mean_delta FROM h GROUP BY variant ORDER BY variant, mean_delta DESC")
def delta_by_variant(spark, sf_dir):  # A27 O3
    return rounded(kl_results(spark, sf_dir).groupBy("variant").agg(F.avg("bm_en_delta").alias("mean_delta"))).orderBy("variant", F.col("mean_delta").desc())


@register(
    "runs_upsert",
    "SELECT o_orderstatus AS family, o_orderpriority AS variant, max(o_orderkey) AS seq, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY ALL",
)
def runs_upsert(spark, sf_dir):  # K7 W2 X1
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("family"), F.col("o_orderpriority").alias("variant"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("price"))
    return rc.upsert(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1").drop("price").join(rows.select("seq", "price"), "seq"), ["family", "variant"], "seq")


@register("union_by_name", "SELECT event_id, event_type, CASE WHEN event_id % 2 = 0 THEN value END AS value, CASE WHEN event_id % 2 = 1 THEN user_id END AS user_id FROM events")
def union_by_name(spark, sf_dir):  # S11 X1
    e = table(spark, sf_dir, "events")
    return e.where("event_id % 2 = 0").select("event_id", "event_type", "value").unionByName(
        e.where("event_id % 2 = 1").select("event_type", "user_id", "event_id"), allowMissingColumns=True
    )


MODULE = "concat('backbone.layers.', p_partkey % 24, CASE p_size % 5 WHEN 0 THEN '.mixer.gate' WHEN 1 THEN '.mixer.experts.' || p_size || '.up_proj' WHEN 2 THEN '.mixer.shared_experts.down_proj' WHEN 3 THEN '.self_attn.q_proj' ELSE '.lm_head' END)"


def modules(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(f"{MODULE} as name", "p_size % 7 = 0 as quantized", "p_partkey", "cast(p_size as long) as n_params", "p_brand as model")


@register(
    "pattern_audit",
    f"""WITH m AS (SELECT {MODULE} AS name, p_size % 7 = 0 AS q FROM part)
SELECT '*.mixer.gate' AS pattern, count(*) FILTER (name LIKE '%.mixer.gate%') AS n_matched, count(*) FILTER (name LIKE '%.mixer.gate%' AND q) AS n_violations, true AS router FROM m
UNION ALL SELECT '*experts.?.up_proj*', count(*) FILTER (name LIKE '%experts._.up_proj%'), count(*) FILTER (name LIKE '%experts._.up_proj%' AND q), false FROM m
UNION ALL SELECT 'lm_head', count(*) FILTER (name LIKE '%lm_head'), count(*) FILTER (name LIKE '%lm_head' AND q), false FROM m""",
)
def pattern_audit(spark, sf_dir):  # J13 G8 M11 M12
    return rc.pattern_audit(modules(spark, sf_dir), ["*.mixer.gate", "*experts.?.up_proj*", "lm_head"])


@register(
    "module_names",
    f"""WITH m AS (SELECT p_partkey, {MODULE} AS name FROM part)
SELECT p_partkey, regexp_matches(name, '\\.gate$') AS is_router, contains(name, 'expert') AND NOT contains(name, 'shared') AS is_expert,
  coalesce(list_filter(string_split(name, '.'), lambda p: regexp_full_match(p, '[0-9]+'))[-1]::INT, -1) AS layer FROM m""",
)
def module_names(spark, sf_dir):  # M13 M14 M16 B1
    n = F.col("name")
    return modules(spark, sf_dir).select("p_partkey", rc.is_router(n).alias("is_router"), rc.is_routed_expert(n).alias("is_expert"), rc.layer_index(n).alias("layer"))


@register(
    "module_census",
    f"""WITH m AS (SELECT p_brand AS model, {MODULE} AS name, p_size % 7 = 0 AS on_, p_size % 2 = 0 AS amax, p_size FROM part)
SELECT model, count(*) FILTER (on_) AS n_quantized_modules, count(*) FILTER (contains(name, 'expert') AND NOT contains(name, 'shared') AND p_size > 0) AS expert_carriers,
  count(*) FILTER (contains(name, 'expert') AND NOT contains(name, 'shared') AND p_size > 0 AND on_) AS experts_quantized, count(*) FILTER (NOT on_ OR NOT amax) AS n_fallback_layers FROM m GROUP BY 1""",
)
def module_census(spark, sf_dir):  # A30 A31 G9
    q = F.array(F.struct(F.col("quantized").alias("enabled"), (F.col("n_params") % 2 == 0).alias("has_amax")))
    return rc.module_census(modules(spark, sf_dir).withColumn("quantizers", q), ["model"])


@register("variant_labels", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'baseline_en' WHEN p_partkey % 3 = 1 THEN 'mixed_5050' END AS variant FROM part")
def variant_labels(spark, sf_dir):  # T29
    label = F.expr("case p_partkey % 3 when 0 then 'w4a16_baseline_en_1024' when 1 then 'w4a4_mixed_5050' else 'bf16_reference' end")
    return table(spark, sf_dir, "part").select("p_partkey", rc.variant_of(label, ["baseline_en", "bm_only", "mixed_5050", "mixed_weighted"]).alias("variant"))


@register(
    "run_matrix",
    "WITH f AS (SELECT DISTINCT r_name AS family FROM region), v AS (SELECT DISTINCT o_orderpriority AS variant FROM orders), c AS (SELECT unnest([256, 512, 1024])::BIGINT AS sample_count) SELECT * FROM f, v, c WHERE NOT (family = 'ASIA' AND sample_count = 256)",
)
def run_matrix(spark, sf_dir):  # R1
    families = table(spark, sf_dir, "region").select(F.col("r_name").alias("family")).distinct()
    variants = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("variant")).distinct()
    counts = spark.range(1).select(F.explode(F.array(*[F.lit(n).cast("long") for n in (256, 512, 1024)])).alias("sample_count"))
    done = families.where("family = 'ASIA'").join(F.broadcast(variants)).withColumn("sample_count", F.lit(256).cast("long"))
    return rc.run_matrix(families, variants, counts, done)


@register(
    "scalar_formats",
    "SELECT event_id, CASE WHEN value IS NULL THEN 'n/a' ELSE printf('%.4f', value) END AS shown, trim(regexp_replace(lower(event_type || ' (ms) #' || user_id), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM events",
)
def scalar_formats(spark, sf_dir):  # T30 T31 T32
    name = F.concat("event_type", F.lit(" (ms) #"), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", tx.format_scalar(F.col("value")).alias("shown"), tx.slug(name).alias("slug"))


# ------------------------------------------------------------------------- smaller operators


@register(
    "classifier_input",
    "SELECT doc_id, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 2000) AS cleaned, left(text, 64) AS head, ('0x' || substr(md5(left(text, 8)), 1, 8))::BIGINT & 2147483647 AS token_id FROM documents",
)
def classifier_input(spark, sf_dir):  # T13 T28 T34
    from ..functions.hashing import token_id

    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", tx.classifier_input(t).alias("cleaned"), F.substring(t, 1, 64).alias("head"), token_id(F.substring(t, 1, 8)).alias("token_id")
    )


@register("router_width_filter", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 2 AND 1024 AND (p_size = 16 OR NOT EXISTS (SELECT 1 FROM part WHERE p_size = 16))")
def router_width_filter(spark, sf_dir):  # F10 B1
    return rc.exact_width(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", 16)


@register(
    "context_clamp",
    "SELECT p_partkey, least(4096, CASE WHEN p_size * 100 - 500 > 0 THEN p_size * 100 - 500 ELSE 4096 END) AS context, coalesce(CASE WHEN p_size % 4 > 1 THEN p_size % 4 END, CASE WHEN p_size > 1 THEN p_size END, 8) AS experts FROM part",
)
def context_clamp(spark, sf_dir):  # M15 M17
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", rc.context_length(F.lit(4096), s * 100 - 500).alias("context"), rc.first_valid([s % 4, s], 2, 8).alias("experts")
    )


@register(
    "checkpoint_staleness",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'no_record' WHEN o_orderkey % 5 = 0 THEN 'error' WHEN o_orderstatus <> 'O' THEN 'other_recipe' WHEN o_custkey % 3 = 0 THEN 'no_experts_quantized' END AS stale_reason FROM orders""",
)
def checkpoint_staleness(spark, sf_dir):  # G10
    runs = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "if(o_orderkey % 7 = 0, null, 'p') as checkpoint_path", "if(o_orderkey % 5 = 0, 'failed', null) as error", "o_orderstatus as recipe_hash", "o_custkey % 3 as experts_quantized"
    )
    return rc.staleness(runs, "O").select("o_orderkey", "stale_reason")


@register(
    "parallel_unpivot",
    "SELECT item_id, 'english' AS language, text AS question FROM benchmark WHERE text IS NOT NULL UNION ALL SELECT item_id, 'malay', 'ms ' || text FROM benchmark WHERE text IS NOT NULL",
)
def parallel_unpivot(spark, sf_dir):  # S19 S20
    wide = table(spark, sf_dir, "benchmark").selectExpr("item_id", "named_struct('question', text) as english", "named_struct('question', concat('ms ', text)) as malay")
    long = wide.unpivot("item_id", ["english", "malay"], "language", "cell")
    return long.where("cell.question is not null").select("item_id", "language", "cell.question")


@register("ids_except", "SELECT DISTINCT o_custkey AS id FROM orders EXCEPT SELECT user_id FROM events")
def ids_except(spark, sf_dir):  # X2 X3
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).subtract(table(spark, sf_dir, "events").select("user_id"))


@register("existing_columns", "SELECT side, n_tokens, kl_mean FROM (WITH " + KL + " SELECT side, " + SUMMARY + " FROM kl GROUP BY side)")
def existing_columns(spark, sf_dir):  # O7 R6
    summary = rounded(ev.kl_summary(kl_rows(spark, sf_dir), ["side"]))
    return summary.select([c for c in ("side", "variant", "n_tokens", "kl_mean") if c in summary.columns])


@register("first_pairs", "SELECT conv_id, turn, text FROM conversations ORDER BY conv_id, turn LIMIT 100")
def first_pairs(spark, sf_dir):  # S29 O5
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").orderBy("conv_id", "turn").limit(100)


@register(
    "calibration_scan",
    "SELECT count(*) AS n, count(*) FILTER (coalesce(text, '') = '') AS n_empty, bool_and(('<|user|>' || coalesce(text, '')) LIKE '<|%') AS prefixed FROM (SELECT text FROM documents ORDER BY doc_id LIMIT 64)",
)
def calibration_scan(spark, sf_dir):  # S14 S18 G5
    some = table(spark, sf_dir, "documents").orderBy("doc_id").limit(64)
    return some.agg(
        F.count("*").alias("n"),
        F.count_if(F.coalesce("text", F.lit("")) == "").alias("n_empty"),
        F.bool_and(F.startswith(F.concat(F.lit("<|user|>"), F.coalesce("text", F.lit(""))), F.lit("<|"))).alias("prefixed"),
    )
