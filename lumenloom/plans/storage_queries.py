"""Queries that go through storage, constraints, ordered rules and counter-based draws.

Each reads driver tables, writes what the operator keeps to the shared folder, reads it back and
returns what was read. Comments name the survey ids a query covers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import draws as dw
from ..operators import evalstats as ev
from ..operators import findings as fd
from ..operators import guards, ranks
from ..operators import recipes as rc
from ..session import shared_path, table
from ..sources import artifacts, ingest, logprob_cache, splits
from . import eval_queries as eq
from .corpus_queries import CLASS, SPLIT, classed, documents, parted
from .eval_queries import KL, MODULE, K, modules, rounded

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# ------------------------------------------------------------------------------- lines


@register(
    "jsonl_physical_lines",
    """SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS line, length(text)::BIGINT AS n FROM documents QUALIFY doc_id % 7 <> 0""",
)
def jsonl_physical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:  # S1 S6 S7
    # every seventh line is blank, and counts
    path = shared_path(spark, "jsonl")
    record = F.to_json(F.struct("doc_id", "text"), {"ignoreNullFields": "false"})
    dealt = documents(spark, sf_dir).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    dealt.select(F.when(F.col("doc_id") % 7 == 0, "").otherwise(record).alias("value")).write.text(path)
    lines = ingest.scan_lines(spark, [path])
    read = lines.select("line", F.from_json("value", "doc_id long, text string").alias("r"))
    return read.select("r.doc_id", "line", F.length("r.text").cast("long").alias("n"))


# --------------------------------------------------------------------- artifacts, splits, caches


@register("artifact_versions", f"SELECT {CLASS} AS corpus_class, count(*) AS n, 2::BIGINT AS version FROM documents WHERE {CLASS} IS NOT NULL GROUP BY 1")
def artifact_versions(spark, sf_dir):  # K1 K2 S8 S9
    path = shared_path(spark, "artifact")
    rows = classed(spark, sf_dir).groupBy("corpus_class").agg(F.count("*").alias("n"))
    for version in (1, 2):
        artifacts.write_artifact(rows.withColumn("version", F.lit(version).cast("long")), path, f"f{version}", "phase0")
    if not artifacts.is_complete(spark, path, "f2"):
        raise RuntimeError("the second version is not current")
    return artifacts.read_artifact(spark, path).select("corpus_class", "n", "version")


@register(
    "fanout_rewrite",
    """SELECT l_returnflag AS corpus_class, l_linenumber::INT AS layer_index, count(*) AS n, (CASE WHEN l_returnflag = 'A' THEN 2 ELSE 1 END)::INT AS version FROM lineitem GROUP BY ALL""",
)
def fanout_rewrite(spark, sf_dir):  # K9
    path = shared_path(spark, "fanout")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("corpus_class"), F.col("l_linenumber").cast("int").alias("layer_index"), "l_orderkey", "l_suppkey")
    keys = ["corpus_class", "layer_index"]
    artifacts.write_fanout(rows.withColumn("version", F.lit(1)), path, keys, "f", "phase1")
    # one class is made again; the others' folders stay
    artifacts.write_fanout(rows.where("corpus_class = 'A'").withColumn("version", F.lit(2)), path, keys, "f", "phase1")
    return spark.read.parquet(path).groupBy(*keys, "version").agg(F.count("*").alias("n"))


@register("split_round_trip", f"WITH {SPLIT} SELECT * FROM split")
def split_round_trip(spark, sf_dir):  # S13 K6 P1
    path = shared_path(spark, "splits")
    splits.save_splits(parted(spark, sf_dir), path, "f0")
    return splits.load_splits(spark, path, "f0")


@register("guarded_split", f"WITH {SPLIT} SELECT * FROM split")
def guarded_split(spark, sf_dir):  # G2 G3
    return guards.sound_split(parted(spark, sf_dir))


@register("logprob_cache_kl", f"WITH {KL} SELECT vec_id, round(kl, 6) AS kl, round(tail, 6) AS tail FROM kl")
def logprob_cache_kl(spark, sf_dir):  # S25 K8 J3
    e = table(spark, sf_dir, "embeddings")
    rows = lambda logits: e.select(F.col("label").cast("string").alias("key"), F.col("vec_id").alias("pos"), ev.top_logprobs(logits, K).alias("tokens"))
    exact, coarse = rows(F.col("embedding")), rows(F.transform("embedding", lambda v: F.round(v.cast("double"), 1)))
    # the reference is scored in two goes
    first = logprob_cache.write_cache(exact.where("pos % 3 > 0"))
    reference = logprob_cache.read_cache(spark, logprob_cache.extend_cache(spark, first, exact.where("pos % 3 = 0")))
    candidate = logprob_cache.read_cache(spark, logprob_cache.write_cache(coarse))
    both = logprob_cache.join_cached(reference, candidate)
    told = both.select(F.col("pos").alias("vec_id"), ev.token_kl(F.col("reference"), F.col("candidate")).alias("k"))
    return rounded(told.select("vec_id", "k.kl", "k.tail"))


# ------------------------------------------------------------------------- rules and constraints

STOCK = [
    {"quantizer_name": "*", "enable": False},
    {"quantizer_name": "*mlp*weight_quantizer", "cfg": {"num_bits": [2, 1], "block_sizes": {-1: 16}}},
    {"quantizer_name": "*self_attn*input_quantizer", "cfg": {"num_bits": [2, 1], "block_sizes": {-1: 32}}},
    {"quantizer_name": "*.q_proj.weight_quantizer", "cfg": {"num_bits": 8}},
]
RULES = rc.quantizer_rules(
    STOCK,
    [{"pattern": "*.mixer.experts.*.up_proj", "format": "nvfp4", "activation_bits": 4}, {"pattern": "*.mixer.shared_experts.*", "format": "nvfp4"}],
    ["*.mixer.gate", "*layers.?.lm_head", "*experts.1?.up_proj.input_quantizer"],
    group_size=16,
)
_RULE_ROWS = ", ".join("({}, '{}', '{}', {})".format(i, r["quantizer_name"], rc.glob_regex(r["quantizer_name"]).replace("'", "''"), str(bool(r.get("enable", True))).lower()) for i, r in enumerate(RULES))
_QUANTIZERS = f"(SELECT p_partkey, {MODULE} || q AS name FROM part, (VALUES ('.weight_quantizer'), ('.input_quantizer')) v(q))"


@register(
    "rule_resolution",
    f"""WITH q AS {_QUANTIZERS}, r(rule, pattern, regex, enabled) AS (VALUES {_RULE_ROWS})
SELECT p_partkey, name, max(rule)::INT AS rule, arg_max(pattern, rule) AS pattern, arg_max(enabled, rule) AS enabled FROM q LEFT JOIN r ON regexp_matches(name, regex) GROUP BY p_partkey, name""",
)
def rule_resolution(spark, sf_dir):  # B6 M11 M12 J13
    kinds = F.explode(F.array(F.lit(".weight_quantizer"), F.lit(".input_quantizer")))
    names = modules(spark, sf_dir).select("p_partkey", "name", kinds.alias("kind")).select("p_partkey", F.concat("name", "kind").alias("name"))
    return rc.resolved_rules(names, RULES).drop("cfg")


@register(
    "resolved_configs",
    """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_size % 3 = 0 THEN 'NVFP4_MLP_WEIGHT_ONLY_CFG' ELSE 'NVFP4_MLP_ONLY_CFG' END
  ELSE CASE WHEN p_size % 3 = 0 THEN 'NVFP4_DEFAULT_CFG' ELSE 'NVFP4_AFFINE_KV_CFG' END END AS config FROM part""",
)
def resolved_configs(spark, sf_dir):  # G18
    names = [n for v in guards.CONFIG_PREFERENCE.values() for n in v]
    first = F.array(*[F.lit(n) for n in names])
    second = F.array(*[F.lit(v[1]) for v in guards.CONFIG_PREFERENCE.values()])
    p = table(spark, sf_dir, "part").withColumns({"width": F.when(F.col("p_size") % 2 == 0, 16).otherwise(4), "offered": F.when(F.col("p_size") % 3 == 0, first).otherwise(second)})
    return p.select("p_partkey", guards.resolved_config(F.col("width"), F.col("offered")).alias("config"))


@register(
    "preflight_checks",
    """WITH f AS (SELECT r_regionkey, r_name AS family, CASE WHEN r_regionkey <> 3 THEN substr(md5((r_regionkey // 2)::VARCHAR), 1, 16) END AS identity, CASE WHEN r_regionkey <> 3 THEN 4 * (1 + r_regionkey) END AS bits FROM region)
SELECT 'recipe' AS "check", family AS subject, identity IS NOT NULL AS ok, coalesce(identity, 'missing') AS detail FROM f
UNION ALL SELECT 'recipes differ', string_agg(family, ',' ORDER BY family), count(*) = 1, identity FROM f WHERE identity IS NOT NULL GROUP BY identity
UNION ALL SELECT 'widths differ', string_agg(family, ',' ORDER BY family), count(*) = 1, bits::VARCHAR FROM f WHERE bits IS NOT NULL GROUP BY bits
UNION ALL SELECT 'dataset id', n_name, n_nationkey % 5 <> 0 AND n_nationkey % 7 <> 0, CASE WHEN n_nationkey % 5 = 0 THEN 'missing' WHEN n_nationkey % 7 = 0 THEN 'gated' ELSE substr(md5(n_name), 1, 8) END FROM nation""",
)
def preflight_checks(spark, sf_dir):  # G17 R12
    r = table(spark, sf_dir, "region")
    families = [x.r_name for x in r.select("r_name").collect()]  # the run's configuration: its few families
    recipes = r.where("r_regionkey <> 3").select(
        F.col("r_name").alias("family"), F.substring(F.md5(F.floor(F.col("r_regionkey") / 2).cast("string")), 1, 16).alias("identity"), (4 * (1 + F.col("r_regionkey"))).cast("int").alias("activation_bits")
    )
    n = F.col("n_nationkey")
    ids = table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("name"), F.lit("dataset").alias("kind"), (n % 5 != 0).alias("found"), (n % 7 == 0).alias("gated"), F.substring(F.md5("n_name"), 1, 8).alias("revision")
    )
    return guards.preflight(recipes, ids, families)


# ------------------------------------------------------------------------------------- draws

_DRAWN = dw.philox_sql(
    "(SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT AS w0, ('0x' || substr(md5(doc_id::VARCHAR), 9, 8))::BIGINT AS w1, b FROM documents, range(2) t(b))",
    ("w0", "w1", "b", "0"),
    dw.scope(42, "queries", "uniform"),
    "doc_id, b",
)


@register(
    "scoped_draws",
    f"""WITH d AS ({_DRAWN}), u AS (SELECT doc_id, b, ((c0 >> 5)::BIGINT * 67108864 + (c1 >> 6)::BIGINT) / 9007199254740992.0 AS x, ((c2 >> 5)::BIGINT * 67108864 + (c3 >> 6)::BIGINT) / 9007199254740992.0 AS y FROM d)
SELECT doc_id, max(x::DOUBLE) FILTER (b = 0) AS u0, max(y::DOUBLE) FILTER (b = 0) AS u1, max(x::DOUBLE) FILTER (b = 1) AS u2 FROM u GROUP BY doc_id""",
)
def scoped_draws(spark, sf_dir):  # M2 M1
    u = dw.uniforms(dw.row_words(F.col("doc_id")), 3, 42, "queries", "uniform")
    return documents(spark, sf_dir).select("doc_id", u.alias("u")).select("doc_id", *[F.col("u")[i].alias(f"u{i}") for i in range(3)])


# ------------------------------------------------------------------------------- report

_SIDES = f"""{KL}, sided AS (SELECT 'all' AS grp, vec_id, CASE WHEN vec_id % 2 = 0 THEN 'bm' ELSE 'en' END AS side, vec_id >> 1 AS pair, kl, tail FROM kl)"""
_SUMS = {
    "n_tokens": "count(*)", "kl_mean": "avg(kl)", "kl_std": "coalesce(stddev_samp(kl), 0)", "kl_sem": "coalesce(stddev_samp(kl), 0) / sqrt(count(*))", "mean_tail_mass": "avg(tail)",
    "max_tail_mass": "max(tail)", "kl_p50": "quantile_cont(kl, 0.5)", "kl_p99": "quantile_cont(kl, 0.99)",
}
_PER_SIDE = ", ".join(f"{sql.replace('(*)', '(kl)')} AS {name}" for name, sql in _SUMS.items())
_WIDE = ", ".join(
    f"{'max({0}) FILTER (side = {1!r})' if c == 'n_tokens' else 'round(max({0}) FILTER (side = {1!r}), 6)'} AS {side}_{c}".format(c, side) for side in ("bm", "en") for c in (*_SUMS, "ci_low", "ci_high")
)


@register(
    "tier1_wide_row",
    f"""WITH {_SIDES}, {eq.interval_sql("sided", "grp, side", "kl", "vec_id::VARCHAR", "ci_low", "ci_high", tag="_s")},
paired AS (SELECT grp, pair, avg(kl) FILTER (side = 'bm') - avg(kl) FILTER (side = 'en') AS d FROM sided GROUP BY ALL),
{eq.interval_sql("(SELECT * FROM paired WHERE d IS NOT NULL)", "grp", "d", "grp || '|' || pair", "lo", "hi", tag="_p")},
per AS (SELECT grp, side, {_PER_SIDE} FROM sided GROUP BY ALL),
wide AS (SELECT grp, {_WIDE}, max(kl_mean) FILTER (side = 'bm') AS b, max(kl_mean) FILTER (side = 'en') AS e FROM per JOIN ends_s USING (grp, side) GROUP BY grp)
SELECT wide.* EXCLUDE (b, e), round(lo, 6) AS bm_en_delta_ci_low, round(hi, 6) AS bm_en_delta_ci_high, coalesce(lo > 0 OR hi < 0, false) AS delta_excludes_zero, round(b - e, 6) AS bm_en_delta, round(CASE WHEN e > 0 THEN b / e END, 6) AS bm_en_ratio
FROM wide LEFT JOIN ends_p USING (grp)""",
)
def tier1_wide_row(spark, sf_dir):  # R2 A19 A20
    side = F.when(F.col("vec_id") % 2 == 0, "bm").otherwise("en")
    rows = eq.kl_rows(spark, sf_dir).withColumns({"side": side, "pair": F.shiftright("vec_id", 1), "grp": F.lit("all")})
    return rounded(ev.tier1_row(rows, ["grp"], "side", "bm", "en", "pair", resamples=200, key=["vec_id"]))


@register(
    "report_findings",
    f"""WITH {eq.PAIRS}, {eq.HEAD}, {eq.PROFILE},
m AS (SELECT avg(d) FILTER (variant = 'baseline_en') AS b, avg(d) FILTER (variant = 'oracle_contaminated') AS o FROM h WHERE family = 'w4a4_mech'),
g AS (SELECT max(cramers_v) AS v, avg(top32_jaccard) AS t FROM pv WHERE (class_a IN ('c1', 'c2', 'c3') AND class_b = 'c0') OR (class_b IN ('c1', 'c2', 'c3') AND class_a = 'c0')),
w AS (SELECT expert_id, coalesce(sum(token_count) FILTER (corpus_class = 'A'), 0) AS ma, coalesce(sum(token_count) FILTER (corpus_class = 'N'), 0) AS en FROM prof GROUP BY 1),
s AS (SELECT count(*) FILTER (mf - ef > 0 AND ef < 0.015) AS n, coalesce(sum(mf) FILTER (mf - ef > 0 AND ef < 0.015), 0) AS share FROM (SELECT ma / sum(ma) OVER () AS mf, en / sum(en) OVER () AS ef FROM w))
SELECT * FROM (
SELECT 0 AS position, 'calibration' AS topic, CASE WHEN (b - o) / abs(b) >= 0.1 THEN 'There is headroom: the contaminated oracle recovers ' || printf('%.4f', (b - o) / abs(b)) || ' of the difference, an upper bound for any legitimate calibration.'
  ELSE 'Null result: calibrating on the evaluation data itself recovers ' || printf('%.4f', (b - o) / abs(b)) || ' of the difference, under the threshold of 0.10. The choice of calibration text is not the lever here, and the other variants were not run.' END AS finding FROM m
UNION ALL SELECT 1, 'routing', CASE WHEN v >= 0.05 OR t <= 0.95 THEN 'Experts are used differently by language (largest Cramer''s V ' || printf('%.4f', v) || ', mean top-32 Jaccard ' || printf('%.4f', t) || '), which the coverage mechanism needs.'
  ELSE 'Routing of the language classes and of the control cannot be told apart, which weakens the coverage mechanism whatever calibration does.' END FROM g
UNION ALL SELECT 2, 'experts', CASE WHEN n > 0 THEN n || ' experts carry Malay tokens that English calibration hardly reaches (' || printf('%.4f', share) || ' of all Malay tokens).' END FROM s) WHERE finding IS NOT NULL""",
)
def report_findings(spark, sf_dir):  # R7 R8
    heads = ev.headroom(eq.kl_results(spark, sf_dir)).where("preferred").select("status", "relative_headroom", "gate_open")
    pairs = eq.rt.pairwise(eq.rt.observe(eq.router_tokens(spark, sf_dir))[0], eq.EXPERTS)
    gate = fd.gate_readback(eq.rt.routing_gate(pairs, ["c1", "c2", "c3"], "c0"), spark)
    starved = eq._preference(eq.profiles(spark, sf_dir)).where("malay_preference > 0 and english_frequency < 0.015")  # noqa: SLF001
    counts = starved.agg(F.count("*").alias("n_starved"), F.coalesce(F.sum("malay_frequency"), F.lit(0.0)).alias("starved_share"))
    return fd.findings(heads, gate, counts, eq.kl_results(spark, sf_dir).agg(F.count("*").alias("n")))


@register("fixed_batches", "SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 64)::BIGINT AS batch FROM documents")
def fixed_batches(spark, sf_dir):  # R10
    return ranks.batches(documents(spark, sf_dir).select("doc_id"), 64, ["doc_id"])


@register(
    "hub_resolution",
    """WITH c AS (SELECT n_name AS name, bool_or(n_nationkey % 7 = 0) AS gated, max(substr(md5(n_name), 1, 8)) AS revision FROM nation WHERE n_nationkey % 5 <> 0 GROUP BY 1)
SELECT w.n_name AS name, 'dataset' AS kind, c.name IS NOT NULL AS found, coalesce(gated, false) AS gated, revision, c.name IS NOT NULL AND NOT coalesce(gated, false) AS usable FROM nation w LEFT JOIN c ON c.name = w.n_name""",
)
def hub_resolution(spark, sf_dir):  # S28 R12
    n = table(spark, sf_dir, "nation")
    catalog = n.where("n_nationkey % 5 <> 0").select(F.col("n_name").alias("name"), (F.col("n_nationkey") % 7 == 0).alias("gated"), F.substring(F.md5("n_name"), 1, 8).alias("revision"))
    return guards.resolved_ids(n.select(F.col("n_name").alias("name"), F.lit("dataset").alias("kind")), catalog)
