"""Values worked out by hand from the definitions."""

import math

import pytest
from pyspark.sql import functions as F

from lumenloom.functions import hashing, lexicons, text
from lumenloom.operators import corpus, dedup, evalstats, recipes, routing
from lumenloom.operators.staged import Journal, Stage, run_stages, validate_config


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_seed():
    assert hashing.derive_seed(42, "split", "formal_bm") == 1822327971


def test_seed_column(spark):
    assert one(spark, hashing.seed_column(42, "split", "formal_bm")) == 1822327971


@pytest.mark.parametrize("n,want", [(0, 0), (12, 1), (13, 1), (14, 2)])
def test_shingles(spark, n, want):
    t = " ".join(f"w{i}" for i in range(n))
    assert len(one(spark, text.shingles(text.words(F.col("t")), 13), t=t)) == want


def test_markers(spark):
    t = "Saya nak pergi kedai, macam mana nak cakap?"
    assert one(spark, text.marker_ratio(F.col("t"), lexicons.INDONESIAN_MARKERS), t=t) == 0.0
    assert one(spark, text.marker_ratio(F.col("t"), lexicons.MALAYSIAN_MARKERS), t=t) == 0.625


def test_switching(spark):
    t = "I want to makan nasi lemak dengan you. Saya suka makan nasi lemak itu."
    got = one(spark, text.switch_counts(F.col("t"), lexicons.ENGLISH_WORDS, lexicons.MALAY_WORDS), t=t)
    assert (got.considered, got.mixed) == (2, 1)
    assert one(spark, text.switch_counts(F.col("t"), lexicons.ENGLISH_WORDS, lexicons.MALAY_WORDS), t="ok lah").considered == 0


@pytest.mark.parametrize("t,want", [("kamek sik tauk", ("sarawak", 2)), ("bah", (None, 1)), ("kitak bah gerek", ("sarawak", 2))])
def test_dialect(spark, t, want):
    got = one(spark, text.dialect(F.col("t"), lexicons.DIALECT_MARKERS), t=t)
    assert (got.name, got.hits) == want


@pytest.mark.parametrize(
    "a,b,want",
    [("x" * 100, "y" * 40, ("ok", 2.5)), ("x" * 39, "y" * 100, ("too_short", 0.0)), ("1 2" + "x" * 40, "1 3" + "y" * 40, ("ok", 1.0)), ("1 2" + "x" * 40, "3 4" + "y" * 40, ("numeric_content_diverges", 1.0))],
)
def test_alignment(spark, a, b, want):
    got = one(spark, text.alignment(F.col("a"), F.col("b")), a=a, b=b)
    assert (got.reason, got.ratio) == want


def test_instruction_pair(spark):
    got = one(spark, text.instruction_pair(F.col("i"), F.col("o")), i="`hello there` terjemah ke melayu ", o="hai")
    assert (got.malay, got.english) == ("hai", "hello there")


@pytest.mark.parametrize("o,want", [("(B) kunci", ("B", "kunci")), ("A. kunci (keys)", ("A", "kunci (keys)")), ("kunci", (None, "kunci")), ("A.kunci", (None, "A.kunci"))])
def test_options(spark, o, want):
    assert (one(spark, text.option_letter(F.col("o")), o=o), one(spark, text.option_text(F.col("o")), o=o)) == want


def test_slug(spark):
    assert one(spark, text.slug(F.col("t")), t="Time To First Token (ms)") == "time_to_first_token_ms"


def test_strip_marks(spark):
    assert one(spark, text.strip_marks(F.col("t")), t="  É  Straße\n") == "e strasse"


def test_names(spark):
    n = F.col("n")
    assert one(spark, recipes.layer_index(n), n="backbone.layers.3.mixer.gate") == 3
    assert one(spark, recipes.layer_index(n), n="lm_head") == -1
    assert recipes.quantizer_glob("*.mixer.experts.*.up_proj", "weight_quantizer") == "*mixer.experts*up_proj*weight_quantizer*"
    assert one(spark, recipes.variant_of(n, ["baseline_en", "bm_only"]), n="w4a16_shipped_baseline_en_1024") == "baseline_en"
    assert one(spark, recipes.variant_of(n, ["baseline_en"]), n="bf16_reference") is None


@pytest.mark.parametrize("total,f,want", [(10, 0.8, 8), (5, 0.8, 4), (3, 0.8, 2), (1, 0.8, 0), (5, 0.5, 2)])
def test_split_sizes(spark, total, f, want):
    docs = spark.range(total).select(F.col("id").alias("doc_id"), F.lit("c").alias("corpus_class"))
    parts = corpus.split(docs, train=f)
    assert parts.where("side = 'train'").count() == want
    corpus.assert_split(parts)


def test_three_places_by_exact_value(spark):
    values = [i / n for n in (80, 16, 48, 400, 2000, 3) for i in range(2 * n + 1)] + [0.0875, 0.0005, 0.0015, 1e-9, 7.1235, 60000.0625]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", corpus.three_places(F.col("x")).alias("s")).collect()
    assert [r.s for r in rows] == [f"{r.x:.3f}" for r in rows]


def test_split_ignores_other_classes(spark):
    a = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("a").alias("corpus_class"))
    b = spark.range(50, 90).select(F.col("id").alias("doc_id"), F.lit("b").alias("corpus_class"))
    alone = {r.doc_id for r in corpus.split(a).where("side = 'train'").collect()}
    both = {r.doc_id for r in corpus.split(a.union(b)).where("side = 'train' and corpus_class = 'a'").collect()}
    assert alone == both


def test_contamination(spark):
    with pytest.raises(corpus.ContaminationError):
        corpus.assert_disjoint(spark.range(5).toDF("doc_id"), spark.range(4, 9).toDF("doc_id"))
    corpus.assert_disjoint(spark.range(5).toDF("doc_id"), spark.range(5, 9).toDF("doc_id"))


def counts(spark, a, b):
    rows = [("a", 0, i, n) for i, n in enumerate(a)] + [("b", 0, i, n) for i, n in enumerate(b)]
    return spark.createDataFrame([r for r in rows if r[3]], "corpus_class string, layer_index int, expert_id int, token_count long")


def test_chi_squared(spark):
    r = routing.pairwise(counts(spark, [10, 20, 30], [20, 20, 20]), 3).first()
    assert r.chi2 == pytest.approx(5.333333, abs=1e-6) and r.cramers_v == pytest.approx(0.210819, abs=1e-6)
    assert routing.chi2_p_value(r.chi2, 2) == pytest.approx(0.069483, abs=1e-6)
    assert routing.chi2_p_value(2 * 3.90735, 3) == pytest.approx(0.05, abs=1e-5)


def test_divergences(spark):
    r = routing.pairwise(counts(spark, [2, 2], [1, 3]), 2).first()
    assert r.kl_a_to_b == pytest.approx(0.143841, abs=1e-6)
    r = routing.pairwise(counts(spark, [5, 0], [0, 5]), 2).first()
    assert r.jensen_shannon == pytest.approx(math.log(2), abs=1e-6)
    r = routing.pairwise(counts(spark, [5, 3, 2], [2, 3, 5]), 3, top=2).first()
    assert r.top32_jaccard == pytest.approx(1 / 3)


@pytest.mark.parametrize("v,want", [([1, 1, 1, 1], 0.0), ([0, 0, 0, 4], 0.75), ([0, 0, 0, 0], 0.0)])
def test_gini(spark, v, want):
    df = spark.createDataFrame([("g", x) for x in v], "g string, tokens long")
    rank, agg = routing.gini("tokens", ["g"])
    assert df.withColumn("_i", rank).groupBy("g").agg(agg.alias("x")).first().x == pytest.approx(want)


def test_token_kl(spark):
    df = spark.sql("select array(struct(7 as id, ln(0.6D) as lp), struct(9 as id, ln(0.3D) as lp)) as r, array(struct(7 as id, ln(0.5D) as lp), struct(8 as id, ln(0.4D) as lp)) as c")
    got = df.select(evalstats.token_kl(F.col("r"), F.col("c")).alias("k")).first().k
    assert got.kl == pytest.approx(0.854865, abs=1e-6) and got.tail == pytest.approx(0.1)


def test_greedy():
    trace = routing.greedy_order([[4, 0, 0], [3, 0, 0], [0, 2, 0], [0, 0, 1]], 3, saturation=2.5)
    assert [t["doc_index"] for t in trace] == [0, 2, 3]
    assert [t["min_coverage"] for t in trace] == [0, 0, 1]
    assert [t["experts_unseen"] for t in trace] == [2, 1, 0]
    assert [t["saturated_coverage"] for t in trace] == [2.5, 4.5, 5.5]


def test_perplexity_and_accuracy(spark):
    p = evalstats.perplexity(spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None)], "c string, nll double"), ["c"]).first()
    assert p.perplexity == pytest.approx(7.389056, abs=1e-6) and p.nll_std == pytest.approx(1.414214, abs=1e-6) and p.n_tokens == 2
    a = evalstats.accuracy(spark.createDataFrame([(x,) for x in (1, 1, 0, 1)], "ok int"), [], ["ok"]).first()
    assert (a.ok_accuracy, a.ok_se) == (0.75, pytest.approx(0.216506, abs=1e-6))


def test_spearman(spark):
    df = spark.createDataFrame([(1, 1), (2, 3), (2, 2), (4, 4)], "x int, y int")
    assert evalstats.spearman(df, "x", "y").first().spearman_rho == pytest.approx(0.948683, abs=1e-6)
    assert evalstats.spearman(df.withColumn("y", F.lit(1)), "x", "y").first().spearman_rho is None


def test_throughput(spark):
    ref = spark.createDataFrame([(1, 100.0, "a")], "concurrency int, output_tokens_per_sec double, measured_by string")
    rows = spark.createDataFrame([(1, 94.0, "a"), (1, 95.5, "a")], ref.schema)
    got = sorted((round(r.throughput_vs_reference, 3), r.regression_flagged) for r in evalstats.throughput_regression(rows, ref, ["concurrency"]).collect())
    assert got == [(-0.06, True), (-0.045, False)]
    mixed = evalstats.throughput_regression(rows.withColumn("measured_by", F.lit("b")), ref, ["concurrency"]).collect()
    assert all(r.throughput_vs_reference is None and not r.regression_flagged for r in mixed)


def test_headroom(spark):
    rows = [("w4a4", "baseline_en", 0.0139, True), ("w4a4", "oracle_contaminated", 0.0100, True), ("x", "baseline_en", 0.1, False), ("x", "oracle_contaminated", 0.0, True)]
    got = {r.family: r for r in evalstats.headroom(spark.createDataFrame(rows, "family string, variant string, bm_en_delta double, delta_excludes_zero boolean")).collect()}
    assert got["w4a4"].relative_headroom == pytest.approx(0.280576, abs=1e-6) and got["w4a4"].gate_open and got["w4a4"].preferred
    assert got["x"].relative_headroom is None and not got["x"].gate_open


def test_faithful_duplicates_follow_arrival(spark):
    docs = spark.range(4).toDF("doc_id")
    pairs = spark.createDataFrame([(0, 1, 0.9), (1, 2, 0.9), (2, 3, 0.9)], "doc_a long, doc_b long, agreement double")
    sigs = spark.createDataFrame([(i, [i]) for i in range(4)], "doc_id long, signature array<long>")
    gone = {r.doc_id for r in dedup.arrival_verdict(docs, sigs, pairs).where("duplicate").collect()}
    assert gone == {1, 3}  # 2 stays, because 1 was never kept
    assert {r.doc_id for r in dedup.pairwise_verdict(docs, sigs, pairs).where("duplicate").collect()} == {1, 2, 3}


def test_faithful_duplicates_of_a_long_chain(spark):
    docs = spark.range(106).toDF("doc_id")
    pairs = spark.createDataFrame([(i, i + 1, 0.9) for i in range(105)], "doc_a long, doc_b long, agreement double")
    sigs = spark.createDataFrame([(i, [i]) for i in range(106)], "doc_id long, signature array<long>")
    gone = {r.doc_id for r in dedup.arrival_verdict(docs.coalesce(1), sigs.coalesce(1), pairs.coalesce(1)).where("duplicate").collect()}
    assert gone == set(range(1, 106, 2))
    with pytest.raises(RuntimeError):
        dedup.arrival_verdict(docs, sigs, spark.createDataFrame([(3, 2, 0.9), (2, 3, 0.9)], pairs.schema))


def test_recipes():
    a = {"name": "a", "algorithm": "x", "calibration": {"n": 1}}
    assert recipes.identity_hash(a) == recipes.identity_hash({**a, "name": "b", "calibration": {"n": 2}})
    assert recipes.materialise(a, n=5)["calibration"] == {"n": 5}
    assert recipes.fingerprint({"x": 1, "dry_run": True}) == recipes.fingerprint({"x": 1, "dry_run": False}) != recipes.fingerprint({"x": 2})
    with pytest.raises(recipes.RecipeError):
        recipes.assert_same_identity([a, {**a, "algorithm": "y"}])


def test_stages_stop_at_a_shut_gate(spark, tmp_path):
    ran = []
    stages = [Stage("a", lambda: ran.append("a")), Stage("b", lambda: ran.append("b"), gate=lambda _: False, blocking=True), Stage("c", lambda: ran.append("c"))]
    journal = run_stages(spark, stages, "f", Journal(str(tmp_path / "journal.json")))
    assert ran == ["a", "b"] and journal.entries[-1]["status"] == "stopped"


def test_config():
    good = {"gate_sample_count": 2, "sample_counts": (2, 4), "gate_variant": "a", "variants": ("a",), "traffic_mix": {"x": 0.5, "y": 0.5}}
    validate_config(good)
    for bad in ({"gate_sample_count": 3}, {"gate_variant": "b"}, {"traffic_mix": {"x": 0.4}}, {"classes": ("x",)}):
        with pytest.raises(ValueError):
            validate_config({**good, **bad})


def test_small_classes_compute_their_input_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def named(i):
        calls.add(1)
        return "a" if i % 4 else "b"

    rows = spark.range(40).select("id", named("id").alias("c"))
    assert {r.c for r in corpus.drop_small_classes(rows, "c", ["b"], 20).collect()} == {"a"}
    assert calls.value == 40
