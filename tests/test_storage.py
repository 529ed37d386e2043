"""Artifacts, splits, caches, lines, rules, constraints and draws against failures and brute force."""

import fnmatch
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenloom.functions import draws
from lumenloom.operators import corpus, dedup, evalstats, guards, recipes
from lumenloom.sources import artifacts, ingest, logprob_cache, splits

# ------------------------------------------------------------------------------- lines


def test_physical_lines_over_several_splits(spark, tmp_path):
    rng = random.Random(1)
    lines = [rng.choice(["", "   ", "{bad", json.dumps({"id": i, "text": "x" * rng.randint(0, 60)})]) for i in range(2000)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
    (tmp_path / "b.jsonl").write_text('{"id": -1}\n\n{"id": -2}', encoding="utf-8")
    files = [str(tmp_path / n) for n in ("a.jsonl", "none.jsonl", "b.jsonl")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = ingest.physical_lines(spark, files)
        rows = {(r.file_ord, r.line): r.value for r in got.collect()}
        assert spark.read.text(files[0]).rdd.getNumPartitions() > 5
        assert rows == {(0, i): v for i, v in enumerate(lines)} | {(2, 0): '{"id": -1}', (2, 1): "", (2, 2): '{"id": -2}'}
        for limit in (0, 7, 1999, 2001, 5000):
            want = [json.loads(v)["id"] for v in lines[:limit] if v.startswith('{"')]
            assert [r.id for r in ingest.read_jsonl(spark, files[0], "id long", limit).where("id is not null").orderBy("id").collect()] == want
        good = [json.loads(v)["id"] for v in lines if v.startswith('{"')] + [-1, -2]
        limited = ingest.scan_lines(spark, files, limit=len(good) - 1).select(F.from_json("value", "id long").alias("r")).select("r.id").collect()
        assert sorted(r.id for r in limited) == sorted(good[:-1])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


# --------------------------------------------------------------------------- artifacts


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    artifacts.write_artifact(spark.range(3), path, "one", "p")
    bad = spark.range(1000).repartition(4).withColumn("x", F.when(F.col("id") == 777, F.raise_error("broken")).otherwise("y"))
    with pytest.raises(Exception, match="broken"):
        artifacts.write_artifact(bad, path, "two", "p")
    assert artifacts.read_artifact(spark, path).count() == 3 and artifacts.fingerprint_of(spark, path) == "one"
    assert len([d for d in os.listdir(path) if d.startswith("v-")]) == 1
    with pytest.raises(FileExistsError):
        artifacts.write_artifact(spark.range(5), path, "two", "p", overwrite=False)


def test_readers_keep_their_version(spark, tmp_path):
    path = str(tmp_path / "t")
    artifacts.write_artifact(spark.range(3), path, "one", "p")
    begun = artifacts.read_artifact(spark, path)
    artifacts.write_artifact(spark.range(4), path, "two", "p")
    assert begun.count() == 3 and artifacts.read_artifact(spark, path).count() == 4
    for n in (5, 6, 7):
        artifacts.write_artifact(spark.range(n), path, f"f{n}", "p")
    assert artifacts.read_artifact(spark, path).count() == 7
    assert len([d for d in os.listdir(path) if d.startswith("v-")]) == 2
    spark.range(2).write.parquet(str(tmp_path / "u"))  # without versions
    assert artifacts.union_files(spark, f"{tmp_path}/*").count() == 9


def test_fanout(spark, tmp_path):
    path = str(tmp_path / "f")
    rows = spark.range(4000).select((F.when(F.col("id") % 10 == 0, "b").otherwise("a")).alias("c"), (F.col("id") % 2).alias("layer"), "id")
    artifacts.write_fanout(rows, path, ["c", "layer"], "f1", "p", files_per_key=3)
    files = lambda k: {f for f in os.listdir(f"{path}/{k}") if f.endswith(".parquet")}
    keys = [f"c={c}/layer={n}" for c, n in (("a", 0), ("a", 1), ("b", 0))]
    first = {k: files(k) for k in keys}
    assert all(1 <= len(v) <= 3 for v in first.values())
    artifacts.write_fanout(rows.where("c = 'a' and layer = 0").limit(5), path, ["c", "layer"], "f2", "p", files_per_key=3)
    assert files(keys[1]) == first[keys[1]] and files(keys[2]) == first[keys[2]]
    assert spark.read.parquet(path).where("c = 'a' and layer = 0").count() == 5


# ------------------------------------------------------------------------------ splits


def test_splits_are_checked(spark, tmp_path):
    path = str(tmp_path / "s")
    docs = spark.createDataFrame([(i, ("01", "b", "b")[i % 3]) for i in range(30)], "doc_id long, corpus_class string")
    parts = corpus.split(docs)
    splits.save_splits(parts, path, "f0")
    read = splits.load_splits(spark, path, "f0")
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, parts.select("doc_id", "corpus_class", "doc_index", "side").collect()))
    with pytest.raises(corpus.SplitError, match="made under"):
        splits.load_splits(spark, path, "other")
    with pytest.raises(FileNotFoundError):
        splits.load_splits(spark, str(tmp_path / "none"))
    at = f"{artifacts.current(spark, path)}/rows/corpus_class=01"
    changed = spark.read.parquet(at).withColumn("side", F.lit("train"))
    changed.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "changed"))
    os.rename(at, str(tmp_path / "kept"))
    os.rename(str(tmp_path / "changed"), at)
    with pytest.raises(corpus.SplitError, match="01"):
        splits.load_splits(spark, path, "f0")
    os.rename(at, str(tmp_path / "gone"))
    with pytest.raises(corpus.SplitError, match="01"):
        splits.load_splits(spark, path, "f0")


# ------------------------------------------------------------------------- log-prob cache


def test_cached_join_has_no_exchange(spark):
    rows = spark.range(3000).select((F.col("id") % 7).cast("string").alias("key"), F.col("id").alias("pos"), F.array(F.struct(F.lit(1).alias("id"), F.lit(-0.5).alias("lp"))).alias("tokens"))
    a = logprob_cache.write_cache(rows.where("pos < 2000").union(rows.where("pos < 5")), buckets=8)
    b = logprob_cache.write_cache(rows, buckets=8)
    more = logprob_cache.extend_cache(spark, a, rows.where("pos >= 1000").withColumn("tokens", F.array(F.struct(F.lit(2).alias("id"), F.lit(-1.5).alias("lp")))), buckets=8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        both = logprob_cache.join_cached(logprob_cache.read_cache(spark, more), logprob_cache.read_cache(spark, b))
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert both.count() == 3000 and both.where("reference[0].id = 2").count() == 2000
    assert logprob_cache.read_cache(spark, a).count() == 2000
    with pytest.raises(FileNotFoundError):
        logprob_cache.read_cache(spark, "no_such_cache")


# ------------------------------------------------------------------------------- rules


@pytest.mark.parametrize("seed", [1, 2])
def test_last_rule_wins(spark, seed):
    rng = random.Random(seed)
    part = lambda: rng.choice(["mixer", "experts", "gate", "mlp", "a.b", "q_proj", "3", "weight_quantizer", "x"])
    names = [".".join(part() for _ in range(rng.randint(1, 6))) for _ in range(300)] + ["", "*", "gate+x"]
    globs = ["".join(rng.choice(["*", "?", ".", part(), part()]) for _ in range(rng.randint(1, 5))) for _ in range(40)] + ["*", "gate+?"]
    rules = [{"quantizer_name": g, **({"enable": False} if i % 3 else {"cfg": {"num_bits": i}})} for i, g in enumerate(globs)]
    got = recipes.resolved_rules(spark.createDataFrame([(n, i) for i, n in enumerate(names)] + [(None, -1)], "name string, i int"), rules).collect()
    assert len(got) == len(names) + 1
    for r in got:
        hit = [k for k, g in enumerate(globs) if r.name is not None and fnmatch.fnmatchcase(r.name, g)]
        assert r.rule == (hit[-1] if hit else None)
        assert r.pattern == (globs[r.rule] if hit else None) and r.enabled == ((r.rule % 3 == 0) if hit else None)


def test_quantizer_rules():
    stock = [{"quantizer_name": "*", "enable": False}, {"quantizer_name": "*mlp*weight_quantizer", "cfg": {"num_bits": 4, "block_sizes": {-1: 32}}}, {"quantizer_name": "*input_quantizer", "cfg": {"num_bits": 4}}]
    layers = [{"pattern": "*.experts.*.up", "format": "NVFP4", "activation_bits": 4}, {"pattern": "*.mixer", "format": "nvfp4"}, {"pattern": "*.x", "format": "fp8"}]
    out = recipes.quantizer_rules(stock, layers, ["*.gate", "lm_head*"], group_size=16)
    assert [r["quantizer_name"] for r in out[3:]] == ["*experts*up*weight_quantizer*", "*experts*up*input_quantizer*", "*mixer*weight_quantizer*", "*.gate*", "lm_head*"]
    assert out[1]["cfg"]["block_sizes"] == {-1: 16} == out[3]["cfg"]["block_sizes"] and stock[1]["cfg"]["block_sizes"] == {-1: 32}
    assert all(r == {"quantizer_name": r["quantizer_name"], "enable": False} for r in out[-2:])
    assert recipes.quantizer_rules({"*": {"enable": False}}, [], ["a"])[-1] == {"quantizer_name": "a*", "enable": False}
    with pytest.raises(recipes.RecipeError):
        recipes.quantizer_rules("rules", [], [])


# ------------------------------------------------------------------------- constraints


def test_bad_rows_fail_the_job_that_writes(spark, tmp_path):
    df = guards.checked(spark.range(10), {"too large": F.col("id") < 9, "negative": F.col("id") >= 0}, F.col("id"))
    with pytest.raises(Exception, match="too large: 9"):
        df.write.parquet(str(tmp_path / "x"))
    assert guards.checked(spark.range(10), {"fine": F.col("id") < 10}).count() == 10
    with pytest.raises(Exception, match="unknown"):
        guards.checked(spark.range(1), {"unknown": F.lit(None).cast("boolean")}).collect()


def test_bad_splits_fail_the_job(spark, tmp_path):
    docs = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)], "doc_id long, corpus_class string")
    parts = corpus.split(docs)
    assert guards.sound_split(parts).count() == 40
    for bad, message in (
        (parts.where("doc_index <> 3 or corpus_class = 'b'"), "misses"),
        (parts.union(parts.where("doc_id = 5")), "repeats"),
        (parts.withColumn("side", F.lit("train")), "fraction"),
    ):
        with pytest.raises(Exception, match=message):
            guards.sound_split(bad).write.parquet(str(tmp_path / message))


def test_configs(spark):
    rows = spark.createDataFrame([(16, ["NVFP4_MLP_ONLY_CFG"]), (4, ["NVFP4_AFFINE_KV_CFG", "NVFP4_DEFAULT_CFG"])], "w int, o array<string>")
    assert [r[0] for r in rows.select(guards.resolved_config(F.col("w"), F.col("o"))).collect()] == ["NVFP4_MLP_ONLY_CFG", "NVFP4_DEFAULT_CFG"]
    for w, o, message in ((4, ["OTHER_CFG"], "none of NVFP4_DEFAULT_CFG"), (8, ["x"], "width 8"), (None, ["x"], "width null")):
        with pytest.raises(Exception, match=message):
            spark.createDataFrame([(w, o)], "w int, o array<string>").select(guards.resolved_config(F.col("w"), F.col("o"))).collect()


def test_preflight(spark):
    recipe_rows = spark.createDataFrame([("a", "h1", 4), ("b", "h2", 16)], "family string, identity string, activation_bits int")
    ids = spark.createDataFrame([("m", "model", True, False, "abc")], "name string, kind string, found boolean, gated boolean, revision string")
    good = guards.preflight(recipe_rows, ids, ["a", "b"])
    guards.assert_preflight(good)
    assert guards.passed(spark.range(3), good).count() == 3
    bad = guards.preflight(recipe_rows.withColumn("activation_bits", F.lit(4)), ids.withColumn("gated", F.lit(True)), ["a", "b", "c"])
    with pytest.raises(recipes.RecipeError, match="model id m: gated.*recipe c: missing.*widths differ a,b: 4"):
        guards.assert_preflight(bad)
    with pytest.raises(Exception, match="preflight failed"):
        guards.passed(spark.range(3), bad).count()


# ------------------------------------------------------------------------------- draws


def test_philox_known_answers(spark):
    # Published test vectors of the generator with ten rounds.
    for counter, key, want in (
        ([0, 0, 0, 0], (0, 0), ["6627e8d5", "e169c58d", "bc57ac4c", "9b00dbd8"]),
        ([0xFFFFFFFF] * 4, (0xFFFFFFFF, 0xFFFFFFFF), ["408f276d", "41c83b0e", "a20bc7c6", "6d5451fd"]),
        ([0x243F6A88, 0x85A308D3, 0x13198A2E, 0x03707344], (0xA4093822, 0x299F31D0), ["d16cfe09", "94fdcceb", "5001e420", "24126ea1"]),
    ):
        assert [f"{int(x):08x}" for x in draws.philox_numpy([np.array(c) for c in counter], key)] == want
        row = spark.range(1).select(draws.philox([F.lit(c).cast("long") for c in counter], key).alias("w")).first()
        assert [f"{x:08x}" for x in row.w] == want


def test_draws_do_not_depend_on_partitioning(spark):
    df = spark.range(500)
    u = lambda d, *tags: {r.id: list(r.u) for r in d.select("id", draws.uniforms(draws.row_words(F.col("id")), 3, 1, *tags).alias("u")).collect()}
    a = u(df, "x")
    assert a == u(df.repartition(9), "x") and a != u(df, "y")
    flat = np.array(list(a.values())).ravel()
    assert 0 <= flat.min() and flat.max() < 1 and abs(flat.mean() - 0.5) < 0.03 and len(set(flat)) == len(flat)


def test_bootstrap_covers_the_mean_and_shuffles_sums_only(spark):
    rng = np.random.default_rng(1)
    rows = [(g, i, float(v)) for g in ("a", "b", None) for i, v in enumerate(rng.normal(3, 1, 400))]
    df = spark.createDataFrame(rows, "g string, i int, v double").repartition(6)
    got = {r.g: r for r in evalstats.bootstrap_interval(df, ["g"], "v", resamples=300, key=["i"]).collect()}
    assert set(got) == {"a", "b", None}
    mean = np.mean([r[2] for r in rows if r[0] == "a"])
    assert got["a"].ci_low < mean < got["a"].ci_high and abs(got["a"].ci_high - got["a"].ci_low - 2 * 1.96 / 20) < 0.04
    plan = evalstats.bootstrap_interval(df, ["g"], "v", resamples=300, key=["i"])._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
    assert "Generate explode" not in plan


# ------------------------------------------------------------------------- banding


def near_pairs_of(found):
    sets = {}
    for r in found.collect():
        sets.setdefault(r.group, set()).add(r.doc_id)
    return {(a, b) for s in sets.values() for a in s for b in s if a < b}


def mutated(rng, base, k):
    out = list(base)
    for at in rng.choice(len(base), size=k, replace=False):
        out[at] = int(rng.integers(1 << 20))
    return [int(x) for x in out]


@pytest.mark.parametrize("hot", [3, 8, 1000])
def test_no_near_pair_is_lost(spark, hot):
    rng = np.random.default_rng(hot)
    bases = rng.integers(1 << 20, size=(4, 16)).tolist()
    bases[1][:4] = bases[0][:4]  # two clusters in one band
    rows = [(i, mutated(rng, bases[i % 4], int(rng.integers(0, 5)))) for i in range(90)]
    rows += [(200 + i, bases[0][:4] + rng.integers(1 << 20, size=12).tolist()) for i in range(30)]  # a frequent band
    sigs = spark.createDataFrame(rows, "doc_id long, signature array<long>")
    first = {}
    for d, s in rows:
        first.setdefault(tuple(s), d)
    reps = [(d, s) for s, d in first.items()]
    want = {(min(a, b), max(a, b)) for a, x in reps for b, y in reps if a != b and sum(p == q for p, q in zip(x, y)) >= 13}
    assert near_pairs_of(dedup.near_groups(sigs, 0.8, rows=4, hot=hot)) == want


def test_a_band_of_very_many_costs_its_size(spark):
    n = 20_000
    sigs = spark.range(n).select(
        F.col("id").alias("doc_id"), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda p: F.when(p < 4, F.lit(7).cast("long")).otherwise(F.pmod(F.xxhash64("id", p), F.lit(1 << 30)))).alias("signature")
    )
    near = sigs.where("doc_id = 5").select(F.lit(n + 5).cast("long").alias("doc_id"), F.transform("signature", lambda v, p: F.when(p == 9, F.lit(1).cast("long")).otherwise(v)).alias("signature"))
    assert near_pairs_of(dedup.near_groups(sigs.union(near), 0.8, rows=4)) == {(5, n + 5)}


def test_settled_sets_follow_arrival(spark):
    rng = random.Random(4)
    sets = [sorted(rng.sample(range(60), rng.randint(2, 6))) for _ in range(40)]
    kept, gone = set(), set()
    for d in range(60):
        (gone if any(d in s and kept & {x for x in s if x < d} for s in sets) else kept).add(d)
    got = {r.doc_id for r in dedup.settled(spark.createDataFrame([(g, d) for g, s in enumerate(sets) for d in s], "group long, doc_id long")).collect()}
    assert got == gone


def test_fanout_stamps_after_the_shuffle(spark, tmp_path, monkeypatch):
    seen, stamp = [], artifacts.stamp

    def watched(df, *args):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stamp(df, *args)

    monkeypatch.setattr(artifacts, "stamp", watched)
    path = f"file://{tmp_path}/fan"
    artifacts.write_fanout(spark.range(30).selectExpr("id", "id % 3 AS c"), path, ["c"], "f1", "p")
    assert "Sort [" in seen[0] and "RepartitionByExpression" in seen[0]
    back = spark.read.parquet(path)
    assert back.count() == 30 and set(artifacts.STAMP) <= set(back.columns)
