"""Settings, findings, special functions and small helpers."""

import os

import pytest
from pyspark.sql import functions as F

from lumenloom import settings as st
from lumenloom.functions import special
from lumenloom.operators import evalstats, findings, guards, ranks, routing
from lumenloom.sources import artifacts


def test_settings():
    s = st.settings_from("seq_len: 2048\nsample_counts: [2, 4]\ngate_sample_count: 4\nmodel: big\ndry_run_model: small\nreference_model: ref\n", seed=7)
    assert (s.seed, s.effective_seq_len(), s.effective_sample_counts(), s.effective_model()) == (7, 2048, (2, 4), "big")
    dry = st.settings_from(s.shown(), dry_run=True)
    assert (dry.effective_seq_len(), dry.effective_sample_counts(), dry.effective_model()) == (1024, (8, 16), "small")
    assert dry.fingerprint() == s.fingerprint() != st.settings_from(s.shown(), seed=8).fingerprint()
    assert s.folder("eval") == "artifacts/eval"
    with pytest.raises(KeyError):
        s.folder("none")
    for bad in ("no_such: 1", "gate_sample_count: 3", "- a list", "traffic_mix: {a: 0.4}"):
        with pytest.raises(ValueError):
            st.settings_from(bad)
    assert st.settings_from("") == st.Settings()


def test_recipes_and_checkpoints():
    text = '{"name": "f", "algorithm": "max", "quantized_layers": [], "exclude": []}'
    assert st.recipe_from(text, "f")["algorithm"] == "max"
    for bad, family in ((text, "g"), ("name: f", "f")):
        with pytest.raises(ValueError):
            st.recipe_from(bad, family)
    s = st.Settings(reference_model="ref", dry_run_model="small")
    assert st.checkpoint_path(s, "reference", {}) == "ref" and st.checkpoint_path(s, "a", {"a": "/x"}) == "/x"
    assert st.checkpoint_path(st.Settings(dry_run=True, dry_run_model="small"), "a", {}) == "small"
    with pytest.raises(FileNotFoundError):
        st.checkpoint_path(s, "b", {"b": None})


def facts(spark, head, gate, starved, n):
    return (
        spark.createDataFrame(head, "status string, relative_headroom double, gate_open boolean"),
        spark.createDataFrame(gate, "status string, weakened boolean, max_cramers_v double, mean_jaccard double"),
        spark.createDataFrame([starved], "n_starved long, starved_share double"),
        spark.createDataFrame([(n,)], "n long"),
    )


def test_findings(spark):
    said = lambda *a: {r.topic: r.finding for r in findings.findings(*facts(spark, *a)).collect()}
    null = said([("computed", 0.02, False)], [("same", True, 0.01, 0.99)], (0, 0.0), 5)
    assert set(null) == {"calibration", "routing"} and null["calibration"].startswith("Null result") and "0.0200" in null["calibration"] and "weakens" in null["routing"]
    good = said([("computed", 0.5, True)], [("differs", False, 0.2, 0.4)], (3, 0.125), 5)
    assert "0.5000" in good["calibration"] and "0.2000" in good["routing"] and good["experts"].startswith("3 experts") and "0.1250" in good["experts"]
    none = said([], [], (0, 0.0), 0)
    assert set(none) == {"calibration", "provisional"} and "unknown" in none["calibration"]
    assert findings.gate_readback(None, spark).first().status == "unavailable"


def test_chi2_survival(spark):
    values = [(0.0, 5), (3.5, 0), (5.3342, 2), (7.8147, 3), (1e-9, 7), (50.0, 64), (300.0, 127), (2500.0, 1000), (1200.0, 63), (None, 3)]
    for r in spark.createDataFrame(values, "x double, d int").select("x", "d", special.chi2_survival(F.col("x"), F.col("d")).alias("p")).collect():
        assert r.p is None if r.x is None else r.p == pytest.approx(routing.chi2_p_value(r.x, r.d), rel=1e-9, abs=1e-300)


def test_rank_survival(spark):
    values = [(rho, n) for rho in (0.0, 0.01, -0.3, 0.7, -0.99, 1.0) for n in (3, 4, 10, 65, 900)] + [(0.5, 2), (None, 9), (float("nan"), 9)]
    for r in spark.createDataFrame(values, "x double, n long").select("x", "n", special.rank_survival(F.col("x"), F.col("n")).alias("p")).collect():
        if r.n < 3 or r.x is None or r.x != r.x:
            assert r.p is None
        else:
            assert r.p == pytest.approx(evalstats.rank_p_value(r.x, r.n), abs=1e-10)


def test_batches_and_newest_files(spark, tmp_path):
    got = sorted((r.batch, r.id) for r in ranks.batches(spark.range(10), 4, [-F.col("id")]).collect())
    assert got == [(0, 6), (0, 7), (0, 8), (0, 9), (1, 2), (1, 3), (1, 4), (1, 5), (2, 0), (2, 1)]
    for i, name in enumerate(("a.json", "d/b.json", "c.txt")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x" * (i + 1))
        os.utime(tmp_path / name, (1_700_000_000 + i, 1_700_000_000 + i))
    rows = artifacts.newest_files(spark, str(tmp_path), "*.json").collect()
    assert [(os.path.basename(r.path), r["size"]) for r in rows] == [("b.json", 2), ("a.json", 1)]


def test_resolved_ids(spark):
    wanted = spark.createDataFrame([("a", "model"), ("b", "dataset"), ("c", "dataset")], "name string, kind string")
    known = spark.createDataFrame([("a", False, "r1"), ("b", True, "r2"), ("z", False, None)], "name string, gated boolean, revision string")
    got = {r.name: (r.found, r.gated, r.revision, r.usable) for r in guards.resolved_ids(wanted, known).collect()}
    assert got == {"a": (True, False, "r1", True), "b": (True, True, "r2", False), "c": (False, False, None, False)}


def test_wide_row_of_one_side(spark):
    rows = spark.createDataFrame([("x", "bm", i, 0.1 * i, 0.0) for i in range(5)], "c string, side string, pair long, kl double, tail double")
    r = evalstats.tier1_row(rows, ["c"], "side", "bm", "en", "pair", resamples=20).first()
    assert r.bm_n_tokens == 5 and r.en_n_tokens is None and r.bm_en_delta is None and r.delta_excludes_zero is False
