"""The ingest state machine against the loop it stands for, and what it shares with deduplication."""

import random

import pytest
from pyspark.sql import functions as F

from lumenloom.functions import text as tx
from lumenloom.operators import admission, dedup, evalstats

SCHEMA = "arrival long, source string, primary string, text string, corpus_class string, reason string"
PERMUTATIONS, ROWS, LEAST = 16, 4, 0.8


def loop(records, signature, normal, target, required, cap):
    """Record by record, as a stream would be read."""
    full = {}
    kept_rows, kept_forms, outcome = [], set(), {}
    stopped, read = set(), {}
    for r in sorted(records, key=lambda r: r[0]):
        arrival, source, primary, text, cls, reason = r
        if source in stopped:
            outcome[arrival] = "unread"
            continue
        read[source] = read.get(source, 0) + 1
        if primary is not None and full.get(primary, 0) >= target:
            outcome[arrival] = "primary_class_full"
            stopped.add(source)
        elif cap is not None and read[source] > cap:
            outcome[arrival] = "source_cap_reached"
            stopped.add(source)
        elif required and all(full.get(c, 0) >= target for c in required):
            outcome[arrival] = "all_classes_full"
            stopped.add(source)
        elif text is None:
            outcome[arrival] = "missing_text_field"
        elif cls is None:
            outcome[arrival] = reason
        elif full.get(cls, 0) >= target:
            outcome[arrival] = "class_full"
        else:
            sig, form = signature.get(arrival), normal[arrival]
            bands = lambda s: {tuple(s[i : i + ROWS]) + (i,) for i in range(0, PERMUTATIONS, ROWS)}
            near = sig is not None and any(
                k is not None and bands(k) & bands(sig) and sum(a == b for a, b in zip(k, sig, strict=True)) / PERMUTATIONS >= LEAST for k in kept_rows
            )
            if form in kept_forms or near:
                outcome[arrival] = "duplicate"
            else:
                outcome[arrival] = "kept"
                kept_rows.append(sig)
                kept_forms.add(form)
                full[cls] = full.get(cls, 0) + 1
    return outcome


def stream(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    bases = [[rng.choice(vocabulary) for _ in range(60)] for _ in range(30)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 2, 20))):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        text = rng.choice((" ".join(words), " ".join(words).upper() + "  ", None if i % 17 == 0 else " ".join(words), "!!" if i % 13 == 0 else " ".join(words), "" if i % 19 == 0 else " ".join(words)))
        source = rng.choice(("a", "b", None)) if seed % 2 else ("a", "b", "c")[i * 3 // n]
        cls = rng.choice(("x", "y", "z", None))
        rows.append((i * 3, source, {"a": "x", "b": "y"}.get(source), text, cls, None if cls else "too_short"))
    return rows


@pytest.mark.parametrize("seed,target,required,cap", [(0, 6, ["x", "y", "z"], None), (1, 4, ["x", "y"], 35), (2, 1000, [], 20), (3, 1, ["x"], None)])
def test_admission_is_the_loop(spark, seed, target, required, cap):
    rows = stream(seed)
    records = spark.createDataFrame(rows, SCHEMA)
    flat = records.where("text is not null").select(F.col("arrival").alias("doc_id"), tx.strip_marks(F.col("text")).alias("text"))
    signature = {r.doc_id: list(r.signature) for r in dedup.signatures(flat, PERMUTATIONS).collect()}
    normal = {r.doc_id: r.text for r in flat.collect()}
    got = admission.ingest(records, target, required, cap, PERMUTATIONS, ROWS, LEAST).collect()
    assert len(got) == len(rows)
    assert {r.arrival: r.outcome for r in got} == loop(rows, signature, normal, target, required, cap)


def test_admission_of_nothing(spark):
    assert admission.ingest(spark.createDataFrame([], SCHEMA), 3, ["x"]).collect() == []


def test_signatures_are_kept_apart(spark):
    rows = [(1, "a b c d"), (1, "e f g h"), (None, "a b c d"), (None, "i j k l"), (2, None), (3, "!!")]
    got = dedup.signatures(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 0, 1, 1] and len({tuple(r.signature) for r in got}) == 3


def test_normalised_first_seen(spark):
    rows = [(1, "Café"), (2, "café"), (3, "CAFE"), (4, "cafes"), (5, "ﬁne"), (6, "fine"), (7, None), (8, " ")]
    got = dedup.first_seen(spark.createDataFrame(rows, "doc_id long, text string"), full=True)
    assert {r.doc_id for r in got.where("duplicate").collect()} == {2, 3, 6, 8}


def test_paired_interval(spark):
    rng = random.Random(5)
    rows = [(g, i, side, x + shift) for g, shift_of in (("far", 0.5), ("same", 0.0)) for i in range(200) for x in [rng.random()] for side, shift in (("bm", shift_of), ("en", 0.0))]
    rows += [("same", 1000, "bm", 99.0), ("same", None, "en", None)]  # no partner, no value
    df = spark.createDataFrame(rows, "g string, i long, side string, kl double")
    first, again = ({r.g: r for r in evalstats.paired_interval(d, "side", "bm", "en", "i", ["g"], resamples=50).collect()} for d in (df, df.repartition(7)))
    for g, want in (("far", 0.5), ("same", 0.0)):
        # the difference is the same in every pair, so pairs drawn together leave no spread
        for got in (first[g], again[g]):
            assert got.bm_en_delta_ci_low == pytest.approx(want, abs=1e-9) and got.bm_en_delta_ci_high == pytest.approx(want, abs=1e-9)
    assert first["far"].delta_excludes_zero


def test_bootstrap_interval(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([("a", i, rng.gauss(3, 1)) for i in range(2000)] + [("a", -1, None)], "g string, i long, v double")
    first, again = (evalstats.bootstrap_interval(d, ["g"], "v", resamples=200).first() for d in (df, df.repartition(5)))
    assert first.ci_low == pytest.approx(again.ci_low, abs=1e-9) and first.ci_high == pytest.approx(again.ci_high, abs=1e-9)
    # two standard errors of the mean are 0.045
    assert 2.9 < first.ci_low < 3.05 and 0.06 < first.ci_high - first.ci_low < 0.12


@pytest.mark.parametrize("rho,n,p", [(0.5, 10, 0.141113), (0.9, 5, 0.037386), (-0.5, 10, 0.141113), (0.0, 10, 1.0), (1.0, 10, 0.0)])
def test_rank_p_value(rho, n, p):
    assert evalstats.rank_p_value(rho, n) == pytest.approx(p, abs=1e-6)


def test_records_are_computed_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def named(i):
        calls.add(1)
        return "a"

    rows = spark.range(30).select(
        F.col("id").alias("arrival"), F.lit("s").alias("source"), F.lit("a").alias("primary"), F.format_string("text number %d of this source", F.col("id")).alias("text"),
        named("id").alias("corpus_class"), F.lit("r").alias("reason"),
    )
    got = admission.ingest(rows, target=5, required=["a"]).collect()
    assert len(got) == 30 and sum(r.outcome == "kept" for r in got) == 5
    assert calls.value == 30
