"""Corpus operators: statistics, classification, quotas, splits, samples, manifests, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as tx
from ..functions.hashing import order_key
from ..session import materialize
from .ranks import first_rows, quota_flag, ranked
from .routing import coverage_greedy


class ContaminationError(ValueError):
    """Calibration documents that are also evaluated on."""


class SplitError(ValueError):
    """A split that overlaps, repeats or misses documents."""


def seeded_sample(docs: DataFrame, n: int, seed: int, tag: str, by: list[str], key: str) -> DataFrame:
    """At most ``n`` rows of each ``by`` group, in seeded order; a feature, not a safeguard."""
    return first_rows(docs, by, order_key(seed, tag, *[F.col(c).cast("string") for c in by], F.col(key).cast("string")), [key], n)


def corpus_stats(docs: DataFrame, by: str, seq_len: int = 2048, sample: int | None = None, seed: int = 42) -> DataFrame:
    """Token, character and word statistics of each class; tokens are words.

    ``sample`` bounds the documents of a class that are counted, as the reference report does;
    None counts all of them.
    """
    rows = docs if sample is None else seeded_sample(docs, sample, seed, "stats", [by], "doc_id")
    totals = docs.groupBy(by).agg(F.count("*").alias("n_docs"))
    sized = rows.select(by, F.size(tx.words(F.col("text"))).cast("long").alias("t"), F.length(F.coalesce("text", F.lit(""))).alias("c"))
    r6 = lambda x: F.round(x, 6)
    pct = lambda q: r6(F.percentile("t", F.lit(q)))
    stats = sized.groupBy(by).agg(
        F.count("*").alias("n_docs_sampled_for_tokens"),
        r6(F.avg("t")).alias("tokens_mean"),
        r6(F.coalesce(F.stddev_samp("t"), F.lit(0.0))).alias("tokens_std"),
        pct(0.1).alias("tokens_p10"),
        pct(0.5).alias("tokens_p50"),
        pct(0.9).alias("tokens_p90"),
        pct(0.99).alias("tokens_p99"),
        F.max("t").alias("tokens_max"),
        r6(F.avg((F.col("t") >= seq_len).cast("double"))).alias("frac_at_calib_seq_len"),
        r6(F.avg("c")).alias("chars_mean"),
        r6(F.avg("t")).alias("words_mean"),
        r6(F.sum("t") / F.greatest(F.sum("t"), F.lit(1))).alias("fertility_tokens_per_word"),
    )
    return stats.join(totals, by).withColumn("total_tokens_estimate", r6(F.col("tokens_mean") * F.col("n_docs")))


def with_class(docs: DataFrame) -> DataFrame:
    """The stand-in classes of the driver tables, by language."""
    c = F.col("lang")
    return docs.withColumn(
        "corpus_class",
        F.when(c == "en", "english_control").when(c == "fr", "formal_bm").when(c == "de", "manglish").when(c == "es", "code_switched"),
    )


def fuse_labels(primary: Column, specialist: Column) -> Column:
    """Label map of both classifiers: the specialist's Malay and Indonesian labels win when larger."""
    judged = list(lx.MALAY_LABELS + lx.INDONESIAN_LABELS)
    chosen = F.map_filter(specialist, lambda k, _: k.isin(judged))
    return F.map_zip_with(primary, chosen, lambda _, a, b: F.greatest(a, b))


def label_mass(probs: Column, labels) -> Column:
    return F.aggregate(F.map_values(F.map_filter(probs, lambda k, _: k.isin(list(labels)))), F.lit(0.0), lambda a, x: a + x)


def top_label(probs: Column) -> Column:
    """The most probable label; the alphabetically first of equals."""
    best = F.array_min(F.transform(F.map_entries(probs), lambda e: F.struct((-e["value"]).alias("p"), e["key"].alias("k"))))
    return F.coalesce(best["k"], F.lit("unknown"))


def three_places(x: Column) -> Column:
    """``x`` (0 to 65536) to three places by the double's exact value, ties to even.

    Spark rounds the shortest decimal that reads back as ``x``: 0.0875 up, though the double lies below it.
    """
    # both parts of x are short enough that a thousand times them is exact, and so is the sign of their sum
    high = F.floor(x * (1 << 30)) / F.lit(float(1 << 30))
    low = F.floor(x * 1000)
    over = (high * 1000 - (low + 0.5)) + (x - high) * 1000
    up = F.when(over > 0, 1).when(over < 0, 0).otherwise(low % 2)
    return F.format_string("%.3f", (low + up) / 1000)


def lid_result(
    probs: Column, id_ratio: Column, my_ratio: Column, min_malay: float = 0.7, max_indo: float = 0.2, min_english: float = 0.8, max_marker: float = 0.02
) -> Column:
    """struct(verdict, malay_prob, indonesian_prob, english_prob, top_label, rejected_by)."""
    def judge(s):
        top, malay, indo, eng = s["top"], s["malay"], s["indo"], s["eng"]
        verdict = (
            F.when(top == "unknown", "unknown")
            .when(top.isin(list(lx.ENGLISH_LABELS)), F.when(eng >= min_english, "english").otherwise("other"))
            .when(top.isin(list(lx.MANGLISH_LABELS)), "manglish")
            .when(top.isin(list(lx.ROJAK_LABELS)), "rojak")
            .when(top.isin(list(lx.INDONESIAN_LABELS)), "indonesian")
            .when(top.isin(list(lx.MALAY_LABELS)), "malay")
            .otherwise("other")
        )
        return tx.let(
            verdict,
            lambda v: F.struct(
                v.alias("verdict"),
                malay.alias("malay_prob"),
                indo.alias("indonesian_prob"),
                eng.alias("english_prob"),
                top.alias("top_label"),
                F.when(
                    v.isin("malay", "manglish", "rojak"),
                    F.when(malay < min_malay, f"fasttext_malay_prob<{min_malay}")
                    .when(indo > max_indo, f"fasttext_indonesian_prob>{max_indo}")
                    .when((s["id"] > max_marker) & (s["id"] > s["my"]), F.concat(F.lit("lexicon_indonesian_markers="), three_places(s["id"]), F.lit(f">{max_marker}"))),
                ).alias("rejected_by"),
            ),
        )

    masses = F.struct(
        label_mass(probs, lx.MALAY_LABELS + lx.MANGLISH_LABELS + lx.ROJAK_LABELS).alias("malay"),
        label_mass(probs, lx.INDONESIAN_LABELS).alias("indo"),
        label_mass(probs, lx.ENGLISH_LABELS).alias("eng"),
        top_label(probs).alias("top"),
        id_ratio.alias("id"),
        my_ratio.alias("my"),
    )
    return tx.let(masses, judge)


def classify(
    text: Column, provenance: Column, lid: Column, degraded: Column, id_ratio: Column, my_ratio: Column, switched: Column, dialect: Column, min_chars: int = 200
) -> Column:
    """struct(corpus_class, reason): the ordered ladder that gives a document one class or rejects it.

    ``lid`` is ``lid_result``'s struct, ``switched`` a boolean and ``dialect`` ``text.dialect``'s struct.
    """
    out = lambda c, r: F.struct((F.lit(None).cast("string") if c is None else F.lit(c)).alias("corpus_class"), (r if isinstance(r, Column) else F.lit(r)).alias("reason"))
    verdict, rejected, name = lid["verdict"], lid["rejected_by"], dialect["name"]
    english = (verdict == "english") & (lid["english_prob"] >= 0.8)
    weak = (
        F.when(id_ratio > my_ratio, out(None, "lexicon_indonesian"))
        .when(switched, out("code_switched", "degraded_intrasentential"))
        .when(name.isNotNull(), out("dialect", F.concat(F.lit("degraded_dialect_"), name)))
        .when(my_ratio > 0, out("formal_bm", "degraded_lexicon_malay"))
        .otherwise(out(None, "degraded_no_malay_signal"))
    )
    return (
        F.when(F.length(F.coalesce(text, F.lit(""))) < min_chars, out(None, "too_short"))
        .when(provenance == "code", out("code_control", "provenance_code"))
        .when((provenance == "english") & english, out("english_control", "lid_english"))
        .when((provenance == "english") & degraded, out("english_control", "provenance_english_lid_degraded"))
        .when(provenance == "english", out(None, "english_source_but_not_english"))
        .when(degraded, weak)
        .when(verdict == "indonesian", out(None, "indonesian"))
        .when(rejected.isNotNull(), out(None, rejected))
        .when(verdict == "english", out("english_control", "lid_english"))
        .when(~verdict.isin("malay", "manglish", "rojak"), out(None, F.concat(F.lit("verdict_"), verdict)))
        .when((verdict == "manglish") & switched, out("code_switched", "lid_manglish_intrasentential"))
        .when(verdict == "manglish", out("manglish", "lid_manglish"))
        .when((verdict == "rojak") & switched, out("code_switched", "lid_rojak_intra"))
        .when(verdict == "rojak", out(None, "rojak_but_inter_sentential"))
        .when(switched, out("code_switched", "intrasentential"))
        .when(name.isNotNull(), out("dialect", F.concat(F.lit("dialect_"), name)))
        .otherwise(out("formal_bm", "lid_malay"))
    )


def first_arrivals(docs: DataFrame, by: str, order: str, quota: int) -> DataFrame:
    """``docs`` with ``arrival`` (from 0 within its class) and ``accepted``: the class's first ``quota`` rows."""
    return ranked(docs, [by], [order], "arrival").withColumns({"arrival": F.col("arrival").cast("int"), "accepted": F.col("arrival") < quota})


def drop_small_classes(docs: DataFrame, by: str, optional: list[str], floor: int) -> DataFrame:
    """Without the optional classes that have fewer than ``floor`` rows; ``docs`` is computed once, and written."""
    docs = materialize(docs, "classes")
    small = docs.where(F.col(by).isin(optional)).groupBy(by).count().where(F.col("count") < floor).select(by)
    return docs.join(small, by, "left_anti")


def required_full(docs: DataFrame, by: str, targets: dict[str, int]) -> DataFrame:
    """One row: whether every required class has its target."""
    spark = docs.sparkSession
    need = spark.createDataFrame(sorted(targets.items()), f"{by} string, target long")
    have = docs.groupBy(by).agg(F.count("*").alias("n"))
    return need.join(have, by, "left").agg(F.coalesce(F.bool_and(F.coalesce("n", F.lit(0)) >= F.col("target")), F.lit(True)).alias("all_full"))


def manifest(judged: DataFrame, source: str = "source", kept: str = "kept", reason: str = "reason") -> DataFrame:
    """Records read, kept and rejected by reason for each source."""
    per = judged.groupBy(source, F.when(F.col(kept), F.lit(None)).otherwise(F.col(reason)).alias("reason")).agg(F.count("*").alias("n"))
    return per.groupBy(source).agg(
        F.sum("n").alias("records_read"),
        F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("n"))), F.lit(0)).alias("records_kept"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n"))))
        ).alias("records_rejected"),
    )


# ------------------------------------------------------------------------------- splits


def split(docs: DataFrame, by: str = "corpus_class", key: str = "doc_id", seed: int = 42, train: float = 0.8) -> DataFrame:
    """``docs`` with doc_index (0-based arrival in its class) and side, train or eval.

    Each class is ordered by its own seed, so adding a class moves no other's documents. The
    number of train rows is rounded half to even and kept between 1 and all but one. A class of
    any size is dealt over many tasks.
    """
    arrived = ranked(docs, [by], [key], "doc_index").withColumn("doc_index", F.col("doc_index").cast("int"))
    total = F.col("total")
    n_train = F.greatest(F.lit(1), F.least(F.bround(total * train).cast("long"), total - 1))
    quota = arrived.groupBy(by).agg(F.count("*").alias("total")).select(by, F.when(total == 1, F.lit(0)).otherwise(n_train).alias("quota"))
    digest = order_key(seed, "split", F.col(by), F.col("doc_index").cast("string"))
    flagged = quota_flag(arrived, [by], digest, ["doc_index"], quota, "_train")
    return flagged.withColumn("side", F.when(F.col("_train"), "train").otherwise("eval")).drop("_train")


def split_summary(parts: DataFrame, by: str = "corpus_class") -> DataFrame:
    return parts.groupBy(by).agg(
        F.count("*").alias("total"), F.count_if(F.col("side") == "train").alias("train"), F.count_if(F.col("side") == "eval").alias("eval")
    )


def split_faults(parts: DataFrame, by: str = "corpus_class", train: float = 0.8, tolerance: float = 0.02) -> DataFrame:
    """Repeats, gaps and the train fraction of each class's split."""
    index = F.col("doc_index")
    return parts.groupBy(by).agg(
        (F.count("*") - F.countDistinct("doc_index")).alias("repeated"),
        (F.max(index) + 1 - F.countDistinct("doc_index")).cast("long").alias("missing"),
        F.round(F.avg((F.col("side") == "train").cast("double")), 6).alias("train_fraction"),
    ).withColumn("fraction_ok", F.abs(F.col("train_fraction") - train) <= tolerance)


def assert_split(parts: DataFrame, by: str = "corpus_class") -> None:
    bad = split_faults(parts, by).where("repeated > 0 or missing > 0").limit(5).collect()
    if bad:
        raise SplitError(f"split repeats or misses documents: {bad}")


def contamination(calibration: DataFrame, evaluation: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row: how many calibration ids are evaluated on, and their share in percent."""
    ids, held = calibration.select(key).distinct(), evaluation.select(key).distinct()
    hit = ids.join(held.withColumn("_hit", F.lit(1)), key, "left")
    return hit.agg(
        F.count("*").alias("n_calibration"),
        F.count("_hit").alias("n_overlap"),
        F.round(F.coalesce(100 * F.try_divide(F.count("_hit"), F.count("*")), F.lit(0.0)), 6).alias("overlap_pct"),
    )


def assert_disjoint(calibration: DataFrame, evaluation: DataFrame, key: str = "doc_id", allow: bool = False) -> None:
    found = contamination(calibration, evaluation, key).first()
    if found.n_overlap and not allow:
        some = [r[0] for r in calibration.select(key).intersect(evaluation.select(key)).limit(5).collect()]
        raise ContaminationError(f"{found.n_overlap} ids ({found.overlap_pct}%) are evaluated on, such as {some}")


# ---------------------------------------------------------------------------- variants

WEIGHTS = {"formal_bm": 0.25, "english_control": 0.30, "manglish": 0.20, "code_switched": 0.20, "dialect": 0.05}


def candidate_pool(parts: DataFrame, target: int, seed: int = 42, by: str = "corpus_class", among: DataFrame | None = None) -> DataFrame:
    """Equally many train documents of each class, target over classes, at least one; only those of ``among`` (doc_id), if given."""
    train = parts.where(F.col("side") == "train")
    classes = train.groupBy(by).agg(F.count("*").alias("n"))
    # one row of one number, joined to one row a class
    each = classes.agg(F.greatest(F.floor(F.lit(target) / F.countDistinct(by)), F.lit(1)).alias("quota"))
    quota = classes.select(by).join(F.broadcast(each))
    if among is not None:
        train = train.join(among.select("doc_id").distinct(), "doc_id", "left_semi").select(parts.columns)
    return first_rows(train, [by], order_key(seed, "pool", F.col(by), F.col("doc_id").cast("string")), ["doc_id"], quota)


def variant(
    parts: DataFrame,
    name: str,
    n: int,
    seed: int = 42,
    by: str = "corpus_class",
    weights: dict[str, float] = WEIGHTS,
    profiles: DataFrame | None = None,
    experts: int | None = None,
    pool: int = 50_000,
) -> DataFrame:
    """The documents of a calibration variant: baseline_en, bm_only, mixed_5050, mixed_weighted, coverage_greedy or oracle_contaminated.

    coverage_greedy picks among the class-balanced candidate pool of ``pool`` train documents that
    have ``profiles`` (doc_id, expert_id, tokens) over ``experts`` experts.
    """
    train, held = parts.where(F.col("side") == "train"), parts.where(F.col("side") == "eval")
    english = F.col(by) == "english_control"

    def pick(rows: DataFrame, k: int, tag: str) -> DataFrame:
        key = order_key(seed, name, tag, n, F.col("doc_id").cast("string"))
        return rows.orderBy(key, "doc_id").limit(k)  # a sample of k rows is the feature

    if name == "baseline_en":
        out = pick(train.where(english), n, "en")
    elif name == "bm_only":
        out = pick(train.where(~english), n, "bm")
    elif name == "mixed_5050":
        out = pick(train.where(english), n // 2, "en").union(pick(train.where(~english), n - n // 2, "bm"))
    elif name == "mixed_weighted":
        quota = parts.sparkSession.createDataFrame([(c, w) for c, w in weights.items()], f"{by} string, w double").select(by, F.bround(F.lit(n) * F.col("w")).alias("quota"))
        out = first_rows(train, [by], order_key(seed, name, F.col(by), n, F.col("doc_id").cast("string")), ["doc_id"], quota)
    elif name == "coverage_greedy":
        if profiles is None or experts is None:
            raise ValueError("coverage_greedy needs the documents' routing profiles: run the routing phase first")
        candidates = candidate_pool(parts, pool, seed, by, profiles)
        picks = coverage_greedy(profiles.join(candidates.select("doc_id"), "doc_id", "left_semi"), experts, n)
        # n rows
        out = candidates.join(F.broadcast(picks.select("doc_id")), "doc_id", "left_semi")
    elif name == "oracle_contaminated":
        out = pick(held.where(~english), n, "oracle")
    else:
        raise ValueError(f"unknown variant {name}")
    return out.withColumns({"variant": F.lit(name), "contaminated": F.lit(name == "oracle_contaminated")})
