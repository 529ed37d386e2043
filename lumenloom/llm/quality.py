"""Quality rules [native]: hashed n-gram log-likelihood ratio plus base counts of each text.

Model. A text's n-grams are its words and the 2-grams of its words' shapes (runs of lower-case
letters become ``a``, upper-case ``A``, digits ``0``, other characters stay), padded at both ends;
all are hashed by CRC-32 into ``buckets``. Words tell what a text is about, shapes tell prose from
markup in any language. Two multinomials over the buckets are estimated with additive
smoothing: one from trusted documents, one from the whole corpus. A document's score is the sum
of log(trusted / corpus) over its n-grams, in whole millionths, divided by the number of
n-grams; it is kept when the score is at least ``threshold`` and the base rules pass. Sums are
integers, so the verdict does not depend on partitioning.

Plan. Texts are read once: base counts and bucket numbers are written to the shared folder, then
counted, then scored against the model, which is one array of ``buckets`` integers. Both counts
cover every document, and every trusted one.

Defined results: null text has no words, zero counts, base_failed true and kept false. Without
trusted rows every ratio is zero, so the base rules alone decide. Repeated rows get equal
results. Null ids are never trusted. ``keep_good`` keeps all columns, whatever their names; in
``judge_quality`` a column of the input that is named like a result gives way to it. An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize, passing, small_side

BUCKETS = 4096
#: Mean log ratio per n-gram below which a document is rejected.
THRESHOLD = -0.1
#: Added to each bucket's trusted count, and as much of the corpus: fewer n-grams than that say little either way.
SMOOTH = 8.0
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def word_shapes(text: Column) -> Column:
    """The array of word shapes of ``text``."""
    shaped = F.regexp_replace(F.coalesce(text, F.lit("")), r"\p{Ll}+", "a")
    shaped = F.regexp_replace(F.regexp_replace(shaped, r"\p{Lu}+", "A"), r"\p{Nd}+", "0")
    return words_of(shaped)


def grams(words: Column, shapes: Column, buckets: int) -> Column:
    """Hash buckets of the words and of the padded 2-grams of their shapes; none for no words."""
    place = lambda x: F.pmod(F.crc32(x), F.lit(buckets)).cast("int")
    after = F.concat(F.slice(shapes, F.lit(2), F.size(shapes)), F.array(F.lit("")))
    first = F.array(place(F.concat(F.lit(" "), F.get(shapes, F.lit(0)))))
    pairs = F.zip_with(shapes, after, lambda a, b: place(F.concat(a, F.lit(" "), b)))
    return F.when(F.size(words) > 0, F.concat(F.transform(words, place), first, pairs)).otherwise(F.array().cast("array<int>"))


def fit_ratios(counted: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """log(trusted / corpus) of every bucket in millionths, from all rows of ``counted`` (doc_id, grams)."""
    ids = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    trusted = small_side(ids).withColumn("trusted", F.lit(1))
    rows = (
        counted.select("doc_id", "grams")
        .join(trusted, "doc_id", "left")
        # the outer form: for the inner one the optimizer would test the array's size by computing it again
        .select("trusted", F.explode_outer("grams").alias("bucket"))
        .where("bucket is not null")
        .groupBy("bucket")
        .agg(F.count("*").alias("n"), F.count("trusted").alias("t"))
    )
    counts = rows.agg(
        F.collect_list(F.struct("bucket", "n", "t")).alias("c"), F.sum("n").alias("n"), F.sum("t").alias("t")
    )
    scaled = counts.select(
        F.transform(
            "c",
            lambda c: F.struct(
                c["bucket"].alias("bucket"),
                F.when(F.col("t") > 0, _ratio(c["t"], F.col("t"), c["n"], F.col("n")))
                .otherwise(F.lit(0))
                .cast("long")
                .alias("micro"),
            ),
        ).alias("c")
    ).first()
    out = [0] * buckets
    for c in scaled.c:
        out[c.bucket] = c.micro
    return out


def _ratio(t: Column, ts: Column, n: Column, ns: Column) -> Column:
    """log of the smoothed shares: ``SMOOTH`` is added to the trusted count and to what the corpus lets expect of it."""
    expected = n.cast("double") * ts.cast("double") / ns.cast("double")
    return F.round(F.lit(1e6) * F.log((t + F.lit(SMOOTH)) / (expected + F.lit(SMOOTH))))



def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``q_words`` and the base columns, each named ``q_`` and its name.

    Window hashes are sorted as they are to see whether any comes twice; only the windows of such
    texts are sorted again with their places.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0)
    windows = F.when(
        F.size("q_words") >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size("q_words") - 3),
            lambda i: F.xxhash64(F.get("q_words", i), F.get("q_words", i + 1), F.get("q_words", i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    wide = docs.withColumn("q_words", words_of(F.col(text))).withColumns({"q_lines": lines, "q_windows": windows})
    placed = F.sort_array(F.transform("q_windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    wide = wide.withColumn("q_placed", F.when(F.size(F.array_distinct("q_windows")) < F.size("q_windows"), placed))
    twice = F.filter(
        "q_placed",
        lambda x, j: (x["w"] == F.get("q_placed", j - 1)["w"]) | (x["w"] == F.get("q_placed", j + 1)["w"]),
    )
    wide = wide.withColumn("q_at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    # a window covers three words, less those that the next one covers
    covered = F.aggregate(
        F.transform("q_at", lambda x, j: F.least(F.lit(3), F.coalesce(F.get("q_at", j + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x
    )
    n_words = F.size("q_words")
    return (
        wide.withColumns(
            {
                "q_n_words": n_words.cast("long"),
                "q_word_chars": F.aggregate("q_words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)),
                "q_n_symbols": F.regexp_count(body, F.lit(f"[{SYMBOLS}]")).cast("long"),
                "q_n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
                "q_n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            }
        )
        .drop("q_lines", "q_windows", "q_placed", "q_at")
        .withColumn("q_base_failed", (F.col("q_n_words") < 50) | (F.col("q_n_repeat_words") * 100 > F.col("q_n_words") * 50))
    )


def _scored(docs: DataFrame, labels: DataFrame, carry: list[str], threshold: float, buckets: int) -> DataFrame:
    """The ``carry`` columns of ``docs`` as c0, c1, ... by place, with all results named ``q_`` and their name."""
    at = [docs.columns.index(c) for c in carry]
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text, doc_id = (f"c{docs.columns.index(c)}" for c in ("text", "doc_id"))
    counted = base_counts(plain, text).withColumn("q_shapes", word_shapes(F.col(text)))
    kept = dict.fromkeys([*(f"c{i}" for i in at), doc_id])
    written = materialize(
        counted.select(*kept, *[f"q_{c}" for c in BASE], grams(F.col("q_words"), F.col("q_shapes"), buckets).alias("q_grams")), "quality"
    )
    ratios = fit_ratios(written.select(F.col(doc_id).alias("doc_id"), F.col("q_grams").alias("grams")), labels, buckets)
    table = F.lit(ratios).cast("array<bigint>")
    least = F.lit(int(round(threshold * 1e6)))
    return (
        written.withColumns(
            {
                "q_n_grams": F.size("q_grams").cast("long"),
                "q_llr_micro": F.aggregate("q_grams", F.lit(0).cast("long"), lambda a, g: a + F.get(table, g)),
            }
        )
        .drop("q_grams")
        .withColumn("q_kept", ~F.col("q_base_failed") & (F.col("q_llr_micro") >= F.col("q_n_grams") * least))
        .select(*[F.col(f"c{i}").alias(f"c{j}") for j, i in enumerate(at)], *[f"q_{c}" for c in RESULTS])
    )


RESULTS = [*BASE, "n_grams", "llr_micro", "kept"]


def judge_quality(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, carry: list[str] | None = None
) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the base columns, n_grams, llr_micro and kept.

    ``llr_micro`` is the sum of the ratios in millionths of a nat; ``carry`` names the columns to keep.
    """
    carry = [c for c in carry or docs.columns if c not in RESULTS]
    return _scored(docs, labels, carry, threshold, buckets).toDF(*carry, *RESULTS)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns; written, so that the scored table can go."""
    with passing(docs.sparkSession) as keep:
        scored = _scored(docs, labels, docs.columns, threshold, buckets)
        good = keep(materialize(scored.where("q_kept").select(*[f"c{i}" for i in range(len(docs.columns))]), "good"))
    return good.toDF(*docs.columns)
