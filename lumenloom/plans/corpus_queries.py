"""Queries over ``documents``, ``conversations`` and ``benchmark``: corpus building and its checks.

Comments name the survey ids a query covers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing as hs
from ..functions import text as tx
from ..operators import admission, corpus, dedup
from ..session import cut_lineage, table
from ..sources import ingest

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

# The test tables hold invented prose in four languages, so these lists stand in for the fixed ones.
FIRST, SECOND = ("the", "and", "of", "der", "die", "le"), ("is", "that", "to", "und", "das", "la", "de", "el")
ID_MARKERS, MY_MARKERS = ("der", "und", "die das", "ist"), ("le", "de", "la le", "que", "et")
DIALECTS = {"north": ("the", "of", "le"), "south": ("and", "der", "de", "el"), "west": ("is", "la", "die")}

W = r"[\p{L}\p{M}\p{N}_](?:[\p{L}\p{M}\p{N}_'']*[\p{L}\p{M}\p{N}_])?"
CLASS = "CASE lang WHEN 'en' THEN 'english_control' WHEN 'fr' THEN 'formal_bm' WHEN 'de' THEN 'manglish' WHEN 'es' THEN 'code_switched' END"


def quoted(items) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.with_class(documents(spark, sf_dir)).where("corpus_class is not null")


@register(
    "corpus_stats",
    rf"""
WITH s AS (SELECT lang, len(regexp_extract_all(coalesce(text, ''), '{W}'))::BIGINT AS t, length(coalesce(text, '')) AS c FROM documents)
SELECT lang, count(*) AS n_docs_sampled_for_tokens, round(avg(t), 6) AS tokens_mean, round(coalesce(stddev_samp(t), 0), 6) AS tokens_std,
  round(quantile_cont(t, 0.1), 6) AS tokens_p10, round(quantile_cont(t, 0.5), 6) AS tokens_p50, round(quantile_cont(t, 0.9), 6) AS tokens_p90,
  round(quantile_cont(t, 0.99), 6) AS tokens_p99, max(t) AS tokens_max, round(avg((t >= 2048)::INT::DOUBLE), 6) AS frac_at_calib_seq_len,
  round(avg(c), 6) AS chars_mean, round(avg(t), 6) AS words_mean, round(sum(t) / greatest(sum(t), 1), 6) AS fertility_tokens_per_word,
  count(*) AS n_docs, round(round(avg(t), 6) * count(*), 6) AS total_tokens_estimate
FROM s GROUP BY lang""",
)
def corpus_stats(spark, sf_dir):  # A1 T2 W5
    return corpus.corpus_stats(documents(spark, sf_dir), "lang")


@register(
    "word_shingles_13",
    rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{W}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) > 0 THEN list_distinct(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i:i + 12], ' '))) ELSE [] END AS s FROM w)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(list_sum(list_transform(s, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT)), 0)::BIGINT AS checksum FROM s""",
)
def word_shingles_13(spark, sf_dir):  # T2 T3
    sets = documents(spark, sf_dir).select("doc_id", tx.words(F.col("text")).alias("w")).select("doc_id", tx.shingles(F.col("w"), 13).alias("s"))
    return sets.select(
        "doc_id",
        F.size("s").cast("long").alias("n_shingles"),
        F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + hs.hash32(x)).alias("checksum"),
    )


NORM = "trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g'))"


@register(
    "exact_dedup_first_seen",
    f"""
WITH k AS (SELECT doc_id, sha256({NORM}) AS key FROM documents)
SELECT doc_id, key, row_number() OVER (PARTITION BY key ORDER BY doc_id) > 1 AS duplicate FROM k""",
)
def exact_dedup(spark, sf_dir):  # T4 W10
    return dedup.first_seen(documents(spark, sf_dir))


@register(
    "dedup_counters",
    f"""
WITH k AS (SELECT sha256({NORM}) AS key FROM documents)
SELECT count(*) AS n_read, count(DISTINCT key) AS n_unique, count(*) - count(DISTINCT key) AS n_exact FROM k""",
)
def dedup_counters(spark, sf_dir):  # A4 X5
    return dedup.first_seen(documents(spark, sf_dir)).agg(
        F.count("*").alias("n_read"), F.count_if(~F.col("duplicate")).alias("n_unique"), F.count_if("duplicate").alias("n_exact")
    )


PERMS = 16
PERM_ROWS = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(hs.permutations(PERMS)))
SIGNATURES = rf"""
w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{W}') AS w FROM documents),
h AS (SELECT DISTINCT doc_id, ('0x' || substr(md5(s), 1, 8))::BIGINT % {hs.PRIME} AS x FROM (
  SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i:i + 12], ' '))) AS s FROM w WHERE len(w) > 0)),
p(i, a, b) AS (VALUES {PERM_ROWS}),
sig AS (SELECT doc_id, i, min((a * x + b) % {hs.PRIME})::BIGINT AS v FROM h, p GROUP BY ALL)"""


@register("minhash_signatures", f"WITH {SIGNATURES} SELECT doc_id, array_to_string(list(v ORDER BY i), ',') AS signature FROM sig GROUP BY doc_id")
def minhash_signatures(spark, sf_dir):  # T5
    return dedup.signatures(documents(spark, sf_dir), PERMS).select("doc_id", F.array_join("signature", ",").alias("signature"))


LSH = f"""{SIGNATURES},
whole AS (SELECT doc_id, list(v ORDER BY i) AS s FROM sig GROUP BY doc_id),
class AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS rep FROM whole),
band AS (SELECT doc_id, i // 4 AS band, array_to_string(list(v ORDER BY i), '|') AS key FROM sig WHERE doc_id IN (SELECT rep FROM class) GROUP BY doc_id, i // 4),
pair AS (SELECT DISTINCT l.doc_id AS a, r.doc_id AS b FROM band l JOIN band r ON l.band = r.band AND l.key = r.key AND l.doc_id < r.doc_id),
agree AS (SELECT a, b, count(*) FILTER (x.v = y.v) / {PERMS} AS agreement FROM pair JOIN sig x ON x.doc_id = a JOIN sig y ON y.doc_id = b AND x.i = y.i GROUP BY a, b)"""


@register("lsh_candidate_pairs", f"WITH {LSH} SELECT a AS doc_a, b AS doc_b, round(agreement, 6) AS agreement FROM agree")
def lsh_candidate_pairs(spark, sf_dir):  # T6 T7 J6
    pairs = dedup.candidate_pairs(dedup.signatures(documents(spark, sf_dir), PERMS), rows=4)
    return pairs.select("doc_a", "doc_b", F.round("agreement", 6).alias("agreement"))


@register(
    "near_dup_pairwise",
    f"""WITH {LSH}
SELECT doc_id, doc_id IN (SELECT b FROM agree WHERE agreement >= 0.8) OR doc_id IN (SELECT doc_id FROM class WHERE doc_id <> rep) AS duplicate FROM documents""",
)
def near_dup_pairwise(spark, sf_dir):  # I2 (pairwise mode)
    docs = documents(spark, sf_dir)
    sigs = cut_lineage(dedup.signatures(docs, PERMS))
    return dedup.pairwise_groups(docs, sigs, dedup.near_groups(sigs, 0.8, rows=4))


@register("exact_dedup_normalised")
def exact_dedup_normalised(spark, sf_dir):  # T1 T4 W10
    return dedup.first_seen(documents(spark, sf_dir), full=True)


@register("near_dup_faithful")
def near_dup_faithful(spark, sf_dir):  # I2 (arrival order)
    docs = documents(spark, sf_dir)
    sigs = cut_lineage(dedup.signatures(docs, PERMS))
    return dedup.arrival_groups(docs, sigs, dedup.near_groups(sigs, 0.8, rows=4))


def sql_hits(markers) -> str:
    single, multi = [m for m in markers if " " not in m], [m for m in markers if " " in m]
    out = f"len(list_filter(w, lambda x: x IN ({quoted(single)})))"
    return " + ".join([out, *[f"(length(low) - length(replace(low, '{m}', ''))) // {len(m)}" for m in multi]])


@register(
    "marker_ratios",
    rf"""
WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS low, regexp_extract_all(lower(coalesce(text, '')), '{W}') AS w FROM documents)
SELECT doc_id, len(w)::BIGINT AS n_words, CASE WHEN len(w) = 0 THEN 0 ELSE round(({sql_hits(ID_MARKERS)}) / len(w), 6) END AS id_ratio,
  CASE WHEN len(w) = 0 THEN 0 ELSE round(({sql_hits(MY_MARKERS)}) / len(w), 6) END AS my_ratio FROM d""",
)
def marker_ratios(spark, sf_dir):  # T8
    t = F.col("text")
    return documents(spark, sf_dir).select(
        "doc_id",
        F.size(tx.words(t)).cast("long").alias("n_words"),
        F.round(tx.marker_ratio(t, ID_MARKERS), 6).alias("id_ratio"),
        F.round(tx.marker_ratio(t, MY_MARKERS), 6).alias("my_ratio"),
    )


SWITCH = rf"""
sent AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_extract_all(lower(coalesce(text, '')), '[^.!?\n]+[.!?]?'), lambda s: trim(s)), lambda s: s <> '')) AS s FROM documents),
sw AS (SELECT doc_id, list_distinct(regexp_extract_all(s, '{W}')) AS w FROM sent),
mix AS (SELECT doc_id, count(*) FILTER (len(w) >= 5) AS considered,
  count(*) FILTER (len(w) >= 5 AND list_has_any(w, [{quoted(FIRST)}]) AND list_has_any(w, [{quoted(SECOND)}])) AS mixed FROM sw GROUP BY doc_id),
switch AS (SELECT d.doc_id, coalesce(considered, 0) AS considered, coalesce(mixed, 0) AS mixed,
  CASE WHEN coalesce(considered, 0) = 0 THEN 0 ELSE mixed / considered END AS ratio FROM documents d LEFT JOIN mix USING (doc_id))"""


@register(
    "code_switch_ratio",
    f"WITH {SWITCH} SELECT doc_id, considered, mixed, round(ratio, 6) AS ratio, ratio >= 0.15 AS switched FROM switch",
)
def code_switch_ratio(spark, sf_dir):  # T9 T10 T11
    found = documents(spark, sf_dir).select("doc_id", tx.switch_counts(F.col("text"), FIRST, SECOND).alias("s"))
    ratio = F.coalesce(F.try_divide("s.mixed", "s.considered"), F.lit(0.0))
    return found.select("doc_id", "s.considered", "s.mixed", F.round(ratio, 6).alias("ratio"), (ratio >= 0.15).alias("switched"))


DIALECT = rf"""
dw AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '{W}')) AS w FROM documents),
dh AS (SELECT doc_id, [{", ".join(f"len(list_intersect(w, [{quoted(m)}]))" for m in DIALECTS.values())}] AS h FROM dw),
dialect AS (SELECT doc_id, list_max(h)::BIGINT AS hits, CASE WHEN list_max(h) >= 2 THEN ([{quoted(DIALECTS)}])[list_position(h, list_max(h))] END AS dialect FROM dh)"""


@register("dialect_hits", f"WITH {DIALECT} SELECT * FROM dialect")
def dialect_hits(spark, sf_dir):  # T12
    return documents(spark, sf_dir).select("doc_id", tx.dialect(F.col("text"), DIALECTS).alias("d")).select(
        "doc_id", "d.hits", F.col("d.name").alias("dialect")
    )


def label_maps(docs: DataFrame) -> DataFrame:
    """Stand-in classifier output: two label maps from the language and a hash of the id."""
    u = lambda tag: (hs.hash32(F.concat(F.lit(tag), F.col("doc_id").cast("string"))) % 1000) / 1000
    main = F.when(F.col("lang") == "en", "eng").when(F.col("lang") == "fr", "malay").when(F.col("lang") == "de", "manglish").otherwise("rojak")
    return docs.withColumns(
        {
            "primary": F.create_map(main, F.lit(0.55) + u("p") * 0.45, F.lit("ind"), u("i") * 0.3, F.lit("other"), u("o") * 0.6),
            "specialist": F.create_map(F.lit("standard-malay"), u("m"), F.lit("ind"), u("n") * 0.25, F.lit("other"), F.lit(0.9)),
        }
    )


SQL_U = lambda tag: f"((('0x' || substr(md5('{tag}' || doc_id::VARCHAR), 1, 8))::BIGINT % 1000) / 1000)"
LABELS = f"""
raw AS (SELECT doc_id, text, lang, source, CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'malay' WHEN 'de' THEN 'manglish' ELSE 'rojak' END AS main,
  0.55::DOUBLE + {SQL_U("p")} * 0.45::DOUBLE AS pm, greatest({SQL_U("i")} * 0.3::DOUBLE, {SQL_U("n")} * 0.25::DOUBLE) AS ind, {SQL_U("o")} * 0.6::DOUBLE AS oth, {SQL_U("m")} AS sm FROM documents),
mass AS (SELECT *, CASE WHEN main IN ('malay', 'manglish', 'rojak') THEN pm ELSE 0 END + sm AS malay_p, CASE WHEN main = 'eng' THEN pm ELSE 0 END AS eng_p,
  list_sort([{{'p': -pm, 'k': main}}, {{'p': -ind, 'k': 'ind'}}, {{'p': -oth, 'k': 'other'}}, {{'p': -sm, 'k': 'standard-malay'}}])[1].k AS top FROM raw),
ver AS (SELECT *, CASE WHEN top = 'eng' THEN CASE WHEN eng_p >= 0.8 THEN 'english' ELSE 'other' END WHEN top = 'manglish' THEN 'manglish' WHEN top = 'rojak' THEN 'rojak'
  WHEN top = 'ind' THEN 'indonesian' WHEN top IN ('malay', 'standard-malay') THEN 'malay' ELSE 'other' END AS verdict FROM mass),
ratio AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 ELSE ({sql_hits(ID_MARKERS)}) / len(w) END AS idr, CASE WHEN len(w) = 0 THEN 0 ELSE ({sql_hits(MY_MARKERS)}) / len(w) END AS myr
  FROM (SELECT doc_id, lower(coalesce(text, '')) AS low, regexp_extract_all(lower(coalesce(text, '')), '{W}') AS w FROM documents)),
lid AS (SELECT v.*, idr, myr, CASE WHEN verdict IN ('malay', 'manglish', 'rojak') THEN CASE WHEN malay_p < 0.7 THEN 'fasttext_malay_prob<0.7'
  WHEN ind > 0.2 THEN 'fasttext_indonesian_prob>0.2' WHEN idr > 0.02 AND idr > myr THEN 'lexicon_indonesian_markers=' || printf('%.3f', idr) || '>0.02' END END AS rejected_by
  FROM ver v JOIN ratio USING (doc_id))"""


def lid_columns(docs: DataFrame) -> DataFrame:
    signals = tx.word_signals(F.col("text"), {"id": ID_MARKERS, "my": MY_MARKERS}, DIALECTS)
    return (
        label_maps(docs)
        .withColumns({"probs": corpus.fuse_labels(F.col("primary"), F.col("specialist")), "signals": signals})
        .withColumns({"id_ratio": F.col("signals.id"), "my_ratio": F.col("signals.my"), "di": F.col("signals.dialect")})
        .withColumn("lid", corpus.lid_result(F.col("probs"), F.col("id_ratio"), F.col("my_ratio")))
    )


@register(
    "lid_fusion",
    f"""WITH {LABELS} SELECT doc_id, verdict, round(malay_p, 6) AS malay_prob, round(ind, 6) AS indonesian_prob, round(eng_p, 6) AS english_prob, top AS top_label, rejected_by,
  verdict IN ('malay', 'manglish', 'rojak') AND rejected_by IS NULL AS accepted_as_malay, verdict = 'english' AND eng_p >= 0.8 AS is_english FROM lid""",
)
def lid_fusion(spark, sf_dir):  # T15 T16 T17
    r = lid_columns(documents(spark, sf_dir))
    return r.select(
        "doc_id",
        "lid.verdict",
        *[F.round(f"lid.{c}", 6).alias(c) for c in ("malay_prob", "indonesian_prob", "english_prob")],
        "lid.top_label",
        "lid.rejected_by",
        (F.col("lid.verdict").isin("malay", "manglish", "rojak") & F.col("lid.rejected_by").isNull()).alias("accepted_as_malay"),
        ((F.col("lid.verdict") == "english") & (F.col("lid.english_prob") >= 0.8)).alias("is_english"),
    )


def ladder(docs: DataFrame) -> DataFrame:
    """(doc_id, source, corpus_class, reason) of the classification ladder on the stand-in inputs, computed once."""
    kind = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    t = F.col("text")
    rows = lid_columns(docs).withColumns(
        {
            "provenance": F.when(kind == 19, "code").when(kind == 18, "english").otherwise("malay"),
            "degraded": kind == 17,
            "sw": tx.switch_counts(t, FIRST, SECOND),
        }
    )
    switched = F.coalesce(F.try_divide("sw.mixed", "sw.considered"), F.lit(0.0)) >= 0.15
    out = corpus.classify(t, F.col("provenance"), F.col("lid"), F.col("degraded"), F.col("id_ratio"), F.col("my_ratio"), switched, F.col("di"))
    # written: a filter on the class would be pushed down with the whole ladder in it, each step repeated in the next
    return cut_lineage(rows.select("doc_id", "source", out.alias("o")).select("doc_id", "source", "o.corpus_class", "o.reason"))


LADDER = f"""{LABELS}, {SWITCH}, {DIALECT},
inp AS (SELECT l.*, s.ratio >= 0.15 AS switched, d.dialect, regexp_extract(source, '(\\d+)$', 1)::INT AS kind
  FROM lid l JOIN switch s USING (doc_id) JOIN dialect d USING (doc_id)),
judged AS (SELECT doc_id, source, unnest(CASE
  WHEN length(coalesce(text, '')) < 200 THEN {{'corpus_class': NULL::VARCHAR, 'reason': 'too_short'}}
  WHEN kind = 19 THEN {{'corpus_class': 'code_control', 'reason': 'provenance_code'}}
  WHEN kind = 18 AND verdict = 'english' AND eng_p >= 0.8 THEN {{'corpus_class': 'english_control', 'reason': 'lid_english'}}
  WHEN kind = 18 THEN {{'corpus_class': NULL, 'reason': 'english_source_but_not_english'}}
  WHEN kind = 17 AND idr > myr THEN {{'corpus_class': NULL, 'reason': 'lexicon_indonesian'}}
  WHEN kind = 17 AND switched THEN {{'corpus_class': 'code_switched', 'reason': 'degraded_intrasentential'}}
  WHEN kind = 17 AND dialect IS NOT NULL THEN {{'corpus_class': 'dialect', 'reason': 'degraded_dialect_' || dialect}}
  WHEN kind = 17 AND myr > 0 THEN {{'corpus_class': 'formal_bm', 'reason': 'degraded_lexicon_malay'}}
  WHEN kind = 17 THEN {{'corpus_class': NULL, 'reason': 'degraded_no_malay_signal'}}
  WHEN verdict = 'indonesian' THEN {{'corpus_class': NULL, 'reason': 'indonesian'}}
  WHEN rejected_by IS NOT NULL THEN {{'corpus_class': NULL, 'reason': rejected_by}}
  WHEN verdict = 'english' THEN {{'corpus_class': 'english_control', 'reason': 'lid_english'}}
  WHEN verdict NOT IN ('malay', 'manglish', 'rojak') THEN {{'corpus_class': NULL, 'reason': 'verdict_' || verdict}}
  WHEN verdict = 'manglish' AND switched THEN {{'corpus_class': 'code_switched', 'reason': 'lid_manglish_intrasentential'}}
  WHEN verdict = 'manglish' THEN {{'corpus_class': 'manglish', 'reason': 'lid_manglish'}}
  WHEN verdict = 'rojak' AND switched THEN {{'corpus_class': 'code_switched', 'reason': 'lid_rojak_intra'}}
  WHEN verdict = 'rojak' THEN {{'corpus_class': NULL, 'reason': 'rojak_but_inter_sentential'}}
  WHEN switched THEN {{'corpus_class': 'code_switched', 'reason': 'intrasentential'}}
  WHEN dialect IS NOT NULL THEN {{'corpus_class': 'dialect', 'reason': 'dialect_' || dialect}}
  ELSE {{'corpus_class': 'formal_bm', 'reason': 'lid_malay'}} END) FROM inp)"""


@register("classify_ladder", f"WITH {LADDER} SELECT * FROM judged")
def classify_ladder(spark, sf_dir):  # T18 F1 F6
    return ladder(documents(spark, sf_dir))


@register(
    "ingest_manifest",
    f"""WITH {LADDER}, per AS (SELECT source, CASE WHEN corpus_class IS NULL THEN reason END AS reason, count(*) AS n FROM judged GROUP BY ALL)
SELECT source, sum(n)::BIGINT AS records_read, coalesce(sum(n) FILTER (reason IS NULL), 0)::BIGINT AS records_kept,
  coalesce(string_agg(reason || '=' || n, ',' ORDER BY reason) FILTER (reason IS NOT NULL), '') AS records_rejected FROM per GROUP BY source""",
)
def ingest_manifest(spark, sf_dir):  # A3
    judged = ladder(documents(spark, sf_dir)).withColumn("kept", F.col("corpus_class").isNotNull())
    text = F.array_join(F.transform(F.map_entries("records_rejected"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return corpus.manifest(judged).withColumn("records_rejected", text)


@register("ingest_state_machine")
def ingest_state_machine(spark, sf_dir):  # I3
    kind = F.coalesce(F.regexp_extract("source", r"(\d+)$", 1).try_cast("long"), F.lit(0))
    primary = F.when(kind == 19, "code_control").when(kind == 18, "english_control").when(kind % 2 == 0, "formal_bm")
    docs = documents(spark, sf_dir)
    judged = ladder(docs).join(docs.select("doc_id", "text"), "doc_id")
    # sources are read one after another
    records = judged.withColumns({"arrival": kind * (1 << 40) + F.col("doc_id"), "primary": primary})
    return admission.ingest(records, target=50, required=["formal_bm", "english_control"], cap=200_000)


@register(
    "class_quota",
    f"""WITH {LADDER}, r AS (SELECT doc_id, corpus_class, row_number() OVER (PARTITION BY corpus_class ORDER BY doc_id) - 1 AS arrival FROM judged WHERE corpus_class IS NOT NULL)
SELECT doc_id, corpus_class, arrival::INT AS arrival, arrival < 50 AS accepted FROM r""",
)
def class_quota(spark, sf_dir):  # F2 W1 W9
    kept = ladder(documents(spark, sf_dir)).where("corpus_class is not null").select("doc_id", "corpus_class")
    return corpus.first_arrivals(kept, "corpus_class", "doc_id", 50)


@register(
    "optional_class_floor",
    f"""WITH {LADDER}, n AS (SELECT corpus_class, count(*) AS n FROM judged WHERE corpus_class IS NOT NULL GROUP BY 1)
SELECT corpus_class, n FROM n WHERE NOT (corpus_class IN ('dialect', 'code_control') AND n < 60)""",
)
def optional_class_floor(spark, sf_dir):  # F5
    kept = ladder(documents(spark, sf_dir)).where("corpus_class is not null")
    left = corpus.drop_small_classes(kept, "corpus_class", ["dialect", "code_control"], 60)
    return left.groupBy("corpus_class").agg(F.count("*").alias("n"))


@register(
    "required_classes_full",
    f"WITH c AS (SELECT {CLASS} AS k FROM documents) SELECT count(*) FILTER (k = 'formal_bm') >= 20 AND count(*) FILTER (k = 'manglish') >= 20 AS all_full FROM c",
)
def required_classes_full(spark, sf_dir):  # F3 F4
    return corpus.required_full(classed(spark, sf_dir), "corpus_class", {"formal_bm": 20, "manglish": 20})


# ------------------------------------------------------------------------ records, pairs, prompts


@register(
    "raw_record_extract",
    """SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN NULL ELSE text END AS extracted FROM documents""",
)
def raw_record_extract(spark, sf_dir):  # S1 S4 S5
    k = F.col("doc_id") % 5
    text = F.to_json(F.struct(F.col("text").alias("v")))
    value = F.expr("substring(j, 6, length(j) - 6)")
    raw = (
        documents(spark, sf_dir)
        .withColumn("j", text)
        .withColumn("s", value)
        .select(
            "doc_id",
            F.when(k == 0, "bare_string").when(k == 1, "json_array").otherwise("object").alias("shape"),
            F.when(k == 0, F.col("s"))
            .when(k == 1, F.concat(F.lit('["tag", '), F.col("s"), F.lit(', {"ms": "x"}]')))
            .when(k == 2, F.concat(F.lit('{"text": '), F.col("s"), F.lit("}")))
            .when(k == 3, F.col("s"))
            .otherwise(F.lit('{"text": 42}'))
            .alias("value"),
        )
    )
    return ingest.extract_text(ingest.parse_lines(raw), field="text", index=1).select("doc_id", F.col("text").alias("extracted"))


TURNS = """t AS (SELECT conv_id, turn, role, text, lead(text) OVER w AS reply, lead(role) OVER w AS reply_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pair AS (SELECT conv_id, turn, text AS l, reply AS r FROM t WHERE role = 'user' AND reply_role = 'assistant' AND reply IS NOT NULL),
al AS (SELECT *, length(l) AS n, length(r) AS m, list_distinct(regexp_extract_all(l, '\\p{Nd}+')) AS a, list_distinct(regexp_extract_all(r, '\\p{Nd}+')) AS b FROM pair),
judged AS (SELECT conv_id, turn, CASE WHEN n < 40 OR m < 40 THEN 'too_short' WHEN n / m < 0.4 OR n / m > 2.5 THEN 'length_ratio'
  WHEN len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b)) / len(list_distinct(a || b)) < 0.3 THEN 'numeric_content_diverges' ELSE 'ok' END AS reason,
  CASE WHEN n < 40 OR m < 40 THEN 0 ELSE n / m END AS ratio FROM al)"""


def reply_pairs(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumns({"reply": F.lead("text").over(w), "reply_role": F.lead("role").over(w)})
    return turns.where("role = 'user' and reply_role = 'assistant' and reply is not null")


@register("pair_alignment", f"WITH {TURNS} SELECT conv_id, turn, reason = 'ok' AS passed, reason, round(ratio, 6) AS ratio FROM judged")
def pair_alignment(spark, sf_dir):  # T20 F7
    judged = reply_pairs(spark, sf_dir).select("conv_id", "turn", tx.alignment(F.col("text"), F.col("reply")).alias("a"))
    return judged.select("conv_id", "turn", "a.passed", "a.reason", F.round("a.ratio", 6).alias("ratio"))


@register(
    "alignment_pass_rate",
    f"""WITH {TURNS}, s AS (SELECT * FROM judged QUALIFY row_number() OVER (ORDER BY md5('42|alignment|' || conv_id || '|' || turn), conv_id, turn) <= 200)
SELECT count(*) AS n_sampled, round(avg((reason = 'ok')::INT::DOUBLE), 6) AS pass_rate FROM s""",
)
def alignment_pass_rate(spark, sf_dir):  # A33 P5
    key = hs.order_key(42, "alignment", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    some = reply_pairs(spark, sf_dir).orderBy(key, "conv_id", "turn").limit(200)
    passed = tx.alignment(F.col("text"), F.col("reply"))["passed"]
    return some.agg(F.count("*").alias("n_sampled"), F.round(F.avg(passed.cast("double")), 6).alias("pass_rate"))


@register(
    "instruction_pair_parse",
    """WITH d AS (SELECT doc_id, trim(replace(text, '`', ' ')) AS src, trim(text) AS tgt FROM documents)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN tgt WHEN 1 THEN src END AS malay, CASE doc_id % 3 WHEN 0 THEN src WHEN 1 THEN tgt END AS english FROM d WHERE src <> ''""",
)
def instruction_pair_parse(spark, sf_dir):  # T21 T22
    way = F.when(F.col("doc_id") % 3 == 0, " terjemah ke bahasa Melayu").when(F.col("doc_id") % 3 == 1, " Terjemah  ke english").otherwise(" ringkaskan")
    rows = documents(spark, sf_dir).where("trim(replace(text, '`', ' ')) <> ''").select(
        "doc_id", F.concat(F.lit("`"), F.expr("replace(text, '`', ' ')"), F.lit("`"), way).alias("i"), F.col("text").alias("o")
    )
    return rows.select("doc_id", tx.instruction_pair(F.col("i"), F.col("o")).alias("p")).select("doc_id", "p.malay", "p.english")


@register(
    "chat_template",
    """WITH c AS (SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY turn) AS s FROM conversations GROUP BY conv_id)
SELECT conv_id, length(s) AS n_chars, md5(s) AS digest, s LIKE '<|%' AS has_prefix FROM c""",
)
def chat_template(spark, sf_dir):  # T19 G5
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("t"))
    text = turns.select("conv_id", tx.chat_turns(F.col("t")).alias("s"))
    return text.select("conv_id", F.length("s").alias("n_chars"), F.md5("s").alias("digest"), F.startswith("s", F.lit("<|")).alias("has_prefix"))


@register(
    "spotcheck_fractions",
    f"""WITH {LABELS}, c AS (SELECT doc_id, verdict, {CLASS} AS corpus_class FROM lid),
s AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY corpus_class ORDER BY md5('42|spotcheck|' || corpus_class || '|' || doc_id), doc_id) <= 100)
SELECT corpus_class, count(*) AS n_sampled, {", ".join(f"round(avg((verdict = '{v}')::INT::DOUBLE), 6) AS frac_{v}" for v in ("malay", "manglish", "rojak", "indonesian", "english", "other"))} FROM s GROUP BY 1""",
)
def spotcheck_fractions(spark, sf_dir):  # A2 P5
    rows = corpus.with_class(lid_columns(documents(spark, sf_dir))).select("doc_id", "corpus_class", "lid.verdict")
    some = corpus.seeded_sample(rows, 100, 42, "spotcheck", ["corpus_class"], "doc_id")
    share = lambda v: F.round(F.avg((F.col("verdict") == v).cast("double")), 6).alias(f"frac_{v}")
    return some.groupBy("corpus_class").agg(F.count("*").alias("n_sampled"), *[share(v) for v in ("malay", "manglish", "rojak", "indonesian", "english", "other")])


# ----------------------------------------------------------------------------- splits and samples

SPLIT = f"""
c AS (SELECT doc_id, lang, {CLASS} AS corpus_class FROM documents),
i AS (SELECT *, row_number() OVER (PARTITION BY corpus_class ORDER BY doc_id) - 1 AS doc_index, count(*) OVER (PARTITION BY corpus_class) AS total FROM c),
split AS (SELECT doc_id, corpus_class, doc_index::INT AS doc_index, CASE WHEN row_number() OVER (PARTITION BY corpus_class ORDER BY md5('42|split|' || corpus_class || '|' || doc_index), doc_index)
  <= CASE WHEN total = 1 THEN 0 ELSE greatest(1, least(round_even(total * 0.8, 0), total - 1)) END THEN 'train' ELSE 'eval' END AS side FROM i)"""


def parted(spark, sf_dir) -> DataFrame:
    return corpus.split(classed(spark, sf_dir).select("doc_id", "corpus_class"))


@register("split_80_20", f"WITH {SPLIT} SELECT * FROM split")
def split_80_20(spark, sf_dir):  # P1 W1
    return parted(spark, sf_dir)


@register(
    "split_summary",
    f"WITH {SPLIT} SELECT corpus_class, count(*) AS total, count(*) FILTER (side = 'train') AS train, count(*) FILTER (side = 'eval') AS eval FROM split GROUP BY 1",
)
def split_summary(spark, sf_dir):  # A32
    return corpus.split_summary(parted(spark, sf_dir))


@register(
    "split_guard",
    f"""WITH {SPLIT}, f AS (SELECT corpus_class, count(*) - count(DISTINCT doc_index) AS repeated, (max(doc_index) + 1 - count(DISTINCT doc_index))::BIGINT AS missing,
  round(avg((side = 'train')::INT::DOUBLE), 6) AS train_fraction FROM split GROUP BY 1)
SELECT *, abs(train_fraction - 0.8) <= 0.02 AS fraction_ok FROM f""",
)
def split_guard(spark, sf_dir):  # G2 G3
    return corpus.split_faults(parted(spark, sf_dir))


@register(
    "candidate_pool",
    f"""WITH {SPLIT}, n AS (SELECT greatest(floor(100 / count(DISTINCT corpus_class)), 1) AS each FROM split WHERE side = 'train')
SELECT split.* FROM split, n WHERE side = 'train' QUALIFY row_number() OVER (PARTITION BY corpus_class ORDER BY md5('42|pool|' || corpus_class || '|' || doc_id), doc_id) <= any_value(each) OVER ()""",
)
def candidate_pool(spark, sf_dir):  # P2 P3 J1
    return corpus.candidate_pool(parted(spark, sf_dir), 100)


def _variant(name: str, body: str):
    sql = f"WITH {SPLIT} SELECT *, '{name}' AS variant, {str(name == 'oracle_contaminated').lower()} AS contaminated FROM ({body})"

    @register(f"variant_{name}", sql)
    def run(spark, sf_dir):  # P4 J1 J12 S14 S15
        return corpus.variant(parted(spark, sf_dir), name, 64)


def _pick(where: str, k: int, name: str, tag: str) -> str:
    return f"SELECT * FROM split WHERE {where} QUALIFY row_number() OVER (ORDER BY md5('42|{name}|{tag}|64|' || doc_id), doc_id) <= {k}"


_variant("baseline_en", _pick("side = 'train' AND corpus_class = 'english_control'", 64, "baseline_en", "en"))
_variant("bm_only", _pick("side = 'train' AND corpus_class <> 'english_control'", 64, "bm_only", "bm"))
_variant(
    "mixed_5050",
    f"({_pick("side = 'train' AND corpus_class = 'english_control'", 32, 'mixed_5050', 'en')}) UNION ALL ({_pick("side = 'train' AND corpus_class <> 'english_control'", 32, 'mixed_5050', 'bm')})",
)
_variant(
    "mixed_weighted",
    f"""SELECT split.* FROM split JOIN (VALUES {", ".join(f"('{c}', {w}::DOUBLE)" for c, w in corpus.WEIGHTS.items())}) q(k, w) ON corpus_class = k WHERE side = 'train'
QUALIFY row_number() OVER (PARTITION BY corpus_class ORDER BY md5('42|mixed_weighted|' || corpus_class || '|64|' || doc_id), doc_id) <= round_even(64 * w, 0)""",
)
_variant("oracle_contaminated", _pick("side = 'eval' AND corpus_class <> 'english_control'", 64, "oracle_contaminated", "oracle"))


@register(
    "contamination_check",
    f"""WITH {SPLIT}, cal AS (SELECT doc_id FROM split WHERE doc_id % 7 = 0 OR side = 'train')
SELECT count(*) AS n_calibration, count(e.doc_id) AS n_overlap, round(100 * count(e.doc_id) / count(*), 6) AS overlap_pct FROM cal LEFT JOIN (SELECT doc_id FROM split WHERE side = 'eval') e USING (doc_id)""",
)
def contamination_check(spark, sf_dir):  # G1 G4 J10 X2
    parts = parted(spark, sf_dir)
    return corpus.contamination(parts.where("doc_id % 7 = 0 or side = 'train'"), parts.where("side = 'eval'"))


@register(
    "class_breakdown",
    f"WITH {SPLIT} SELECT side, string_agg(corpus_class || '=' || n, ',' ORDER BY corpus_class) AS breakdown FROM (SELECT side, corpus_class, count(*) AS n FROM split GROUP BY ALL) GROUP BY side",
)
def class_breakdown(spark, sf_dir):  # A17 T33
    per = parted(spark, sf_dir).groupBy("side", "corpus_class").agg(F.count("*").alias("n"))
    item = F.concat("corpus_class", F.lit("="), F.col("n").cast("string"))
    return per.groupBy("side").agg(F.array_join(F.array_sort(F.collect_list(item)), ",").alias("breakdown"))


@register(
    "held_out_sample",
    f"WITH {SPLIT} SELECT doc_id, corpus_class, doc_index FROM split WHERE side = 'eval' QUALIFY row_number() OVER (PARTITION BY corpus_class ORDER BY md5('42|ppl|' || corpus_class || '|' || doc_id), doc_id) <= 20",
)
def held_out_sample(spark, sf_dir):  # S16
    held = parted(spark, sf_dir).where("side = 'eval'")
    return corpus.seeded_sample(held, 20, 42, "ppl", ["corpus_class"], "doc_id").select("doc_id", "corpus_class", "doc_index")


@register(
    "mc_prompt_render",
    r"""WITH b AS (SELECT item_id, text AS q, [' (A) ' || text, 'b. ' || text || '.', 'x' || text] AS o, CASE WHEN item_id % 2 = 0 THEN 'english' ELSE 'malay' END AS lang FROM benchmark),
c AS (SELECT *, list_transform(o, lambda x: trim(regexp_replace(x, '^\s*\(?([A-Za-z])[.):]\s+', ''))) AS bare FROM b),
p AS (SELECT *, q || chr(10) || 'A. ' || bare[1] || chr(10) || 'B. ' || bare[2] || chr(10) || 'C. ' || bare[3] AS body FROM c)
SELECT item_id, array_to_string(bare, '|') AS options, upper(regexp_extract(o[1], '^\s*\(?([A-Za-z])[.):]\s+', 1)) AS first_letter,
  rtrim(CASE WHEN lang = 'english' THEN 'The following is a multiple choice question. Answer with the letter of the correct option only.' || chr(10) || chr(10) || body || chr(10) || 'Answer:'
    ELSE 'Berikut adalah soalan aneka pilihan tentang pengetahuan am. Jawab dengan memberikan huruf pilihan yang betul sahaja.' || chr(10) || chr(10) || body || chr(10) || 'Jawapan:' END) AS prompt,
  (item_id % 3)::INT AS answer FROM p""",
)
def mc_prompt_render(spark, sf_dir):  # T23 T24 T25 T26 T27
    raw = table(spark, sf_dir, "benchmark").select(
        "item_id",
        F.col("text").alias("q"),
        F.array(F.concat(F.lit(" (A) "), "text"), F.concat(F.lit("b. "), "text", F.lit(".")), F.concat(F.lit("x"), "text")).alias("o"),
        F.when(F.col("item_id") % 2 == 0, "english").otherwise("malay").alias("lang"),
        F.char(F.col("item_id") % 3 + 65).alias("key"),
    )
    bare = raw.withColumn("bare", F.transform("o", tx.option_text))
    return bare.select(
        "item_id",
        F.array_join("bare", "|").alias("options"),
        tx.option_letter(F.col("o")[0]).alias("first_letter"),
        tx.render_prompt(F.col("q"), F.col("bare"), F.col("lang"), F.lit(""), F.lit(False)).alias("prompt"),
        tx.answer_index(F.col("o"), F.col("key"), F.lit(None).cast("string")).alias("answer"),
    )


@register(
    "parallel_ids",
    """WITH l AS (SELECT DISTINCT user_id AS id, event_type AS lang FROM events), a AS (SELECT id FROM l GROUP BY id HAVING count(DISTINCT lang) = 5)
SELECT lang, count(*) AS n_ids, count(*) FILTER (id NOT IN (SELECT id FROM a)) AS n_unmatched FROM l GROUP BY lang""",
)
def parallel_ids(spark, sf_dir):  # J11 G16 X3 X5
    pairs = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("lang")).distinct()
    whole = pairs.groupBy("id").agg(F.count("*").alias("n")).where("n = 5").select("id", F.lit(1).alias("hit"))
    return pairs.join(whole, "id", "left").groupBy("lang").agg(F.count("*").alias("n_ids"), F.count_if(F.col("hit").isNull()).alias("n_unmatched"))
