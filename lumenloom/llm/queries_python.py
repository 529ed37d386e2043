"""Registered queries of the operators that run numpy over Arrow batches, and DuckDB SQL where it can express one."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import decontaminate, html_text, jaccard, media, packing, prefix_trie, suffix, token_orc, toxicity, whitening
from .common import materialize


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file: in ``LUMENLOOM_TOKENIZERS`` if that is set, else where the package has it."""
    folder = os.environ.get("LUMENLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents"))


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_orc.tokens_round_trip(docs, tokenizer_file("word_bpe_49k.json"), end_id=1)


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, percent=90)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_documents(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), threshold=0.3)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.judge_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=400)


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), end_id=0)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.ordered_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return prefix_trie.build_trie(*prefix_trie.grafted(materialize(turns, "ordered"), pool=100, heads=6))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", components=16, scale=64, shift=1_000_000)


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"), window=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {
    "op1_flac": op1_flac,
    "op2_token_orc": op2_token_orc,
    "op3_jaccard": op3_jaccard,
    "op4_toxicity": op4_toxicity,
    "op6_html_text": op6_html_text,
    "op7_suffix_array": op7_suffix_array,
    "op8_best_fit": op8_best_fit,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_whitening": op12_whitening,
    "op13_decontaminate": op13_decontaminate,
}

OP11_SQL = """
WITH crc_table AS (SELECT list(c ORDER BY k) AS t FROM (
  SELECT k, list_reduce([k] || range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(k))),
own AS (SELECT conv_id AS c, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (SELECT c, own.t, xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(c::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT),
  lambda a, b: xor(a >> 8, crc_table.t[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h FROM own, crc_table),
rebuilt AS (SELECT a.c, coalesce(b.t[1:h], []) || a.t[h + 1:] AS t FROM heads a LEFT JOIN own b ON b.c = a.c - a.c % 100),
starts AS (SELECT c, len(t) AS n, d, md5(to_json(t[1:d])::VARCHAR) AS p, t[d].x AS x FROM (SELECT *, unnest(range(0, len(t) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(length(any_value(x)), 0) AS saved,
  sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256 FROM starts GROUP BY d, p),
links AS (SELECT DISTINCT a.d, a.p, b.d AS ud, b.p AS up FROM starts a JOIN starts b ON a.c = b.c AND b.d <= a.d),
kids AS (SELECT ud AS d, up AS p, count(*) FILTER (d = ud + 1) AS n_children FROM links GROUP BY ALL),
sums AS (SELECT l.ud AS d, l.up AS p, count(*) FILTER (k.n_children = 0) AS n_leaves, sum(n.saved)::BIGINT AS saved_tokens
  FROM links l JOIN kids k ON l.d = k.d AND l.p = k.p JOIN nodes n ON l.d = n.d AND l.p = n.p GROUP BY ALL)
SELECT n.conv_id, n.d::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, k.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN kids k ON n.d = k.d AND n.p = k.p JOIN sums s ON n.d = s.d AND n.p = s.p
LEFT JOIN (links l JOIN nodes u ON l.ud = u.d AND l.up = u.p) ON l.d = n.d AND l.p = n.p AND l.ud = n.d - 1
"""

_ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_ITEM_WORD}')"

OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
grams AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT rid, n, i, item_id FROM grams JOIN windows USING (n, g)),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
found AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN found USING (rid)
"""

ORACLE_SQL: dict[str, str] = {"op11_prefix_trie": OP11_SQL, "op13_decontaminate": OP13_SQL}
