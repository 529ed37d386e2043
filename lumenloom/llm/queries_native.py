"""Registered queries of the native operators (5, 9, 10) and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import mixing, quality, url_filter
from .url_filter import Rule

RULES = [
    Rule("block", "com/en/"),
    Rule("allow", "example.com/en/7"),
    Rule("block", "net/de/"),
    Rule("block", "example.net/de/8"),
    Rule("block", "org/es/"),
]


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"), RULES)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge_quality(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), carry=["doc_id"]).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "n_grams",
        "llr_micro",
    )


QUERIES = {"op5_mix_sources": op5_mix_sources, "op9_url_filter": op9_url_filter, "op10_quality": op10_quality}

_WS = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"

_RULE_ROWS = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}', '{r.text}')" for r in RULES)

OP9_SQL = rf"""
WITH RECURSIVE rules(v, h, p, t) AS (VALUES {_RULE_ROWS}),
split AS (
  SELECT page_id, url, html,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    row_number() OVER () AS rid
  FROM pages),
addressed AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, CASE WHEN starts_with(lower(url), 'https:') THEN ':443$' ELSE ':80$' END, '') || regexp_replace(path, '(?:/index\.html?|/|\.html?)$', '')
    || coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*(\?[^#]+)', 1), '') END AS address FROM split),
ruled AS (
  SELECT a.rid, a.page_id, a.host, a.path, a.address, a.html, r.t AS rule, r.v AS rule_verdict
  FROM addressed a LEFT JOIN rules r
    ON (a.host = r.h OR suffix(a.host, '.' || r.h)) AND prefix(a.path, r.p)
  QUALIFY row_number() OVER (PARTITION BY a.rid ORDER BY length(r.t) DESC, r.t) = 1),
found AS (
  SELECT address AS src, unnest([
    CASE WHEN contains(lower(html), 'canonical') AND regexp_matches(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b')
      THEN regexp_extract(html, '(?is)<link\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)', 1) END,
    CASE WHEN contains(lower(html), 'http-equiv')
      THEN regexp_extract(html, '(?is)<meta\b[^>]*\burl\s*=\s*["'']?([^"''\s>]+)', 1) END]) AS target
  FROM ruled WHERE address IS NOT NULL),
links AS (
  SELECT src, translate(regexp_extract(target, '(?s)^.*?://([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}')
    || regexp_replace(regexp_extract(target, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '(?:/index\.html?|/|\.html?)$', '') || coalesce(regexp_extract(target, '(?s)^.*?://[^?#]*(\?[^#]+)', 1), '') AS dst
  FROM found WHERE contains(target, '://')),
near AS (SELECT src AS a, dst AS b FROM links UNION SELECT dst, src FROM links),
reach(a, b) AS (SELECT DISTINCT address, address FROM ruled WHERE address IS NOT NULL
  UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
decided AS (
  SELECT r.a AS address, bool_or(coalesce(u.rule_verdict = 'allow', false)) AS al, bool_or(coalesce(u.rule_verdict = 'block', false)) AS bl
  FROM reach r JOIN ruled u ON u.address = r.b GROUP BY 1)
SELECT u.page_id, u.host, u.path, u.rule,
  coalesce(u.rule_verdict, CASE WHEN d.bl AND NOT d.al THEN 'block' END, 'allow') AS verdict
FROM ruled u LEFT JOIN decided d ON u.address = d.address
"""

OP10_SQL = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
trusted AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL),
worded AS (SELECT *, regexp_extract_all(text, '{_WORD}') AS w, string_split(text, chr(10)) AS l,
  [''] || regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(text, '\p{{Ll}}+', 'a', 'g'), '\p{{Lu}}+', 'A', 'g'), '\p{{Nd}}+', '0', 'g'), '{_WORD}') || [''] AS s
  FROM docs),
lined AS (SELECT *, list_filter(l, lambda x: regexp_matches(x, '{_WORD}')) AS ll,
  CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [] END AS win
  FROM worded),
wins AS (SELECT rid, unnest(win) AS g, unnest(range(len(win))) AS i FROM lined),
again AS (SELECT rid, i FROM wins QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
reps AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY rid),
pairs AS (
  SELECT rid, doc_id, unnest(CASE WHEN len(w) > 0 THEN w || list_transform(range(1, len(s)), lambda i: s[i] || ' ' || s[i + 1]) ELSE [] END) AS g
  FROM worded),
crc_table AS (SELECT list(c ORDER BY k) AS t FROM (
  SELECT k, list_reduce([k] || range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
  FROM range(256) r(k))),
hashed AS (
  SELECT g, xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(g)), '..'), lambda h: ('0x' || h)::BIGINT),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % {quality.BUCKETS} AS bucket
  FROM (SELECT DISTINCT g FROM pairs), crc_table),
counts AS (
  SELECT bucket, count(*) AS n, count(t.doc_id) AS t
  FROM pairs JOIN hashed USING (g) LEFT JOIN trusted t ON pairs.doc_id = t.doc_id GROUP BY bucket),
totals AS (SELECT sum(n)::DOUBLE AS ns, sum(t)::DOUBLE AS ts FROM counts),
ratios AS (
  SELECT bucket, CASE WHEN ts > 0 THEN round(1e6 * ln((t + {quality.SMOOTH}) / (n::DOUBLE * ts / ns + {quality.SMOOTH})))::BIGINT ELSE 0 END AS micro
  FROM counts, totals),
scores AS (SELECT rid, count(*) AS n_grams, sum(micro)::BIGINT AS llr_micro FROM pairs JOIN hashed USING (g) JOIN ratios USING (bucket) GROUP BY rid),
based AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ll) - len(list_distinct(ll)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    coalesce(n_grams, 0)::BIGINT AS n_grams, coalesce(llr_micro, 0)::BIGINT AS llr_micro
  FROM lined LEFT JOIN reps USING (rid) LEFT JOIN scores USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND llr_micro >= n_grams * {int(round(quality.THRESHOLD * 1e6))} AS kept,
  n_grams, llr_micro
FROM based
"""

OP5_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
    coalesce('v' || source, 'w') AS skey,
    md5('{mixing.SEED}|' || coalesce(doc_id::VARCHAR, '-') || '|' || md5(coalesce(text, ''))) AS h
  FROM documents),
sums AS (SELECT skey, source, sum(size)::DOUBLE AS ss FROM sized GROUP BY 1, 2),
weighed AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS wt FROM sums),
levels AS (
  SELECT *, sum(ss) OVER () AS total,
    (sum(ss) OVER () - {mixing.MOST} * coalesce(sum(ss) OVER before, 0)) / (sum(wt) OVER () - coalesce(sum(wt) OVER before, 0)) AS lv, ss / wt AS ratio
  FROM weighed WINDOW before AS (ORDER BY ss / wt, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
leveled AS (
  SELECT *, (SELECT arg_min(lv, (ratio, skey)) FROM levels WHERE lv <= {mixing.MOST} * ratio) AS final FROM levels),
targets AS (
  SELECT skey, ss, total, CASE WHEN final IS NOT NULL AND {mixing.MOST} * ratio >= final THEN wt * final ELSE {mixing.MOST} * ss END AS target,
    least(greatest(floor(total / {1 << 20}), 16), 4096)::BIGINT AS block
  FROM leveled),
q0 AS (SELECT *, floor(total / block)::BIGINT AS seats, sum(target) OVER () AS votes, count(*) OVER () AS k FROM targets),
q1 AS (SELECT *, CASE WHEN votes > 0 THEN greatest(0, floor(target * seats / votes)::BIGINT - k - 1) ELSE 0 END AS low FROM q0),
q2 AS (SELECT *, seats - sum(low) OVER () AS open FROM q1),
q3 AS (SELECT skey, open, row_number() OVER (ORDER BY target / (2 * (low + j) + 1) DESC, skey, j) AS r
  FROM q2, range(0, 4000) x(j) WHERE target > 0 AND j < 3 * k + 6),
q4 AS (SELECT skey, count(*) AS won FROM q3 WHERE r <= open GROUP BY 1),
quotas AS (SELECT q2.*, low + coalesce(won, 0) AS quota, greatest(1, ceil(ss / (block * {mixing.SHARD_BLOCKS})))::BIGINT AS shards FROM q2 LEFT JOIN q4 USING (skey)),
dealt AS (SELECT s.*, q.ss, q.target, q.block, q.quota, ('0x' || substr(h, 1, 8))::BIGINT % shards AS shard FROM sized s JOIN quotas q USING (skey)),
s0 AS (SELECT skey, shard, any_value(block) AS block, any_value(quota) AS seats, sum(size)::DOUBLE AS sh FROM dealt GROUP BY 1, 2),
s1 AS (SELECT *, sum(sh) OVER (PARTITION BY skey) AS votes, count(*) OVER (PARTITION BY skey) AS k FROM s0),
s2 AS (SELECT *, CASE WHEN votes > 0 THEN greatest(0, floor(sh * seats / votes)::BIGINT - k - 1) ELSE 0 END AS low FROM s1),
s3 AS (SELECT *, seats - sum(low) OVER (PARTITION BY skey) AS open FROM s2),
s4 AS (SELECT skey, shard, open, row_number() OVER (PARTITION BY skey ORDER BY sh / (2 * (low + j) + 1) DESC, shard, j) AS r
  FROM s3, range(0, 4000) x(j) WHERE sh > 0 AND j < 3 * k + 6),
s5 AS (SELECT skey, shard, count(*) AS won FROM s4 WHERE r <= open GROUP BY 1, 2),
s6 AS (SELECT s3.skey, s3.shard, block, ceil(sh / block)::BIGINT AS n, least(low + coalesce(won, 0), {mixing.MOST} * ceil(sh / block)::BIGINT) AS q
  FROM s3 LEFT JOIN s5 ON s3.skey = s5.skey AND s3.shard = s5.shard),
s7 AS (SELECT skey, shard, block, n, q, CASE WHEN n > 0 THEN q // n ELSE 0 END AS passes, i
  FROM (SELECT skey, shard, block, n, q, unnest(range(n)) AS i FROM s6)
  QUALIFY row_number() OVER (PARTITION BY skey, shard ORDER BY md5('{mixing.SEED}|' || skey || '|' || shard::VARCHAR || '|' || i::VARCHAR), i) <= q % n),
s8 AS (SELECT skey, shard, list(i ORDER BY i) AS chosen FROM s7 GROUP BY 1, 2),
placed AS (
  SELECT d.*, sum(size) OVER (PARTITION BY skey, shard ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM dealt d)
SELECT p.doc_id, p.size, p.ss::BIGINT AS source_size, p.target::DOUBLE AS target,
  CASE WHEN p.size = 0 THEN 0 ELSE (CASE WHEN s6.n > 0 THEN s6.q // s6.n ELSE 0 END) * p.size
    + (SELECT coalesce(sum(greatest(0, least(stop, (c + 1) * p.block) - greatest(stop - p.size, c * p.block))), 0) FROM (SELECT unnest(coalesce(s8.chosen, [])) AS c))
  END::BIGINT AS taken
FROM placed p JOIN s6 ON p.skey = s6.skey AND p.shard = s6.shard LEFT JOIN s8 ON p.skey = s8.skey AND p.shard = s8.shard
"""

ORACLE_SQL = {"op5_mix_sources": OP5_SQL, "op9_url_filter": OP9_SQL, "op10_quality": OP10_SQL}
