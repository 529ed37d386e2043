"""Streaming queries, drained so their results can be compared with the batch form."""

from __future__ import annotations

from ..streaming import corpus_stream as cs


def stream_class_counts(spark, sf_dir):
    return cs.drain(cs.running_counts(cs.document_stream(spark, sf_dir), "lang"), "complete")


def stream_first_copies(spark, sf_dir):
    return cs.drain(cs.first_copies(cs.document_stream(spark, sf_dir)).select("key"), "append")


QUERIES = {"stream_class_counts": stream_class_counts, "stream_first_copies": stream_first_copies}
ORACLE_SQL = {
    "stream_class_counts": "SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY lang",
    "stream_first_copies": r"SELECT DISTINCT sha256(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))) AS key FROM documents",
}
