"""Empty tables, nulls, repeats, very long texts and clashing column names, for operators and pipeline stages."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenloom.llm import html_text, packing, toxicity, url_filter
from lumenloom.llm.queries_python import tokenizer_file
from tests.compare import DATA

TAKEN = ["host", "path", "address", "evidence", "score", "held_out", "predicted", "piece", "start", "length", "ids", "part", "component", "rule", "verdict", "label"]


def with_clashes(df):
    return df.withColumns({c: F.lit(i) for i, c in enumerate(TAKEN)})


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_toxicity(spark):
    texts = ["you are a grolk, you grolk", "a calm day by the lake", None, "", "grolk " * 30_000]
    rows = [(i, texts[i % 5]) for i in range(60)] + [(3, ""), (None, texts[0]), (None, None), (0, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 in (0, 4))) for i in range(60)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    plain = toxicity.score_documents(docs, labels)
    got = plain.collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = {r.doc_id: r.held_out for r in got}
    assert held[None] is False and all(held[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(60))
    assert len({r.score for r in got if r.doc_id in (3, 2) or (r.doc_id is None and r.evidence == 0)}) == 1  # empty and null alike
    assert rows_of(toxicity.score_documents(with_clashes(docs), labels.withColumns({"text": F.lit("x"), "score": F.lit(1)}))) == sorted(map(str, got))
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0
    assert toxicity.score_documents(docs, labels.limit(0)).count() == len(rows)


def test_html(spark):
    body = "<html><body><nav><a href='/'>Home</a></nav><article><p>" + "A long story about rivers and the sea. " * 20 + "</p></article></body></html>"
    huge = "<html><body><article>" + "<p>One more line of the story, told in full.</p>" * 30_000 + "</article></body></html>"
    rows = [(1, "http://a.org/1", body), (1, "http://a.org/1", body), (2, None, body), (None, "no scheme", body), (3, "http://a.org/3", None), (4, "http://a.org/4", ""), (5, None, None), (6, "http://b.org", huge)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_text.extract_pages(pages).collect()
    assert len(got) == len(rows)
    assert all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id in (3, 4, 5)} == {""}
    assert {r.text for r in got if r.page_id in (1, 2, None)} == {("A long story about rivers and the sea. " * 20).strip()}
    assert next(r for r in got if r.page_id == 6).text == "\n\n".join(["One more line of the story, told in full."] * 30_000)
    assert rows_of(html_text.extract_pages(with_clashes(pages.withColumn("text", F.lit("own"))).drop("path").withColumn("n_chars", F.lit(0)))) == sorted(map(str, got))
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def test_urls(spark):
    rules = [url_filter.Rule("block", "com/en/"), url_filter.Rule("allow", "example.com/en/7")]
    link = "<link rel='canonical' href='http://example.com/en/1'>"
    rows = [(1, "http://x.org/a", link), (1, "http://x.org/a", link), (2, "http://example.com/en/1", None), (3, None, None), (None, "plain", ""), (4, "http://y.org/" + "z" * 100_000, "<p>" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = url_filter.judge_urls(pages, rules).collect()
    verdicts = sorted(((r.page_id or 0), r.host, r.rule, r.verdict) for r in got)
    assert verdicts == [(0, "", None, "allow"), (1, "x.org", None, "block"), (1, "x.org", None, "block"), (2, "example.com", "com/en/", "block"), (3, "", None, "allow"), (4, "y.org", None, "allow")]
    assert rows_of(url_filter.judge_urls(with_clashes(pages), rules)) == sorted(map(str, got))
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_packing(spark):
    texts = ["a b c", None, "", "word " * 40_000, "a b c"]
    docs = spark.createDataFrame([*enumerate(texts), (0, "a b c"), (None, "a b c"), (None, None)], "doc_id long, text string")
    file = tokenizer_file("byte_bpe_50k.json")
    got = packing.pack_documents(docs, file).collect()
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for bins in places.values():  # gapless, from 0, within the capacity
        ends = np.cumsum([n for _, n in sorted(bins)])
        assert [a for a, _ in sorted(bins)] == [0, *ends[:-1]] and ends[-1] <= 2048
    long = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == 3)
    assert [s for _, s, _ in long] == [0, *np.cumsum([n for *_, n in long])[:-1]] and all(n == 2048 for *_, n in long[1:])
    assert [(r.length, r.ids_crc32) for r in got if r.doc_id in (1, 2)] == [(1, zlib.crc32(bytes(4)))] * 2
    assert sum(r.doc_id is None for r in got) == 2 and sum(r.doc_id == 0 for r in got) == 2
    key = lambda rows: sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(packing.pack_documents(with_clashes(docs), file).collect()) == key(got)
    assert packing.pack_documents(docs.limit(0), file).count() == 0


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages(spark, name, stage):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id % 5 = 0")
    first = docs.first()
    odd = [{**first.asDict(), "doc_id": i, "text": t} for i, t in ((None, None), (None, ""), (-1, " \n "), (-2, None))]
    docs = with_clashes(docs.union(spark.createDataFrame(odd, docs.schema)).unionAll(spark.createDataFrame([first] * 3, docs.schema)))
    got = stage(spark, docs, DATA)
    if name == "best-fit packing":
        assert {r.doc_id for r in got.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    else:
        assert got.columns == docs.columns
        assert got.where(" or ".join(f"{c} <> {i}" for i, c in enumerate(TAKEN))).count() == 0
        assert 0 < got.count() <= 3 * docs.count()
    assert stage(spark, docs.limit(0), DATA).count() == 0
