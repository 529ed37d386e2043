import collections
import os

import corpus_pipeline
from lumenloom import session
from lumenloom.llm import jaccard, suffix
from tests.compare import DATA
from tests.llm.test_operators import WORDS, runs_brute, shingle_set


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, jaccard.materialize(stage(spark, docs, DATA), "t")
        seen[name] = (before.collect(), docs.collect())
        if name != "best-fit packing":
            assert docs.columns == columns
    before, after = seen["quality rules"]
    kept = {r.doc_id for r in after}
    assert all(len(WORDS.findall(r.text)) >= 50 for r in after)
    assert {r.doc_id for r in before if "###" in r.text or " | " in r.text}.isdisjoint(kept)
    before, after = seen["n-gram Jaccard join"]
    sets = {r.doc_id: shingle_set(r.text, 5) for r in before}
    left = [r.doc_id for r in after]
    for i, a in enumerate(left):
        for b in left[:i]:
            assert 100 * len(sets[a] & sets[b]) < 80 * len(sets[a] | sets[b])
    for gone in set(sets) - set(left):
        assert any(100 * len(sets[gone] & s) >= 80 * len(sets[gone] | s) for d, s in sets.items() if d != gone)
    _, after = seen["suffix-array dedup"]
    before, after = seen["suffix-array dedup"]
    runs = dict(zip([r.doc_id for r in before], runs_brute([tuple(r) for r in before], suffix.PASSAGE_BYTES, suffix.PASSAGE_WORDS), strict=True))
    assert len(after) == len(before)
    texts = {r.doc_id: (r.text or "").encode() for r in before}
    for r in after:
        data, at, kept = texts[r.doc_id], 0, b""
        for a, b in runs[r.doc_id]:
            kept, at = kept + data[at:a], b
        assert r.text == (kept + data[at:]).decode("utf-8", "ignore") and r.n_chars == len(r.text)
    before, after = seen["source mix"]
    size = {r.doc_id: len(WORDS.findall(r.text)) for r in before}
    taken = collections.Counter()
    for r in after:
        taken[r.doc_id] += len(WORDS.findall(r.text))
    assert all(n <= 3 * size[d] for d, n in taken.items())
    assert abs(sum(taken.values()) - sum(size.values())) < 0.05 * sum(size.values())
    _, pieces = seen["best-fit packing"]
    fill = collections.Counter()
    for r in pieces:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {x for x in files.split("\n") if "/shuffle_" in x}


def test_stages_leave_little_on_disk(spark):
    """A stage's working tables and shuffle files go before the next stage begins."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for (_, stage), most in zip(corpus_pipeline.STAGES[:3], ({"good"}, {"judged", "again", "go", "verdicts"}, {"repeats"}), strict=True):
        tables, files = set(session._written), shuffle_files(spark)
        out = stage(spark, docs, DATA)
        assert {os.path.basename(p).rpartition("-")[0] for p in session._written - tables} <= most
        docs = jaccard.materialize(out, "t")
        assert len(shuffle_files(spark) - files) < 50  # of small counts only, hundreds before
