"""Coverage-greedy selection over many tasks against exact lazy greedy."""

import numpy as np
import pytest

from lumenloom.operators import corpus, routing

EXPERTS = 12


def profiles(n=400, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(n):
        for e in rng.choice(EXPERTS, size=rng.integers(1, 5), replace=False):
            rows.append((d, int(e), int(rng.integers(1, 60) * (3 if e < 3 else 1))))
    return rows


def exact(rows, n):
    docs = sorted({r[0] for r in rows})
    dense = np.zeros((len(docs), EXPERTS))
    for d, e, t in rows:
        dense[docs.index(d), e] += t
    picks = routing.greedy_order(dense, n)
    return [docs[p["doc_index"]] for p in picks], picks[-1]["saturated_coverage"] if picks else 0.0


def test_one_task_is_exact(spark):
    rows = profiles()
    got = routing.coverage_greedy(spark.createDataFrame(rows, "doc_id long, expert_id int, tokens long"), EXPERTS, 12).orderBy("step").collect()
    assert [r.doc_id for r in got] == exact(rows, 12)[0]


@pytest.mark.parametrize("per_task", [30, 100])
def test_many_tasks_come_near(spark, per_task):
    rows = profiles()
    df = spark.createDataFrame(rows, "doc_id long, expert_id int, tokens long")
    got = routing.coverage_greedy(df, EXPERTS, 12, per_task=per_task).orderBy("step").collect()
    assert [r.step for r in got] == list(range(12)) and len({r.doc_id for r in got}) == 12
    assert got[-1].saturated_coverage >= 0.97 * exact(rows, 12)[1]
    again = routing.coverage_greedy(df.repartition(7), EXPERTS, 12, per_task=per_task).orderBy("step").collect()
    assert [r.doc_id for r in again] == [r.doc_id for r in got]


@pytest.mark.parametrize("per_task", [5, 30])
def test_many_tasks_are_exact(spark, per_task):
    rows = profiles()
    got = routing.coverage_greedy(spark.createDataFrame(rows, "doc_id long, expert_id int, tokens long"), EXPERTS, 12, per_task=per_task).orderBy("step").collect()
    assert [r.doc_id for r in got] == exact(rows, 12)[0]


def test_pool_is_of_documents_with_profiles(spark):
    parts = spark.createDataFrame([(i, "a", "train") for i in range(60)], "doc_id long, corpus_class string, side string")
    some = spark.createDataFrame([(i,) for i in range(0, 60, 6)], "doc_id long")
    assert {r.doc_id for r in corpus.candidate_pool(parts, 10, among=some).collect()} == set(range(0, 60, 6))


def test_more_picks_than_documents_and_none(spark):
    df = spark.createDataFrame(profiles(5), "doc_id long, expert_id int, tokens long")
    assert routing.coverage_greedy(df, EXPERTS, 50, per_task=2).count() == 5
    assert routing.coverage_greedy(df.where("doc_id < 0"), EXPERTS, 3).count() == 0


def test_variant(spark):
    docs = spark.createDataFrame([(i, ("a", "b", "c")[i % 3]) for i in range(60)], "doc_id long, corpus_class string")
    parts = corpus.split(docs)
    with pytest.raises(ValueError, match="profiles"):
        corpus.variant(parts, "coverage_greedy", 4)
    df = spark.createDataFrame([r for r in profiles(60) if r[0] % 2], "doc_id long, expert_id int, tokens long")
    got = corpus.variant(parts, "coverage_greedy", 4, profiles=df, experts=EXPERTS, pool=30).collect()
    assert len(got) == 4 and all(r.side == "train" and r.doc_id % 2 and not r.contaminated for r in got)
