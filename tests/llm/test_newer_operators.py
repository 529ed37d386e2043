"""Prefix trie, whitening and decontamination against brute force on small made-up tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenloom.llm import decontaminate, prefix_trie, whitening

CONVERSATIONS = "conv_id long, turn long, role string, text string, rep int, k string"


def rebuilt_nodes(rows, pool, heads):
    """The contract, node by node, over whole prefixes."""
    key = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
    convs = collections.defaultdict(list)
    plain = [(c, t, r or "", x or "") for c, t, r, x, *_ in rows if c is not None]
    for c, _, r, x in sorted(plain, key=lambda v: (v[1] is not None, v[1] or 0, key(v[2], v[3]))):
        convs[c].append((r, x))
    h = lambda c: zlib.crc32(str(c).encode()) % heads
    base = lambda c: c - (abs(c) % pool) * (1 if c >= 0 else -1)
    rebuilt = {c: convs.get(base(c), [])[: h(c)] + t[h(c) :] for c, t in convs.items()}
    members = collections.defaultdict(list)
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += not kids[p]
    ends = lambda p, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(p)))).encode()).hexdigest()
    return sorted((len(p), min(m), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], ends(p, m)) for p, m in members.items())


def trie_rows(spark, rows, pool, heads):
    df = spark.createDataFrame(rows, CONVERSATIONS)
    out = prefix_trie.build_trie(*prefix_trie.grafted(prefix_trie.ordered_turns(df), pool, heads))
    return sorted((r.depth, r.conv_id, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in out.collect())


def made_up_conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 24), 101, 107, 250, -3, -250]:
        deep = 14 if c % 8 == 5 else rng.randint(1, 5)  # beyond the turns that are carried along
        for t in range(deep):
            text = "x" * (t + 1) if c % 8 == 5 else rng.choice(["", "é", "two words", None])
            rows.append((c, None if rng.random() < 0.05 else t, rng.choice(["user", None]) if c % 8 != 5 else "u", text, 1, "z"))
    rows += [rows[3], rows[3], (None, 0, "user", "lost", 1, "z"), (13, 14, "u", "one more", 1, "z")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 2)
    monkeypatch.setattr(prefix_trie, "RUN", 3)
    rows = made_up_conversations(seed)
    assert trie_rows(spark, rows, 10, 6) == rebuilt_nodes(rows, 10, 6)


def test_trie_turnless_and_empty(spark):
    rows = [(7, 0, "user", "a", 1, "z"), (8, 0, "user", "a", 1, "z")]  # no conversation 0 to take turns from
    heads = 6
    assert any(zlib.crc32(str(c).encode()) % heads > 0 for c in (7, 8))
    assert trie_rows(spark, rows, 100, heads) == rebuilt_nodes(rows, 100, heads)
    assert trie_rows(spark, [], 100, heads) == []


def test_copies_of_a_long_conversation_take_few_rounds(spark, monkeypatch):
    rounds = []
    real = prefix_trie.materialize
    monkeypatch.setattr(prefix_trie, "materialize", lambda df, tag: rounds.append(tag) or real(df, tag))
    rows = [(c, t, "user", f"turn {t}", 1, "z") for c in range(30) for t in range(120)] + [(40, 0, "user", "other", 1, "z")]
    want = rebuilt_nodes(rows, 1, 1)
    assert trie_rows(spark, rows, 1, 1) == want
    assert rounds.count("level") == 1


# ------------------------------------------------------------------------------ whitening


def vectors(seed, n=120, d=9):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, d)) * np.arange(1, d + 1) / 7
    rows = [(i, [float(np.float32(v)) for v in base[i]], i, 1, "x") for i in range(n)]
    rows += [(500 + i, rows[5][1], 0, 1, "x") for i in range(40)]  # a vector that many rows hold
    rows += [(None, rows[6][1], 0, 1, "x"), (6, rows[6][1], 0, 1, "x")]
    rows += [(900, None, 0, 1, "x"), (901, [None] * d, 0, 1, "x"), (902, [float("nan")] * d, 0, 1, "x"), (903, [float("inf")] * d, 0, 1, "x"), (904, [1.0] * (d - 1), 0, 1, "x"), (905, [], 0, 1, "x"), (906, [1e300] * d, 0, 1, "x")]
    return rows


SCHEMA12 = "vec_id long, embedding array<float>, label int, n int, component string"


def test_whitening(spark):
    rows = vectors(1)
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA12), "embedding", components=5).collect()
    good = [r for r in rows if r[0] is None or r[0] < 900]
    x = np.array([[int(np.floor(64 * float(np.float32(v)))) + 1_000_000 for v in r[1]] for r in good], dtype=object)
    fit = np.array(sorted({tuple(v) for v in x}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    y = np.array([[float(n * v - t) / n for v, t in zip(row, s)] for row in fit])
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:5], u[:, ::-1][:, :5]
    assert len(out) == 5 * len(good)
    assert {r.n for r in out} == {n} and {r.label for r in out} == {r[2] for r in good}
    dev = {tuple(map(int, row)): sum((n * int(v) - int(t)) ** 2 for v, t in zip(row, s)) for row in x}
    by_id = collections.defaultdict(list)
    for r in out:
        by_id[r.vec_id].append(r)
        assert abs(r.explained - e[r.component - 1] / (y * y).sum() * n) < 1e-9 and 0 <= r.identity_error < 1e-9
    z = {r[0]: (np.array([float(n * int(v) - int(t)) / n for v, t in zip(row, s)]) @ u / np.sqrt(e), dev[tuple(map(int, row))]) for r, row in zip(good, x)}
    sign = [np.sign(next(r.whitened for r in by_id[0] if r.component == j + 1) * z[0][0][j]) for j in range(5)]
    for key, (want, d) in z.items():
        for r in by_id[key]:
            assert r.deviation == d and abs(r.whitened - sign[r.component - 1] * want[r.component - 1]) < 1e-9


def test_whitening_without_variance(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0], 0, 1, "x"), (2, [1.0, 2.0], 0, 1, "x")], SCHEMA12)
    assert whitening.whiten(one, "embedding").count() == 0
    assert whitening.whiten(one.where("vec_id > 5"), "embedding").count() == 0
    assert whitening.whiten(one.withColumn("embedding", F.lit(None).cast("array<float>")), "embedding").count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], 0, 1, "x") for i in range(6)], SCHEMA12)  # one direction only
    assert {r.component for r in whitening.whiten(line, "embedding").collect()} == {1}


def test_large_deviations_are_exact_or_null():
    centre = whitening.Centre(3, [10, 0])
    assert centre.deviations(np.array([[1 << 40, 0]]))[0] is None
    got = centre.deviations(np.array([[900_000_000, 5]]))[0]
    assert got == (3 * 900_000_000 - 10) ** 2 + 15**2


@pytest.mark.parametrize(("d", "k", "kind"), [(40, 6, "flat"), (90, 6, "folded"), (30, 4, "low"), (20, 3, "equal"), (1, 16, "flat")])
def test_block_lanczos(d, k, kind):
    rng = np.random.default_rng(d)
    a = rng.standard_normal((5 if kind == "low" else 4 * d, d))
    v = a.T @ a / len(a)
    if kind == "equal":
        q, _ = np.linalg.qr(a[:d])
        v = (q * np.where(np.arange(d) < 8, 5.0, 1.0)) @ q.T
    passes = []
    e, u, _ = whitening.leading_pairs(lambda b: passes.append(b.shape[1]) or v @ b, d, k, most=30 if kind == "folded" else 512)
    want = np.sort(np.linalg.eigvalsh(v))[::-1][:k]
    assert np.abs(e - want).max() < 1e-12 * max(1, want[0])
    assert np.abs(v @ u - u * e).max() < 1e-11 and np.abs(u.T @ u - np.eye(u.shape[1])).max() < 1e-12
    assert kind == "folded" or sum(passes) <= d


# ------------------------------------------------------------------------- decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def leaks(docs, items, window):
    patterns = collections.defaultdict(set)
    for name, text in items:
        w = words_of(text)
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if n else 0):
            patterns[tuple(w[i : i + n])].add(name)
    out = []
    for doc_id, text in docs:
        w, hit, names = words_of(text), set(), set()
        for n in {len(p) for p in patterns}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in patterns:
                    hit |= set(range(i, i + n))
                    names |= patterns[tuple(w[i : i + n])]
        out.append((doc_id, len(w), len(hit), sorted(str(x) for x in names if x is not None)))
    return sorted(out, key=repr)


def benchmark_like(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "cc", "ééé", "x" * 9, "y" * 20, "y" * 19 + "z", "7", "It", "ÀB"]
    text = lambda k: "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\n", ", ", ".\x00", "-"]) for _ in range(k))
    items = [(i, text(rng.choice([0, 1, 3, 9, 10, 11, 25]))) for i in range(12)]
    items += [(None, text(12)), (4, text(11)), (90, None), (91, items[5][1]), (92, "Ünique " + "word " * 30)]
    docs = [(i, text(rng.choice([0, 1, 5, 12, 40, 400]))) for i in range(25)] + [(100 + i, text(3) + (t or "") + text(4)) for i, (_, t) in enumerate(items)]
    docs += [(1, docs[30][1]), (None, docs[31][1]), (7, None), (8, ""), (9, "... \n"), (300, text(30_000) + (items[-1][1]))]
    return docs, items


@pytest.mark.parametrize(("window", "part_bytes"), [(10, 1 << 20), (3, 1 << 20), (10, 300)])
def test_leaks(spark, window, part_bytes):
    docs, items = benchmark_like(window)
    frame = spark.createDataFrame([(*d, "kept", 5) for d in docs], "doc_id long, text string, items string, c0 int").repartition(3)
    found = decontaminate.find_leaks(frame, spark.createDataFrame(items, "item_id long, text string"), window, part_bytes=part_bytes)
    rows = found.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in rows), key=repr) == leaks(docs, items, window)
    assert {r.c0 for r in rows} == {5}
    for r in rows:  # runs are apart, in order, and hold the hit words
        assert sum(s.last - s.first + 1 for s in r.spans) == r.n_hit
        assert all(b.first > a.last + 1 for a, b in zip(r.spans, r.spans[1:]))


def test_no_benchmark_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r["items"]) for r in decontaminate.find_leaks(docs, none).collect()] == [(2, 0, [])]
    assert decontaminate.find_leaks(docs.where("doc_id > 1"), none).count() == 0


def test_most_words_are_jumped_over(monkeypatch):
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(20_000)).encode()
    item = " ".join("".join(rng.choice("stuvwxyz") for _ in range(5)) for _ in range(40))
    seen = []
    real = decontaminate.Words.block
    monkeypatch.setattr(decontaminate.Words, "block", lambda self, last, size: seen.append(len(last)) or real(self, last, size))
    searcher = decontaminate.Searcher([("1", item)], 10)
    seen.clear()
    searcher.judged(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))
    assert sum(seen) < 20_000 / 7


def test_same_hash_is_no_match(monkeypatch):
    """Blocks that all hash alike are told apart by their bytes."""
    monkeypatch.setattr(decontaminate.Words, "symbol", lambda self, w: np.zeros(len(w), dtype=np.uint64))
    docs, items = benchmark_like(4)
    small = [(d, t) for d, t in docs if t and len(t) < 2000]
    searcher = decontaminate.Searcher([(None if i is None else str(i), t or "") for i, t in items], 10)
    blobs = [t.encode() for _, t in small]
    n_words, n_hit, _, names = searcher.judged(np.frombuffer(b"".join(blobs), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in blobs])]).astype(np.int64))
    assert sorted(zip([d for d, _ in small], n_words, n_hit, names), key=repr) == leaks(small, items, 10)
