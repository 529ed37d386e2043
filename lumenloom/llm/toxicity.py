"""Toxicity: a weighted finite-state pattern grammar over clauses.

Transducers. A lexical transducer maps each word to weighted symbols: insult (with the weight of
the arc that accepts it: a learned word or word start), threat, target, negation, reported speech,
quotation mark or other; a word may have several. Three clause transducers read and write symbols,
each with its states and arcs: negation (an insult or threat within reach of one weighs less),
reported speech (what follows the verb weighs less, and what stands in a quotation that a later
verb reports: guessed where the quotation opens, owed until the verb comes) and target (a clause
that names one weighs more; a threat counts only with one within reach before it or, guessed and
owed, after it). Their composition is one machine; a clause is scored by its best path, where an arc
multiplies its symbol's weight, the path adds up, and the final state has the last factor. Clauses
end with sentences: not within a quotation, and not at a line's end after a colon or comma. A
document's evidence is the sum over its clauses, and a logistic curve turns it into a score.

Learning. Insult arcs are words and word starts of 3 to 7 letters that toxic training documents
share and others lack. What is counted is how many different words of a document have a feature,
so that a start that many words of few documents share is told from a chance word; weights are log
odds. The curve is fitted on the same rows.
At most ``TOXIC_ROWS`` toxic and ``CLEAN_ROWS`` other labelled rows are used (lowest CRC-32 of
the id first), near copies once (five-word shingles at a
verified similarity of 0.8, as in ``jaccard``); at most ``ARCS`` arcs are kept. Rows whose
crc32(doc_id) mod 4 is 2 are held out. Only ``text`` and ``toxic`` are learned from.

Defined results: null or empty text has no evidence and gets the curve's lowest score.
A null doc_id is not held out. Without labelled rows there are no insult arcs and the curve
has its default parameters. Repeated rows score alike. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, trimmed
from .jaccard import keep_one_of_each

#: Documented bounds of what is learned from.
TOXIC_ROWS, CLEAN_ROWS, ARCS, FEATURES = 6_000, 14_000, 4_096, 60_000
LEAST_ROWS = 3
LEAST_ODDS = 1.5
#: An arc's likelihood-ratio statistic passes twice the log of the number of features tested by this.
LEAST_RATIO = 6.0
#: A longer arc with this share of an arc's toxic documents replaces it.
SPECIFIC = 0.95
NEGATED, REPORTED, TARGETED, REACH = 0.5, 0.6, 1.25, 3
THREAT_WEIGHT = 4.0

THREATS = frozenset("kill murder strangle stab shoot töten umbringen erschießen tuer assassiner égorger matar asesinar degollar".split())
TARGETS = frozenset("you your yourself u du dich dir euch tu te toi vous tú ti usted ustedes".split())
NEGATIONS = frozenset("not never no nor isn't aren't don't nicht kein keine nie pas jamais nunca ni".split())
REPORTS = frozenset("said says say wrote called quoted reported claimed sagte schrieb nannte dit disait écrit dijo escribió".split())

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
#: Words and quotation marks.
_PIECE = re.compile(WORD.pattern + '|["\u201c\u201d\u00ab\u00bb]')
#: A clause: a quotation of up to 300 characters is within it, whatever it holds.
_CLAUSE = re.compile('(?:[^.!?\\n"\u201c\u00ab:,]+|"[^"\\n]{0,300}"|\u201c[^\u201d\\n]{0,300}\u201d|\u00ab[^\u00bb\\n]{0,300}\u00bb|[:,][ \\t]*\\n+[ \\t]*|["\u201c\u00ab:,])+')


@dataclass
class Grammar:
    """Learned arcs (word start ending in ``*``, or whole word) with weights, and the curve."""

    arcs: dict[str, float] = field(default_factory=dict)
    slope: float = 3.0
    length: float = 0.0
    shift: float = -3.0

    def machine(self):
        """The union of insult and threat arcs as an automaton that runs over characters."""
        import ahocorasick

        out = ahocorasick.Automaton()
        for arc, weight in self.arcs.items():
            start = arc.rstrip("*")
            kept = out.get(start, (start, 0.0, 0.0))
            if arc.endswith("*"):
                out.add_word(start, (start, max(weight, kept[1]), kept[2]))
            else:
                out.add_word(start, (start, kept[1], max(weight, kept[2])))
        for word in THREATS:
            if word not in out:
                out.add_word(word, (word, 0.0, 0.0))
        out.make_automaton()
        return out

    def score(self, evidence: F.Column, n_chars: F.Column) -> F.Column:
        at = F.lit(self.slope) * F.log1p(evidence) + F.lit(self.length) * F.log1p(n_chars) + F.lit(self.shift)
        return 1 / (1 + F.exp(-at))


SYMBOLS = ("insult", "threat", "target", "negation", "report", "quote", "other")


@dataclass(frozen=True)
class Transducer:
    """Weighted finite-state machine: ``arcs[state, symbol]`` are (next state, written symbol, factor)."""

    start: object
    arcs: dict[tuple[object, str], tuple[tuple[object, str, float], ...]]
    final: dict[object, float]

    def compose(self, after: Transducer) -> Transducer:
        """The machine whose paths read by this one and have what it writes read by ``after``; factors multiply."""
        start = (self.start, after.start)
        arcs, final, open_ = {}, {}, [start]
        seen = {start}
        while open_:
            here = open_.pop()
            a, b = here
            if a in self.final and b in after.final:
                final[here] = self.final[a] * after.final[b]
            for symbol in SYMBOLS:
                out = tuple(
                    ((a2, b2), written, f * g)
                    for a2, middle, f in self.arcs.get((a, symbol), ())
                    for b2, written, g in after.arcs.get((b, middle), ())
                )
                if out:
                    arcs[here, symbol] = out
                    fresh = [x[0] for x in out if x[0] not in seen]
                    seen.update(fresh)
                    open_ += fresh
        return Transducer(start, arcs, final)

    def best(self, words: list[tuple[tuple[str, float], ...]]) -> float:
        """Weight of the best path over the words' (symbol, weight) choices; 0 if none ends in a final state."""
        now = {self.start: 0.0}
        for choices in words:
            then: dict[object, float] = {}
            for state, total in now.items():
                for symbol, weight in choices:
                    for to, _, factor in self.arcs.get((state, symbol), ()):
                        value = total + weight * factor
                        if value > then.get(to, -1.0):
                            then[to] = value
            now = then
        return max((total * self.final[s] for s, total in now.items() if s in self.final), default=0.0)


def negation_machine() -> Transducer:
    """States count the words that a negation still reaches."""
    arcs = {}
    for left in range(REACH + 1):
        below = max(0, left - 1)
        for s in SYMBOLS:
            arcs[left, s] = ((REACH if s == "negation" else below, s, NEGATED if left and s in ("insult", "threat") else 1.0),)
    return Transducer(0, arcs, dict.fromkeys(range(REACH + 1), 1.0))


def report_machine() -> Transducer:
    """Speech is reported from a verb of saying on, and in a quotation that one follows.

    A quotation opens on two guesses: ``promised``, which weighs less and owes the verb, and
    ``quoted``, which ends if a verb comes after all.
    """
    arcs = {}
    less = lambda s: REPORTED if s in ("insult", "threat") else 1.0
    for s in SYMBOLS:
        arcs["plain", s] = (("plain", s, 1.0),)
        arcs["quoted", s] = (("quoted", s, 1.0),)
        arcs["past", s] = (("past", s, 1.0),)
        arcs["promised", s] = (("promised", s, less(s)),)
        arcs["owed", s] = (("owed", s, 1.0),)
        arcs["reported", s] = (("reported", s, less(s)),)
    arcs["plain", "quote"] = (("promised", "quote", 1.0), ("quoted", "quote", 1.0))
    arcs["quoted", "quote"] = (("past", "quote", 1.0),)
    arcs["promised", "quote"] = (("owed", "quote", 1.0),)
    arcs["past", "quote"] = (("quoted", "quote", 1.0),)
    arcs["owed", "quote"] = (("promised", "quote", 1.0),)
    for state in ("plain", "quoted", "owed"):
        arcs[state, "report"] = (("reported", "report", 1.0),)
    del arcs["past", "report"]
    return Transducer("plain", arcs, dict.fromkeys(("plain", "quoted", "past", "reported"), 1.0))


def target_machine() -> Transducer:
    """States are (a target was named, words a named target still reaches, words in which one is owed).

    A threat near a target counts; another counts on the promise of one, and a path that owes a
    target at the end, or for too long, is none.
    """
    arcs, final, open_ = {}, {}, [(False, 0, 0)]
    seen = set(open_)
    while open_:
        named, near, owed = here = open_.pop()
        if not owed:
            final[here] = TARGETED if named else 1.0
        for s in SYMBOLS:
            below = (named, max(0, near - 1), max(0, owed - 1))
            kept = owed != 1  # the last word in which the target could come
            if s == "target":
                out = (((True, REACH, 0), s, 1.0),)
            elif s == "threat" and not near:
                out = ((below, s, 0.0), ((named, 0, owed - 1 if owed else REACH), s, 1.0)) if kept else ()
            else:
                out = ((below, s, 1.0),) if kept else ()
            if out:
                arcs[here, s] = out
                fresh = {x[0] for x in out} - seen
                seen |= fresh
                open_ += sorted(fresh)
    return Transducer((False, 0, 0), arcs, final)


#: What all clauses are scored by.
CLAUSE = negation_machine().compose(report_machine()).compose(target_machine())


def lexical(word: str, insult: float) -> tuple[tuple[str, float], ...]:
    """The lexical transducer's arcs over one word: the symbols it may be read as, with their weights."""
    if not word[0].isalpha():
        return (("quote", 0.0),)
    out = [("insult", insult)] if insult else []
    for symbol, words, weight in (("threat", THREATS, THREAT_WEIGHT), ("target", TARGETS, 0.0), ("negation", NEGATIONS, 0.0), ("report", REPORTS, 0.0)):
        if word in words:
            out.append((symbol, weight))
    return tuple(out) or (("other", 0.0),)


def clause_weight(words: list[tuple[tuple[str, float], ...]]) -> float:
    """What the composed machine gives for a clause's words, each with its choice of symbols."""
    return CLAUSE.best(words)


def evidence(text: str | None, machine) -> float:
    """The summed weight of all clauses that hold an insult or a threat."""
    if not text:
        return 0.0
    low = text.lower().replace("\u2019", "'")
    hits: dict[int, float] = {}
    for stop, (start, prefix, whole) in machine.iter(low):
        first = stop - len(start) + 1
        if first and low[first - 1].isalpha():
            continue
        ends = stop + 1 == len(low) or not low[stop + 1].isalpha()
        weight = whole if ends else prefix  # a word start is learned from longer words only
        if weight or (ends and start in THREATS):
            hits[first] = max(weight, hits.get(first, 0.0))
    if not hits:
        return 0.0
    total, places = 0.0, sorted(hits)
    k = 0
    for clause in _CLAUSE.finditer(low):
        begin, end = clause.span()
        while k < len(places) and places[k] < begin:
            k += 1
        if k == len(places):
            break
        if places[k] < end:
            total += clause_weight([lexical(m[0], hits.get(m.start(), 0.0)) for m in _PIECE.finditer(low, begin, end)])
    return total


def word_features(text: str | None) -> dict[str, int]:
    """Words, and their starts of 3 to 7 letters marked by ``*``, with how many different words have them."""
    out: dict[str, int] = {}
    for w in set(re.findall(r"[^\W\d_]+", (text or "").lower())):
        if len(w) >= 3:
            for feature in (w, *(w[:k] + "*" for k in range(3, min(len(w), 8)))):
                out[feature] = out.get(feature, 0) + 1
    return out


def _n_words(features: dict[str, int]) -> int:
    """Different words, from ``word_features``: each has a feature of its own."""
    return sum(not f.endswith("*") for f in features)


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(4)) == 2


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the bounded labelled sample, near copies of one label once (the lowest doc_id)."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("doc_id")).select("doc_id", "toxic").distinct()
    order = [F.crc32(F.concat(F.lit("toxic"), F.col("doc_id").cast("string"))), F.col("doc_id")]
    picked = rows.where("toxic = 1").orderBy(*order).limit(TOXIC_ROWS).union(
        rows.where("toxic = 0").orderBy(*order).limit(CLEAN_ROWS)
    )
    # at most TOXIC_ROWS + CLEAN_ROWS ids
    found = materialize(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic"), "toxic-sample")
    # words carry their label, so that one pass finds copies of one label only
    marked = found.withColumns({"plain": F.col("text"), "text": F.regexp_replace("text", r"([^\x20\x09-\x0D]+)", F.concat(F.col("toxic").cast("string"), F.lit("$1")))})
    return keep_one_of_each(marked, words=5, percent=80).select(F.col("plain").alias("text"), "toxic")


def learn(docs: DataFrame, labels: DataFrame) -> Grammar:
    """The grammar from the training rows of ``labels`` (doc_id, toxic)."""
    rows = materialize(training_rows(docs, labels).repartition(16), "toxic-rows")

    def shares(batches):
        import pyarrow as pa

        for batch in batches:
            for text in batch.column(0).to_pylist():
                features = word_features(text)
                # the empty arc counts all words
                yield pa.RecordBatch.from_arrays([pa.array(["", *features]), pa.array([_n_words(features), *features.values()], pa.int64())], ["arc", "n"])

    toxic = rows.where("toxic = 1").select("text").mapInArrow(trimmed(shares), "arc string, n long").groupBy("arc").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    often = toxic.where((F.col("rows") >= LEAST_ROWS) & (F.col("arc") != "")).orderBy(F.col("n").desc(), "arc").limit(FEATURES)
    bad = {r.arc: r.n for r in often.collect()}  # at most FEATURES
    whole = toxic.where("arc = ''").first()
    n_bad = whole.n if whole else 0

    def clean_shares(batches):
        from collections import Counter

        import pyarrow as pa

        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                features = word_features(text)
                seen.update({f: n for f, n in features.items() if f in bad})
                seen[""] += _n_words(features)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["arc", "n"])

    counted = rows.where("toxic = 0").select("text").mapInArrow(trimmed(clean_shares), "arc string, n long").groupBy("arc").agg(F.sum("n").alias("n"))
    clean = {r.arc: r.n for r in counted.collect()}  # at most FEATURES
    n_clean = clean.pop("", 0)
    arcs = choose_arcs(bad, clean, n_bad, n_clean)
    grammar = Grammar(dict(sorted(arcs.items(), key=lambda x: (-x[1], x[0]))[:ARCS]))
    if n_bad and n_clean:
        _fit_curve(grammar, rows)
    return grammar


def choose_arcs(bad: dict[str, int], clean: dict[str, int], n_bad: int, n_clean: int) -> dict[str, float]:
    """Significant arcs and their log odds, from counts of each feature and of all words."""
    arcs: dict[str, float] = {}
    share = min(max(n_bad / max(n_bad + n_clean, 1), 1e-6), 1 - 1e-6)
    inner: dict[str, tuple[int, int]] = {}  # counts of the best accepted arc inside a shorter one
    for arc in sorted(bad, key=lambda a: (-len(a.rstrip("*")), a)):
        start, (n_in, other_in) = arc.rstrip("*"), inner.get(arc, (0, 0))
        n, other = bad[arc], clean.get(arc, 0)
        rest, other_rest = max(n - n_in, 0), max(other - other_in, 0)  # what the longer arc leaves
        both = rest + other_rest
        if n_in >= SPECIFIC * n or not rest:
            continue
        odds = math.log((rest + 0.5) / (n_bad + 1)) - math.log((other_rest + 0.5) / (n_clean + 1))
        ratio = 2 * (rest * math.log(rest / (both * share)) + (other_rest * math.log(other_rest / (both * (1 - share))) if other_rest else 0.0))
        if odds >= LEAST_ODDS and rest > both * share and ratio >= LEAST_RATIO + 2 * math.log(max(len(bad), 1)):
            arcs[arc] = odds
            for k in range(3, len(start) + (arc != start)):
                short = start[:k] + "*"
                if short != arc:
                    inner[short] = max(inner.get(short, (0, 0)), (n, other))
    return arcs


def _fit_curve(grammar: Grammar, rows: DataFrame) -> None:
    """The curve by penalised Newton steps on at most TOXIC_ROWS + CLEAN_ROWS labelled points."""
    import numpy as np

    pairs = _with_evidence(rows, grammar, ["toxic"]).select("evidence", "n_chars", "toxic").collect()
    grid = np.array([(math.log1p(p.evidence), math.log1p(p.n_chars), 1.0) for p in pairs])
    y = np.array([p.toxic for p in pairs], dtype=float)
    ridge = np.array([0.05, 0.05, 1e-6])
    w = np.array([1.0, 0.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(grid @ w, -30, 30)))
        hess = grid.T @ (grid * (p * (1 - p))[:, None]) + np.diag(ridge)
        step = np.linalg.solve(hess, grid.T @ (p - y) + ridge * w)
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    if w[0] > 0:
        grammar.slope, grammar.length, grammar.shift = map(float, w)


def _with_evidence(docs: DataFrame, grammar: Grammar, keep: list[str]) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        machine = grammar.machine()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            found = pa.array([evidence(t, machine) for t in texts], pa.float64())
            sizes = pa.array([len(t or "") for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found, sizes], [*keep, "evidence", "n_chars"])

    schema = T.StructType([docs.schema[c] for c in keep]).add("evidence", "double").add("n_chars", "long")
    return docs.select(*keep, "text").mapInArrow(trimmed(run), schema)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) for every row of ``docs`` (doc_id, text)."""
    grammar = learn(docs, labels)
    score = grammar.score(F.col("evidence"), F.col("n_chars"))
    return _with_evidence(docs, grammar, ["doc_id"]).select(
        "doc_id", held_out("doc_id").alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"), "evidence"
    )
