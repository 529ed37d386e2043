"""Text expressions: words, sentences, markers, dialects, alignment, options, slugs.

Lengths are code points. A null text behaves like an empty one unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORDS = r"(?U)\b[\w']+\b"
SENTENCES = r"[^.!?\n]+[.!?]?"


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, whatever the optimizer does with aliases."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORDS), F.lit(0))


def collapse(text: Column) -> Column:
    """White-space runs to one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normal_form(text: Column) -> Column:
    """Lower case with white space collapsed: the native form of the deduplication key."""
    return collapse(F.lower(text))


def classifier_input(text: Column, most: int = 2000) -> Column:
    return F.substring(collapse(text), 1, most)


def shingles(word_list: Column, n: int) -> Column:
    """Distinct n-word shingles; one of all words if there are fewer, none without words."""
    return F.when(
        F.size(word_list) > 0,
        F.array_distinct(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.size(word_list) - n + 1, F.lit(1))),
                lambda i: F.array_join(F.slice(word_list, i, F.lit(n)), " "),
            )
        ),
    ).otherwise(F.array().cast("array<string>"))


def count_text(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a literal string."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def marker_hits(text: Column, markers: Sequence[str]) -> Column:
    """Hits of one-word markers among the words plus of longer ones in the raw lower-cased text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    single = [m for m in markers if " " not in m]
    hits = F.size(F.filter(words(low), lambda w: w.isin(single))).cast("long") if single else F.lit(0).cast("long")
    for m in markers:
        if " " in m:
            hits = hits + count_text(low, m)
    return hits


def marker_ratio(text: Column, markers: Sequence[str]) -> Column:
    return F.coalesce(F.try_divide(marker_hits(text, markers), F.size(words(text))), F.lit(0.0))


def word_signals(text: Column, lists: dict[str, Sequence[str]], dialects: dict[str, Sequence[str]]) -> Column:
    """struct of the ``marker_ratio`` of each of ``lists`` by its name, and ``dialect``, with the words found once."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def told(w):
        ratios = []
        for name, markers in lists.items():
            single = [m for m in markers if " " not in m]
            hits = F.size(F.filter(w, lambda x: x.isin(single))).cast("long")  # noqa: B023
            for m in markers:
                if " " in m:
                    hits = hits + count_text(low, m)
            ratios.append(F.coalesce(F.try_divide(hits, F.size(w)), F.lit(0.0)).alias(name))
        return F.struct(*ratios, _named_dialect(F.array_distinct(w), dialects, 2).alias("dialect"))

    return let(words(low), told)


def sentences(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCES), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != "")


def switch_counts(text: Column, first: Sequence[str], second: Sequence[str], least: int = 5) -> Column:
    """struct(considered, mixed): sentences with enough distinct words, and those holding words of both lists."""
    a, b = F.array(*[F.lit(x) for x in first]), F.array(*[F.lit(x) for x in second])
    sets = F.filter(
        F.transform(sentences(F.lower(text)), lambda s: F.array_distinct(words(s))), lambda w: F.size(w) >= least
    )
    return let(
        sets,
        lambda s: F.struct(
            F.size(s).cast("long").alias("considered"),
            F.size(F.filter(s, lambda w: F.arrays_overlap(w, a) & F.arrays_overlap(w, b))).cast("long").alias("mixed"),
        ),
    )


def dialect(text: Column, markers: dict[str, Sequence[str]], least: int = 2) -> Column:
    """struct(name, hits): most distinct markers; the earlier dialect wins ties; no name below ``least``."""
    return _named_dialect(F.array_distinct(words(F.lower(text))), markers, least)


def _named_dialect(distinct: Column, markers: dict[str, Sequence[str]], least: int) -> Column:
    scored = lambda w: F.array_max(
        F.array(
            *[
                F.struct(
                    F.size(F.array_intersect(w, F.array(*[F.lit(x) for x in m]))).cast("long").alias("hits"),
                    F.lit(-i).alias("rank"),
                    F.lit(name).alias("name"),
                )
                for i, (name, m) in enumerate(markers.items())
            ]
        )
    )
    return let(
        let(distinct, scored),
        lambda b: F.struct(F.when(b["hits"] >= least, b["name"]).alias("name"), b["hits"].alias("hits")),
    )


def alignment(left: Column, right: Column, low: float = 0.4, high: float = 2.5, least: int = 40, digits: float = 0.3) -> Column:
    """struct(passed, reason, ratio) of a translated pair."""
    n, m = F.length(left), F.length(right)
    ratio = n / m
    a, b = (F.array_distinct(F.regexp_extract_all(x, F.lit(r"(?U)\d+"), F.lit(0))) for x in (left, right))
    overlap = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    reason = (
        F.when((n < least) | (m < least), "too_short")
        .when((ratio < low) | (ratio > high), "length_ratio")
        .when((F.size(a) > 0) & (F.size(b) > 0) & (overlap < digits), "numeric_content_diverges")
        .otherwise("ok")
    )
    return let(
        F.struct(reason.alias("reason"), F.when((n >= least) & (m >= least), ratio).otherwise(F.lit(0.0)).alias("ratio")),
        lambda s: F.struct((s["reason"] == "ok").alias("passed"), s["reason"].alias("reason"), s["ratio"].alias("ratio")),
    )


def instruction_pair(instruction: Column, output: Column) -> Column:
    """struct(malay, english) from a back-quoted source and the direction the instruction names."""
    source = F.trim(F.regexp_extract(instruction, r"(?s)`(.+?)`", 1))
    target = F.trim(output)
    known = (instruction.isNotNull()) & (output.isNotNull()) & instruction.rlike(r"(?s)`(.+?)`")
    to_malay = instruction.rlike(r"(?i)terjemah\s+ke\s+(bahasa\s+)?(melayu|malay)")
    to_english = instruction.rlike(r"(?i)terjemah\s+ke\s+(bahasa\s+)?(inggeris|english)")
    return F.struct(
        F.when(known & to_malay, target).when(known & to_english, source).alias("malay"),
        F.when(known & to_malay, source).when(known & to_english, target).alias("english"),
    )


OPTION = r"^\s*\(?([A-Za-z])[.):]\s+"


def option_letter(option: Column) -> Column:
    return F.upper(F.nullif(F.regexp_extract(option, OPTION, 1), F.lit("")))


def option_text(option: Column) -> Column:
    return F.trim(F.regexp_replace(option, OPTION, ""))


def render_options(options: Column) -> Column:
    return F.array_join(F.transform(options, lambda o, i: F.concat(F.char(i + 65), F.lit(". "), o)), "\n")


MALAY_PROMPT = (
    "Berikut adalah soalan aneka pilihan tentang {subject}. Jawab dengan memberikan huruf pilihan yang betul sahaja.\n\n{question}\nJawapan:"
)
ENGLISH_PROMPT = "The following is a multiple choice question. Answer with the letter of the correct option only.\n\n{question}\nAnswer:"


def render_prompt(question: Column, options: Column, language: Column, subject: Column, embedded: Column) -> Column:
    """The prompt of a multiple-choice item; options already in the question are not rendered again."""
    body = F.when(embedded, question).otherwise(F.concat(question, F.lit("\n"), render_options(options)))
    head, tail = MALAY_PROMPT.split("{subject}")
    before, after = tail.split("{question}")
    topic = F.coalesce(F.nullif(subject, F.lit("")), F.lit("pengetahuan am"))
    en_before, en_after = ENGLISH_PROMPT.split("{question}")
    return F.rtrim(
        F.when(language == "english", F.concat(F.lit(en_before), body, F.lit(en_after))).otherwise(
            F.concat(F.lit(head), topic, F.lit(before), body, F.lit(after))
        )
    )


def answer_index(options: Column, key: Column, answer: Column) -> Column:
    """0-based index of the right option: by key letter, else by equal text; null if neither resolves."""
    bare = F.transform(options, option_text)
    by_key = F.ascii(F.upper(F.trim(key))) - 65
    by_text = F.array_position(bare, option_text(answer)).cast("int") - 1
    return F.when((F.length(F.trim(key)) == 1) & (by_key >= 0) & (by_key < F.size(options)), by_key).when(by_text >= 0, by_text)


def options_embedded(question: Column, options: Column) -> Column:
    return F.forall(F.slice(options, 1, 2), lambda o: F.contains(question, o))


def slug(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_"))


def csv_items(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")


def format_scalar(value: Column, digits: int = 4) -> Column:
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, "n/a").otherwise(F.format_string(f"%.{digits}f", value))


def chat_turns(turns: Column) -> Column:
    """``turns``: array of struct(turn, role, text) rendered in turn order."""
    return F.array_join(
        F.transform(F.array_sort(turns), lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))), ""
    )


def strip_marks(text: Column) -> Column:
    """Compatibility decomposition without combining marks, case-folded, white space collapsed.

    Spark has no Unicode normalisation, so this one is an Arrow UDF; ``normal_form`` is the native form.
    """
    return _strip_marks(text)


@F.pandas_udf(StringType())
def _strip_marks(values):
    import unicodedata

    def one(s):
        if s is None:
            return None
        flat = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
        return " ".join(flat.casefold().split())

    return values.map(one)
