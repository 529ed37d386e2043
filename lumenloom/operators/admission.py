"""The ingest state machine: records in reading order, quotas, early stops and deduplication in one result.

Read one record after another it is a loop: a source stops once the class it feeds is full, a
record of a full class is turned away before it is deduplicated, and only kept documents make
later ones duplicates. The loop's whole state is where each class fills, so that is found instead:
decide with no class full, take the earliest place where one fills, drop what is turned away
beyond it, decide again. Decisions up to that place stay as they are, so this takes one round for
each class that fills, whatever the number of records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut_lineage, release
from . import dedup


def _same_text(records: DataFrame, permutations: int, rows: int, least: float) -> tuple[DataFrame, DataFrame]:
    """((arrival, group), (group, doc_id)): documents of one signature, and sets of groups that are near duplicates.

    A group is named by its first arrival. Texts without words are grouped by their normal form.
    """
    # read twice; its texts come from a Python function
    flat = cut_lineage(records.select(F.col("arrival").alias("doc_id"), tx.strip_marks(F.col("text")).alias("text")))
    sigs = cut_lineage(dedup.signatures(flat, permutations))
    bare = flat.join(sigs.select("doc_id"), "doc_id", "left_anti")
    named = lambda rows, key: rows.join(rows.groupBy(key).agg(F.min("doc_id").alias("group")), key).select(F.col("doc_id").alias("arrival"), "group")
    groups = named(sigs, "signature").union(named(bare, "text"))
    found = cut_lineage(groups), cut_lineage(dedup.near_groups(sigs, least, rows))
    release(flat)
    release(sigs)
    return found


def ingest(
    records: DataFrame,
    target: int,
    required: list[str],
    cap: int | None = None,
    permutations: int = 64,
    rows: int = 4,
    least: float = 0.8,
) -> DataFrame:
    """(arrival, source, corpus_class, outcome) of every record.

    ``records``: arrival (long, unique, ascending in reading order), source, primary (the class the
    source feeds, or null), text (null: the record has none), corpus_class (null: rejected), reason.
    A source stops at its first record after its primary class has ``target`` documents, at its
    record ``cap`` + 1, or at its first record after all ``required`` classes are full. Outcomes:
    kept, duplicate, class_full, the rejection's reason, missing_text_field, what stopped the source
    (primary_class_full, source_cap_reached, all_classes_full), and unread for what follows that.
    Null sources are one source. An empty table gives an empty result.
    """
    at = F.col("arrival")
    # what classifies the records is paid for once, not in each of the passes below
    records = cut_lineage(records.select("arrival", "source", "primary", "text", "corpus_class", "reason"))
    capped = None
    if cap is not None:
        nth = F.row_number().over(Window.partitionBy("source").orderBy("arrival"))
        # a rank under a bound is cut within each partition before the shuffle
        capped = cut_lineage(records.select("source", "arrival").withColumn("r", nth).where(F.col("r") <= cap + 1).where(F.col("r") == cap + 1).select("source", at.alias("cap_stop")))
    judged = records.where("text is not null and corpus_class is not null")
    if capped is not None:
        judged = judged.join(capped.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").where(F.col("cap_stop").isNull() | (at < F.col("cap_stop")))
    judged = judged.select("arrival", "primary", "corpus_class", "text")
    groups, near = _same_text(judged, permutations, rows, least)
    judged = cut_lineage(judged.drop("text").join(groups, "arrival"))

    full: dict[str, int] = {}  # where each class filled: as many entries as there are classes
    while True:
        over = F.lit(False)
        for name, place in full.items():
            over = over | (((F.col("corpus_class") == name) | (F.coalesce("primary", F.lit("")) == name)) & (at > place))
        if required and set(required) <= set(full):
            over = over | (at > max(full[c] for c in required))
        alive = judged.where(~over)
        firsts = alive.groupBy("group").agg(F.min_by(F.struct("arrival", "corpus_class"), "arrival").alias("f")).select("group", "f.arrival", "f.corpus_class")
        sets = near.join(firsts.select(F.col("group").alias("doc_id"), at), "doc_id").select("group", at.alias("doc_id"))
        gone = dedup.settled(sets)
        kept = cut_lineage(firsts.join(gone.select(F.col("doc_id").alias("arrival")), "arrival", "left_anti").select("arrival", "corpus_class"))
        rank = F.row_number().over(Window.partitionBy("corpus_class").orderBy("arrival"))
        filled = kept.withColumn("r", rank).where(F.col("r") <= target).where(F.col("r") == target).select("corpus_class", "arrival").collect()
        fresh = [(r.arrival, r.corpus_class) for r in filled if r.corpus_class not in full]
        if not fresh:
            break
        place, name = min(fresh)
        full[name] = place

    beyond = F.lit(None).cast("long")
    for name, place in full.items():
        beyond = F.when((F.col("primary") == name) & (at > place), at).otherwise(beyond)
    all_full = max(full[c] for c in required) if required and set(required) <= set(full) else None
    stops = records.groupBy("source").agg(
        F.min(beyond).alias("primary_stop"), F.min(F.when(at > all_full, at) if all_full is not None else F.lit(None).cast("long")).alias("all_stop")
    )
    if capped is not None:
        stops = stops.join(capped.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    else:
        stops = stops.withColumn("cap_stop", F.lit(None).cast("long"))
    stops = stops.withColumn("stop", F.least("primary_stop", "cap_stop", "all_stop")).withColumnRenamed("source", "s")
    class_full = F.lit(False)
    for name, place in full.items():
        class_full = class_full | ((F.col("corpus_class") == name) & (at > place))
    outcome = (
        F.when(at > F.col("stop"), "unread")
        .when(at == F.col("primary_stop"), "primary_class_full")
        .when(at == F.col("cap_stop"), "source_cap_reached")
        .when(at == F.col("all_stop"), "all_classes_full")
        .when(F.col("text").isNull(), "missing_text_field")
        .when(F.col("corpus_class").isNull(), F.col("reason"))
        .when(class_full, "class_full")
        .when(F.col("is_kept"), "kept")
        .otherwise("duplicate")
    )
    return (
        records.join(stops, F.col("source").eqNullSafe(F.col("s")), "left")
        .join(kept.select("arrival", F.lit(True).alias("is_kept")), "arrival", "left")
        .select("arrival", "source", "corpus_class", outcome.alias("outcome"))
    )
