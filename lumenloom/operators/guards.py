"""Constraints as part of a plan: rows pass unchanged, or the job that reads them fails and says why.

Nothing is counted beforehand. A constraint on rows is a filter that lets all rows pass or raises;
one on groups is a join with the groups' aggregates, which raise in the same job. What a job saw is
observed while it runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .recipes import RecipeError


def _first_broken(rules: dict[str, Column]) -> Column:
    """The message of the first rule that does not hold; an unknown truth does not hold."""
    return F.coalesce(*[F.when(F.coalesce(holds, F.lit(False)), F.lit(None).cast("string")).otherwise(F.lit(message)) for message, holds in rules.items()])


def checked(df: DataFrame, rules: dict[str, Column], detail: Column | None = None) -> DataFrame:
    """``df`` as it is; evaluating a row that breaks a rule raises the rule's message, with ``detail`` of the row."""
    if not rules:
        return df
    broken = _first_broken(rules)
    message = F.concat_ws(": ", broken, detail.cast("string")) if detail is not None else broken
    return df.where(F.when(broken.isNotNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))


def checked_groups(df: DataFrame, by: list[str], facts: dict[str, Column], rules: dict[str, Column]) -> DataFrame:
    """``df`` as it is; raises if the aggregates ``facts`` of a ``by`` group break a rule.

    For few groups, such as classes: their aggregates are sent to every task.
    """
    groups = df.groupBy(*by).agg(*[c.alias(k) for k, c in facts.items()])
    sound = checked(groups, rules, F.to_json(F.struct(*groups.columns))).select(*[F.col(b).alias(f"_{b}") for b in by], F.lit(True).alias("_sound"))
    on = F.lit(True)
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_{b}"))
    return df.join(F.broadcast(sound), on).where("_sound").select(*df.columns)


def sound_split(parts: DataFrame, by: str = "corpus_class", train: float = 0.8, tolerance: float = 0.02) -> DataFrame:
    """``parts`` (doc_index, side); evaluating them raises if a class repeats or misses documents or its train fraction is off."""
    index = F.col("doc_index")
    facts = {
        "rows": F.count("*"),
        "last": F.max(index),
        "distinct": F.countDistinct(index),
        "share": F.avg((F.col("side") == "train").cast("double")),
    }
    rules = {
        "a split repeats documents": F.col("distinct") == F.col("rows"),
        "a split misses documents": F.col("last") + 1 == F.col("rows"),
        "a split's train fraction is off": F.abs(F.col("share") - train) <= tolerance,
    }
    return checked_groups(parts, [by], facts, rules)


#: Configurations by expert activation width, in the order they are preferred.
CONFIG_PREFERENCE = {
    16: ("NVFP4_MLP_WEIGHT_ONLY_CFG", "NVFP4_MLP_ONLY_CFG"),
    4: ("NVFP4_DEFAULT_CFG", "NVFP4_AFFINE_KV_CFG"),
}


def resolved_config(width: Column, offered: Column) -> Column:
    """The preferred configuration of a width among those ``offered`` (array of text); raises where there is none."""
    wanted = F.coalesce(*[F.when(width == w, F.array(*[F.lit(n) for n in names])) for w, names in CONFIG_PREFERENCE.items()])
    found = F.try_element_at(F.filter(wanted, lambda n: F.array_contains(offered, n)), F.lit(1))
    unknown = F.concat(F.lit("no configuration is known for activation width "), F.coalesce(width.cast("string"), F.lit("null")))
    missing = F.concat(F.lit("none of "), F.array_join(wanted, ", "), F.lit(" is among "), F.array_join(F.array_sort(offered), ", "))
    return F.when(wanted.isNull(), F.raise_error(unknown).cast("string")).when(found.isNull(), F.raise_error(missing).cast("string")).otherwise(found)


def resolved_ids(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    """``wanted`` (name, kind, ...) with found, gated, revision and usable, from a ``catalog`` (name, gated, revision) of what there is.

    Nothing raises here: a name that the catalog lacks is not found and not usable.
    """
    listed = catalog.groupBy("name").agg(F.bool_or(F.coalesce("gated", F.lit(False))).alias("gated"), F.max("revision").alias("revision"), F.lit(True).alias("found"))
    joined = wanted.join(listed, "name", "left").withColumns({"found": F.coalesce("found", F.lit(False)), "gated": F.coalesce("gated", F.lit(False))})
    return joined.withColumn("usable", F.col("found") & ~F.col("gated"))


def preflight(recipes: DataFrame, ids: DataFrame, families: list[str]) -> DataFrame:
    """(check, subject, ok, detail): everything that can be told before a run, as one plan.

    ``recipes``: family, identity, activation_bits (one row a family that has a recipe); ``ids``:
    name, kind (model or dataset), found, gated, revision. Every family needs a recipe; no two may
    share an identity or an activation width; every id must be there and not be gated.
    """
    spark = recipes.sparkSession
    wanted = spark.createDataFrame([(f,) for f in families], "family string")
    have = recipes.groupBy("family").agg(F.min("identity").alias("identity"), F.min("activation_bits").alias("activation_bits"))
    joined = wanted.join(have, "family", "left")
    present = joined.select(F.lit("recipe").alias("check"), F.col("family").alias("subject"), F.col("identity").isNotNull().alias("ok"), F.coalesce("identity", F.lit("missing")).alias("detail"))

    def apart(column: str, check: str) -> DataFrame:
        shared = joined.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("family")), ",").alias("who"))
        return shared.select(F.lit(check).alias("check"), F.col("who").alias("subject"), (F.col("n") == 1).alias("ok"), F.col(column).cast("string").alias("detail"))

    state = F.when(~F.col("found"), "missing").when(F.col("gated"), "gated").otherwise(F.coalesce("revision", F.lit("unpinned")))
    usable = F.coalesce(F.col("found") & ~F.col("gated"), F.lit(False))
    resolved = ids.select(F.concat(F.col("kind"), F.lit(" id")).alias("check"), F.col("name").alias("subject"), usable.alias("ok"), F.coalesce(state, F.lit("unknown")).alias("detail"))
    return present.union(apart("identity", "recipes differ")).union(apart("activation_bits", "widths differ")).union(resolved)


def assert_preflight(checks: DataFrame) -> None:
    """Raises RecipeError with what is wrong; one row a check."""
    bad = checks.where(~F.col("ok")).orderBy("check", "subject").limit(20).collect()
    if bad:
        raise RecipeError("; ".join(f"{r.check} {r.subject}: {r.detail}" for r in bad))


def passed(df: DataFrame, checks: DataFrame) -> DataFrame:
    """``df`` as it is; the job that reads it raises if a check failed, so preflight and write are one job."""
    bad = checks.where(~F.col("ok")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "check", "subject"))), "; ").alias("_bad"))
    # one row
    return df.join(F.broadcast(checked(bad, {"preflight failed": F.col("_bad") == ""}, F.col("_bad")))).drop("_bad")
