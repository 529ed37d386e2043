"""Recipe and run bookkeeping: identities, glob matching, audits, staleness, keyed upserts."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicons import ROUTER_PATTERNS


class RecipeError(ValueError):
    """A recipe that does not do what it says."""


def identity_hash(recipe: dict) -> str:
    """16 hex digits of what a recipe does; calibration, name and description don't count."""
    kept = {k: v for k, v in recipe.items() if k not in ("calibration", "name", "description")}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:16]


def fingerprint(config: dict) -> str:
    """16 hex digits of a configuration, whether it is a dry run or profiled apart."""
    kept = {k: v for k, v in config.items() if k not in ("dry_run", "profiling")}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, default=str).encode()).hexdigest()[:16]


def assert_same_identity(recipes: list[dict]) -> str:
    found = {identity_hash(r) for r in recipes}
    if len(found) != 1:
        raise RecipeError(f"recipes differ beyond their calibration: {sorted(found)}")
    return found.pop()


def materialise(recipe: dict, **calibration) -> dict:
    """``recipe`` for one run; only its calibration may differ."""
    out = {**recipe, "calibration": {**recipe.get("calibration", {}), **calibration}}
    assert_same_identity([recipe, out])
    return out


def quantizer_glob(pattern: str, kind: str) -> str:
    """A glob that a module pattern's quantizers of one kind match in either layout."""
    return pattern.replace(".*.", "*").replace("*.", "*").rstrip("*.") + f"*{kind}*"


def glob_regex(pattern: str) -> str:
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def module_matches(name: Column, pattern: str) -> Column:
    """The glob, the glob continued, or the bare end of the name."""
    bare = pattern.rstrip("*")
    return name.rlike(glob_regex(pattern)) | name.rlike(glob_regex(bare + "*")) | F.endswith(name, F.lit(bare.rstrip(".")))


def quantizer_rules(stock: list[dict], layers: list[dict], exclude: list[str], group_size: int | None = None) -> list[dict]:
    """The ordered rules of a recipe: the stock rules, what its layers enable, and last what it excludes.

    A rule has quantizer_name (a glob) with cfg or enable. Layers in the 4-bit format borrow the
    numeric settings of the stock's first rule for that kind of quantizer, so that only the modules
    differ; inputs are quantized where the layer asks for 4-bit activations. ``group_size``
    replaces other block sizes along the last axis. A mapping of globs to settings is a list in its
    order. Raises if ``stock`` is neither, as the exclusions could then not come last.
    """
    if isinstance(stock, dict):
        stock = [{"quantizer_name": k, **v} for k, v in stock.items()]
    if not isinstance(stock, list) or not all(isinstance(r, dict) for r in stock):
        raise RecipeError(f"rules of type {type(stock).__name__} cannot carry the recipe's exclusions")

    def numbers(kind: str) -> dict | None:
        return next((r["cfg"] for r in stock if kind in str(r.get("quantizer_name", "")) and "num_bits" in (r.get("cfg") or {})), None)

    def sized(rule: dict) -> dict:
        blocks = (rule.get("cfg") or {}).get("block_sizes")
        if not group_size or not isinstance(blocks, dict) or blocks.get(-1, group_size) == group_size:
            return rule
        return {**rule, "cfg": {**rule["cfg"], "block_sizes": {**blocks, -1: group_size}}}

    enabled = []
    for layer in layers:
        kinds = ["weight_quantizer"] + (["input_quantizer"] if int(layer.get("activation_bits", 16)) == 4 else [])
        if str(layer.get("format", "")).lower() == "nvfp4" and numbers("weight_quantizer"):
            enabled += [{"quantizer_name": quantizer_glob(str(layer["pattern"]), k), "cfg": numbers(k)} for k in kinds if numbers(k)]
    excluded = [{"quantizer_name": p if p.endswith("*") else f"{p}*", "enable": False} for p in exclude]
    return [sized(r) for r in [*stock, *enabled]] + excluded


#: Length of the pieces of names and globs that are looked up.
GRAM = 4


def _grams(text: Column) -> Column:
    last = F.length(text) - GRAM
    return F.when(last >= 0, F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(text, i + 1, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def resolved_rules(modules: DataFrame, rules: list[dict], name: str = "name") -> DataFrame:
    """``modules`` with rule (its place in ``rules``, from 0), pattern, enabled and cfg (JSON) of the last rule whose glob matches, else nulls.

    A rule is looked up by one piece of its glob, the one that fewest names hold, and only the names
    with that piece are matched against it; rules without a piece of literal text meet every name.
    So the work follows the matches and not names times rules.
    """
    spark = modules.sparkSession
    listed = [(i, r["quantizer_name"], glob_regex(r["quantizer_name"]), bool(r.get("enable", True)), json.dumps(r.get("cfg"), sort_keys=True) if r.get("cfg") is not None else None) for i, r in enumerate(rules)]
    # the rules are a recipe's own list
    table = F.broadcast(spark.createDataFrame(listed, "rule int, pattern string, regex string, enabled boolean, cfg string"))
    pieces = [(i, run[k : k + GRAM]) for i, p, *_ in listed for run in re.split(r"[*?]", p) for k in range(len(run) - GRAM + 1)]
    bare = [(i,) for i, *_ in listed if i not in {j for j, _ in pieces}]
    grams = F.broadcast(spark.createDataFrame(pieces, "rule int, gram string").distinct())
    names = modules.select(F.col(name).alias("_n")).where("_n is not null").distinct()
    held = names.select("_n", F.explode(_grams(F.col("_n"))).alias("gram"))
    counts = held.join(grams.select("gram").distinct(), "gram").groupBy("gram").agg(F.count("*").alias("names"))
    # one piece a rule; a piece that no name holds says that nothing matches
    anchors = grams.join(counts, "gram", "left").groupBy("rule").agg(F.min_by("gram", F.struct(F.coalesce("names", F.lit(0)), F.col("gram"))).alias("gram"))
    met = held.join(F.broadcast(anchors), "gram").select("_n", "rule")
    if bare:
        met = met.union(names.join(F.broadcast(spark.createDataFrame(bare, "rule int"))))
    hits = met.join(table, "rule").where(F.expr("_n rlike regex"))
    last = hits.groupBy("_n").agg(F.max_by(F.struct("rule", "pattern", "enabled", "cfg"), "rule").alias("_r"))
    found = modules.join(last, F.col(name) == F.col("_n"), "left")
    return found.select(*modules.columns, F.col("_r.rule").alias("rule"), F.col("_r.pattern").alias("pattern"), F.col("_r.enabled").alias("enabled"), F.col("_r.cfg").alias("cfg"))


def is_router(name: Column) -> Column:
    return name.rlike("|".join(ROUTER_PATTERNS))


def is_routed_expert(name: Column) -> Column:
    low = F.lower(name)
    return F.contains(low, F.lit("expert")) & ~F.contains(low, F.lit("shared"))


def layer_index(name: Column) -> Column:
    numbers = F.filter(F.split(name, r"\."), lambda p: p.rlike("^[0-9]+$"))
    return F.coalesce(F.try_element_at(numbers, F.lit(-1)).cast("int"), F.lit(-1))


def first_valid(values: list[Column], least: int, default: int | None = None) -> Column:
    """The first of ``values`` that is at least ``least``."""
    return F.coalesce(*[F.when(v >= least, v) for v in values], F.lit(default))


def context_length(requested: Column, capacity: Column) -> Column:
    return F.least(requested, F.coalesce(F.when(capacity > 0, capacity), requested))


def exact_width(modules: DataFrame, width: str, experts: int, low: int = 2, high: int = 1024) -> DataFrame:
    """Modules of a plausible width; only those of exactly ``experts`` if there are any."""
    plausible = modules.where(F.col(width).between(low, high))
    any_exact = F.max((F.col(width) == experts).cast("int")).over(Window.partitionBy(F.lit(0)))
    return plausible.withColumn("_any", any_exact).where((F.col("_any") == 0) | (F.col(width) == experts)).drop("_any")


def pattern_audit(modules: DataFrame, patterns: list[str], name: str = "name", quantized: str = "quantized") -> DataFrame:
    """(pattern, n_matched, n_violations, router): what every excluded pattern matches, and what of it is quantized.

    The patterns are a recipe's own short list, so they are columns of one scan.
    """
    col = F.col(name)
    aggs = []
    for i, p in enumerate(patterns):
        aggs += [F.count_if(module_matches(col, p)).alias(f"m{i}"), F.count_if(module_matches(col, p) & F.col(quantized)).alias(f"v{i}")]
    row = modules.agg(*aggs)
    parts = [F.struct(F.lit(p).alias("pattern"), F.col(f"m{i}").alias("n_matched"), F.col(f"v{i}").alias("n_violations"), F.lit(any(w in p for w in ("gate", "router"))).alias("router")) for i, p in enumerate(patterns)]
    return row.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def assert_exclusions(audit: DataFrame, strict: bool = True) -> None:
    for r in audit.collect():  # one row a pattern
        if r.n_violations:
            raise RecipeError(f"{r.n_violations} modules excluded by {r.pattern} are quantized")
        if strict and r.router and not r.n_matched:
            raise RecipeError(f"router pattern {r.pattern} matches nothing")


def module_census(modules: DataFrame, by: list[str]) -> DataFrame:
    """Expert carriers and those quantized, enabled quantizers, and modules that fell back."""
    carrier = is_routed_expert(F.col("name")) & (F.col("n_params") > 0)
    enabled = F.exists("quantizers", lambda q: q["enabled"])
    fallback = F.when(~enabled, F.concat(F.col("name"), F.lit(":disabled"))).when(F.exists("quantizers", lambda q: q["enabled"] & ~q["has_amax"]), F.concat(F.col("name"), F.lit(":no_amax")))
    return modules.groupBy(*by).agg(
        F.count_if(enabled).alias("n_quantized_modules"),
        F.count_if(carrier).alias("expert_carriers"),
        F.count_if(carrier & enabled).alias("experts_quantized"),
        F.count(fallback).alias("n_fallback_layers"),
    )


def staleness(runs: DataFrame, recipe_hash: str) -> DataFrame:
    reason = (
        F.when(F.col("checkpoint_path").isNull(), "no_record")
        .when(F.col("error").isNotNull(), "error")
        .when(F.col("recipe_hash") != recipe_hash, "other_recipe")
        .when(F.coalesce("experts_quantized", F.lit(0)) == 0, "no_experts_quantized")
    )
    return runs.withColumn("stale_reason", reason)


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of every key."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Both tables by column name; of one key the latest row wins."""
    return keep_last(old.unionByName(new, allowMissingColumns=True), keys, order)


def run_matrix(families: DataFrame, variants: DataFrame, counts: DataFrame, done: DataFrame) -> DataFrame:
    """Every family, variant and sample count that has no finished run. The three lists are configuration."""
    cells = families.join(F.broadcast(variants)).join(F.broadcast(counts))
    return cells.join(done, ["family", "variant", "sample_count"], "left_anti")


def variant_of(label: Column, variants: list[str]) -> Column:
    """The first variant whose name stands in a label between underscores."""
    framed = F.concat(F.lit("_"), label, F.lit("_"))
    return F.coalesce(*[F.when(F.contains(framed, F.lit(f"_{v}_")), F.lit(v)) for v in variants])
