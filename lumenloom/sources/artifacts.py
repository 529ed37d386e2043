"""Artifacts: provenance stamps, fingerprints, optional bundles, sidecars, metrics, reports."""

from __future__ import annotations

import json
import os
import subprocess
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

STAMP = ("_config_fingerprint", "_phase", "_git_sha", "_written_at")


def git_sha(default: str = "unknown") -> str:
    """The short commit, with ``-dirty`` behind it where files have changed."""
    try:
        run = lambda *a: subprocess.run(["git", *a], capture_output=True, text=True, check=True, timeout=10).stdout.strip()
        return run("rev-parse", "--short", "HEAD") + ("-dirty" if run("status", "--porcelain") else "")
    except (OSError, subprocess.SubprocessError):
        return default


def stamp(df: DataFrame, fingerprint: str, phase: str) -> DataFrame:
    now = datetime.now(timezone.utc).isoformat()
    return df.withColumns(dict(zip(STAMP, map(F.lit, (fingerprint, phase, git_sha(), now)), strict=True)))


#: The file that names an artifact's current version.
POINTER = "_current"


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001


def _exists(spark: SparkSession, path: str) -> bool:
    at, fs = _path(spark, path)
    return fs.exists(at)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, put in place by one rename that replaces an older one."""
    part, fs = _path(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()  # noqa: SLF001
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)  # noqa: SLF001
    how[0] = kind.OVERWRITE
    to, _ = _path(spark, path)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(part), fs.makeQualified(to), how)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, None where there is none."""
    at, fs = _path(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)  # Spark's readers skip names that begin with an underscore
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")  # noqa: SLF001
    finally:
        stream.close()


def current(spark: SparkSession, path: str) -> str | None:
    """Where an artifact's current version lies; ``path`` itself if it was written without versions, None if it is not there."""
    named = read_text(spark, f"{path}/{POINTER}")
    if named:
        return f"{path}/{named.strip()}"
    return path if _exists(spark, path) and not _versions(spark, path) else None


def _versions(spark: SparkSession, path: str) -> list[str]:
    at, fs = _path(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(at) if x.getPath().getName().startswith("v-")] if fs.exists(at) else []


@contextmanager
def new_version(spark: SparkSession, path: str, overwrite: bool = True, keep: int = 1) -> Iterator[str]:
    """Where to write an artifact's next version, which readers see only once all of it is there.

    At the end the pointer file is replaced by one rename, so a reader finds the old version or the
    new one, whole. After a failure the new version is deleted and the old one stays current. The
    ``keep`` versions before are left for readers that have begun; older ones are deleted.
    """
    before = read_text(spark, f"{path}/{POINTER}")
    if not overwrite and current(spark, path):
        raise FileExistsError(f"{path} is already there")
    name = f"v-{datetime.now(timezone.utc):%Y%m%d%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    try:
        yield f"{path}/{name}"
        write_text(spark, f"{path}/{POINTER}", name)
    except BaseException:
        at, fs = _path(spark, f"{path}/{name}")
        fs.delete(at, True)
        raise
    held = {name, *([before.strip()] if before and keep else []), *sorted(_versions(spark, path))[-keep - 1 :]}
    for old in set(_versions(spark, path)) - held:
        at, fs = _path(spark, f"{path}/{old}")
        fs.delete(at, True)


def write_artifact(df: DataFrame, path: str, fingerprint: str, phase: str, overwrite: bool = True, partition_by: list[str] | None = None) -> None:
    """``df`` with its stamp as the artifact's next version; zstd Parquet. A failed write leaves the old version current."""
    with new_version(df.sparkSession, path, overwrite) as at:
        out = stamp(df, fingerprint, phase).write.option("compression", "zstd")
        (out.partitionBy(*partition_by) if partition_by else out).parquet(at)


def write_fanout(df: DataFrame, path: str, keys: list[str], fingerprint: str, phase: str, files_per_key: int = 4) -> None:
    """One folder for each value of ``keys``; folders of keys that ``df`` does not hold are left as they are.

    Rows are brought together by key first, in at most ``files_per_key`` parts each, so there are
    no more files than that a key, and a key of very many rows takes that many tasks.
    """
    part = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_key))
    dealt = df.withColumn("_part", part).repartition(*keys, "_part").sortWithinPartitions(*keys).drop("_part")
    # stamped last, so that no task shuffles and sorts the same four texts with every row
    stamp(dealt, fingerprint, phase).write.option("compression", "zstd").option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*keys).parquet(path)


def read_artifact(spark: SparkSession, path: str) -> DataFrame:
    at = current(spark, path)
    if at is None:
        raise FileNotFoundError(f"{path} is missing: run the phase that writes it")
    return spark.read.parquet(at)


def fingerprint_of(spark: SparkSession, path: str) -> str | None:
    """The stored fingerprint, None where there is no artifact or no row; one column is read."""
    at = current(spark, path)
    if at is None:
        return None
    row = spark.read.parquet(at).select(STAMP[0]).limit(1).first()
    return row[0] if row else None


def is_complete(spark: SparkSession, path: str, fingerprint: str) -> bool:
    return fingerprint_of(spark, path) == fingerprint


def bundle(spark: SparkSession, paths: dict[str, str]) -> tuple[dict[str, DataFrame], list[str]]:
    """The artifacts that are there, and the names of those missing."""
    places = {k: current(spark, p) for k, p in paths.items()}
    found = {k: spark.read.parquet(at) for k, at in places.items() if at}
    return found, [k for k in paths if k not in found]


def union_files(spark: SparkSession, glob: str) -> DataFrame:
    """The artifacts and Parquet files that a glob names, by column name."""
    at, fs = _path(spark, glob)
    found = sorted(x.getPath().toString() for x in fs.globStatus(at) or [])
    places = [p for p in (current(spark, f) for f in found) if p]
    if not places:
        raise FileNotFoundError(f"nothing matches {glob}")
    return spark.read.option("mergeSchema", True).parquet(*places)


def write_json(payload, path: str) -> None:
    """A sidecar, replaced in one step."""
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(payload, f, indent=2, default=str, ensure_ascii=False)
    os.replace(part, path)


def read_json(path: str):
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


#: Names of the load-test metrics and the endings they go by.
METRIC_ALIASES = {
    "output_token_throughput": ("output_token_throughput", "output_token_throughput_avg"),
    "request_throughput": ("request_throughput", "request_throughput_avg"),
    "time_to_first_token_avg": ("time_to_first_token_avg", "time_to_first_token_mean"),
    "time_to_first_token_p99": ("time_to_first_token_p99",),
    "inter_token_latency_avg": ("inter_token_latency_avg", "inter_token_latency_mean"),
}


def csv_metrics(df: DataFrame, name: str = "Metric") -> DataFrame:
    """(metric, value) of a wide table: ``slug_stat`` names, thousands separators removed, other values left out."""
    stats = [c for c in df.columns if c != name]
    long = df.unpivot(name, [F.col(c).cast("string").alias(c) for c in stats], "stat", "raw")
    value = F.expr("try_cast(replace(raw, ',', '') as double)")
    return long.select(F.concat_ws("_", tx.slug(F.col(name)), tx.slug(F.col("stat"))).alias("metric"), value.alias("value")).where("value is not null")


def canonical_metric(metric) -> F.Column:
    """The canonical name a metric's ending stands for, null for others."""
    return F.coalesce(*[F.when(F.greatest(*[F.endswith(metric, F.lit(e)) for e in ends]) if len(ends) > 1 else F.endswith(metric, F.lit(ends[0])), F.lit(c)) for c, ends in METRIC_ALIASES.items()])


def flatten_json(df: DataFrame, column: str, keys: list[str], depth: int = 3) -> DataFrame:
    """(keys..., metric, value): numbers of nested JSON objects, names joined by underscores, no booleans."""
    rows = df.select(*keys, F.lit("").alias("path"), F.expr(f"try_parse_json({column})").alias("v"))
    out = None
    for _ in range(depth):
        rows.createOrReplaceTempView("_flat")
        step = df.sparkSession.sql(
            f"SELECT {', '.join(keys)}, concat(if(path = '', '', concat(path, '_')), e.key) AS path, e.value AS v FROM _flat, LATERAL variant_explode_outer(v) e WHERE e.key IS NOT NULL"
        )
        kind = F.expr("schema_of_variant(v)")
        leaf = step.where(~kind.startswith("OBJECT") & (kind != "BOOLEAN")).select(*keys, F.col("path").alias("metric"), F.expr("try_variant_get(v, '$', 'double')").alias("value"))
        out = leaf if out is None else out.union(leaf)
        rows = step.where(kind.startswith("OBJECT"))
    return out.where("value is not null")


def discover_metrics(spark: SparkSession, folder: str) -> DataFrame | None:
    """(metric, value) of the first load-test export that names a throughput: JSON, JSON lines, then CSV; raw logs are skipped."""
    for kind, pattern in (("json", "*.json"), ("jsonl", "*.jsonl"), ("csv", "*.csv")):
        reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
        if kind == "csv":
            rows = reader.option("header", True).csv(folder) if _any_file(spark, folder, ".csv") else None
            found = csv_metrics(rows, rows.columns[0]) if rows is not None else None
        else:
            if not _any_file(spark, folder, f".{kind}"):
                continue
            text = reader.option("wholetext", kind == "json").text(folder).withColumn("f", F.col("_metadata.file_path")).where(~F.endswith("f", F.lit("_raw.jsonl")))
            found = flatten_json(text.dropDuplicates(["f"]), "value", ["f"]).select("metric", "value")
        if found is not None and not found.where(F.contains("metric", F.lit("throughput"))).isEmpty():
            return found
    return None


def _any_file(spark: SparkSession, folder: str, ending: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)  # noqa: SLF001
    files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)  # noqa: SLF001
    while files.hasNext():
        if files.next().getPath().getName().endswith(ending):
            return True
    return False


def newest_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, modified, size) of a folder's files at any depth, newest first, by name where equally new; contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return listed.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size")).orderBy(F.desc("modified"), "path")


def track(df: DataFrame, path: str, run: str) -> bool:
    """Append finite (metric, value) rows of a run to a table; a tracker that fails does not fail the run."""
    try:
        finite_metrics(df).withColumn("run", F.lit(run)).write.mode("append").parquet(path)
    except Exception:  # noqa: BLE001
        return False
    return True


def finite_metrics(df: DataFrame) -> DataFrame:
    return df.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))


def markdown_table(df: DataFrame, most: int = 40, note: str = "") -> str:
    """The first ``most`` rows without ``_`` columns, numbers to four places, and a note of how many there are."""
    shown = [c for c in df.columns if not c.startswith("_")]
    kinds = dict(df.dtypes)
    cells = [tx.format_scalar(F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.coalesce(F.col(c).cast("string"), F.lit("n/a")).alias(c) for c in shown]
    rows = df.select(*cells).limit(most).collect()
    lines = ["| " + " | ".join(shown) + " |", "|" + " --- |" * len(shown)]
    lines += ["| " + " | ".join(r) + " |" for r in rows]
    total = df.count()
    if total > most:
        lines.append(f"\nFirst {most} of {total} rows.")
    return "\n".join(lines) + (f"\n\n{note}" if note else "")


def report(title: str, sections: dict[str, DataFrame | None]) -> str:
    """A Markdown report; sections without data are listed at the end."""
    parts = [f"# {title}"] + [f"## {k}\n\n{markdown_table(v)}" for k, v in sections.items() if v is not None]
    missing = [k for k, v in sections.items() if v is None]
    return "\n\n".join(parts + (["## Missing\n\n" + "\n".join(f"- {k}" for k in missing)] if missing else [])) + "\n"
