"""Record sources: JSON lines of several shapes, described by small specifications."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from ..session import materialize, small_side

SHAPES = ("object", "bare_string", "json_array", "instruction_pair")


@dataclass(frozen=True)
class SourceSpec:
    """Where a source's records are and how its text is found in them."""

    name: str
    files: tuple[str, ...] = field(default_factory=tuple)
    format: str = "jsonl"
    shape: str = "object"
    field_name: str = "text"
    index: int = 1
    provenance: str = "malay"
    licence: str = ""


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)  # noqa: SLF001


def physical_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file_ord, line, value) of every line of an ordered file list, blank ones too; ``line`` counts from 0 in each file.

    Files are read in splits by many tasks. A split's lines are numbered as it is read, counted, and
    moved up by the counts of the splits before it in its file, so nothing is sorted. Files that do
    not exist are left out.
    """
    frames = None
    for i, path in enumerate(files):
        if _exists(spark, path):
            rows = spark.read.text(path).select(
                F.lit(i).alias("file_ord"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"), "value"
            )
            frames = rows if frames is None else frames.union(rows)
    if frames is None:
        return spark.createDataFrame([], "file_ord int, line long, value string")
    lines = materialize(frames, "lines")
    splits = lines.groupBy("file_ord", "_f", "_b").agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    # a path may be a folder, whose files follow one another by name
    before = Window.partitionBy("file_ord").orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    shifts = splits.select("file_ord", "_f", "_b", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    # one row a split of the input
    return lines.join(small_side(shifts, row_bytes=512), ["file_ord", "_f", "_b"]).select("file_ord", (F.col("_m") + F.col("_shift")).alias("line"), "value")


def first_lines(lines: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` of ``lines`` (file_ord, line, ...) over all files, by position and without a sort."""
    sizes = lines.groupBy("file_ord").agg((F.max("line") + 1).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("file_ord").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file_ord", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # one row a file
    return lines.join(F.broadcast(starts), "file_ord").where(F.col("_start") + F.col("line") < limit).drop("_start")


def scan_lines(spark: SparkSession, files: list[str], limit: int | None = None) -> DataFrame:
    """(file_ord, line, value) of the non-blank lines of an ordered file list; ``line`` is the physical one, from 0.

    Files that don't exist are left out. ``limit`` counts records that decode, over all files.
    """
    out = physical_lines(spark, files).withColumn("value", F.trim("value")).where("value <> ''")
    if limit is None:
        return out
    # ranks come from counts, so the records are not sorted into one task
    decoded = ranked(out.where(F.expr("try_parse_json(value) is not null")), [], ["file_ord", "line"], "_nth")
    return decoded.where(F.col("_nth") < limit).drop("_nth")


def parse_lines(lines: DataFrame) -> DataFrame:
    """``lines`` with ``record`` as VARIANT; lines that don't decode go."""
    return lines.withColumn("record", F.expr("try_parse_json(value)")).where(F.col("record").isNotNull())


def extract_text(records: DataFrame, field: str = "text", index: int = 1) -> DataFrame:
    """``records`` (shape, record) with ``text``: null where the shape holds no string.

    A bare string is taken in an object source too.
    """
    kind = F.expr("schema_of_variant(record)")
    bare = F.when(kind == "STRING", F.expr("try_variant_get(record, '$', 'string')"))
    item = F.when(F.expr(f"schema_of_variant(try_variant_get(record, '$[{index}]', 'variant')) = 'STRING'"), F.expr(f"try_variant_get(record, '$[{index}]', 'string')"))
    value = F.when(F.expr(f"schema_of_variant(try_variant_get(record, '$.{field}', 'variant')) = 'STRING'"), F.expr(f"try_variant_get(record, '$.{field}', 'string')"))
    text = F.when(F.col("shape") == "bare_string", bare).when(F.col("shape") == "json_array", item).otherwise(F.coalesce(bare, value))
    return records.withColumn("text", text)


def stream_source(spark: SparkSession, spec: SourceSpec, limit: int | None = None) -> DataFrame:
    """(source, provenance, text) of one source, by its format."""
    if spec.format in ("jsonl", "text"):
        records = parse_lines(scan_lines(spark, list(spec.files), limit))
        out = extract_text(records.withColumn("shape", F.lit(spec.shape)), spec.field_name, spec.index)
    else:
        out = spark.read.format(spec.format).load(list(spec.files)).withColumn("text", F.col(spec.field_name).cast("string"))
        out = out.limit(limit) if limit is not None else out
    return out.select(F.lit(spec.name).alias("source"), F.lit(spec.provenance).alias("provenance"), "text")


def extract_pair(records: DataFrame) -> DataFrame:
    """``records`` (record VARIANT) with malay and english: instruction form, known field pairs, then a nested translation."""
    from ..functions.text import instruction_pair

    get = lambda path: F.when(
        F.expr(f"schema_of_variant(try_variant_get(record, '{path}', 'variant')) = 'STRING'"), F.expr(f"try_variant_get(record, '{path}', 'string')")
    )
    told = instruction_pair(get("$.input"), get("$.output"))
    forms = [(told["malay"], told["english"])]
    # Field names of the known conventions, in the order they are tried.
    for a, b in (("ms", "en"), ("malay", "english"), ("src", "tgt"), ("translation_ms", "translation_en"), ("translation.ms", "translation.en")):
        forms.append((get(f"$.{a}"), get(f"$.{b}")))
    pair = F.coalesce(*[F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("malay"), b.alias("english"))) for a, b in forms])
    return records.withColumn("_p", pair).withColumns({"malay": F.col("_p.malay"), "english": F.col("_p.english")}).drop("_p")


def count_lines(spark: SparkSession, path: str) -> int:
    """Non-blank lines of a file, 0 if it doesn't exist; nothing is parsed or numbered."""
    if not _exists(spark, path):
        return 0
    return spark.read.text(path).where(F.trim("value") != "").count()


def read_jsonl(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """Typed records of a JSON-lines file; ``limit`` counts its physical lines, blank and bad ones included.

    Blank lines give no record; a line that does not decode gives nulls, as Spark's reader does.
    """
    if limit is None:
        return spark.read.schema(schema).json(path)
    lines = first_lines(physical_lines(spark, [path]), limit).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")
