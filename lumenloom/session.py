"""Session builder and small table helpers shared by every module."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "lumenloom", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the queries are tuned for.

    On a cluster the caller's own session is used instead; nothing here is required for
    correct results except a UTC session time zone.
    """
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Folders that ``materialize`` wrote and nothing has released yet.
_written: set[str] = set()
#: Folders named within the innermost ``passing`` block of this thread.
_block: ContextVar[list[str] | None] = ContextVar("lumenloom_block", default=None)
#: Spark's setting by which a query's shuffle files go when it ends, not when the driver next collects garbage.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``; a temporary one where that is unset in local mode.

    A cluster without the setting uses the warehouse, which its executors share as well.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        at = "file://" + tempfile.mkdtemp(prefix="lumenloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return (at or spark.conf.get("spark.sql.warehouse.dir") + "/lumenloom-shared").rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, deleted by ``release_all``."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _written.add(path)
    if _block.get() is not None:
        _block.get().append(path)
    return path


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries run within leave no shuffle files behind."""
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)


@contextmanager
def passing(spark: SparkSession) -> Iterator:
    """Deletes at its end what was written within, all but the tables handed to the function it gives."""
    outer, mine, kept = _block.get(), [], set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._lumenloom_path)  # noqa: SLF001
        return df

    token = _block.set(mine)
    try:
        yield keep
    finally:
        _block.reset(token)
        for path in mine:
            if path not in kept:
                _delete(spark, path)
            elif outer is not None:
                outer.append(path)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, which cuts its lineage.

    The files outlive lost executors. ``release`` deletes them once nothing reads them, ``passing``
    those of a block, ``release_all`` what is left when a session is done.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lumenloom_path = path  # noqa: SLF001
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)  # noqa: SLF001
    _written.discard(path)


def release(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for this very DataFrame object."""
    path = getattr(df, "_lumenloom_path", None)
    if path:
        _delete(df.sparkSession, path)


def release_all(spark: SparkSession) -> None:
    """Delete everything this process wrote to the shared folder; results that still read it end."""
    for path in list(_written):
        _delete(spark, path)


def small_side(df: DataFrame, rows: int = 100_000, row_bytes: int = 256) -> DataFrame:
    """``df`` marked for broadcast if a count shows at most ``rows`` rows of about ``row_bytes``, else as it is.

    For rows of bounded width only; wider ones take a lower bound, so that about 25 MB are sent at most.
    """
    return F.broadcast(df) if df.count() <= rows * 256 // max(row_bytes, 256) else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, so rounds do not grow a plan and lost executors lose nothing."""
    return materialize(df, "cut")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
