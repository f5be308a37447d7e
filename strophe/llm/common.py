"""Helpers shared by the training-data operators: tables, text, stored tables, shared folder."""

from __future__ import annotations

import string
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Set while a stored table is written, so that its shuffle files go as soon as it is there.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named input table, cut to the columns an operator reads (further columns never clash)."""
    df = spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only in local mode, where one machine is all there is,
    an unset folder is replaced by one of our own; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/strophe-checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/strophe/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, path: str | None = None, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder (in folders by the values of ``by``) and read it back: lineage ends there, and
    lost executors cost nothing."""
    spark = df.sparkSession
    path = path or new_path(spark, label)
    with session_conf(spark, {_CLEANUP: "true"}):
        (df.write.partitionBy(by) if by else df.write).mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strophe_path = path  # for discard()
    for made in (_MADE, *_SCRATCH):
        made.append(path)
    return out


#: Stored tables of this process, and of each open ``scratch``.
_MADE: list[str] = []
_SCRATCH: list[list[str]] = []


def clear(spark: SparkSession) -> None:
    """Delete all stored tables of this process. Results that are read lazily need theirs, so call it when they are done."""
    for path in _MADE:
        delete(spark, path)
    _MADE.clear()


@contextmanager
def scratch(spark: SparkSession):
    """Delete what was stored inside, but for the paths taken out of the list it gives."""
    made: list[str] = []
    _SCRATCH.append(made)
    try:
        yield made
    finally:
        _SCRATCH[:] = [x for x in _SCRATCH if x is not made]
        for path in made:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*frames_or_paths) -> None:
    """Delete stored tables that nothing reads any more."""
    for x in frames_or_paths:
        path = x if isinstance(x, str) else getattr(x, "_strophe_path", None)
        spark = SparkSession.getActiveSession() if isinstance(x, str) else x.sparkSession
        if path and spark:
            delete(spark, path)
            if path in _MADE:
                _MADE.remove(path)


@contextmanager
def session_conf(spark: SparkSession, conf: dict[str, str]):
    """Set session options for a while."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


#: What operators keep between tasks of a Python worker, and how it is dropped.
WORKER_CACHES: dict[str, Callable[[], None]] = {}


def only(operator: str) -> None:
    """At the start of a Python task: workers are reused, so what other operators keep in this one goes."""
    import pyarrow as pa

    for name, drop in WORKER_CACHES.items():
        if name != operator:
            drop()
    pa.default_memory_pool().release_unused()


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; all-ASCII texts take the fast path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    )


def content_key(*cols: Column) -> Column:
    """128 bits of the values in these columns. Rows of different scans are joined by it, never by their place in a scan,
    which changes with the number of cores; rows that are equal in all these columns have one key."""
    return F.unhex(F.md5(F.concat_ws("\u0001", *[F.coalesce(c.cast("string"), F.lit("\u0002")) for c in cols])))


def plan_row() -> Column:
    """A number for each row of one scan, for one write or one branch of a plan: never joined with another scan's."""
    return F.monotonically_increasing_id()
