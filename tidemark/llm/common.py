"""Shared helpers of the corpus operators: staged tables, batch limits, text conventions."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; ``bytes.split()`` cuts the same words.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_records: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session leaves it unset (tests, local mode) a fresh local folder is used."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.conf.get("spark.tidemark.dir", None)
        if not at:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
            spark.conf.set("spark.tidemark.dir", at)
    return at.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    at = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex[:12]}"
    for paths in _records:
        paths.append(at)
    return at


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut and lost executors lose nothing."""
    at = stage_path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables and forget them; for when the results built on them are written."""
    hadoop = spark._jsc.hadoopConfiguration()
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(hadoop).delete(path, True)


@contextmanager
def recorded(paths: list[str]):
    """Within the block, tables that are staged are also noted in ``paths``."""
    _records.append(paths)
    try:
        yield
    finally:
        _records.remove(paths)


_ARROW_ROWS, _ARROW_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound what one Arrow batch holds, as single texts may be megabytes long.

    For plans that are handed out unwritten, as the bound is read when they run; it stays for the session."""
    spark.conf.set(_ARROW_ROWS, str(rows))
    spark.conf.set(_ARROW_BYTES, str(16 << 20))


@contextmanager
def batched(spark: SparkSession, rows: int = 256):
    """The same bound for what is written within the block; the session's own settings come back after it."""
    before = {k: spark.conf.get(k, None) for k in (_ARROW_ROWS, _ARROW_BYTES)}
    small_batches(spark, rows)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Id sets up to this size are broadcast; larger ones are joined by key.
BROADCAST_IDS = 500_000


def sized(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """``ids`` with a broadcast hint where it has ``most`` rows at most; a plain shuffled join is left beyond."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


#: At most so many keys are treated as hubs: each holds more than this share of all rows.
HUBS, HUB_ROWS = 10_000, 64


def hub_join(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of ``rows`` (``total`` of them) with ``table``, where ``key`` is unique and column ``n`` counts the rows under it.

    Keys with more than ``total`` / HUBS rows, so HUBS keys at most, are broadcast; the others are joined by key.
    No task takes all rows of a hub."""
    many = F.col("n") > max(HUB_ROWS, total // HUBS)
    hubs = stage(table.filter(many).drop("n"), "hub-keys")
    if hubs.isEmpty():
        return rows.join(table.drop("n"), key)
    rest = rows.join(F.broadcast(hubs.select(key)), key, "left_anti").join(table.filter(~many).drop("n"), key)
    return rows.join(F.broadcast(hubs), key).unionByName(rest)


def as_row(docs: DataFrame) -> Column:
    """All of a table's columns as one, so that no other name can clash with theirs."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def numbered(docs: DataFrame) -> DataFrame:
    """number, row: every row of ``docs`` as a struct under a key of its own, written once, so that later passes agree on it."""
    return stage(docs.select(F.monotonically_increasing_id().alias("number"), as_row(docs)), "numbered")


def without_rows(own: DataFrame, drop: DataFrame) -> DataFrame:
    """The rows of ``own`` (see ``numbered``) whose number isn't in ``drop`` (column number, distinct, written before)."""
    gone = sized(drop.select(F.col("number").alias("drop_number")))
    return own.join(gone, F.col("number") == F.col("drop_number"), "left_anti").select("row.*")
