"""Exact deduplication by a stateful stream.

A structured stream over the documents' digests keeps, per digest, the stable identifier (the largest doc_id),
its content locator (file and row in it) and the count. The state lives in RocksDB on disk, checkpointed to the shared
folder, and never expires; ``Seen`` keeps it between arrivals. Arrived rows whose digest was hit, and what the state held of that digest
before, are checked on full bytes: their locators, as bitmaps of rows per file, are followed into the files that hold them, and no
others are read again. A digest that holds different texts is split by the texts themselves.

Equality: identical UTF-8 bytes after lower-casing A-Z. Nulls and odd input: a null text counts as empty; a null
doc_id is smaller than any other; rows that repeat a doc_id and text are members of one group, of which a single
row is kept; an empty table gives an empty result; an arrival that is sent again changes nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, as_row, ascii_lower, hub_join, sized, stage, stage_path

#: Arrival files in one micro-batch.
FILES_PER_BATCH = 512
#: Rows that a bitmap covers (what ``bitmap_construct_agg`` builds, 4 kB), and bitmaps that are broadcast at once.
MAP_ROWS, MAPS = 32_768, 8_192

ARRIVALS = "doc_id long, digest string, text_sha256 string, file string, row long, arrival int"
STATE = "digest string, keep struct<doc_id: bigint, file: string, row: bigint>, group_size bigint, batch bigint"

_STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _place(docs: DataFrame) -> list[Column]:
    """The content locator of a plain read of files, whatever its own columns are called."""
    at = docs.metadataColumn("_metadata")
    return [at["file_path"].alias("file"), at["row_index"].alias("row")]


def _located(docs: DataFrame) -> bool:
    try:
        docs.select(*_place(docs)).schema
    except AnalysisException:
        return False
    return True


def arrivals(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, digest, text_sha256 (null where it is the digest), file, row. One pass over whole texts; texts don't leave it.

    ``docs`` is a plain read of Parquet files."""
    norm = normalised(F.col("text"))
    sha = F.lit(None).cast("string") if digest is sha256 else sha256(norm)
    return docs.select(F.col("doc_id").cast("long"), digest(norm).alias("digest"), sha.alias("text_sha256"), *_place(docs))


def _bit(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (at % 8).cast("int")) == 1


def _slot(file: Column, of: int) -> Column:
    return F.pmod(F.xxhash64(file), F.lit(of))


def follow(content: DataFrame, hits: DataFrame, then: Callable[[DataFrame], DataFrame], most: int = MAPS) -> DataFrame:
    """``then`` of the rows (doc_id, norm, file, row) of ``content``, a plain read of files, at the locators ``hits`` (file, row).

    Locators become bitmaps per file; files without any aren't read, and of the others only rows that are located move. Beyond ``most`` bitmaps the files
    are taken in parts, each reading its own files alone; then ``then`` is applied to each part and the results, written, are put together."""
    part = F.floor(F.col("row") / MAP_ROWS)
    maps = stage(hits.groupBy("file", part.alias("part")).agg(F.bitmap_construct_agg(F.col("row") % MAP_ROWS).alias("bits")), "hit-rows")
    parts = max(1, math.ceil(maps.count() / most))
    out = []
    for i in range(parts):
        own = maps.filter(_slot(F.col("file"), parts) == i) if parts > 1 else maps
        files = bytes(own.agg(F.bitmap_construct_agg(_slot(F.col("file"), MAP_ROWS))).first()[0])
        file, row = _place(content)
        rows = content.filter(_bit(F.lit(files), _slot(file, MAP_ROWS))).select(F.col("doc_id").cast("long"), "text", file, row)
        rows = rows.withColumn("part", part).join(sized(own, 4 * most), ["file", "part"]).filter(_bit(F.col("bits"), F.col("row") % MAP_ROWS))
        got = then(rows.select("doc_id", normalised(F.col("text")).alias("norm"), "file", "row"))
        out.append(stage(got, "followed") if parts > 1 else got)
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def stream_state(arrived: str, schema, spark, checkpoint: str, out: str) -> None:
    """Run the stream over the files in ``arrived`` until it has seen them all.

    A later call with the same checkpoint goes on from the state that is there, and each micro-batch writes
    its changed keys under its own number, so that a repeated batch replaces itself."""
    before = {k: spark.conf.get(k, None) for k in _STREAM_CONF}
    for k, v in _STREAM_CONF.items():
        spark.conf.set(k, v)
    try:
        seen = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(arrived)
        held = seen.groupBy("digest").agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count("*").alias("group_size"))

        def write(changed: DataFrame, batch: int) -> None:
            changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

        held.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def current_state(spark, out: str, upto: int | None = None) -> DataFrame:
    """digest, keep, group_size as of the last micro-batch, or as of number ``upto``. One batch's keys are unique as they are."""
    rows = spark.read.option("basePath", out).schema(STATE).parquet(out)
    if upto is not None:
        rows = rows.filter(F.col("batch") <= upto)
    if rows.select("batch").distinct().count() > 1:
        rows = rows.groupBy("digest").agg(F.max(F.struct("batch", "keep", "group_size")).alias("s")).select("digest", "s.keep", "s.group_size")
    return rows.select("digest", "keep", "group_size")


def mixed_digests(content: DataFrame, new: DataFrame, before: DataFrame | None, state: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Digests under which different texts lie, by the full bytes of what arrived (``new``) under a digest that was hit and of what was held of it ``before``.

    Only these texts move, and of equal ones a task sends one, so a group costs no task more than a text from each other task."""
    groups = state.filter("group_size > 1").select("digest", F.col("group_size").alias("n"))
    shared, total = groups.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    rows = new.select("digest", "file", "row")
    hits = rows.join(F.broadcast(groups), "digest", "left_semi") if shared <= BROADCAST_IDS else hub_join(rows, groups, "digest", total)
    if before is not None:
        hits = stage(hits, "hits")
        hits = hits.unionByName(before.select("digest", "keep.file", "keep.row").join(sized(hits.select("digest").distinct()), "digest", "left_semi"))

    def texts(found: DataFrame) -> DataFrame:
        return found.select(digest(F.col("norm")).alias("digest"), "norm").distinct()

    found = follow(content, hits.select("file", "row"), texts)
    return found.distinct().groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest")


class Seen:
    """All that arrived under one path: arrivals, the stream's state and checkpoint, and the digests that hold different texts.

    An arrival is a number and a Parquet path, which must stay where it is: its texts are read again when later arrivals hit them.
    An arrival that broke off is finished by the next call, before or together with the one that is asked for."""

    def __init__(self, spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256):
        self.spark, self.path, self.digest = spark, path.rstrip("/"), digest

    def _there(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if self._there(name) else self.spark.createDataFrame([], schema)

    def _done(self) -> DataFrame:
        return self._read("done", "batch long, arrival int")

    def content(self) -> DataFrame:
        """doc_id and text of every arrival, a plain read of its files."""
        paths = [r.path for r in self._read("sources", "path string, arrival int").select("path").distinct().collect()]
        return self.spark.read.schema("doc_id long, text string").parquet(*paths)

    def arrive(self, number: int, path: str) -> bool:
        """Take in the documents at ``path`` as arrival ``number``; whether anything was done."""
        if not self._done().filter(F.col("arrival") == number).isEmpty():
            return False
        self.spark.createDataFrame([(path,)], "path string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/sources/arrival={number}")
        self._take(number, self.spark.read.schema("doc_id long, text string").parquet(path), self.content())
        return True

    def _take(self, number: int, docs: DataFrame, content: DataFrame) -> None:
        at = f"{self.path}/arrived/arrival={number}"
        if not self._there(f"arrived/arrival={number}/_SUCCESS"):
            arrivals(docs, self.digest).write.mode("overwrite").parquet(at)
        arrived = self._read("arrived", ARRIVALS)
        out = f"{self.path}/state"
        stream_state(f"{self.path}/arrived", arrived.schema, self.spark, f"{self.path}/checkpoint", out)
        if not self._there("state"):
            self.spark.createDataFrame([], STATE).drop("batch").coalesce(1).write.parquet(f"{out}/batch=0")
        done = self._done()
        upto = done.agg(F.max("batch")).first()[0]
        before = None if upto is None else current_state(self.spark, out, upto)
        new = arrived if upto is None else arrived.join(F.broadcast(done.select("arrival")), "arrival", "left_anti")
        mixed_digests(content, new, before, current_state(self.spark, out), self.digest).write.mode("overwrite").parquet(f"{self.path}/mixed/arrival={number}")
        newest = self.spark.read.option("basePath", out).schema(STATE).parquet(out).agg(F.coalesce(F.max("batch"), F.lit(0)).alias("batch")).first()[0]
        open_ones = [r.arrival for r in new.select("arrival").distinct().collect()]
        for n in sorted({*open_ones, number}):
            self.spark.range(1).select(F.lit(newest).cast("long").alias("batch")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/done/arrival={n}")

    def verdicts(self) -> DataFrame:
        """One row per row that arrived: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
        return self._verdicts(self.content)

    def _verdicts(self, content: Callable[[], DataFrame]) -> DataFrame:
        arrived, state = self._read("arrived", ARRIVALS), current_state(self.spark, f"{self.path}/state")
        mixed = stage(self._read("mixed", "digest string, arrival int").select("digest").distinct(), "mixed-digests")
        split = not mixed.isEmpty()
        pure, held = arrived, state
        if split:
            pure, held = (x.join(sized(mixed), "digest", "left_anti") for x in (arrived, state))
        rows = held.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
        sha = F.coalesce("text_sha256", "digest").alias("text_sha256")
        ledger = hub_join(pure, held.withColumn("n", F.col("group_size")), "digest", rows)
        kept = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
        ledger = ledger.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), sha)
        if not split:
            return ledger
        hits = arrived.join(sized(mixed), "digest", "left_semi").select("file", "row")
        texts = stage(follow(content(), hits, lambda found: found), "mixed-texts")
        by_text = texts.groupBy("norm").agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count("*").alias("group_size"))
        exact = texts.withColumnRenamed("norm", "own").join(by_text, F.col("own") == F.col("norm"))
        return ledger.unionByName(exact.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), sha256(F.col("norm")).alias("text_sha256")))


def dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, plain: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    ``plain`` says that ``docs`` is a plain read of Parquet files, whose rows have locators; other tables' ids and texts, and those that turn out to be without, are written first."""
    if not (plain and _located(docs)):
        docs = stage(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "content")
    seen = Seen(docs.sparkSession, stage_path(docs.sparkSession, "dedup-stream"), digest)
    seen._take(0, docs, docs)
    return seen._verdicts(lambda: docs)


def keep_last(docs: DataFrame, plain: bool = False) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows that share a doc_id and a text are the same row again: one of them, always the same, is taken where their group keeps that doc_id."""
    key = ["doc_id", "text_sha256"]
    ledger = dedup(docs, plain=plain).groupBy(*key).agg(F.count("*").alias("rows"), F.max("kept").alias("kept"))
    odd = stage(ledger.filter("NOT kept OR rows > 1").select(F.col("doc_id").alias("l_doc"), F.col("text_sha256").alias("l_sha"), "kept"), "odd-rows")
    own = docs.select(as_row(docs), F.col("doc_id").cast("long").alias("own_doc"), sha256(normalised(F.col("text"))).alias("own_sha"))
    on = F.col("own_doc").eqNullSafe(F.col("l_doc")) & (F.col("own_sha") == F.col("l_sha"))
    out = own.join(sized(odd.drop("kept")), on, "left_anti").select("row.*")
    repeated = odd.filter("kept").drop("kept")
    if repeated.isEmpty():
        return out
    one = own.join(sized(repeated), on).groupBy("l_doc", "l_sha").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return out.unionByName(one.select("row.*"))
