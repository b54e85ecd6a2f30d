"""Token counts as delta-maintained rollups.

A store keeps two append-only logs, partitioned by batch: the counts that a batch set per document and tokenizer
version (within a batch by a hash bucket of doc_id, sorted), and the signed deltas that follow from them by source, language and version.
Totals are sums over committed batches' deltas. A commit looks up the counts that its keys had: it reads the buckets that the batch touches and,
for batches of few keys, only the pages that these keys lie in. A batch is committed by its marker, written last. Batches are numbered
upwards: one that is committed changes nothing when it is sent again, one below the newest that isn't is refused, and what a batch left
behind that broke off is removed by the next commit. So a batch is committed if and only if it isn't above the newest marker.

Nulls and odd input: null source and language are groups of their own; a null count is a delete; changes without a
version are refused; rows without doc_id are one document; of changes that repeat a document and version in one batch the largest count
stands; deleting what isn't there changes nothing; an empty batch commits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, batched, sized, stage, stage_path
from .tokenize import encoder

COUNTS = "doc_id long, version string, source string, lang string, n_tokens long, batch long, bucket int"
DELTAS = "source string, lang string, version string, docs long, tokens long, batch long"
MARKS = "batch long"
#: Stands for a null doc_id in a store's keys.
NO_ID = -(1 << 63)
LONG = 1000
#: Buckets of a store, and keys of a batch up to which the scan is told each of them.
BUCKETS, NAMED_KEYS = 64, 1_000
VERSIONS = {"word_bpe_49k": "word_bpe_49k.json", "byte_bpe_50k": "byte_bpe_50k.json"}


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def pieces(text: Column) -> Column:
    """Runs of anything but white space and ASCII signs, and each such sign."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]")).cast("long")


def tokenizer_counts(docs: DataFrame, versions: dict[str, str]) -> DataFrame:
    """doc_id, source, lang, version, n_tokens by public tokenizer files, each whole text read once. Written, as it is used in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {v: encoder(file) for v, file in versions.items()}
        for b in batches:
            texts = [x.as_py() or "" for x in b.column(3)]
            for v, enc in own.items():
                counts = pa.array([len(enc.encode(x)) for x in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([v] * len(texts), pa.string()), counts], ["doc_id", "source", "lang", "version", "n_tokens"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("text").cast("string"))
    with batched(docs.sparkSession):
        return stage(narrow.mapInArrow(run, "doc_id long, source string, lang string, version string, n_tokens long"), "tokenizer-counts")


def counted(docs: DataFrame, counters: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Counts of built-in counters, all versions from one pass over whole texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = F.array(*[F.struct(F.lit(v).alias("version"), f(text).alias("n_tokens")) for v, f in counters.items()])
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.inline(own))


class CountStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _files(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _read(self, name: str, schema: str) -> DataFrame:
        if not self._files().exists(self._path(name)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def newest(self) -> int | None:
        """The last committed batch."""
        return self._read("marks", MARKS).agg(F.max("batch")).first()[0]

    def _of_committed(self, name: str, schema: str) -> DataFrame:
        newest = self.newest()
        return self._read(name, schema).filter(F.lit(False) if newest is None else F.col("batch") <= newest)

    def _drop_above(self, newest: int | None) -> None:
        """Remove what batches above the newest marker have left: they broke off."""
        files = self._files()
        for name in ("counts", "deltas"):
            for status in files.listStatus(self._path(name)) if files.exists(self._path(name)) else []:
                folder = status.getPath().getName()
                if folder.startswith("batch=") and (newest is None or int(folder[6:]) > newest):
                    files.delete(status.getPath(), True)

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply ``changes`` (doc_id, version, source, lang, n_tokens; null n_tokens deletes) as batch number ``batch``.

        Returns whether anything was done."""
        newest = self.newest()
        if newest is not None and batch <= newest:
            if self._read("marks", MARKS).filter(F.col("batch") == batch).isEmpty():
                raise ValueError(f"batch {batch} comes after batch {newest} was committed")
            return False
        key = ["doc_id", "version"]
        doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")
        new = changes.select(doc, "version", F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_tokens").cast("long"))
        if not new.filter("version IS NULL").isEmpty():
            raise ValueError("a change needs a version")
        self._drop_above(newest)
        top = F.max(F.struct("n_tokens", "source", "lang")).alias("r")
        new = new.groupBy(*key).agg(top).select(*key, "r.source", "r.lang", "r.n_tokens", F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int").alias("bucket"))
        at = f"{self.path}/counts/batch={batch}"
        new.repartition("bucket").sortWithinPartitions("bucket", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(at)
        new = self.spark.read.schema(new.schema).parquet(at)
        old = self._last(self.touched(new)).join(sized(new.select(*key)), key, "left_semi")
        signed = new.filter("n_tokens IS NOT NULL").select("source", "lang", "version", F.lit(1).alias("sign"), "n_tokens").unionByName(old.select("source", "lang", "version", F.lit(-1).alias("sign"), "n_tokens"))
        delta = signed.groupBy("source", "lang", "version").agg(F.sum("sign").cast("long").alias("docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("long").alias("tokens"))
        delta.filter("docs != 0 OR tokens != 0").write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch}")
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/marks/batch={batch}")
        return True

    def touched(self, new: DataFrame) -> DataFrame:
        """Committed counts that a batch's keys may have: its buckets and versions, and of small batches the keys themselves, as scan filters."""
        rows = self._of_committed("counts", COUNTS)
        keys = [r.doc_id for r in new.select("doc_id").distinct().limit(NAMED_KEYS + 1).collect()]
        buckets = [r.bucket for r in new.select("bucket").distinct().collect()]
        versions = [r.version for r in new.select("version").distinct().limit(NAMED_KEYS).collect()]
        rows = rows.filter(F.col("bucket").isin(buckets)) if buckets else rows.filter("false")
        rows = rows.filter(F.col("version").isin(versions)) if 0 < len(versions) < NAMED_KEYS else rows
        return rows.filter(F.col("doc_id").isin(keys)) if 0 < len(keys) <= NAMED_KEYS else rows

    def _last(self, rows: DataFrame) -> DataFrame:
        last = F.max(F.struct("batch", "source", "lang", "n_tokens")).alias("r")
        rows = rows.groupBy("doc_id", "version").agg(last)
        return rows.filter("r.n_tokens IS NOT NULL").select("doc_id", "version", "r.source", "r.lang", "r.n_tokens")

    def current(self) -> DataFrame:
        """doc_id, version, source, lang, n_tokens as of the last committed batch: of each key's counts the latest, unless it is a delete."""
        return self._last(self._of_committed("counts", COUNTS))

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens: from deltas alone."""
        rows = self._of_committed("deltas", DELTAS).groupBy("source", "lang", "version").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return rows.filter("docs != 0 OR tokens != 0")


def replay(docs: DataFrame, labels: DataFrame, versions: dict[str, str] = VERSIONS) -> DataFrame:
    """The totals after a corpus's life: every document counted, a batch per tokenizer version; counts of LONG tokens and more in the first version
    revised by an end token; documents that labels reject deleted; and two batches sent again."""
    spark = docs.sparkSession
    store = CountStore(spark, stage_path(spark, "token-counts"))
    every = tokenizer_counts(docs, versions)
    for batch, version in enumerate(versions, 1):
        store.commit(batch, every.filter(F.col("version") == version))
    first, n = next(iter(versions)), len(versions)
    of_first = every.filter(F.col("version") == first)
    store.commit(n + 1, of_first.filter(F.col("n_tokens") >= LONG).withColumn("n_tokens", F.col("n_tokens") + 1))
    gone = labels.filter("quality = 0").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    deleted = every.join(gone, "doc_id", "left_semi").withColumn("n_tokens", F.lit(None).cast("long"))
    store.commit(n + 2, deleted)
    store.commit(n + 2, deleted)
    store.commit(1, of_first)
    return store.totals()
