"""Token ids in binary shards under minimal perfect hash indexes.

A store is a folder of shards: raw little-endian ids in ascending document order, and per shard an index that maps
document keys to payload offsets. The index is a minimal perfect hash (levels of bit arrays; a key's slot is the rank of
its bit), with a stored fingerprint per slot that turns away keys that the shard doesn't hold. Shards lie as rows
of a Parquet folder, the one binary container that Spark writes to any store; payloads stay raw bytes.

Nulls and odd input: a null text counts as empty and gives the end id alone; null doc_ids come first in order; rows that
repeat a doc_id are stored each, in the order of their texts' hashes, told apart by their occurrence in a shard; an empty table gives an
empty store.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batched, stage
from .tokenize import encoder

#: Ids after which a shard is closed.
SHARD_IDS = 1 << 18
#: Keys that are looked up in a shard at once; more of them meet further copies of it.
KEYS_PER_LOOK = 1 << 16
#: Shards that a lookup names to the scan, which then reads no others; more are joined.
NAMED_SHARDS = 1_000
SHARDS_PER_BATCH = 8
LEVELS = 40
SHARD = "part int, seq int, before long, n_docs long, n_ids long, width int, first_key long, last_key long, nulls long, keys binary, nth binary, levels binary, bits binary, marks binary, rows binary, offsets binary, payload binary"


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (the finaliser of a splitmix generator)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_hash(key: np.ndarray, nth: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Distinct for distinct doc_ids; later occurrences and null keys are mixed once more."""
    h = mix64(key.astype(np.int64).view(np.uint64))
    odd = (nth > 0) | null
    h[odd] = mix64(h[odd] + (nth[odd].astype(np.uint64) * np.uint64(2) + null[odd].astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F))
    return h


class PerfectHash:
    """A minimal perfect hash over 64-bit key hashes: n keys onto 0..n-1, in a few bits a key."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        flags = np.unpackbits(bits)
        self.rank = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        self.flags, self.base = flags, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], hashes
        for level in range(LEVELS):
            if not len(left):
                break
            m = 2 * len(left) + 1
            at = cls._at(left, level, m)
            hits = np.bincount(at, minlength=m)
            levels.append(hits == 1)
            sizes.append(m)
            left = left[hits[at] != 1]
        if len(left):
            raise ValueError("keys share a 64-bit hash")
        flags = np.concatenate(levels) if levels else np.zeros(0, bool)
        return cls(np.array(sizes, np.int64), np.packbits(flags))

    @staticmethod
    def _at(hashes: np.ndarray, level: int, m: int) -> np.ndarray:
        return (mix64(hashes ^ np.uint64(level * 0x9E37 + 1)) % np.uint64(m)).astype(np.int64)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Each key's slot; -1 where no level holds it. A foreign key may get a slot: its fingerprint tells."""
        out = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        for level, m in enumerate(self.sizes):
            at = self.base[level] + self._at(hashes[open_], level, int(m))
            hit = self.flags[at] == 1
            out[open_[hit]] = self.rank[at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
        return out


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (mix64(hashes ^ np.uint64(0xF1EA5EED)) >> np.uint64(48)).astype(np.uint16)


def _shard(part: int, seq: int, before: int, keys: list, nths: list, ids: list[np.ndarray]) -> dict:
    null = np.array([k is None for k in keys], bool)
    key, nth = np.array([k or 0 for k in keys], np.int64), np.array(nths, np.int64)
    ends = np.cumsum([len(x) for x in ids], dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    h = key_hash(key, nth, null)
    index = PerfectHash.build(h)
    slot = index.slots(h)
    marks, offsets, rows = np.empty(len(h), np.uint16), np.empty((len(h), 2), np.uint32), np.empty(len(h), np.uint32)
    marks[slot], offsets[slot, 0], offsets[slot, 1], rows[slot] = fingerprints(h), starts, ends - starts, np.arange(len(h))
    known = key[~null]
    return {
        "part": part, "seq": seq, "before": before, "n_docs": len(keys), "n_ids": int(ends[-1]), "width": ids[0].dtype.itemsize,
        "first_key": int(known[0]) if len(known) else None, "last_key": int(known[-1]) if len(known) else None, "nulls": int(null.sum()),
        "keys": key.tobytes(), "nth": nth.astype(np.uint32).tobytes(), "levels": index.sizes.tobytes(), "bits": index.bits.tobytes(),
        "marks": marks.tobytes(), "rows": rows.tobytes(), "offsets": offsets.tobytes(), "payload": b"".join(x.tobytes() for x in ids),
    }


def _arrow(spark_ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in spark_ddl.split(", "))])


def _shards(tokenizer: str, end_id: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, schema = encoder(tokenizer), TaskContext.get().partitionId(), _arrow(SHARD)
        end = np.array([end_id], enc.dtype)
        seq = before = held = 0
        keys, nths, ids, last, nth = [], [], [], object(), 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                nth = nth + 1 if doc == last else 0
                last = doc
                got = np.concatenate([enc.encode(text.as_py() or ""), end])
                keys.append(doc), nths.append(nth), ids.append(got)
                held += len(got)
                if held >= shard_ids:
                    yield pa.RecordBatch.from_pylist([_shard(part, seq, before, keys, nths, ids)], schema)
                    seq, before, held, keys, nths, ids = seq + 1, before + held, 0, [], [], []
        if keys:
            yield pa.RecordBatch.from_pylist([_shard(part, seq, before, keys, nths, ids)], schema)

    return run


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_ids: int = SHARD_IDS) -> None:
    """Texts are dealt by ranges of doc_id and text hash and sorted, so shards follow document order and repeats of one
    doc_id spread over tasks; each text is encoded once."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = ["doc_id", F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    with batched(docs.sparkSession):
        dealt.mapInArrow(_shards(tokenizer, end_id, shard_ids), SHARD).write.partitionBy("part").parquet(path)


def _opened(row: dict) -> tuple:
    index = PerfectHash(np.frombuffer(row["levels"], np.int64), np.frombuffer(row["bits"], np.uint8))
    return index, np.frombuffer(row["marks"], np.uint16), np.frombuffer(row["offsets"], np.uint32).reshape(-1, 2), np.frombuffer(row["payload"], f"<u{row['width']}")


def _slots(opened: tuple, hashes: np.ndarray) -> np.ndarray:
    """Each key's slot, -1 where the shard doesn't hold it by its fingerprint."""
    slot = opened[0].slots(hashes)
    held = np.flatnonzero(slot >= 0)
    slot[held[opened[1][slot[held]] != fingerprints(hashes[held])]] = -1
    return slot


def _ids(opened: tuple, slot: int) -> tuple[int, np.ndarray]:
    """Offset and ids of a slot."""
    at, n = opened[2][slot].tolist()
    return at, opened[3][at : at + n]


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
            key, nth = np.frombuffer(row["keys"], np.int64), np.frombuffer(row["nth"], np.uint32)
            null = np.arange(len(key)) < row["nulls"]
            opened = _opened(row)
            got = [_ids(opened, s) for s in _slots(opened, key_hash(key, nth, null)).tolist()]
            at = row["base"] + row["before"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, mask=null), pa.array([at + o for o, _ in got], pa.int64()), pa.array([len(x) for _, x in got], pa.int64()), pa.array([crc_of(x) for _, x in got], pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def _with_base(shards: DataFrame) -> DataFrame:
    """Adds ``base``, the ids in earlier parts. One row per writing task is what the window and the broadcast hold."""
    per = shards.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    base = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return shards.join(F.broadcast(per.select("part", base.alias("base"))), "part")


def open_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD).parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, each through its shard's index."""
    shards = _with_base(open_store(spark, path))
    rows = shards.select("base", "before", "width", "nulls", "keys", "nth", "levels", "bits", "marks", "offsets", "payload")
    with batched(spark, SHARDS_PER_BATCH):
        return stage(rows.mapInArrow(_read, READ), "store-rows")


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
            asked, opened = np.array(row["asked"], np.int64), _opened(row)
            zero = np.zeros(len(asked), np.int64)
            slot = _slots(opened, key_hash(asked, zero, zero > 0))
            # A fingerprint may agree by chance; the key that is stored for the slot doesn't.
            at = np.frombuffer(row["rows"], np.uint32)[slot]
            right = (slot >= 0) & (at >= row["nulls"]) & (np.frombuffer(row["keys"], np.int64)[at] == asked)
            hit = [(k, _ids(opened, s)[1].tolist()) for k, s in zip(asked[right].tolist(), slot[right].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in hit], pa.int64()), pa.array([x for _, x in hit], pa.list_(pa.int64()))], ["doc_id", "ids"])


def route(ranges: DataFrame, asked: DataFrame) -> DataFrame:
    """asked, part, seq: for each key the one shard that may hold its first occurrence.

    That is the last shard that begins below the key, if it reaches it, or else the first that begins at it. Headers and keys are
    sorted together by range; each range takes over the last header of the ranges before it (a row per range)."""
    none = [F.lit(None).cast(t).alias(c) for c, t in (("part", "int"), ("seq", "int"), ("last_key", "long"))]
    rows = ranges.select(F.col("first_key").alias("key"), F.lit(True).alias("head"), "part", "seq", "last_key").unionByName(asked.select(F.col("asked").alias("key"), F.lit(False).alias("head"), *none))
    rows = stage(rows.repartitionByRange("key").withColumn("slice", F.spark_partition_id()), "routes")
    shard = F.when(F.col("head"), F.struct("key", "part", "seq", "last_key"))
    over = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("slice").agg(F.max(shard).alias("top")).select("slice", F.last("top", True).over(over).alias("carried"))
    inside = Window.partitionBy("slice").orderBy("key", "head", "part", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("below", F.last(shard, True).over(inside)).filter("NOT head")
    found = found.select("slice", F.col("key").alias("asked"), "below").join(carried, "slice").withColumn("below", F.coalesce("below", "carried"))
    begins = ranges.groupBy(F.col("first_key").alias("asked")).agg(F.min(F.struct("part", "seq")).alias("at"))
    reaches = F.col("below.last_key") >= F.col("asked")
    found = found.join(begins, "asked", "left").withColumn("to", F.when(reaches, F.struct("below.part", "below.seq")).otherwise(F.col("at")))
    return found.filter("to IS NOT NULL").select("asked", "to.part", "to.seq")


def fetch(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """doc_id and ids of the asked keys (column doc_id); keys that aren't stored give no row.

    A repeated doc_id gives its first occurrence. Keys are routed by shard range, of which headers alone are read; payloads are
    read of the shards that keys were routed to, which the scan is told by folder and number."""
    shards = open_store(spark, path)
    ranges = shards.select("part", "seq", "first_key", "last_key").filter("first_key IS NOT NULL")
    asked = keys.select(F.col("doc_id").cast("long").alias("asked")).filter("asked IS NOT NULL").distinct()
    nth = F.row_number().over(Window.partitionBy("part", "seq").orderBy("asked"))
    chunk = F.floor(nth / F.lit(KEYS_PER_LOOK)).alias("chunk")
    routed = route(ranges, asked).select("part", "seq", "asked", chunk).groupBy("part", "seq", "chunk").agg(F.collect_list("asked").alias("asked"))
    routed = stage(routed, "routed")
    named = routed.select("part", "seq").distinct().limit(NAMED_SHARDS + 1).collect()
    if len(named) <= NAMED_SHARDS:
        shards = shards.filter(F.col("part").isin([r.part for r in named]) & F.col("seq").isin([r.seq for r in named])) if named else shards.filter("false")
    looked = shards.join(routed, ["part", "seq"]).select("asked", "width", "nulls", "keys", "levels", "bits", "marks", "rows", "offsets", "payload")
    with batched(spark, SHARDS_PER_BATCH):
        return stage(looked.mapInArrow(_fetch, "doc_id long, ids array<long>"), "fetched")
