"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into as few segments as leave one of them with at most one differing bit (three for four bits).
Each segment is filed under its one-wildcard variants: one per bit, with that bit left out. Fingerprints that
lie within the distance share a variant, so an equality grouping finds every pair, which is then verified. Only
distinct fingerprints take part, and a group of fingerprints under one variant gives a spanning forest of its links, not its pairs.

Nulls and odd input: a null or empty text, or one without words, has fingerprint zero, linked like any other; a null
doc_id carries its component but names none (a component of such rows alone has component_id null); rows that repeat
a doc_id give a row each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, hub_join, numbered, small_batches, stage, without_rows
from .components import components

WORDS, DISTANCE, SEED = 4, 4, 42
#: Members of one variant that one task links by itself; larger groups are dealt out in blocks of this size.
BLOCK = 8192


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """The signed 64-bit SimHash of a text's word shingles, each hashed once per occurrence."""
    own = (text or b"").lower().split()
    if not own:
        return 0
    joined, h = b" ".join(own), xxhash.xxh64_intdigest
    if len(own) <= words:
        hashes = np.array([h(joined, SEED)], "<u8")
    else:
        size = np.fromiter(map(len, own), np.int64, len(own))
        ends = np.cumsum(size + 1) - 1
        starts = ends - size
        hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist())], "<u8")
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the 64-bit hashes have, as a signed number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(x.as_py()) for x in batch.column(1)], pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp of whole texts."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _own_fingerprints(own: DataFrame) -> DataFrame:
    """number, doc_id, fp of numbered rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([fingerprint(x.as_py()) for x in b.column(2)], pa.int64())], ["number", "doc_id", "fp"])

    narrow = own.select("number", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("binary").alias("text"))
    with batched(own.sparkSession):
        return stage(narrow.mapInArrow(run, "number long, doc_id long, fp long"), "fingerprints")


def segments(distance: int = DISTANCE) -> list[tuple[int, int]]:
    """First bit and width of each segment: the least number that leaves one with at most one differing bit."""
    n = distance // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def variants(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """key, fp: one row per bit of each segment. The key names segment and bit, and holds the segment without that bit."""
    keys = []
    for shift, width in segments(distance):
        own = F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(width):
            name = (shift + bit) << 57 if shift + bit < 64 else 0
            name = name - (1 << 64) if name >= 1 << 63 else name
            keys.append(own.bitwiseAND(F.lit(~(1 << bit))).bitwiseOR(F.lit(name)))
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def forest(fps: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Spanning links of the fingerprints that lie within the distance of each other, directly or by way of others."""
    a, b, left = [], [], fps
    while len(left):
        root, left, queue = int(left[0]), left[1:], [left[0]]
        while queue and len(left):
            near = np.bitwise_count((left ^ queue.pop()).view(np.uint64)) <= distance
            if near.any():
                found = left[near]
                left = left[~near]
                a += [root] * len(found)
                b += found.tolist()
                queue += list(found)
    return a, b


def _links(distance: int, block: int):
    """Over rows sorted by key: kind 0 are links (a, b), kind 1 the members (key, fp) of groups above ``block``."""

    def out(kind: int, a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["kind", "a", "b"])

    def settle(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole groups: those of up to eight by shifted comparison, larger ones by their forest."""
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[starts, len(key)])
        of = np.repeat(size, size)
        for step in range(1, 8):
            at = np.flatnonzero((of[step:] <= 8) & (key[step:] == key[:-step]))
            if not len(at):
                break
            near = at[np.bitwise_count((fp[at] ^ fp[at + step]).view(np.uint64)) <= distance]
            if len(near):
                yield out(0, fp[near], fp[near + step])
        for k in np.flatnonzero(size > 8):
            a, b = forest(fp[starts[k] : starts[k] + size[k]], distance)
            if a:
                yield out(0, a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, over = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            key, fp = np.r_[key, batch.column(0).to_numpy()], np.r_[fp, batch.column(1).to_numpy()]
            if over is not None:
                n = int(np.searchsorted(key != over, True)) if (key != over).any() else len(key)
                if n:
                    yield out(1, key[:n], fp[:n])
                key, fp = key[n:], fp[n:]
                if not len(key):
                    continue
                over = None
            last = int(np.flatnonzero(key != key[-1])[-1] + 1) if (key != key[-1]).any() else 0
            if last:
                yield from settle(key[:last], fp[:last])
                key, fp = key[last:], fp[last:]
            if len(key) > block:
                over = key[0]
                yield out(1, key, fp)
                key, fp = key[:0], fp[:0]
        if len(key):
            yield from settle(key, fp)

    return run


def _linked(keyed: DataFrame, distance: int, block: int) -> DataFrame:
    with batched(keyed.sparkSession, 10_000):
        return stage(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_links(distance, block), "kind int, a long, b long"), "links")


def links(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """a, b: links that connect all distinct fingerprints within ``distance`` of each other.

    A group above ``block`` is cut into blocks, and every two of its blocks meet in a task: all its pairs are compared,
    the work is spread, and what comes out stays a forest per task."""
    found = _linked(variants(fps, distance), distance, block)
    edges = found.filter("kind = 0").select("a", "b").distinct()
    over = found.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    sizes = over.groupBy("key").agg(F.ceil(F.count("*") / F.lit(block // 2)).cast("int").alias("blocks"))
    if sizes.isEmpty():
        return edges
    dealt = over.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    rest = _linked(dealt.select(pair.alias("key"), "fp"), distance, 1 << 62)
    return edges.unionByName(rest.select("a", "b")).distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that a document's fingerprint reaches over links."""
    with batched(docs.sparkSession):
        own = stage(fingerprints(docs), "fingerprints")
    distinct = stage(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "distinct")
    n_fps, n_rows = distinct.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    roots = components(links(distinct.select("fp"), distance, block), "a", "b")
    named = stage(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "rows", F.coalesce("root", "fp").alias("root"), "least"), "roots")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    of = stage(hub_join(named, least, "root", n_fps).select("fp", "component_id", F.col("rows").alias("n")), "component-names")
    return hub_join(own, of, "fp", n_rows).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row of ``docs`` per component, with all its columns: of the smallest doc_id, without doc_id only where no row has one."""
    own = numbered(docs)
    fps = _own_fingerprints(own)
    distinct = stage(fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without_id"), "doc_id", "number")).alias("first")), "distinct")
    roots = components(links(distinct.select("fp"), distance), "a", "b")
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    keep = stage(named.select(F.col("first.number").alias("keep_number")), "firsts")
    drop = stage(fps.join(keep, F.col("number") == F.col("keep_number"), "left_anti").select("number"), "near-copies")
    return without_rows(own, drop)
