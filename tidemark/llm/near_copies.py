"""Near copies by word shingles: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from two sides and shingle sets decide. SimHash fingerprints of the same shingles are linked by deletion variants
(``simhash.links``, DISTANCE bits). That alone isn't enough: most pairs at 0.8 differ in 5 to 13 bits, and no split into few segments finds
those. So MinHash bands pick candidates too: of two texts at 0.8 exactly, BANDS bands of BAND_ROWS minima miss one in
(1 - 0.8^6)^35, 3 in 100,000, and less above.

Rows that share a fingerprint, a link or a band are tied to its least row, which gives candidate components. A component's texts meet in tasks of at
most BLOCK rows and about BLOCK_BYTES of text, each with the component's least row; what these leave apart from that row then meets all blocks, so nothing
of a candidate component goes uncompared, and a large group of copies of one text costs what its size is.

Nulls and odd input: shorter texts are one shingle; all texts without words are copies of each other; a null doc_id stays only where its
component has no other; rows that repeat a doc_id are judged each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, batched, hub_join, numbered, sized, stage, without_rows
from .components import components
from .simhash import DISTANCE, links, majority

WORDS, SIMILARITY, SEED = 5, 0.8, 42
BANDS, BAND_ROWS, BLOCK = 35, 6, 256
#: Bytes of texts that a block holds about, whatever its rows.
BLOCK_BYTES = 32 << 20

_RANDOM = np.random.default_rng(7)
_FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RANDOM.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64)


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    own = (text or b"").lower().split()
    joined, h = b" ".join(own), xxhash.xxh64_intdigest
    if len(own) <= words:
        return np.array([h(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, own), np.int64, len(own))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    return np.unique(np.array([h(joined[a:b], SEED) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist())], np.uint64))


def band_keys(own: np.ndarray) -> list[int]:
    """A signed 64-bit key per band of the set's minima."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 2048):
        part = own[at : at + 2048]
        mixed = (part ^ (part >> np.uint64(31))) * _FACTORS[:, None] + _TERMS[:, None]
        np.minimum(least, mixed.min(axis=1), out=least)
    rows = least.reshape(BANDS, BAND_ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), band) - (1 << 63) for band, r in enumerate(rows)]


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingles(x.as_py()) for x in b.column(1)]
        keys, fps = [band_keys(s) for s in sets], [majority(s) for s in sets]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.list_(pa.int64())), pa.array(fps, pa.int64())], ["number", "keys", "fp"])


def spanning(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links (by place) that connect all sets that lie within ``similarity``, directly or by way of others."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(size)
    mark = np.zeros(len(ids), bool)
    left, out = np.arange(1, len(sets)), []
    root, queue = 0, [0]
    while len(left):
        if not queue:
            root, left = int(left[0]), left[1:]
            queue = [root]
            continue
        at = queue.pop()
        n = size[at]
        could = left[(size[left] >= similarity * n - 1e-9) & (n >= similarity * size[left] - 1e-9)]
        if not len(could):
            continue
        mark[ids[ends[at] - n : ends[at]]] = True
        upto = np.r_[0, np.cumsum(mark[ids])]
        mark[ids[ends[at] - n : ends[at]]] = False
        both = upto[ends[could]] - upto[ends[could] - size[could]]
        found = could[both >= similarity * (n + size[could] - both) - 1e-9]
        out += [(root, int(k)) for k in found]
        queue += found.tolist()
        left = np.setdiff1d(left, found, assume_unique=True)
    return out


def _compare(similarity: float):
    """Over rows sorted by key: a, b of similar rows of a key."""

    def settle(rows: dict[int, bytes | None]) -> pa.RecordBatch:
        numbers = sorted(rows)
        found = spanning([shingles(rows[n]) for n in numbers], similarity)
        return pa.RecordBatch.from_arrays([pa.array([numbers[x[k]] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, {}
        for b in batches:
            for k, n, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if k != key and rows:
                    yield settle(rows)
                    rows = {}
                key = k
                rows[n] = t.as_py()
        if rows:
            yield settle(rows)

    return run


def _similar(dealt: DataFrame, texts: DataFrame, similarity: float, name: str) -> DataFrame:
    """a, b: links within each key of ``dealt`` (key, number)."""
    rows = dealt.join(texts, "number").select("key", "number", "text")
    with batched(dealt.sparkSession):
        return stage(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(similarity), "a long, b long"), name)


def candidates(own: DataFrame) -> DataFrame:
    """node, root: rows by number and the least row that they reach over fingerprints, links and shared bands."""
    with batched(own.sparkSession):
        keys = stage(own.select("number", F.col("row.text").cast("binary").alias("text")).mapInArrow(_bands, "number long, keys array<bigint>, fp long"), "bands")
    filed = keys.select("number", F.explode("keys").alias("key"))
    hubs = stage(filed.groupBy("key").agg(F.min("number").alias("hub"), F.count("*").alias("n")).filter("n > 1"), "hubs")
    shared, total = hubs.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    tied = filed.join(sized(hubs.drop("n")), "key") if shared <= BROADCAST_IDS else hub_join(filed, hubs, "key", total)
    fps = stage(keys.groupBy("fp").agg(F.min("number").alias("hub"), F.count("*").alias("n")), "fingerprints")
    same = hub_join(keys.select("number", "fp"), fps, "fp", keys.count())
    end = lambda side: fps.select(F.col("fp").alias(side), F.col("hub").alias("number" if side == "a" else "hub"))
    pairs = stage(links(fps.select("fp"), DISTANCE), "fingerprint-links")
    n_links = pairs.count()
    near = pairs
    for side in ("a", "b"):  # the first of a group of fingerprints stands in all its links
        often = pairs.groupBy(side).agg(F.count("*").alias("n"))
        near = hub_join(near, stage(end(side).join(often, side), f"ends-{side}"), side, n_links)
    ties = [x.filter("number != hub").select("number", "hub") for x in (tied, same, near)]
    return components(ties[0].unionByName(ties[1]).unionByName(ties[2]).distinct(), "number", "hub")


def copies(own: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """node, root: rows of ``own`` (see ``numbered``) that lie in one component of similar texts."""
    groups = stage(candidates(own), "candidates")
    members = groups.select(F.col("node").alias("m_number"))
    texts = stage(own.join(sized(members), F.col("number") == F.col("m_number"), "left_semi").select("number", F.col("row.text").cast("binary").alias("text")), "member-texts")
    held = groups.join(texts.select(F.col("number").alias("node"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("held")), "node")
    blocks = F.greatest(F.ceil(F.count("*") / F.lit(block)), F.ceil(F.sum("held") / F.lit(BLOCK_BYTES)), F.lit(1)).cast("int")
    sizes = stage(held.groupBy("root").agg(blocks.alias("blocks"), F.count("*").alias("n")), "candidate-sizes")
    placed = stage(hub_join(groups, sizes, "root", groups.count()).select("root", "blocks", F.col("node").alias("number"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own")), "placed")
    at = F.xxhash64("root", "own").alias("key")
    hubs = placed.filter("number = root").select("number", "root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"))
    first = _similar(placed.select(at, "number").unionByName(hubs.select(at, "number")).distinct(), texts, similarity, "links")
    tied = stage(components(first, "a", "b"), "first-components")
    # Of components of several blocks, the rows that aren't with their least row: these meet all blocks.
    named = tied.select("node", F.col("root").alias("now"))
    large = placed.filter("blocks > 1").join(named, F.col("number") == F.col("node"), "left").withColumn("now", F.coalesce("now", "number"))
    large = stage(large.drop("node"), "large")
    counts = large.groupBy("root").agg(F.count("*").alias("n"))
    hub_now = stage(large.filter("number = root").select("root", F.col("now").alias("hub_now")).join(counts, "root"), "hubs-now")
    rest = stage(hub_join(large, hub_now, "root", large.count()).filter("now != hub_now").select("root", "blocks", "number"), "rest")
    if rest.isEmpty():
        return tied
    # As many rows of the rest meet in a task as rows of a block, whose number follows from rows and bytes.
    share = F.ceil(F.count("*") * F.max("blocks") / F.first("n_root")).cast("int")
    parts = rest.join(counts.select("root", F.col("n").alias("n_root")), "root").groupBy("root").agg(F.greatest(F.ceil(F.count("*") / F.lit(block)).cast("int"), share, F.lit(1)).alias("parts"), F.count("*").alias("n"))
    parts = stage(parts, "parts")
    n_rest = rest.count()
    left = hub_join(rest, parts, "root", n_rest).withColumn("part", F.pmod(F.xxhash64("number", F.lit(1)), F.col("parts")).cast("int"))
    left = left.select("root", "number", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"))
    whole = stage(parts.drop("n").join(counts, "root"), "parts-of-large")
    right = hub_join(placed, whole, "root", placed.count()).select("root", "number", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "own")
    second = _similar(left.unionByName(right).select(F.xxhash64("root", "part", "own").alias("key"), "number").distinct(), texts, similarity, "more-links")
    return stage(components(first.unionByName(second), "a", "b"), "all-components")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """One row of ``docs`` per component, with all its columns: of the smallest doc_id, without doc_id only where no row has one."""
    own = numbered(docs)
    found = copies(own, similarity, block)
    rows = own.select("number", F.col("row.doc_id").cast("long").alias("doc_id")).join(sized(found), F.col("number") == F.col("node"))
    rows = stage(rows.select("root", "number", F.struct(F.col("doc_id").isNull().alias("without_id"), "doc_id", "number").alias("rank")), "members")
    keep = rows.groupBy("root").agg(F.min("rank").alias("first")).select(F.col("first.number").alias("keep_number"))
    drop = stage(rows.select("number").join(sized(keep), F.col("number") == F.col("keep_number"), "left_anti"), "near-copies")
    return without_rows(own, drop)
