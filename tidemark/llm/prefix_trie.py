"""A trie over conversations: every distinct sequence of first turns is a node, with its members, children, leaves and the tokens that sharing saves.

Turns are sorted by range over all tasks and hashed as they stream by, so that a conversation of any length is split, not gathered: prefixes are
hashed by a rolling sum over 128-bit digests of the turns, which continues from one task to the next by a row per task. A conversation's prefixes
travel as blocks of at most BLOCK. A count-min sketch over all prefix hashes then screens them: a prefix whose estimate is one is
in one conversation only, and so are all that go on from it. Such tails become nodes where they lie. Only prefixes before the tail, which
may be shared, are shuffled and grouped exactly; so a prefix that the sketch overrates costs a row, not a wrong result.

Sums over subtrees need no walk over levels: a node belongs to its smallest member, a conversation owns the last part of its path, and a
node's subtree is what its members own from its depth on. So one running sum along each conversation and one grouping by node give them.

The sketch has ROWS rows of cells, eight a prefix, MOST_CELLS at most (a bit a cell goes to the tasks: 32 MB); with more prefixes than that it screens
less. Rebuilding is a parameter (``heads``): of a conversation, which conversation its first turns come from, and how many.

Nulls and odd input: turns without conv_id belong to no conversation; a null turn comes first, a null role or text is empty; turns that share
a number are ordered by a digest of role and text, and repeated rows are turns each; other columns are not looked at; an empty table gives no node.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batched, hub_join, sized, stage

BLOCK, HEAD = 1024, 8
ROWS, MOST_CELLS, CHUNK = 2, 1 << 27, 1 << 16
#: Prefixes are hashed modulo a prime of 127 bits, to a fixed base.
PRIME, BASE = (1 << 127) - 1, 0x5DEECE66D1F3A9C4E2B7086A51C39D47
ROOT, NOTHING = bytes(16), hashlib.sha256(b"").hexdigest()
IDS = 8192


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest (128 bits of role and text), size (bytes of the text), number."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size"), F.monotonically_increasing_id().alias("number"))
    return own.filter("conv_id IS NOT NULL")


def five(conv_id: Column) -> tuple[Column, Column]:
    """The conversation that the first turns come from, and how many: by fives, as the registered query asks for."""
    return conv_id - F.pmod(conv_id, F.lit(5)), (F.crc32(conv_id.cast("string").cast("binary")) % 9).cast("int")


def _word(x: int) -> bytes:
    return x.to_bytes(16, "little")


def _number(x: bytes) -> int:
    return int.from_bytes(x, "little")


_PIECE = "part int, conv_id long, first long, n int, start binary, hashes binary, sizes binary"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [x.strip().split(" ") for x in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns as blocks under their partition, hashed from where the conversation starts in it; first -1: whole of the partition's first or last conversation."""
    part = conv = None
    n, h, start, hashes, sizes, out, whole = 0, 0, 0, [], [], [], True

    def block() -> None:
        nonlocal start, hashes, sizes
        if hashes:
            out.append((part, conv, n - len(hashes), len(hashes), _word(start), b"".join(hashes), np.array(sizes, "<i8").tobytes()))
        start, hashes, sizes = h, [], []

    for b in batches:
        for p, c, digest, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            if c != conv or part is None:
                block()
                if part is not None and whole:
                    out.append((part, conv, -1, n, _word(h), None, None))
                    whole = False
                part, conv, n, h, start = p, c, 0, 0, 0
            h = (h * BASE + _number(digest)) % PRIME
            hashes.append(_word(h))
            sizes.append(size)
            n += 1
            if len(hashes) == BLOCK:
                block()
        if len(out) >= 256:
            yield _batch(out, _PIECE)
            out = []
    if part is not None:
        block()
        yield _batch([*out, (part, conv, -1, n, _word(h), None, None)], _PIECE)


def carried(edges: list) -> dict[tuple[int, int], tuple[int, int]]:
    """For (part, conversation) that goes on from parts before: turns and hash up to there. edges: part, conv_id, n, start of each part's first and last."""
    out, conv, n, h = {}, None, 0, 0
    for e in sorted({(e.part, e.conv_id, e.n, bytes(e.start)) for e in edges}):
        if e[1] == conv:
            out[e[0], conv] = n, h
            n, h = n + e[2], (h * pow(BASE, e[2], PRIME) + _number(e[3])) % PRIME
        else:
            conv, n, h = e[1], e[2], _number(e[3])
    return out


_OWN = "conv_id long, first long, n int, start binary, hashes binary, sizes binary, head binary, head_sizes binary"


def _joined(carry: dict):
    """Blocks with their place and hashes in the whole conversation; head: what lies within its first HEAD turns."""

    def moved(hashes: bytes, after: int, h: int) -> bytes:
        power, out = pow(BASE, after, PRIME), []
        for k in range(0, len(hashes), 16):
            power = power * BASE % PRIME
            out.append(_word((h * power + _number(hashes[k : k + 16])) % PRIME))
        return b"".join(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                first, start, hashes = r["first"], r["start"], r["hashes"]
                if (r["part"], r["conv_id"]) in carry:
                    n, h = carry[r["part"], r["conv_id"]]
                    hashes = moved(hashes, first, h)
                    start = _word((h * pow(BASE, first, PRIME) + _number(start)) % PRIME)
                    first += n
                near = max(0, HEAD - first)
                rows.append((r["conv_id"], first, r["n"], start, hashes, r["sizes"], hashes[: 16 * near], r["sizes"][: 8 * near]))
            yield _batch(rows, _OWN)

    return run


def own_blocks(conversations: DataFrame) -> DataFrame:
    """Original conversations as blocks: conv_id, first (turns before), n, start (hash before), hashes, sizes, head, head_sizes."""
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest", "number"]
    ranged = turns(conversations).repartitionByRange(*order).sortWithinPartitions(*order)
    with batched(conversations.sparkSession, 4096):
        pieces = stage(ranged.select(F.spark_partition_id().alias("part"), "conv_id", "digest", "size").mapInArrow(_pieces, _PIECE), "turn-pieces")
        # Two rows a task at most.
        carry = carried(pieces.filter("first < 0").select("part", "conv_id", "n", "start").collect())
        return stage(pieces.filter("first >= 0").mapInArrow(_joined(carry), _OWN), "turn-blocks")


_NEW = "conv_id long, depth long, n int, before binary, hashes binary, sizes binary, total long"


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for r in b.to_pylist():
            h, taken, first = r["h"], r["taken"], r["first"]
            skip = min(max(0, h - first), r["n"])  # own turns of the block that the head replaces
            base_hash = _number(r["base"][-16:]) if taken else 0
            own_hash = _number(r["cut"]) if r["cut"] else 0
            shift = (base_hash - own_hash) % PRIME
            own, sizes = r["hashes"][16 * skip :], r["sizes"][8 * skip :]
            if shift and own:
                power, out = pow(BASE, first + skip - h, PRIME), []
                before = (shift * power + _number(r["hashes"][16 * skip - 16 : 16 * skip] if skip else r["start"])) % PRIME
                for k in range(0, len(own), 16):
                    power = power * BASE % PRIME
                    out.append(_word((shift * power + _number(own[k : k + 16])) % PRIME))
                own = b"".join(out)
            else:
                before = _number(r["hashes"][16 * skip - 16 : 16 * skip] if skip else r["start"])
            if first == 0:
                own, sizes = ROOT + r["base"] + own, bytes(8) + r["base_sizes"] + sizes
                rows.append((r["conv_id"], 0, len(own) // 16, None, own, sizes, r["total"]))
            elif own:
                rows.append((r["conv_id"], taken + first + skip - h + 1, len(own) // 16, _word(before), own, sizes, r["total"]))
        yield _batch(rows, _NEW)


def rebuilt(own: DataFrame, heads: Callable[[Column], tuple[Column, Column]] = five) -> DataFrame:
    """Blocks of the rebuilt conversations: conv_id, depth of the first node, n, before (hash of the node above), hashes, sizes, total turns."""
    near = F.sort_array(F.collect_list(F.when(F.col("first") < HEAD, F.struct("first", "head", "head_sizes"))))
    gathered = lambda c: F.aggregate("near", F.lit(b""), lambda a, x: F.concat(a, x[c]))
    convs = own.groupBy("conv_id").agg(F.sum("n").alias("size"), F.count("*").alias("blocks"), near.alias("near"))
    convs = stage(convs.select("conv_id", "size", "blocks", gathered("head").alias("head"), gathered("head_sizes").alias("head_sizes")), "conversations")
    base, h = heads(F.col("conv_id"))
    of = convs.select(F.col("conv_id").alias("b_conv"), F.col("size").alias("b_size"), F.col("head").alias("b_head"), F.col("head_sizes").alias("b_sizes"))
    plan = convs.withColumn("base_id", base).withColumn("h", F.least(h, F.lit(HEAD))).join(of, F.col("base_id") == F.col("b_conv"), "left")
    taken = F.least(F.col("h"), F.coalesce("b_size", F.lit(0))).cast("int")
    binary = lambda c, upto: F.coalesce(F.substring(F.col(c), F.lit(1), upto), F.lit(b""))
    plan = plan.withColumn("taken", taken).select(
        "conv_id", "h", "taken", F.col("blocks").alias("n"),
        F.when((F.col("h") > 0) & (F.col("size") > F.col("h")), F.substring(F.col("head"), F.col("h") * 16 - 15, F.lit(16))).alias("cut"),
        binary("b_head", F.col("taken") * 16).alias("base"), binary("b_sizes", F.col("taken") * 8).alias("base_sizes"),
        (F.col("taken") + F.greatest(F.lit(0), F.col("size") - F.col("h"))).cast("long").alias("total"),
    )
    plan = stage(plan, "plan")
    rows = hub_join(own.select("conv_id", "first", F.col("n").alias("length"), "start", "hashes", "sizes"), plan, "conv_id", own.count())
    with batched(own.sparkSession):
        return stage(rows.withColumnRenamed("length", "n").mapInArrow(_rebuilt, _NEW), "rebuilt")


def cells(hashes: bytes, width: int) -> np.ndarray:
    """A cell of each prefix in each row of the sketch; width is a power of two."""
    words = np.frombuffer(hashes, "<u8").reshape(-1, 2)
    mixed = words ^ (words >> np.uint64(29))
    return np.stack([(mixed[:, 0] & np.uint64(width - 1)), (mixed[:, 1] & np.uint64(width - 1)) + np.uint64(width)]).astype(np.int64)


def sketch_width(prefixes: int) -> int:
    return min(MOST_CELLS, max(CHUNK, 1 << math.ceil(math.log2(8 * max(1, prefixes)))))


def sketch(blocks: DataFrame, width: int) -> np.ndarray:
    """For each cell whether two or more prefixes fall into it: all that an estimate of one needs."""

    def told(held: list[np.ndarray]) -> pa.RecordBatch:
        cell, count = np.unique(np.concatenate(held), return_counts=True)
        chunk, at = np.unique(cell // CHUNK, return_index=True)
        rows = []
        for c, a, z in zip(chunk.tolist(), at, [*at[1:], len(cell)], strict=True):
            low, one = (cell[a:z] % CHUNK).astype("<u2"), count[a:z] == 1
            rows.append((c, low[one].tobytes(), low[~one].tobytes()))
        return _batch(rows, "chunk int, one binary, more binary")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for depth, hashes in zip(b.column(0), b.column(1), strict=True):
                own = hashes.as_py()[0 if depth.as_py() else 16 :]
                held.append(cells(own, width).ravel())
                size += len(own) // 8
                if size >= 1 << 22:
                    yield told(held)
                    held, size = [], 0
        if size:
            yield told(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, np.zeros(CHUNK, np.uint8)
        for b in batches:
            for chunk, one, more in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if chunk != now:
                    if now is not None:
                        yield _batch([(now, np.packbits(seen > 1).tobytes())], "chunk int, bits binary")
                    now, seen = chunk, np.zeros(CHUNK, np.uint8)
                seen[np.frombuffer(more, "<u2")] = 2
                low = np.frombuffer(one, "<u2")
                seen[low] = np.minimum(seen[low] + 1, 2)
        if now is not None:
            yield _batch([(now, np.packbits(seen > 1).tobytes())], "chunk int, bits binary")

    parts = blocks.select("depth", "hashes").mapInArrow(build, "chunk int, one binary, more binary")
    merged = stage(parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(merge, "chunk int, bits binary"), "sketch")
    bits = np.zeros(ROWS * width // 8, np.uint8)
    for r in merged.toLocalIterator():
        bits[r.chunk * CHUNK // 8 : (r.chunk + 1) * CHUNK // 8] = np.frombuffer(r.bits, np.uint8)
    return bits


def _alone(hashes: bytes, bits: np.ndarray, width: int) -> np.ndarray:
    """Prefixes whose estimate is one."""
    cell = cells(hashes, width)
    return ((bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 0).any(axis=0)


_NODE = "conv_id long, depth long, key binary, parent binary, size long, total long, tail long"


def screened(blocks: DataFrame, bits: np.ndarray, width: int) -> DataFrame:
    """A row per node of each conversation. tail: depth from which it is proven alone, total + 1 if nowhere; only rows up to there keep key and parent."""
    sent = blocks.sparkSession.sparkContext.broadcast(bits)

    def first(depth: int, hashes: bytes, total: int) -> int:
        alone = np.flatnonzero(_alone(hashes, sent.value, width)[0 if depth else 1 :])
        return int(alone[0]) + max(depth, 1) if len(alone) else total + 1

    def begins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch([(r["conv_id"], first(r["depth"], r["hashes"], r["total"])) for r in b.to_pylist()], "b_conv long, begin long")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                hashes, depth, total = r["hashes"], r["depth"], r["total"]
                tail = r["begin"] if r["begin"] is not None else first(depth, hashes, total)
                sizes = np.frombuffer(r["sizes"], "<i8").tolist()
                above = r["before"]
                for k, size in enumerate(sizes):
                    own = hashes[16 * k : 16 * k + 16]
                    known = depth + k <= tail
                    rows.append((r["conv_id"], depth + k, own if known else None, above if known else None, size, total, tail))
                    above = own
            yield _batch(rows, _NODE)

    with batched(blocks.sparkSession):
        several = blocks.filter(F.col("n") < F.col("total") + 1)
        begin = stage(several.select("conv_id", "depth", "hashes", "total").mapInArrow(begins, "b_conv long, begin long").groupBy("b_conv").agg(F.min("begin").alias("begin")), "tail-begins")
        rows = blocks.join(sized(begin), F.col("conv_id") == F.col("b_conv"), "left").drop("b_conv")
        return stage(rows.mapInArrow(split, _NODE), "prefixes")


def listed(ends: DataFrame) -> DataFrame:
    """key, ends: SHA-256 of a node's conv_ids, ascending and comma-joined. Ids come in sorted chunks, so a node of many costs a task no memory and few rows."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []
        for b in batches:
            out = []
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if (k != key or len(ids) == IDS) and ids:
                    out.append((key, ids[0], ",".join(map(str, ids)).encode()))
                    ids = []
                key = k
                ids.append(c)
            yield _batch(out, "key binary, first long, ids binary")
        if ids:
            yield _batch([(key, ids[0], ",".join(map(str, ids)).encode())], "key binary, first long, ids binary")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, None
        for b in batches:
            out = []
            for k, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k != key:
                    if own:
                        out.append((key, own.hexdigest()))
                    key, own = k, hashlib.sha256(ids)
                else:
                    own.update(b"," + ids)
            yield _batch(out, "key binary, ends string")
        if own:
            yield _batch([(key, own.hexdigest())], "key binary, ends string")

    ranged = ends.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    parts = stage(ranged.mapInArrow(chunks, "key binary, first long, ids binary"), "end-chunks")
    return parts.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digests, "key binary, ends string")


def subtree_sums(rows: DataFrame) -> DataFrame:
    """key, n_leaves, saved: of what members own from the node's depth on. rows: conv_id, depth, key, leaf, saves, has_tail, total."""
    rows = stage(rows.withColumn("block", F.floor(F.col("depth") / BLOCK)), "members")
    down = Window.partitionBy("conv_id", "block").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select("conv_id", "block", "key", (F.sum("leaf").over(down) + F.col("has_tail").cast("long")).alias("leaf"), F.sum("saves").over(down).alias("saves"))
    long = rows.filter(F.col("total") >= BLOCK)
    if not long.isEmpty():
        after = Window.partitionBy("l_conv").orderBy(F.col("l_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
        later = long.groupBy(F.col("conv_id").alias("l_conv"), F.col("block").alias("l_block")).agg(F.sum("leaf").alias("l"), F.sum("saves").alias("s"))
        later = stage(later.select("l_conv", "l_block", F.sum("l").over(after).alias("l"), F.sum("s").over(after).alias("s")), "later-blocks")
        out = out.join(sized(later), (F.col("conv_id") == F.col("l_conv")) & (F.col("block") == F.col("l_block")), "left")
        out = out.select("key", (F.col("leaf") + F.coalesce("l", F.lit(0))).alias("leaf"), (F.col("saves") + F.coalesce("s", F.lit(0))).alias("saves"))
    return out.groupBy("key").agg(F.sum("leaf").alias("n_leaves"), F.sum("saves").alias("saved"))


def trie(conversations: DataFrame, heads: Callable[[Column], tuple[Column, Column]] = five, width: int | None = None) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, screened (the sketch proved it alone)."""
    blocks = rebuilt(own_blocks(conversations), heads)
    prefixes = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    width = width or sketch_width(prefixes)
    nodes = screened(blocks, sketch(blocks, width), width)
    shared, tails = nodes.filter("depth < tail"), nodes.filter("depth >= tail")
    group = shared.groupBy("key").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.max("size").alias("size"))
    group = stage(group, "groups")
    tops = tails.filter("depth = tail").select("conv_id", "depth", "parent", "total")
    children = group.filter("depth > 0").select("parent").unionByName(tops.select("parent")).groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    group = stage(group.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "groups-with-children")
    table = group.select("key", "rep", "n", (F.col("n") - 1).alias("others"), "n_children")
    members = hub_join(shared.select("key", "conv_id", "depth", "size", "total", "tail"), table, "key", shared.count())
    owns = F.col("rep") == F.col("conv_id")
    sums = subtree_sums(
        members.select(
            "conv_id", "depth", "key", "total", (F.col("tail") <= F.col("total")).alias("has_tail"),
            (owns & (F.col("n_children") == 0)).cast("long").alias("leaf"), F.when(owns, F.col("others") * F.col("size")).otherwise(F.lit(0)).cast("long").alias("saves"),
        )
    )
    ends = listed(shared.filter("depth = total"))
    # The parent's smallest member; a parent of many children is met by broadcast.
    upper = stage(group.filter("n_children > 0").select(F.col("key").alias("parent"), F.col("rep").alias("parent_conv_id"), F.col("n_children").alias("n")), "parents")
    links = upper.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    inner = group.select("key", "parent", "rep", "depth", F.col("n").alias("n_convs"), "n_children").join(sums, "key").join(ends, "key", "left")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    inner = inner.select("parent", F.col("rep").alias("conv_id"), "depth", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"), F.lit(False).alias("screened"))
    last = F.col("depth") == F.col("total")
    alone = [F.when(last, none).otherwise(one).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(NOTHING)).alias("ends_sha256"), F.lit(True).alias("screened")]
    begun = tops.select("parent", "conv_id", "depth", one.alias("n_convs"), *alone)
    root = inner.filter("depth = 0").drop("parent").withColumn("parent_conv_id", F.lit(None).cast("long"))
    below = hub_join(inner.filter("depth > 0").unionByName(begun), upper, "parent", links).drop("parent")
    rest = tails.filter("depth > tail").select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), *alone)
    order = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "screened"]
    return root.select(order).unionByName(below.select(order)).unionByName(rest.select(order))
