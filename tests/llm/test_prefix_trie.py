import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries as Q
from tidemark.llm.prefix_trie import own_blocks, rebuilt, sketch, trie

SCHEMA = "conv_id long, turn long, role string, text string, key int, depth int"


def by_fives(c):
    return c - c % 5, zlib.crc32(str(c).encode()) % 9


def tie(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def brute(rows, heads=by_fives):
    """conv_id, depth, parent, members, children, leaves, saved, ends of each node; rows: (conv_id, turn, role, text)."""
    told = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            told[c].append((turn is not None, turn or 0, tie(role or "", text or ""), role or "", text or ""))
    told = {c: [x[3:] for x in sorted(v)] for c, v in told.items()}
    new = {}
    for c, own in told.items():
        base, h = heads(c)
        new[c] = told.get(base, [])[:h] + own[h:]
    nodes, names = defaultdict(list), {(): 0}  # sequences by number, to keep long ones cheap
    above, ends = {0: None}, defaultdict(list)
    for c, own in sorted(new.items()):
        at = 0
        nodes[0].append(c)
        for t in own:
            at, up = names.setdefault((at, t), len(names)), at
            above[at] = up
            nodes[at].append(c)
        ends[at].append(c)
    depth, last, children, leaves, saved = {0: 0}, {0: 0}, defaultdict(int), defaultdict(int), defaultdict(int)
    for (up, t), at in [x for x in names.items() if x[0]]:
        depth[at], last[at] = depth[up] + 1, len(t[1].encode())
        children[up] += 1
    for at in sorted(depth, key=depth.get, reverse=True) if told else []:
        leaves[at] += not children[at]
        saved[at] += (len(nodes[at]) - 1) * last[at]
        if at:
            leaves[above[at]] += leaves[at]
            saved[above[at]] += saved[at]
    digest = lambda x: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()
    return sorted(
        (min(nodes[at]), depth[at], min(nodes[above[at]]) if at else None, len(nodes[at]), children[at], leaves[at], saved[at], digest(sorted(ends[at]))) for at in depth if told
    )


def got(df):
    return sorted(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def made():
    """Few different turns; conversations without a base, of one turn, of thousands; copies; ties; nulls; a negative id."""
    rng = random.Random(8)
    rows = [(c, k, rng.choice("ua"), f"é{rng.randrange(3)}") for c in range(0, 120) if c % 17 for k in range(rng.randint(1, 12))]
    rows += [(c, k, "u", "same") for c in range(500, 900) for k in range(3)]
    long = [(k, "u", f"long {k % 7}") for k in range(2600)]
    rows += [(c, *x) for c in (1000, 1005, 1011) for x in long] + [(1005, 9999, "a", "end")]
    rows += [(2000, None, None, None), (2000, None, None, ""), (2000, 3, "u", None), (2001, 3, "u", "x"), (2001, 3, "a", "x"), (2001, 3, "a", "x"), (-7, 1, "u", "minus"), (None, 1, "u", "nobody's"), (3004, 5, "u", "alone")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("change", [{}, {"width": 1 << 16}, {"heads": lambda c: (F.lit(None).cast("long"), F.lit(0))}])
def test_equals_brute_force(spark, change):
    rows = made()
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(5)
    heads = (lambda c: (None, 0)) if "heads" in change else by_fives
    assert got(trie(frame, **change)) == brute(rows, heads)


def test_query_equals_brute_force(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert got(Q.op11_prefix_trie(spark, sf)) == brute(rows)


def test_a_conversation_is_split_over_tasks(spark):
    """Half of all turns are of one conversation; its hashes don't depend on how the sort deals it out."""
    rows = [(7, k, "u", f"t{k}") for k in range(4000)] + [(100 + k, 0, "u", f"s{k}") for k in range(4000)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    found = []
    for n in (1, 16):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            blocks = own_blocks(frame.repartition(6)).filter("conv_id = 7").sort("first").collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert sum(b.n for b in blocks) == 4000 and [b.first for b in blocks] == [sum(x.n for x in blocks[:k]) for k in range(len(blocks))]
        assert len(blocks) >= (4 if n == 1 else 8)
        found.append(b"".join(b.hashes for b in blocks))
    assert found[0] == found[1]


def test_the_sketch_never_calls_a_shared_prefix_single(spark):
    rows = made()
    nodes = trie(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(3))
    by = {(r.screened, r.n_convs > 1): r["count"] for r in nodes.groupBy("screened", "n_convs").count().collect()}
    assert (True, True) not in by and nodes.filter("screened").count() > 0.9 * nodes.filter("n_convs = 1").count()


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert trie(none).count() == 0
    assert trie(spark.createDataFrame([(None, 1, "u", "x", 1, 1)], SCHEMA)).count() == 0
    assert rebuilt(own_blocks(none)).count() == 0 and not sketch(rebuilt(own_blocks(none)), 1 << 16).any()
