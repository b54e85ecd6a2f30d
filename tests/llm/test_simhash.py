import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tidemark.llm.components import components
from tidemark.llm.simhash import fingerprint, forest, links, near_duplicates, one_of_each, segments


def brute_fingerprint(text):
    words = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    out = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return out - (1 << 64) if out >> 63 else out


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def pairs(fps, distance):
    fps = sorted(fps)
    u = np.array(fps, np.int64)
    return [(fps[i], fps[j]) for i in range(len(fps)) for j in range(i + 1, len(fps)) if np.bitwise_count((u[i] ^ u[j]).view(np.uint64)) <= distance]


def brute(rows, distance):
    fp = [(d, brute_fingerprint(t)) for d, t in rows]
    of = brute_components({f for _, f in fp}, pairs({f for _, f in fp}, distance))
    least = defaultdict(list)
    for d, f in fp:
        if d is not None:
            least[of[f]].append(d)
    return sorted(((d, f, min(least[of[f]], default=None)) for d, f in fp), key=str)


def test_segments():
    assert len(segments(4)) == 3 and sum(w for _, w in segments(4)) == 64


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
@pytest.mark.parametrize("distance", [4, 8])
def test_near_duplicates_equal_brute_force(request, which, distance):
    frame = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in near_duplicates(frame, distance).collect()), key=str)
    assert got == brute(rows, distance)


def planted(n_groups=12, size=40):
    rng, out = random.Random(5), set()
    for _ in range(n_groups):
        base = rng.getrandbits(64)
        for _ in range(size):
            x = base
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
            base = x if rng.random() < 0.3 else base
    out |= {rng.getrandbits(64) for _ in range(400)} | {0, 1, (1 << 64) - 1}
    return sorted(x - (1 << 64) if x >> 63 else x for x in out)


@pytest.mark.parametrize("block", [8192, 10])
def test_links_lose_nothing_whatever_the_block(spark, block):
    fps = planted()
    found = [tuple(r) for r in links(spark.createDataFrame([(x,) for x in fps], "fp long").repartition(4), 4, block).collect()]
    assert all(np.bitwise_count(np.int64(a ^ b).view(np.uint64)) <= 64 for a, b in found)
    assert brute_components(fps, found) == brute_components(fps, pairs(fps, 4))
    assert len(found) < 64 * len(fps)


def test_forest_spans():
    fps = np.array(planted(3, 60), np.int64)
    a, b = forest(fps, 4)
    assert brute_components(fps.tolist(), list(zip(a, b))) == brute_components(fps.tolist(), pairs(fps.tolist(), 4))


def test_components_of_long_chains(spark):
    rng = random.Random(2)
    chain = list(range(300))
    edges = [(i, i + 1) for i in chain if i % 50 != 49] + [(1000, 1001), (1001, 1000), (5000, 5000)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: i - i % 50 for i in chain} | {1000: 1000, 1001: 1000}


def test_one_of_each_keeps_columns_and_one_row(docs, odd):
    found = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    left = one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, c in found.items() if d == c)
    assert one_of_each(odd).columns == odd.columns


def test_fingerprint_counts_repeats():
    assert fingerprint(b"a b") == brute_fingerprint("a b") and fingerprint(b" \n") == 0
    assert fingerprint(b"x y z w " * 50 + b"q r") == brute_fingerprint("x y z w " * 50 + "q r")
