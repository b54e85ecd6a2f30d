import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as P
from tests.llm.conftest import SCHEMA
from tests.llm.test_rules_and_mix import A_Z
from tests.llm.test_simhash import brute_components
from tidemark.llm.near_copies import one_of_each, spanning


def shingle_set(text):
    own = (text or "").translate(A_Z).encode().split()
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))}


def similar(rows):
    """Pairs of places at 0.8 or more, by all pairs that share a shingle."""
    sets, holders, shared = [shingle_set(t) for t in rows], defaultdict(list), Counter()
    for k, own in enumerate(sets):
        for g in own:
            holders[g].append(k)
    for held in holders.values():
        shared.update((a, b) for i, a in enumerate(held) for b in held[i + 1 :])
    return [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9]


def kept_ids(rows):
    of = brute_components(range(len(rows)), similar([t for _, t in rows]))
    least = {}
    for k, (d, _) in enumerate(rows):
        least[of[k]] = min(least.get(of[k], d), d)
    return sorted(least.values())


def test_stage_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    left = dict(P.STAGES)["SimHash near-dedup"](spark, docs, sf)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.select("doc_id").collect()) == kept_ids(rows)


def planted():
    """Groups whose members drift from each other: copies of copies, some below 0.8 of the first; one large group; one of odd ones."""
    rng, out = random.Random(3), []
    word = lambda: f"w{rng.randrange(9000)}"
    for size in (60, 12, 12, 12):
        base = [word() for _ in range(200)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(200)] = word()
            out.append(" ".join(own))
            if rng.random() < 0.4:
                base = own
    return [(100 - k if k < 50 else 1000 + k, t) for k, t in enumerate(out)]


@pytest.mark.parametrize("block", [256, 5])
def test_blocks_lose_nothing(spark, block):
    rows = planted()
    want = kept_ids(rows)
    assert 4 <= len(want) < len(rows) / 2
    frame = spark.createDataFrame([(d, t, "en", "s", 0, 0) for d, t in rows], SCHEMA).repartition(4)
    assert sorted(r.doc_id for r in one_of_each(frame, block=block).collect()) == want


def test_spanning_and_odd_rows(odd, empty):
    sets = [np.arange(a, a + 100, dtype=np.uint64) for a in range(0, 60, 6)] + [np.arange(900, 1000, dtype=np.uint64), np.arange(900, 1000, dtype=np.uint64)]
    of = brute_components(range(12), spanning(sets))
    assert len({of[k] for k in range(10)}) == 1 and of[10] == of[11] != of[0]
    left = one_of_each(odd)
    assert left.columns == odd.columns and Counter(r.doc_id for r in left.collect()) == Counter([1, 3, 6, 7, None, 8, 9])
    assert one_of_each(empty).count() == 0
