import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import SCHEMA
from tests.llm.test_rules_and_mix import A_Z
from tidemark.llm import queries as Q
from tidemark.llm.ranked_search import Shard, search, terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text):
    return TERM.findall((text or "").translate(A_Z))


def brute(docs, items, k=20):
    """(item, rank, doc, score) by scoring every document for every item. docs: (id, text)."""
    bags = [(d, Counter(own), len(own)) for d, t in docs if (own := cut(t))]
    n, total, df = len(bags), sum(x[2] for x in bags), Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        scored = []
        for d, bag, size in bags:
            m = 100 - 25 + (25 * size * n) // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 12 * m)) for t, q in Counter(cut(text)).items() if t in bag)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert rows(Q.op12_ranked_search(spark, sf)) == brute(docs, items)


def made(n=600, words=40):
    """Few words, so that many documents tie; repeated texts, some of them without an id or under an id of another row."""
    rng = random.Random(4)
    docs = [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % words}" for _ in range(rng.choice([3, 3, 3, 8, 40])))) for i in range(n)]
    docs += [(None, docs[5][1]), (None, docs[5][1]), (7, docs[9][1]), (n + 1, None), (n + 2, "--- ..."), (n + 3, "w3 " * 4000)]
    items = [(i, " ".join(f"w{rng.randrange(words)}" for _ in range(rng.choice([1, 2, 6, 30])))) for i in range(25)]
    return docs, items + [(100, "w3 w3 W3"), (101, None), (102, "nothing here"), (103, "")]


@pytest.mark.parametrize("sizes", [{}, {"block_terms": 30, "shard_postings": 200}, {"k": 3}])
def test_ties_blocks_and_shards(spark, sizes):
    docs, items = made()
    frame = spark.createDataFrame([(d, t, "en", "s", 0, 0) for d, t in docs], SCHEMA).repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    assert rows(search(frame, asked, **sizes)) == brute(docs, items, sizes.get("k", 20))


def test_reading_stops_early_and_loses_nothing():
    rng = np.random.default_rng(5)
    nd, lists = 20_000, 6
    held = [np.sort(rng.choice(nd, 9_000, replace=False)) for _ in range(lists)]
    term, doc = np.repeat(np.arange(lists), 9_000), np.concatenate(held)
    times = rng.zipf(2.2, len(doc)).clip(1, 900)
    order = np.lexsort((term, doc))
    lengths = np.full(nd, 300)
    shard = Shard(lengths, np.bincount(doc, minlength=nd), term[order], times[order], nd, int(lengths.sum()))
    for _ in range(2):  # a shard is clean again after a query
        docs, scores, read = shard.search(np.arange(lists), np.array([9000, 5, 4, 3, 2, 1]), 20)
        exact = np.zeros(nd, np.int64)
        np.add.at(exact, doc, np.array([9000, 5, 4, 3, 2, 1])[term] * ((1_000_000_000 * times) // (1000 * times + 12 * 100)))
        kth = np.sort(exact)[-20]
        assert set(docs) == set(np.flatnonzero(exact >= kth)) and (scores == exact[docs]).all() and read < len(doc) / 3


def test_terms():
    text = "Ünï-code ÄB c3 d\x00e_f `g{h}İ日本"
    assert [t.decode() for t in terms(text.encode())] == cut(text)


def test_odd_tables(spark, odd, empty):
    items = spark.createDataFrame([(1, "text twice word"), (1, "déjà vu line"), (None, "id here a")], "item_id long, text string")
    got, want = rows(search(odd, items)), brute([(r.doc_id, r.text) for r in odd.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got == want and len(got) > 8
    assert search(empty, items).count() == 0 and search(odd, items.limit(0)).count() == 0 and search(empty, items).columns == search(odd, items).columns
