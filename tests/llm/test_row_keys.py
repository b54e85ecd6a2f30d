import random
from collections import Counter

import corpus_pipeline as P
from tests.llm.conftest import SCHEMA
from tidemark.llm.common import stage
from tidemark.llm.kneser_ney import accepted, classify
from tidemark.llm.simhash import one_of_each


def prose(seed, n=120):
    rng = random.Random(seed)
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def near_rows():
    a, b, c, d = (" ".join(prose(s)) for s in range(4))
    texts = [(5, a), (8, a + "  "), (9, b), (5, b + " "), (7, c), (7, c + " "), (None, d), (None, d + " "), (None, "apart " + " ".join(prose(9)))]
    return [(i, t, "en", "s", len(t), k) for k, (i, t) in enumerate(texts)]


def test_near_stage_keeps_one_row_per_component(spark, sf):
    frame = spark.createDataFrame(near_rows(), SCHEMA).repartition(3)
    for left in (one_of_each(frame), dict(P.STAGES)["SimHash near-dedup"](spark, frame, sf)):
        kept = sorted(r.kept for r in left.collect())
        assert kept[:2] == [0, 3] and len(kept) == 5 and len(set(kept) & {4, 5}) == len(set(kept) & {6, 7}) == 1 and 8 in kept


def test_quality_stage_follows_each_rows_verdict(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    junk = "zq " * 400
    extra = spark.createDataFrame([(None, junk + "x", "en", "s", 0), (10**9, junk, "en", "s", 0), (10**9, docs.filter("lang = 'en'").first().text, "en", "s", 0)], docs.schema)
    both = stage(docs.unionByName(extra), "t-both")
    want = Counter((r.doc_id, r.lang) for r in classify(both, labels).filter("kept").collect())
    left = accepted(both, labels)
    assert left.columns == docs.columns and Counter((r.doc_id, r.lang or "") for r in left.collect()) == want
    assert want[10**9, "en"] == 1 and not any(d is None for d, _ in want)
