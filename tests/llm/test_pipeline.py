from collections import Counter

import corpus_pipeline as P
from tests.llm.test_kneser_ney import brute as brute_scores
from tests.llm.test_near_copies import kept_ids
from tests.llm.test_rules_and_mix import A_Z
from tidemark.llm.common import stage
from tidemark.llm.mixing import mix


def rows_of(frame):
    return Counter(tuple(r) for r in frame.collect())


def test_stages_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1 AND toxic = 0").collect()}
    makes = [make for _, make in P.STAGES]
    names = docs.columns

    rows = docs.collect()
    scored = brute_scores([(r.doc_id, r.text, r.lang) for r in rows], good)
    fine = {d for (d, _, _), (_, _, kept) in scored.items() if kept}
    one = stage(makes[0](spark, docs, sf), "t-1")
    assert one.columns == names and rows_of(one) == Counter(tuple(r) for r in rows if r.doc_id in fine)

    rows = one.collect()
    last = {}
    for r in rows:
        key = (r.text or "").translate(A_Z)
        last[key] = max(last.get(key, -1), r.doc_id)
    two = stage(makes[1](spark, one, sf), "t-2")
    assert two.columns == names and rows_of(two) == Counter(tuple(r) for r in rows if r.doc_id in last.values())

    rows = two.collect()
    first = set(kept_ids([(r.doc_id, r.text) for r in rows]))
    three = stage(makes[2](spark, two, sf), "t-3")
    assert three.columns == names and rows_of(three) == Counter(tuple(r) for r in rows if r.doc_id in first)

    rows = {r.doc_id: tuple(r) for r in three.collect()}
    four = stage(makes[3](spark, three, sf), "t-4")
    want = Counter({rows[r.doc_id]: r.copies for r in mix(three).collect() if r.copies})
    assert four.columns == names and rows_of(four) == want and sum(want.values()) > len(rows)

    five = makes[4](spark, four, sf).collect()
    assert {r.doc_id for r in five} == {r.doc_id for r in four.select("doc_id").collect()}
    copies = Counter(r.doc_id for r in four.select("doc_id").collect())
    total, tokens = Counter(), {r.doc_id: r.doc_tokens for r in five}
    for r in five:
        total[r.doc_id] += r.length
    assert all(total[d] == copies[d] * tokens[d] for d in copies)


def test_run_and_odd_rows(spark, sf, odd, empty):
    assert P.run(spark, sf).count() > 100
    for docs in (odd, empty):
        for _, make in P.STAGES:
            docs = stage(make(spark, docs, sf), "t-odd")
        assert docs.columns[-2:] == ["sequence_id", "offset"]
