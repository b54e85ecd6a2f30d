import random
import time
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import license_scan as L
from tidemark.llm.common import stage_path
from tidemark.llm.token_counts import LONG, VERSIONS, CountStore, counted, pieces, replay, tokenizer_counts, words


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


def ids(words):
    return np.array([w[0] for w in words], np.int64)


def test_alignment_finds_the_longest_match_in_a_wide_band():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([bytes([97 + rng.randrange(4)]) for _ in range(rng.randint(1, 12))] for _ in range(2))
        matched, first, last = L.align(ids(a), ids(b), -12, 12)
        assert matched == lcs(a, b)
        if matched:
            assert 0 <= first <= last < len(b) and lcs(a, b[first : last + 1]) == matched
        else:
            assert last < first


def test_winnow_covers_every_window():
    rng = random.Random(9)
    own = [bytes([97 + rng.randrange(5)]) * rng.randint(1, 3) for _ in range(300)]
    places = L.winnow(own, 3, 4)
    assert all(any(i <= p < i + 4 for p in places) for i in range(300 - 3 - 4 + 2)) and len(places) < 200
    assert L.winnow(own[:2]) == [] and L.winnow(own[:3]) == [0] and L.winnow(own, 2, 1) == list(range(299))


def places(text, index):
    return [(index.names[k], m, a, b) for k, _, m, a, b in L.scan(text.encode(), index)]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 2000])
@pytest.mark.parametrize("name", ["MIT (notice)", "CC-BY-NC-4.0 (notice)", "Apache-2.0 (notice)", "GPL-3.0 (notice)"])
def test_back_to_back_notices_give_a_row_each(name, n):
    index = L.Index(L.TEMPLATES)
    size = len(L.words_of(L.TEMPLATES[name].encode()))
    got = [x for x in places((L.TEMPLATES[name] + " ") * n, index) if x[0] == name]
    assert got == [(name, size, i * size, (i + 1) * size - 1) for i in range(n)]


def test_whole_licenses_back_to_back():
    index = L.Index(L.TEMPLATES)
    for name in ("MIT", "ISC", "BSD-2-Clause"):
        size = len(L.words_of(L.TEMPLATES[name].encode()))
        assert [x for x in places((L.TEMPLATES[name] + "\n") * 4, index) if x[0] == name] == [(name, size, i * size, (i + 1) * size - 1) for i in range(4)]


def test_changes_at_a_fifth_of_the_words_are_found():
    """Words replaced, lost or pushed apart at up to a fifth of a template's places, in other text: always met, with the coverage that is left."""
    rng, index = random.Random(11), L.Index(L.TEMPLATES)
    assert [x[0] for x in places("Released under MIT License", index)] == ["MIT (notice)"]
    assert [x[0] for x in places("Released under an MIT License", index)] == ["MIT (notice)"]
    for _ in range(400):
        name = rng.choice(index.names)
        words = [w.decode() for w in L.words_of(L.TEMPLATES[name].encode())]
        out, lost, pushed = list(words), 0, 0
        for at in sorted(rng.sample(range(1, len(words) - 1), len(words) // 5), reverse=True):
            kind = rng.choice("rlp")
            if kind == "p" and pushed == 0:
                out.insert(at, "zzz")
                pushed += 1
            else:
                out[at : at + 1] = ["zzz"] if kind == "r" else []
                lost += 1
            if kind == "l" and sum(1 for _ in out) < len(words) - min(L.BAND, max(1, len(words) // 5)):
                break
        before = ["filler"] * rng.randint(0, 30)
        got = [x for x in places(" ".join(before + out + ["more"] * rng.randint(0, 30)), index) if x[0] == name]
        assert len(got) == 1 and got[0][1] >= len(words) - lost and len(before) <= got[0][2] <= got[0][3] < len(before) + len(out), (name, out, got)


def test_templates_in_parts_and_from_a_table(spark, docs):
    want = Counter(tuple(r) for r in L.license_matches(docs).collect())
    table = spark.createDataFrame(list(L.TEMPLATES.items()), "name string, text string")
    assert L.load_templates(table) == L.TEMPLATES
    assert len(L.template_parts(L.TEMPLATES, 100)) > 3
    assert Counter(tuple(r) for r in L.license_matches(docs, L.load_templates(table), index_words=100).collect()) == want
    with pytest.raises(ValueError):
        L.load_templates(table, most=100)
    with pytest.raises(ValueError):
        L.load_templates(table.union(table))


def test_templates_are_found_edited_and_repeated(spark):
    filler = "some words that no notice has, over and over. " * 40
    mit = L.TEMPLATES["MIT"]
    edited = mit.replace("free of charge", "at no cost").replace("merge, ", "")
    texts = [filler + mit + filler, edited, filler, "Released under the MIT License.\n" + filler + "released UNDER the mit license", None, "", "MIT", "été " + L.TEMPLATES["CC-BY-NC-4.0 (notice)"] + " été"]
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, license int")
    got = defaultdict(list)
    for r in L.license_matches(frame).collect():
        got[r.doc_id].append(r)
        assert r.coverage >= L.COVERAGE and r.matched_words <= r.last_word - r.first_word + 1 + 8
    assert [r.license for r in got[0]] == ["MIT"] and got[0][0].coverage == 1
    assert texts[0][got[0][0].start_char : got[0][0].end_char] == mit.rstrip(".")
    assert [r.license for r in got[1]] == ["MIT"] and 0.9 < got[1][0].coverage < 1
    assert [r.license for r in got[3]] == ["MIT (notice)"] * 2
    assert [texts[7][r.start_char : r.end_char] for r in got[7]] == ["Licensed under CC BY-NC 4.0"]
    assert set(got) == {0, 1, 3, 7}
    assert L.license_matches(frame.limit(0)).count() == 0


def brute_places(own, template, band):
    """Spans over any diagonal where enough of the template lies within the band: plain dynamic programming, no index."""
    out, m = [], len(template)
    for d in range(-m + 1, len(own)):
        best = [[0] * (2 * band + 3) for _ in range(m + 1)]
        for i in range(m):
            for j in range(2 * band + 1):
                at = i + d - band + j
                same = 0 <= at < len(own) and own[at] == template[i]
                best[i + 1][j + 1] = max(best[i][j + 1] + same, best[i][j + 2], best[i + 1][j])
        if max(best[m]) >= L.COVERAGE * m - 1e-9:
            out.append((max(0, d - band), min(len(own), d + m + band) - 1))
    return out


def test_documents_equal_brute_force(docs, odd):
    """Both ways, for every document and template: each place of enough coverage is met by a match, each match is one, and matches lie apart."""
    index, got = L.Index(L.TEMPLATES), defaultdict(list)
    for r in L.license_matches(docs).collect():
        got[r.doc_id, r.license].append(r)
    seen = 0
    for r in docs.collect():
        own = L.words_of(r.text.encode())
        bag = Counter(own)
        for name, text in L.TEMPLATES.items():
            template = L.words_of(text.encode())
            found = sorted((x.first_word, x.last_word, x.matched_words, x.coverage) for x in got.pop((r.doc_id, name), []))
            for a, b, matched, coverage in found:
                assert lcs(template, own[a : b + 1]) == matched and coverage == matched / len(template) >= L.COVERAGE
            assert all(x[1] < y[0] for x, y in zip(found, found[1:]))
            if sum((bag & Counter(template)).values()) < L.COVERAGE * len(template):
                assert not found
                continue
            want = brute_places(own, template, max(1, min(L.BAND, len(template) // 5)))
            assert all(any(a <= y and x <= b for x, y, *_ in found) for a, b in want) and bool(want) == bool(found)
            seen += len(found)
    assert seen > 2 and not got and index.names == list(L.TEMPLATES)
    assert L.license_matches(odd).count() == 0


def flat(rows):
    return {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in rows}


def test_batches_commit_once_and_revise(spark):
    store = CountStore(spark, stage_path(spark, "t-counts"))
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, version string, source string, lang string, n_tokens long")
    assert store.totals().count() == 0
    first = frame([(1, "v", "a", "en", 10), (2, "v", "a", "en", 5), (3, "v", None, None, 7), (1, "w", "a", "en", 4), (2, "v", "a", "en", 3)])
    assert store.commit(1, first) and not store.commit(1, first)
    assert flat(store.totals().collect()) == {("a", "en", "v"): (2, 15), (None, None, "v"): (1, 7), ("a", "en", "w"): (1, 4)}
    assert store.commit(2, frame([(1, "v", "b", "en", 11), (3, "v", None, None, None), (9, "v", "a", "en", None)]))
    assert flat(store.totals().collect()) == {("a", "en", "v"): (1, 5), ("b", "en", "v"): (1, 11), ("a", "en", "w"): (1, 4)}
    spark.createDataFrame([("a", "en", "v", 100, 100)], "source string, lang string, version string, docs long, tokens long").write.parquet(f"{store.path}/deltas/batch=3")
    assert flat(store.totals().collect())["a", "en", "v"] == (1, 5)
    assert store.commit(3, frame([(3, "v", "c", None, 1)])) and store.commit(4, frame([]))
    want = defaultdict(lambda: [0, 0])
    for r in store.current().collect():
        want[r.source, r.lang, r.version][0] += 1
        want[r.source, r.lang, r.version][1] += r.n_tokens
    assert flat(store.totals().collect()) == {k: tuple(v) for k, v in want.items()}
    with pytest.raises(ValueError):
        store.commit(5, frame([(1, None, "a", "en", 1)]))


def test_late_batches_are_refused_and_broken_ones_removed(spark):
    store = CountStore(spark, stage_path(spark, "t-late"), buckets=4)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, version string, source string, lang string, n_tokens long")
    store.commit(3, frame([(1, "v", "a", "en", 7)]))
    with pytest.raises(ValueError):
        store.commit(1, frame([(1, "v", "a", "en", 5)]))
    assert flat(store.totals().collect()) == {("a", "en", "v"): (1, 7)}
    # A batch that broke off before its marker: neither read, nor left behind by the next one.
    frame([(2, "v", "a", "en", 50)]).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{store.path}/counts/batch=5")
    assert {r.doc_id for r in store.current().collect()} == {1}
    store.commit(9, frame([(3, "v", "a", "en", 1)]))
    assert {r.doc_id for r in store.current().collect()} == {1, 3}
    assert flat(store.totals().collect()) == {("a", "en", "v"): (2, 8)}


def test_commit_reads_what_its_batch_touches(spark):
    store = CountStore(spark, stage_path(spark, "t-touched"), buckets=16)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, version string, source string, lang string, n_tokens long")
    store.commit(1, frame([(i, "v", "a", "en", i) for i in range(2000)]))
    change = frame([(5, "v", "a", "en", 1000)]).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int"))
    touched = store.touched(change)
    assert touched.count() == 1 and touched.select("bucket").distinct().count() == 1
    plan = touched._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1].split("]")[0] and "doc_id" in plan.split("PushedFilters")[1]
    store.commit(2, frame([(5, "v", "a", "en", 1000), (6, "v", "a", "en", None)]))
    assert flat(store.totals().collect()) == {("a", "en", "v"): (1999, sum(range(2000)) + 995 - 6)}


def test_replay_equals_brute_force(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    gone = {r.doc_id for r in labels.filter("quality = 0").collect()}
    encoders = {v: Tokenizer.from_file(public_tokenizers.path(f)) for v, f in VERSIONS.items()}
    want = defaultdict(lambda: [0, 0])
    for r in docs.collect():
        for k, (v, t) in enumerate(encoders.items()):
            n = len(t.encode(r.text or "", add_special_tokens=False).ids)
            if r.doc_id not in gone:
                want[r.source, r.lang, v][0] += 1
                want[r.source, r.lang, v][1] += n + (k == 0 and n >= LONG)
    assert flat(replay(docs, labels).collect()) == {k: tuple(v) for k, v in want.items()}


def test_counters_and_odd_rows(spark, odd, empty, docs):
    labels = spark.createDataFrame([(1, 0), (2, 1), (None, 0)], "doc_id long, quality int")
    got = flat(replay(odd, labels).collect())
    assert got["a", "en", "word_bpe_49k"][0] == 1 and got["c", "en", "word_bpe_49k"] == (1, 5001)
    assert got[None, "en", "word_bpe_49k"] == (1, 0) and (None, None, "byte_bpe_50k") not in got
    assert replay(empty, labels).count() == 0
    bpe = tokenizer_counts(docs, {"bpe": "byte_bpe_50k.json"})
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r.doc_id: r.n_tokens for r in bpe.collect()} == {r.doc_id: len(plain.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}
    assert Counter(r.version for r in counted(odd, {"w": words, "p": pieces}).collect()) == {"w": 11, "p": 11}


def test_bands_that_cannot_reach_the_coverage_cost_little(empty):
    """The first words of a template again and again: every place is a candidate, none can match enough."""
    index = L.Index(L.TEMPLATES)
    name = max(L.TEMPLATES, key=lambda n: len(L.TEMPLATES[n]))
    head = " ".join(L.TEMPLATES[name].split()[:10])
    start = time.time()
    found = L.scan((" ".join([head] * 4000)).encode(), index)
    assert time.time() - start < 5 and name not in {index.names[k] for k, *_ in found}
    whole = L.scan((" ".join([head] * 300) + " " + L.TEMPLATES[name]).encode(), index)
    assert [c for k, c, *_ in whole if index.names[k] == name] == [1.0]
    assert L.license_matches(empty).count() == 0
