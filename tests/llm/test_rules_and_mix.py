import fnmatch
import hashlib
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality_rules as Q
from tidemark.llm import url_filter as U
from tidemark.llm.exact_dedup import Seen, dedup, follow, keep_last
from tidemark.llm.mixing import draw, emit, mix, source_targets

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_measure(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    hit = {p for i, w in enumerate(windows) if often[w] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(lines), len(re.findall("[A-Z]", text)))


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_ledger_equals_brute_force(request, which):
    frame = request.getfixturevalue(which)
    rows = frame.select("doc_id", "text").collect()
    got = Counter(tuple(r[m] for m in ("doc_id", *Q.MEASURES)) for r in Q.rule_ledger(frame).collect())
    assert got == Counter((r.doc_id, *brute_measure(r.text)) for r in rows)


def test_policy_and_ablation(docs):
    ledger = Q.apply_policy(Q.rule_ledger(docs))
    rows = ledger.collect()
    full = Q.mask("v2")
    assert all(r.kept == (r.fail_bits & full == 0) for r in rows)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)
    for r in Q.ablation(ledger).collect():
        one = next(1 << x.bit for x in Q.RULES if x.name == r.rule)
        assert (r.failed, r.failed_alone, r.kept_without) == (sum(x.fail_bits & one > 0 for x in rows), sum(x.fail_bits == one for x in rows), sum(x.fail_bits & ~one == 0 for x in rows))
    assert {r.n for r in Q.failure_profile(ledger.withColumn("g", ledger.kept), "g").collect()} == set(Counter(r.kept for r in rows).values())


def test_clean_documents_stay(spark, sf, docs):
    ledger = Q.apply_policy(Q.rule_ledger(docs)).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    good = ledger.filter("quality = 1 AND NOT base_failed").collect()
    assert good and all(r.kept for r in good)


URLS = ["http://a.org/x", "http://org", "http://org/", "HTTP://Sub.Example.ORG/es/1", "http://example.org/ES/", "http://example.org/en/12?x", "http://example.org:80/es/", "no scheme/es/", None, "", "x://y://example.org/es/", "http://notexample.org/es/z", "https://cheap-pills.net/?q=http://a.org/", "http://m.spam-farm.example.com/fr/9", "http://b.com/de/", "http://b.com/de", "http://é.com/fr/ü", "http://a\n.org/q", "http://spam-farmer.net/", "http://spammer.net/", "http://x.net/casino/", "http://best-casino-1.co/x", "http://x.net/blog/wp-login.php", "http://x.net/blog/wp-login.php5", "http://x.net/a/ads/banner/1.gif", "http://x.net/ads/banners/"]


def test_urls_inline_equals_joined_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "host") for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, host string")
    got = {r.page_id: tuple(r) for r in U.judge_urls(pages).collect()}
    assert got == {r.page_id: tuple(r) for r in U.judge_urls(pages, inline=0).collect()}
    listed = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    for i, u in enumerate(URLS):
        rest = (u or "").partition("://")[2]
        host = re.match("[^/?#]*", rest)[0].translate(A_Z)
        path = re.match("[^?#]*", rest[len(host) :])[0]
        hits = [(len(h + p), h + p, v) for v, h, p in listed if (host == h or host.endswith("." + h)) and path.startswith(p)]
        words = {w for label in host.split(".") for w in label.split("-")}
        unwanted = words & set(U.WORDS) or any(fnmatch.fnmatchcase(host + path, w) for w in U.WILDCARDS)
        rule, verdict = max(hits)[1:] if hits else (None, "block" if unwanted else "allow")
        assert got[i][1:5] == (host, path, rule, verdict), u
    assert U.judge_urls(pages.limit(0)).count() == 0


def test_rules_from_a_table(spark):
    rules = [("host", "block", "ads.example.com/"), ("host", "allow", "example.com/ok"), ("word", "block", "loans"), ("wildcard", "block", "*.example.net/*/track*.gif")]
    own = U.load_rules(spark.createDataFrame(rules * 2, "kind string, verdict string, rule string"))
    urls = {"http://x.ads.example.com/a": "block", "http://example.com/okay": "allow", "http://quick-loans.org/": "block", "http://q.example.net/a/track1.gif": "block", "http://q.example.net/track.png": "allow", "http://loansome.org/": "allow"}
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(100 + i, "http://quick-loans.org/") for i in range(300)], "page_id long, url string")
    for inline in (2000, 0):
        got = {r.page_id: r.verdict for r in U.judge_urls(pages, own, (), inline).collect()}
        assert got == {i: v for i, v in enumerate(urls.values())} | {100 + i: "block" for i in range(300)}
    for bad in ([("host", "deny", "a.com/")], [("regex", "block", "a")], [("word", None, "a")]):
        with pytest.raises(ValueError):
            U.load_rules(spark.createDataFrame(bad, "kind string, verdict string, rule string"))
    with pytest.raises(ValueError):
        U.judge_urls(pages, (), (U.wildcard_rule("block", "*a*"),))
    with pytest.raises(ValueError):
        U.load_rules(spark.createDataFrame(rules, "kind string, verdict string, rule string"), most=3)


def brute_dedup(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[(t or "").translate(A_Z)].append(d)
    return Counter((d, max((x for x in own if x is not None), default=None), len(own), hashlib.sha256(t.encode()).hexdigest()) for t, own in groups.items() for d in own)


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_dedup(request, which):
    frame = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    got = dedup(frame).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute_dedup(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)
    assert keep_last(frame).columns == frame.columns
    assert keep_last(frame, plain=True).count() == len(kept)


def test_many_rows_of_one_text_without_id(spark):
    """What grew with the square of such rows before: a group costs what its rows cost."""
    frame = spark.range(60_000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("other "), F.col("id").cast("string"))).otherwise("The same Text").alias("text"))
    got = dedup(frame)
    assert got.filter("group_size = 40000").count() == 40_000 and got.filter("kept").count() == 20_001
    left = keep_last(frame)
    assert left.count() == 20_001 and left.filter("text = 'The same Text'").count() == 1


def test_repeats_that_differ_in_case_leave_the_same_row_whatever_their_order(spark):
    rows = [(1, "A text", "x"), (1, "a TEXT", "y"), (1, "a text", "z"), (2, "b", "x"), (2, "B", "x")]
    left = [sorted(map(tuple, keep_last(spark.createDataFrame(own, "doc_id long, text string, source string").repartition(3)).collect())) for own in (rows, rows[::-1])]
    assert left[0] == left[1] and [r[0] for r in left[0]] == [1, 2]


def test_dedup_splits_digests_that_collide(docs, odd):
    weak = lambda c: F.substring(F.sha2(c, 256), 1, 1)
    for frame in (docs, odd):
        rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
        got = dedup(frame, weak).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute_dedup(rows)
        assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})


@pytest.mark.parametrize("weak", [False, True])
def test_arrivals_equal_brute_force_and_change_nothing_when_sent_again(spark, docs, odd, tmp_path, weak):
    digest = {"digest": lambda c: F.substring(F.sha2(c, 256), 1, 1)} if weak else {}
    seen, rows = Seen(spark, f"{tmp_path}/seen", **digest), []
    parts = [docs.limit(120), odd, docs.orderBy(F.desc("doc_id")).limit(120), odd.limit(0), docs.limit(40)]
    for i, part in enumerate(parts):
        part.write.parquet(f"{tmp_path}/in{i}")
        rows += [(r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_path}/in{i}").select("doc_id", "text").collect()]
        assert seen.arrive(i, f"{tmp_path}/in{i}") and not seen.arrive(i, f"{tmp_path}/in{i}")
        got = seen.verdicts().collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute_dedup(rows), i
        assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})


def test_an_arrival_that_broke_off_is_finished_by_the_next(spark, odd, tmp_path, monkeypatch):
    odd.write.parquet(f"{tmp_path}/a")
    odd.limit(5).write.parquet(f"{tmp_path}/b")
    whole = brute_dedup([(r.doc_id, r.text) for x in "ab" for r in spark.read.parquet(f"{tmp_path}/{x}").select("doc_id", "text").collect()])
    with monkeypatch.context() as m:
        m.setattr("tidemark.llm.exact_dedup.mixed_digests", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            Seen(spark, f"{tmp_path}/seen").arrive(1, f"{tmp_path}/a")
    seen = Seen(spark, f"{tmp_path}/seen")
    assert seen.arrive(2, f"{tmp_path}/b") and not seen.arrive(1, f"{tmp_path}/a")
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in seen.verdicts().collect()) == whole


def test_locators_are_followed_into_their_files_alone(spark, tmp_path):
    at = f"{tmp_path}/t"
    rows = spark.range(0, 80_000, 1, 8).select(F.col("id").alias("doc_id"), F.concat(F.lit("T "), "id").alias("text"), F.lit(1).alias("_metadata"), F.lit("x").alias("file"))
    rows.write.parquet(at)
    content = spark.read.parquet(at)
    place = content.metadataColumn("_metadata")
    named = content.select("doc_id", place["file_path"].alias("file"), place["row_index"].alias("row"))
    want = {7, 9_999, 70_001}
    hit = {r.file for r in named.filter(F.col("doc_id").isin(*want)).select("file").collect()}
    named = spark.createDataFrame(named.collect(), named.schema)
    for other in Path(at).glob("part-*"):
        if other.name not in {x.rsplit("/", 1)[1] for x in hit}:
            other.unlink()
    for most in (8_192, 1):
        got = follow(content, named.filter(F.col("doc_id").isin(*want)).select("file", "row"), lambda x: x, most)
        assert {r.doc_id: r.norm for r in got.collect()} == {i: f"t {i}" for i in want}
    assert len(hit) == 2 and follow(content, named.limit(0).select("file", "row"), lambda x: x).count() == 0


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, target = set(), {}
    while True:
        left = share * sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        total = sum(weight[s] for s in order if s not in capped)
        target = {s: most * sizes[s] if s in capped else left * weight[s] / total for s in order}
        over = {s for s in order if target[s] > most * sizes[s]} - capped
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5, None: 7, "é": 900, "z": 0}, {"a": 10, "b": 10, "c": 10}, {"x": 1000, "y": 1}, {"q": 0}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in source_targets(frame).collect()}
    assert got == pytest.approx(brute_targets(sizes))


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_mix(request, which):
    frame = request.getfixturevalue(which)
    got = mix(frame).collect()
    assert len(got) == frame.count()
    for r in got:
        assert r.taken == r.copies * r.size and r.taken <= 2 * r.size
        assert int(r.rate) <= r.copies <= int(r.rate) + 1
    if which == "docs":
        assert sorted(map(tuple, mix(frame.repartition(7)).collect())) == sorted(map(tuple, got))
        assert emit(frame).count() == sum(r.copies for r in got)
        want, have = defaultdict(float), defaultdict(float)
        for r in got:
            want["all"] += r.rate * r.size
            have["all"] += r.taken
        assert have["all"] == pytest.approx(want["all"], rel=0.15)


def test_every_source_comes_near_its_target_with_and_without_ids(spark):
    """20,000 rows, a third of them without id: what each source's rows are taken for lies within five standard deviations."""
    n = F.col("id")
    words = F.array_join(F.array_repeat(F.lit("w"), (n % 9 + 1).cast("int")), " ")
    frame = spark.range(20_000).select(F.when(n % 3 == 0, F.lit(None)).otherwise(n).alias("doc_id"), F.concat(words, F.lit(" "), n.cast("string")).alias("text"), F.when(n % 7 != 0, F.concat(F.lit("s"), F.floor(n / 3000).cast("string"))).alias("source"))
    got = mix(frame).groupBy("source", "target", "rate").agg(F.sum("taken").alias("taken"), F.sum(F.col("size") * F.col("size")).alias("squares")).collect()
    assert len(got) == 8
    for r in got:
        part = r.rate % 1
        assert abs(r.taken - r.target) <= 5 * (part * (1 - part) * r.squares) ** 0.5 + 1e-6, r


def test_draws_are_uniform(spark):
    us = [r[0] for r in spark.range(20000).select(F.col("id").alias("doc_id"), F.lit(None).cast("long").alias("salt")).select(draw(1)).collect()]
    assert 0 <= min(us) and max(us) < 1 and abs(sum(us) / len(us) - 0.5) < 0.01


def test_many_rules_are_joined_and_long_urls_judged(spark):
    """Thousands of rules, of which few are met; a url of a megabyte is judged by all of its path."""
    rules = tuple(U.word_rule("block", f"word{i}") for i in range(3000)) + (U.wildcard_rule("block", "*/the/end.html"),)
    long = "http://ok.example.net/" + "a/" * 500_000
    urls = [(1, "https://word17.example.net/x"), (2, "https://sword17.example.net/x"), (3, "https://a.word2999.org/"), (4, long + "the/end.html"), (5, long + "the/end"), (6, None)]
    frame = spark.createDataFrame(urls, "page_id long, url string")
    got = {r.page_id: (r.verdict, r.method_rule, len(r.path)) for r in U.judge_urls(frame, (), rules).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "block", 2: "allow", 3: "block", 4: "block", 5: "allow", 6: "allow"} and got[4][2] == 1_000_013
    assert got == {r.page_id: (r.verdict, r.method_rule, len(r.path)) for r in U.judge_urls(frame, (), (rules[17], rules[2999], rules[-1])).collect()}
