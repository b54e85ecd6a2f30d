"""The stream of versions: any order and split gives the same facts, repeats change nothing, what is known too early is set aside."""

import datetime as dt
import random

import pytest

from tidemark.operators import bitemporal as B
from tidemark.plans import fixtures as FX
from tidemark.streaming import facts as SF

D = dt.date(2024, 1, 15)
NAMES = [c.split()[0] for c in SF.FACTS.split(", ")]


def at(days, hours=21):
    return dt.datetime.combine(D, dt.time()) + dt.timedelta(days=days, hours=hours)


def version(symbol, cycle, days, quantity, revised=False, split=False, seen=None):
    day = D + dt.timedelta(days=15 * cycle)
    observed = at(15 * cycle + (days if seen is None else seen), 12) if revised else None
    return (symbol, day, day + dt.timedelta(days=8), at(15 * cycle + days), quantity, split, revised, observed)


def made():
    rng = random.Random(6)
    rows = []
    for s in "ABCDEF":
        for cycle in range(12):
            rows.append(version(s, cycle, 9, rng.randrange(1000)))
            rows += [version(s, cycle, 20 + 7 * k, rng.randrange(1000), True) for k in range(rng.choice([0, 0, 1, 2]))]
    return rows


def run(spark, parts):
    incoming, out, work = (FX.scratch(spark, n) for n in ("t-arrivals", "t-facts", "t-work"))
    for part in parts:
        spark.createDataFrame(part, SF.FACTS).coalesce(2).write.mode("append").parquet(incoming)
        SF.stream_facts(spark, incoming, out, work)
    return out


def known(spark, facts):
    cuts = [(s, (D + dt.timedelta(days=d)), at(d)) for s in "ABCDEFG" for d in range(0, 230, 11)]
    asked = spark.createDataFrame(cuts, "ticker string, decision_date date, cutoff timestamp")
    return sorted(B.known_positions(asked, facts).collect())


def test_any_order_and_split_gives_the_same_facts(spark):
    rows = made()
    want = known(spark, spark.createDataFrame(rows, SF.FACTS))
    newest = {}
    for r in rows:
        newest[r[0], r[1]] = max(newest.get((r[0], r[1]), r), r, key=lambda x: x[3])
    for seed, cuts in ((1, 1), (2, 3)):
        own = list(rows)
        random.Random(seed).shuffle(own)
        own += own[:20]
        n = -(-len(own) // cuts)
        out = run(spark, [own[k : k + n] for k in range(0, len(own), n)])
        assert SF.facts(spark, out).count() == len(rows) and SF.rejected(spark, out).count() == 0
        assert known(spark, SF.facts(spark, out)) == want
        assert {(r.symbol, r.settlement_date): tuple(r[n] for n in NAMES) for r in SF.newest(spark, out).select(*NAMES).collect()} == newest


def test_rejects_name_their_reason(spark):
    good = version("A", 0, 9, 5)
    bad = {
        "conflicting_version": version("A", 0, 9, 6),
        "back_dated": version("A", 0, 12, 7, True, seen=30),
        "revision_without_observation": (*version("A", 0, 15, 7, True)[:7], None),
        "available_before_publication": version("A", 0, 3, 8),
        "available_before_settlement": version("A", 0, -3, 8),
        "incomplete": ("A", D, None, at(9), None, False, False, None),
    }
    out = run(spark, [[good], list(bad.values())])
    assert [tuple(r) for r in SF.facts(spark, out).collect()] == [good]
    assert sorted(r.reason for r in SF.rejected(spark, out).collect()) == sorted(bad)
    none = run(spark, [[("A", None, None, None, 1, False, False, None), (None, D, None, at(9), 1, False, False, None)]])
    assert SF.facts(spark, none).count() == 0 and SF.rejected(spark, none).count() == 2


def test_a_batch_that_is_repeated_replaces_itself(spark):
    """A run that wrote its batch and was stopped before its commit is done again."""
    rows = made()[:30]
    incoming, out, work = (FX.scratch(spark, n) for n in ("t-arrivals", "t-facts", "t-work"))
    spark.createDataFrame(rows, SF.FACTS).coalesce(1).write.parquet(incoming)
    SF.stream_facts(spark, incoming, out, work)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{work}/checkpoint/commits/0")
    assert path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)
    SF.stream_facts(spark, incoming, out, work)
    assert {tuple(r) for r in SF.facts(spark, out).collect()} == set(rows) and SF.facts(spark, out).count() == len(rows)
    with pytest.raises(Exception, match="conflicting"):
        known(spark, SF.facts(spark, out).unionByName(spark.createDataFrame([(*rows[0][:4], rows[0][4] + 1, *rows[0][5:])], SF.FACTS)))


def test_versions_are_judged_by_the_bucket(spark):
    """However the symbols are dealt, the facts are the same; a null beside a quantity beyond 2**53 doesn't round it; repeats and conflicts are told apart."""
    big = 2**53 + 1
    good = [version(s, c, 9, big + c) for s in "ABCDEFGH" for c in range(3)]
    late = [version(s, 0, 20, big - 1, True) for s in "ABCD"]
    none = [(*r[:4], None, *r[5:]) for r in good[:2]]
    odd = [version(s, 1, 9, big) for s in "GH"]
    for buckets in (1, 3):
        incoming, out, work = (FX.scratch(spark, n) for n in ("t-arrivals", "t-facts", "t-work"))
        for part in (good[6:] + none, odd + late + good):
            spark.createDataFrame(part, SF.FACTS).coalesce(1).write.mode("append").parquet(incoming)
            SF.stream_facts(spark, incoming, out, work, buckets=buckets)
        assert {tuple(r) for r in SF.facts(spark, out).collect()} == set(good + late) and SF.facts(spark, out).count() == len(good + late)
        told = SF.rejected(spark, out)
        assert {tuple(r) for r in told.filter("reason = 'incomplete'").drop("reason").collect()} == set(none)
        assert {tuple(r) for r in told.filter("reason = 'conflicting_version'").drop("reason").collect()} == set(odd) and told.count() == 4
        assert {(r.symbol, r.settlement_date): r.short_interest for r in SF.newest(spark, out).collect()} == {(r[0], r[1]): r[4] for r in good + late}
