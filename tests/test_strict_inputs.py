"""What readers and builders refuse, and archives as of a date."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.test_panel_operators import panel, sessions
from tidemark.contract import FIXTURE_RESEARCH, Contract
from tidemark.functions import scalars as S
from tidemark.operators import bitemporal as B
from tidemark.operators import calendar as C
from tidemark.operators import evaluation as E
from tidemark.operators import research as K
from tidemark.operators import worklist as W
from tidemark.plans import fixtures as FX
from tidemark.sources import archives as RA
from tidemark.sources import readers as RD


def values(spark, expression, texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(expression(F.col("t"))).collect()]


def test_flags_and_counts(spark):
    texts = ["y", "YES", " true ", "1", "n", "No", "false", "0", "", None, "R", "revised", "S", "maybe"]
    plain = [True] * 4 + [False] * 6 + [None] * 4
    assert values(spark, S.flag, texts) == plain
    assert values(spark, lambda c: S.flag(c, S.REVISED_YES), texts) == [*plain[:10], True, True, None, None]
    assert values(spark, lambda c: S.flag(c, S.SPLIT_YES), texts) == [*plain[:10], None, None, True, None]
    assert values(spark, lambda c: S.flag(c, S.YES, S.NO), texts)[8:10] == [None, None]
    counts = ["12", "1,234", "12.5", "1e3", "-1", "", None, "9007199254740993", "9223372036854775807", "9223372036854775808", "٣"]
    assert values(spark, S.count, counts) == [12, 1234, None, None, None, None, None, 9007199254740993, 9223372036854775807, None, None]
    assert values(spark, S.bad_count, counts) == [False, False, True, True, True, False, False, False, False, True, True]


def month(spark):
    days = [(d, k, dt.datetime.combine(d, dt.time(21))) for k, d in enumerate(sessions(60))]
    return spark.createDataFrame(days, "session date, idx long, close_ts timestamp")


def short_file(spark, *lines):
    return FX.lines(spark.createDataFrame([(x,) for x in ("symbol|shortInterest|splitFlag|revisionFlag|settlementDate", *lines)], "value string").coalesce(1), "short")


def test_short_interest_is_never_known_early(spark):
    cal, days = month(spark), sessions(60)
    pub = spark.createDataFrame([(days[10], days[17]), (days[20], days[19])], "settlement_date date, publication_date date")
    row = lambda flag, day=days[10], n="5": f"A|{n}|N|{flag}|{day}"
    read = lambda *lines, **k: RD.short_interest_file(spark, short_file(spark, *lines), cal, pub, **k)
    close = lambda k: dt.datetime.combine(days[k], dt.time(21))
    assert read(row("N")).first().available_at == close(18)
    late = F.lit(days[30])
    assert {r.short_interest: r.available_at for r in read(row("N"), row("R", n="6"), row("REVISED", n="7"), observed_at=late).collect()} == {5: close(18), 6: close(31), 7: close(31)}
    assert read(row("R"), observed_at=F.lit(days[12])).first().available_at == close(18)
    for bad, what in ((row("R"), "without observation"), (row("N", days[11]), "without publication"), (row("N", days[20]), "before settlement"), (row("N", n="1.5"), "short_interest"), (row("S"), "revision_flag"), ("|5|N|N|2025-01-15", "symbol")):
        with pytest.raises(ValueError, match=what):
            read(bad)
    for loose in (row("R"), row("N", days[11]), row("N", days[20])):
        assert read(loose, strict=False).first().available_at is None


def test_positions_and_decisions_are_checked(spark):
    cal, days = month(spark), sessions(60)
    kind = "symbol string, settlement_date date, available_at timestamp, short_interest long, stock_split_flag boolean, revision_flag boolean"
    good = ("A", days[2], dt.datetime.combine(days[10], dt.time(21)), 5, False, False)
    asked = spark.createDataFrame([("A", days[20]), ("B", days[20])], "ticker string, decision_date date")
    run = lambda *rows, d=asked: B.short_interest_features(d, spark.createDataFrame(list(rows), kind), cal).collect()
    assert {r.ticker: r.short_interest for r in run(good, good)} == {"A": 5, "B": None}
    for bad in ((*good[:3], 6, False, False), (*good[:3], 5, True, False)):
        with pytest.raises(Exception, match="conflicting short-interest positions of A"):
            run(good, bad)
    for bad in ((*good[:2], None, *good[3:]), (*good[:3], -1, False, False), (*good[:4], None, False), (good[0], None, *good[2:]), ("A", days[30], *good[2:])):
        with pytest.raises(Exception, match="position is invalid"):
            run(bad)
    with pytest.raises(ValueError, match="repeats"):
        run(good, d=asked.unionByName(asked))
    with pytest.raises(ValueError, match="no session"):
        run(good, d=spark.createDataFrame([("A", dt.date(2025, 1, 4))], "ticker string, decision_date date"))
    with pytest.raises(ValueError, match="zone"):
        B.known_positions(asked.withColumn("cutoff", F.lit("2025-02-01").cast("timestamp")), spark.createDataFrame([good], kind).withColumn("available_at", F.col("available_at").cast("timestamp_ntz")))


def test_events_are_checked(spark):
    cal, days = month(spark), sessions(60)
    asked = spark.createDataFrame([("A", days[59])], "ticker string, decision_date date")
    kind = "ticker string, available_at timestamp, transaction_code string, shares double, price double, insider_id string, is_10b5_1 boolean, transaction_id string"
    buy = ("A", dt.datetime.combine(days[50], dt.time(9)), "P", 10.0, 5.0, "i1", True, "t1")
    joint = (*buy[:5], "i2", *buy[6:])
    run = lambda *rows: B.insider_features(asked, spark.createDataFrame(list(rows), kind), cal, 60).first()
    r = run(buy, joint)
    assert (r.form4_open_market_buy_usd, r.form4_10b5_1_buy_usd, r.distinct_insider_buyers) == (50.0, 50.0, 2)
    for bad in ((*joint[:3], 20.0, *joint[4:]), (*joint[:6], False, "t1"), (*joint[:6], None, "t1")):
        with pytest.raises(Exception, match="conflicting reports of transaction t1"):
            run(buy, bad)
    filings = spark.createDataFrame([("A", buy[1], "8-K", "", "a1")], "ticker string, available_at timestamp, form string, items string, accession_number string")
    cover = spark.createDataFrame([("A", s, days[0], days[59], "complete") for s in ("filings", "insider")], "ticker string, source string, coverage_start date, coverage_end date, status string")
    trades = spark.createDataFrame([buy], kind)
    assert B.event_features(asked, filings, trades, cover, cal).first().sec_coverage == "complete"
    for decisions, what in ((asked.unionByName(asked), "repeats"), (asked.withColumn("decision_date", F.lit(dt.date(2025, 1, 4))), "no session")):
        with pytest.raises(ValueError, match=what):
            B.event_features(decisions, filings, trades, cover, cal)


def test_bootstraps_need_whole_blocks(spark):
    d = spark.createDataFrame([(x, 0.1, 0.2, 0.1, 0.1, 0.1, 0.1, 0.0, 0.0, 0.0) for x in sessions(14)], "decision_date date, c_precision_at_10 double, i_precision_at_10 double, c_downside_at_10 double, i_downside_at_10 double, c_catastrophic_loss_at_10 double, i_catastrophic_loss_at_10 double, c_basket_return double, i_basket_return double, spy_return_20d double")
    for f in (K.bootstrap, K.tail_bootstrap):
        with pytest.raises(ValueError, match="horizon"):
            f(d, FIXTURE_RESEARCH, Contract())
        with pytest.raises(ValueError, match="five"):
            f(d, FIXTURE_RESEARCH, Contract(horizon=3))


def test_evidence_by_strategy_and_only_what_is_due(spark):
    days = sessions(20)
    rows = [(s, d, r, n, None if (s, d, r) == ("new", days[1], 1) else 0.1) for s, n in (("old", 10), ("new", 10), ("few", 4)) for d in (days[0], days[1], days[10]) for r in range(1, n + 1)]
    led = spark.createDataFrame(rows, "strategy_version string, decision_date date, rank int, universe_size long, forward_return double")
    done = led.select("strategy_version", "decision_date").distinct()
    cal = C.indexed(spark.createDataFrame([(d,) for d in days], "session date"))
    got = {(r.strategy_version, r.decision_date): r.status for r in E.evidence(led, done, Contract(horizon=5), cal, spark.createDataFrame([(days[12],)], "session date")).collect()}
    assert got == {(s, d): "EVALUATED" for s in ("old", "new") for d in days[:2]} | {("few", d): "eligible_universe_below_top_10" for d in days[:2]} | {("new", days[1]): "top_10_outcomes_incomplete"}


def test_archives_as_of_a_date(spark):
    root = FX.scratch(spark, "t-archive")
    text = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    a = RA.store(text("one"), root, "notes", "1998Q1", "2020-01-05")
    assert RA.store(text("one"), root, "notes", "1998Q1", "2020-01-05") == a
    b = RA.store(text("one", "two"), root, "notes", "1998Q1", "2020-03-01")
    RA.store(text("x"), root, "notes", "1998Q2", "2020-02-01")
    ledger = RA.versions(spark, root)
    assert ledger.count() == 3
    at = lambda day: {r.period: r.observed_at for r in RA.latest(ledger, "notes", day).collect()}
    assert at("2020-01-31") == {"1998Q1": dt.date(2020, 1, 5)} and at("2020-03-01") == {"1998Q1": dt.date(2020, 3, 1), "1998Q2": dt.date(2020, 2, 1)} and at("2019-01-01") == {}
    assert a != b and RA.latest(ledger, "other", "2021-01-01").count() == 0
    bad = FX.scratch(spark, "t-archive")
    RA.store(text("Last Data Received: March 31, 1998"), bad, "filing-index", "1998Q1", "1998-03-01")
    with pytest.raises(ValueError, match="after its own observation"):
        RA.index_receptions(spark, bad, "1998-06-01")


def test_the_work_list_is_judged_by_the_calendar(spark):
    b = panel(spark, {"SPY": 1.001, "A": 1.01, "B": 1.0}, 60, {("B", 58), ("B", 59)})
    cal = month(spark).unionByName(spark.createDataFrame([(dt.date(2025, 3, 31), 60, dt.datetime(2025, 3, 31, 21))], "session date, idx long, close_ts timestamp"))
    names = spark.createDataFrame([(x,) for x in ("SPY", "A", "B", "C")], "ticker string")
    last = sessions(60)[-1]
    plan = lambda now, need=None, share=0.9: {r.ticker: (r.start, r.actions) for r in W.sync_plan(b, names, cal, F.lit(now).cast("timestamp"), need, 10, 20, share).collect()}
    back, week = dt.timedelta(days=210), dt.timedelta(days=7)
    fresh = dt.date(2025, 3, 27)
    assert plan("2025-03-27 12:00:00") == {"B": (fresh - back, ["backfill"]), "C": (fresh - back, ["backfill"])}
    assert plan("2025-03-27 12:00:00", share=0.5) == {}
    stale = dt.date(2025, 4, 1)
    assert plan("2025-04-01 12:00:00", share=0.5) == {"SPY": (last - week, ["refresh"]), "A": (last - week, ["refresh"]), "B": (stale - back, ["backfill"]), "C": (stale - back, ["backfill"])}
    need = spark.createDataFrame([("A", sessions(60)[3], last), ("A", sessions(60)[9], dt.date(2030, 1, 1)), ("OLD", sessions(60)[5], dt.date(2030, 1, 1))], "ticker string, decision_date date, result_date date")
    got = plan("2025-03-27 12:00:00", need, 0.5)
    assert got["A"] == (sessions(60)[3] - week, ["outcome"]) and got["OLD"] == (sessions(60)[5] - week, ["outcome"]) and got["B"][1] == ["backfill"]
    assert not W.sync_status(b, names, cal, F.lit("2025-04-01").cast("timestamp"), 10).first().fresh
    assert W.sync_plan(b.filter("ticker = 'A'"), names, cal, F.lit("2025-03-27").cast("timestamp")).filter("actions = array('backfill')").count() == 4
