"""What was known when: states as of decisions, statuses by date, repeated bars."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.test_panel_operators import panel, sessions
from tidemark.adapters import driver_tables as T
from tidemark.contract import Contract
from tidemark.operators import backtest as BT
from tidemark.operators import bitemporal as B
from tidemark.operators import features as FE
from tidemark.operators import labels as L
from tidemark.operators import ranking as R
from tidemark.operators import transactions as X
from tidemark.plans import fixtures as FX
from tidemark.sources import archives as RA

FLAGS = ("positive", "completed", "terminated", "supp_completed", "supp_terminated")
T0 = dt.datetime(2020, 1, 1)


def fold(filings, decision_at, lookback):
    """The state after the filings that are known, one by one."""
    start = dt.datetime.combine(decision_at.date() - dt.timedelta(days=lookback), dt.time())
    state = ("none", "no_definitive_transaction_filing", None)
    for f in sorted(filings, key=lambda x: (x["at"], x["acc"])):
        base, late = f["form"].removesuffix("/A"), f["form"].endswith("/A")
        if not start <= f["at"] <= decision_at or base in X.IGNORED_FORMS:
            continue
        end = lambda a, b: ("completed", "transaction_completed") if f[a] else ("terminated", "transaction_terminated_or_withdrawn") if f[b] else None
        active, event = state[0] == "active", None
        if active:
            event = end("completed", "terminated")
        if event is None and base == "SC 14D9":
            if not late:
                event = ("active", "target_tender_offer_form_SC_14D9")
            elif state[0] == "none":
                event = ("unknown", "transaction_amendment_without_base_filing")
        elif event is None and f["positive"]:
            event = ("active", "definitive_target_transaction_language")
        if event is None and active and base in X.TEXT_FORMS:
            event = end("supp_completed", "supp_terminated")
        if event:
            state = (*event, f["acc"])
    return state


def filings_frame(spark, rows):
    cols = ", ".join(f"{c} boolean" for c in FLAGS)
    return spark.createDataFrame([(f["ticker"], f["at"], f["acc"], f["form"], *[f[c] for c in FLAGS]) for f in rows], f"ticker string, accepted_at timestamp, accession_number string, form string, {cols}")


@pytest.mark.parametrize("lookback", [732, 40, 5])
def test_states_equal_the_fold_at_every_decision(spark, lookback):
    rng = random.Random(lookback)
    rows = []
    for t in range(12):
        for k in range(rng.choice([0, 3, 40])):
            at = T0 + dt.timedelta(days=rng.randrange(120), hours=rng.choice([0, 9, 21]))
            rows.append({"ticker": f"T{t}", "at": at, "acc": f"{k:04}", "form": rng.choice(["8-K", "6-K", "8-K", "SC 14D9", "SC 14D9/A", "S-4", "DEFM14A"])} | {c: rng.random() < 0.25 for c in FLAGS})
    decisions = [(f"T{t}", (T0 + dt.timedelta(days=d)).date(), T0 + dt.timedelta(days=d, hours=21)) for t in range(13) for d in range(0, 125, 4)]
    frame = spark.createDataFrame(decisions, "ticker string, decision_date date, decision_at timestamp")
    got = {(r.ticker, r.decision_date): (r.state, r.reason, r.accession_number) for r in X.states_as_of(filings_frame(spark, rows), frame, lookback).collect()}
    assert got == {(t, d): fold([f for f in rows if f["ticker"] == t], at, lookback) for t, d, at in decisions}
    seen = {s for s, _, _ in got.values()}
    assert seen == {"none", "active", "completed", "terminated", "unknown"}
    with pytest.raises(ValueError, match="incomplete"):
        X.states_as_of(filings_frame(spark, rows), frame, lookback, strict=True)
    with pytest.raises(ValueError, match="repeats"):
        X.states_as_of(filings_frame(spark, rows), frame.unionByName(frame.limit(1)), lookback)


def test_flags_of_states_and_retained_names_by_date(spark):
    states = spark.createDataFrame([("A", sessions(2)[0], "active"), ("A", sessions(2)[1], "completed"), ("B", sessions(2)[0], "unknown")], "ticker string, decision_date date, state string")
    assert {(r.ticker, r.decision_date): r.flagged for r in X.status_flags(states).collect()} == {("A", sessions(2)[0]): True, ("A", sessions(2)[1]): False}
    asked = spark.createDataFrame([(t, d) for t in "AB" for d in sessions(2)], "ticker string, decision_date date")
    assert {tuple(r) for r in X.retained(asked, states).collect()} == {("A", sessions(2)[1]), ("B", sessions(2)[0]), ("B", sessions(2)[1])}


def market(spark, n=90):
    return panel(spark, {"SPY": 1.001} | {f"T{i:02}": 1 + (i + 1) / 1000 for i in range(12)} | {"WIN": 1.03}, n)


LOOSE = Contract(min_average_dollar_volume=1.0, min_median_dollar_volume_prior=1.0)


def test_statuses_hold_on_their_own_date_and_a_gap_ends_one_date_alone(spark):
    b, days = market(spark), sessions(90)
    decided = days[-17:-14]
    names = [f"T{i:02}" for i in range(12)] + ["WIN"]
    rows = [(t, d, t == "WIN" and d == decided[1]) for t in names for d in decided if not (d == decided[2] and t == "T03")]
    statuses = spark.createDataFrame(rows, "ticker string, decision_date date, flagged boolean")
    got = {r.decision_date: r for r in BT.backtest(b, LOOSE, 3, statuses).collect()}
    assert [got[d].status for d in decided] == ["VALID", "VALID", "INVALID"]
    assert [got[d].universe_size for d in decided] == [13, 12, 13]
    assert got[decided[2]].invalid_reason == "corporate_action_status_unavailable" and got[decided[2]].outcome_coverage is None
    with pytest.raises(ValueError, match="decision_date"):
        BT.backtest(b, LOOSE, 3, statuses.drop("decision_date").distinct())
    with pytest.raises(ValueError, match="more than once"):
        BT.backtest(b, LOOSE, 3, statuses.unionByName(statuses.limit(1)))


def test_a_name_that_was_flagged_once_comes_back(spark):
    ranking = spark.createDataFrame([(t, d, float(-k), k) for d in sessions(3) for k, t in enumerate("ABCD", 1)], "ticker string, decision_date date, score double, rank int")
    flags = spark.createDataFrame([(t, d, t == "A" and d == sessions(3)[1]) for d in sessions(3) for t in "ABCD"], "ticker string, decision_date date, flagged boolean")
    got = {}
    for r in R.replace_flagged(ranking, flags, 2).orderBy("decision_date", "rank").collect():
        got.setdefault(r.decision_date, []).append(r.ticker)
    assert list(got.values()) == [list("ABCD"), list("BCD"), list("ABCD")]


def test_the_last_of_repeated_bars_counts_and_without_a_sequence_they_are_refused(spark):
    b = panel(spark, {"SPY": 1.001, "A": 1.01}, 70).withColumn("seq", F.lit(2))
    twice = b.filter("ticker = 'A'").withColumns({"close": F.lit(1.0), "seq": F.lit(1)}).unionByName(b)
    clean = {(r.ticker, r.dt): r for r in FE.base_features(b.drop("seq")).collect()}
    for rows in (twice, twice.orderBy("seq", ascending=False)):
        assert {(r.ticker, r.dt): r for r in FE.base_features(FE.with_index(rows, sequence="seq")).select(*FE.base_features(b.drop("seq")).columns).collect()} == clean
    want = sorted(L.forward_labels(b.drop("seq"), Contract()).collect())
    assert sorted(L.forward_labels(FE.with_index(twice, sequence="seq"), Contract()).collect()) == want
    for build in (FE.base_features, lambda x: L.forward_labels(x, Contract()), lambda x: R.rank_dates(x, LOOSE)):
        with pytest.raises(Exception, match="repeats A on"):
            build(twice.drop("seq")).write.format("noop").mode("overwrite").save()


def test_feature_steps_hash_and_read_once(spark, sf, monkeypatch):
    """Neither filings nor transactions are sorted to be made unique; files of positions aren't each summed from the line items."""
    for out in (B.filing_features(T.decisions(spark, sf), T.filings(spark, sf), T.daily_calendar(spark)), B.insider_features(T.decisions(spark, sf), T.insider(spark, sf), T.daily_calendar(spark))):
        assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    read, store = [], RA.store
    monkeypatch.setattr(RA, "store", lambda rows, *a: (read.extend(rows.inputFiles()), store(rows, *a))[1])
    FX.short_interest_read(spark, sf)
    assert read and not [f for f in read if "lineitem" in f]


def test_reports_that_differ_by_an_unknown_plan_clash(spark):
    """One report of a transaction names a plan, the other doesn't say; both leave it open."""
    day, cal = dt.date(1996, 3, 29), T.daily_calendar(spark)
    asked = spark.createDataFrame([("A", day)], "ticker string, decision_date date")
    row = lambda plan, owner: ("A", dt.datetime(1996, 3, 20), "P", 2.0, 3.0, owner, plan, "t")
    of = lambda *rows: B.insider_features(asked, spark.createDataFrame(rows, "ticker string, available_at timestamp, transaction_code string, shares double, price double, insider_id string, is_10b5_1 boolean, transaction_id string"), cal)
    for rows in ((row(None, "x"), row(True, "y")), (row(True, "x"), row(False, "y"))):
        with pytest.raises(Exception, match="conflicting reports"):
            of(*rows).select("form4_non_10b5_1_buy_usd").collect()
    got = of(row(None, "x"), row(None, "y")).first()
    assert (got.form4_open_market_buy_usd, got.form4_unknown_10b5_1_buy_usd, got.form4_10b5_1_buy_usd, got.distinct_insider_buyers) == (6.0, 6.0, 0.0, 2)


def test_the_timeline_is_dealt_by_its_rows(spark, sf, monkeypatch):
    """A task's share of the timeline is bounded by rows, not by a number of parts; the states stay."""
    f, d = FX.deal_filings(spark, sf), FX.deal_decisions(spark, sf)
    want = sorted(map(str, X.states_as_of(f, d).collect()))
    monkeypatch.setattr(X, "_LINE_ROWS", 500)
    out = X.states_as_of(f, d)
    rows = f.count() - f.filter("form = 'S-4'").count() + 2 * d.count()
    assert "hashpartitioning(ticker#" in (plan := out._jdf.queryExecution().executedPlan().toString()) and f", {-(-rows // 500)}), REPARTITION_BY_NUM" in plan
    assert sorted(map(str, out.collect())) == want


def by_ticker(rows):
    """What a plan broadcasts under a ticker."""
    return re.findall(r"HashedRelationBroadcastMode\(List\(input\[\d+, string.*", rows._jdf.queryExecution().executedPlan().toString())


def test_feature_steps_never_broadcast_decisions(spark, sf):
    """A plan takes every ticker at every date for next to nothing, as the dates come from an exploded calendar."""
    asked, cal = T.decisions(spark, sf), T.daily_calendar(spark)
    assert by_ticker(T.filings(spark, sf).join(asked, "ticker"))
    positions = spark.createDataFrame([("S000001", dt.date(1996, 3, 15), dt.datetime(1996, 3, 27), 5.0, False, False)], "symbol string, settlement_date date, available_at timestamp, short_interest double, stock_split_flag boolean, revision_flag boolean")
    volumes = asked.withColumn("average_daily_volume", F.lit(2.0))
    for out in (
        B.filing_features(asked, T.filings(spark, sf), cal), B.insider_features(asked, T.insider(spark, sf), cal), B.window_coverage(asked, T.coverage(spark, sf), cal, "filings"),
        FX.event_features(spark, sf), B.short_interest_features(asked, positions, cal, volumes),
    ):
        assert not by_ticker(out)


def test_plans_of_external_features_scan_what_was_made_once(spark, sf):
    """Neither calendar nor decisions are made within them; where all event features are read, the trades aren't there either."""
    for whole in (False, True):
        plan = FX.external(spark, sf, whole)._jdf.queryExecution().executedPlan().toString()
        assert "weekday" not in plan and ("l_partkey" in plan) != whole


def test_a_panel_is_enriched_without_broadcasts_of_it(spark, sf, monkeypatch):
    """Neither where its keys are checked nor where it gets the features."""
    asked, kind, seen = T.decisions(spark, sf), type(spark.range(1)), []
    empty = kind.isEmpty
    monkeypatch.setattr(kind, "isEmpty", lambda rows: (seen.extend(by_ticker(rows)), empty(rows))[1])
    # These features are derived from the decisions, so a plan takes them for next to nothing as well.
    out = B.enrich(asked, asked.filter("decision_date > '1998-01-01'").withColumn("x", F.lit(1.5)), "s1")
    assert not seen and not by_ticker(out)
    got = out.groupBy("x").count().collect()
    assert {r.x for r in got} == {0.0, 1.5} and sum(r["count"] for r in got) == asked.count()
    with pytest.raises(ValueError, match="outside the panel"):
        B.enrich(asked.filter("decision_date > '1998-01-01'"), asked.withColumn("x", F.lit(1.5)), "s1")


def test_coverage_of_windows_counts_sessions_by_hand(spark):
    """Touching, overlapping, broken and unordered intervals against a count of the window's sessions; a decision that comes twice is one."""
    cal, draw = T.daily_calendar(spark), random.Random(4)
    days = [r.session for r in cal.orderBy("idx").collect()]
    some, rows = days[100:180], []
    for k in range(60):
        for _ in range(draw.randrange(0, 5)):
            a = some[0] + dt.timedelta(draw.randrange(0, 110))
            rows.append((f"T{k}", "filings", a, a + dt.timedelta(draw.choice((-3, 0, 2, 10, 40, 90))), draw.choice(("complete", "complete", "complete", "partial", "missing"))))
    rows.append(("T0", "insider", days[0], days[-1], "complete"))
    asked = [(f"T{k}", days[i]) for k in range(61) for i in (5, 120, 131, 150, 170)]
    cover = spark.createDataFrame(rows, "ticker string, source string, coverage_start date, coverage_end date, status string")
    out = B.window_coverage(spark.createDataFrame(asked + asked[:7], "ticker string, decision_date date"), cover, cal, "filings", 10).collect()
    assert len(out) == len(asked)
    for r in out:
        i, own = days.index(r.decision_date), [x for x in rows if x[0] == r.ticker and x[1] == "filings"]
        window = days[max(0, i - 9) : i + 1]
        held = lambda kinds: [d for d in window if any(x[2] <= d <= x[3] for x in own if x[4] in kinds)]  # noqa: B023, E731
        status = "complete" if len(held(("complete",))) == 10 else "partial" if held(("complete", "partial")) else "missing"
        assert (r.status, r.start, r.end) == (status, min((x[2] for x in own), default=None), max((x[3] for x in own), default=None)), r
    assert {r.status for r in out} == {"complete", "partial", "missing"}
