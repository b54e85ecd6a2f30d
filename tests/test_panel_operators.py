import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.contract import FIXTURE_RESEARCH, Contract, ResearchConfig
from tidemark.functions import scalars as S
from tidemark.operators import bitemporal as B
from tidemark.operators import calendar as C
from tidemark.operators import evaluation as E
from tidemark.operators import features as FE
from tidemark.operators import labels as L
from tidemark.operators import panel as P
from tidemark.operators import ranking as R
from tidemark.operators import research as K
from tidemark.operators import transactions as X

DAY0 = dt.date(2025, 1, 1)


def sessions(n, start=DAY0):
    out, d = [], start
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += dt.timedelta(days=1)
    return out


def panel(spark, growth, n=75, skip=(), volume=lambda t, i: 1_000_000 + 1000 * i):
    days = sessions(n)
    rows = [(t, d, 0.995 * c, 1.015 * c, 0.985 * c, c, c, volume(t, i)) for t, g in growth.items() for i, d in enumerate(days) for c in [100.0 * g**i] if (t, i) not in skip]
    return spark.createDataFrame(rows, "ticker string, dt date, open double, high double, low double, close double, raw_close double, volume long")


def at(df, ticker, day):
    return df.filter((F.col("ticker") == ticker) & (F.col("dt") == F.lit(day))).first()


def test_base_features_have_their_analytic_values(spark):
    f = FE.base_features(panel(spark, {"SPY": 1.001, "WIN": 1.01}, 60))
    r = at(f, "WIN", sessions(60)[-1])
    assert r.history_complete_60d and r.return_5d == pytest.approx(1.01**5 - 1) and r.distance_to_60d_high == 0
    assert r.relative_strength_20d == pytest.approx(1.01**20 - 1.001**20)
    assert r.average_volume_20d == pytest.approx(np.mean([1_000_000 + 1000 * i for i in range(40, 60)]))
    dollars = [100 * 1.01**i * (1_000_000 + 1000 * i) for i in range(39, 59)]
    assert r.median_dollar_volume_prior_20d == pytest.approx(np.median(dollars)) and r.valid_price_volume_sessions_prior_20d == 20
    assert r.volume_zscore_20 == pytest.approx(9.5 / np.std(range(20), ddof=1))
    early = at(f, "WIN", sessions(60)[10])
    assert early.average_dollar_volume_20d is None and early.volume_zscore_20 == 0.0 and early.median_dollar_volume_prior_20d is not None and not early.history_complete_60d


def test_a_gap_breaks_history_and_the_future_changes_nothing(spark):
    days = sessions(62)
    f = FE.base_features(panel(spark, {"SPY": 1.001, "A": 1.01}, 62, {("A", 30)}))
    assert not at(f, "A", days[-1]).history_complete_60d and at(f, "SPY", days[-1]).history_complete_60d
    whole, part = (FE.research_features(panel(spark, {"SPY": 1.001, "A": 1.01, "B": 0.99}, n)) for n in (75, 70))
    a, b = (sorted(map(str, x.filter(F.col("dt") <= F.lit(days[61])).select("ticker", "dt", *FE.STOCK_FEATURES).collect())) for x in (whole, part))
    assert a == b


def test_research_features(spark):
    f = FE.research_features(panel(spark, {"SPY": 1.001, "A": 1.01}, 75))
    r = at(f, "A", sessions(75)[-1])
    assert r.return_59d == pytest.approx(1.01**59 - 1) and r.momentum_20d_ex_last_5d == pytest.approx(1.01**15 - 1)
    assert r.trend_efficiency_20d == pytest.approx(1) and r.positive_day_fraction_20d == 1 and r.realized_volatility_20d == 0 and r.jump_ratio_20d == 0
    assert r.close_location_mean_5d == pytest.approx(0.5) and r.parkinson_range_20d == pytest.approx(math.log(1.015 / 0.985) ** 2) and r.beta_40d == 0
    x = FE.cross_sectional_ranks(f.filter(F.col("dt") == F.lit(sessions(75)[-1])), ("return_5d",))
    assert {(q.ticker, q.xrank_return_5d) for q in x.collect()} == {("SPY", -1.0), ("A", 1.0)}


def test_scores_average_ties(spark):
    rows = [("A", 0.1, 0.1, -0.2, 0.0, 0.1), ("B", 0.3, 0.2, -0.1, 1.0, 0.2), ("C", 0.1, 0.1, -0.2, None, 0.1)]
    d = spark.createDataFrame([(t, DAY0, *v) for t, *v in rows], "ticker string, dt date, " + ", ".join(f"{s} double" for s in R.SIGNALS))
    got = [(r.ticker, r.score, r["rank"]) for r in R.score(d).orderBy("rank").collect()]
    assert got == [("B", 3.0, 1), ("A", 1.5, 2), ("C", 1.5, 3)]


def test_ranking_gates(spark):
    c = Contract(min_average_dollar_volume=1e6, min_median_dollar_volume_prior=1e6)
    p = panel(spark, {"SPY": 1.001, "HIGH": 1.02, "MID": 1.01, "LOW": 1.03}, 61, volume=lambda t, i: 10 if t == "LOW" else 1_000_000)
    assert [r.ticker for r in R.rank_latest(p, c).orderBy("rank").collect()] == ["HIGH", "MID"]
    assert R.rank_latest(p.filter("ticker != 'SPY' OR dt < '2025-02-01'"), c).isEmpty()
    reasons = {r.reason for r in R.benchmark_reason(FE.base_features(p), Contract()).collect()}
    assert reasons == {"insufficient_history", None}
    with pytest.raises(ValueError):
        P.require_benchmark(p.filter("ticker != 'SPY'"))


def loop_replace(ranked, flagged, n):
    kept, clean = [], 0
    for t in ranked:
        if clean < n and flagged[t]:
            continue
        clean += not flagged[t]
        kept.append(t)
    return kept


def test_replacement_equals_the_walk(spark):
    rng = random.Random(3)
    for n in (1, 3, 6):
        names = [f"T{i:02}" for i in range(14)]
        flagged = {t: rng.random() < 0.4 for t in names}
        ranking = spark.createDataFrame([(t, DAY0, float(-i), i + 1) for i, t in enumerate(names)], "ticker string, decision_date date, score double, rank long")
        st = spark.createDataFrame(list(flagged.items()), "ticker string, flagged boolean")
        assert [r.ticker for r in R.replace_flagged(ranking, st, n).orderBy("rank").collect()] == loop_replace(names, flagged, n)
    with pytest.raises(ValueError):
        R.replace_flagged(ranking, st.limit(2), 14)


def test_blend_and_risk_rerank_equal_their_definitions(spark):
    rng = random.Random(5)
    rows = [(DAY0 + dt.timedelta(days=d), f"T{i:02}", rng.choice([0.1, 0.2, 0.3, rng.random()]), rng.random()) for d in range(3) for i in range(12)]
    f = spark.createDataFrame(rows, "decision_date date, ticker string, boom double, risk double")
    for strength, top in ((0.0, 10), (1.0, 10), (2.0, 11), (3.0, 30)):
        got = {(r.decision_date, r.ticker): r.adjusted for r in R.risk_adjusted(f, "boom", "risk", strength, top).collect()}
        for day in {r[0] for r in rows}:
            own = [r[1:] for r in rows if r[0] == day]
            order = sorted(own, key=lambda r: (-r[1], r[0]))
            place = {r[0]: i + 1 for i, r in enumerate(order)}
            pool = order[:top]
            quarter = {r[0]: min(3, 4 * i // len(pool)) for i, r in enumerate(sorted(pool, key=lambda r: (r[2], r[0])))}
            final = sorted(pool, key=lambda r: (place[r[0]] + min(strength, quarter[r[0]]), r[2], place[r[0]], r[0])) + order[top:]
            assert [got[day, r[0]] for r in final] == [-float(i + 1) for i in range(len(final))]
    b = R.blend(f, "boom", "risk", 1.0).orderBy("decision_date", F.col("risk").desc()).collect()
    assert [r.blend for r in b[:12]] == pytest.approx([1 - i / 11 for i in range(12)])
    assert R.blend(f.limit(1), "boom", "risk", 0.5).first().blend == 1.0


def test_labels_need_the_exact_session(spark):
    c = Contract()
    lab = L.forward_labels(panel(spark, {"SPY": 1.0, "WIN": 1.02}, 29), c)
    r = at(lab, "WIN", sessions(29)[0])
    assert r.result_date == sessions(29)[14] and r.forward_return == pytest.approx(1.02**14 - 1) and r.future_min_close == pytest.approx(102)
    lab = L.forward_labels(panel(spark, {"SPY": 1.0, "WIN": 1.02}, 29, {("WIN", 14)}), c)
    assert at(lab, "WIN", sessions(29)[0]) is None
    lab = L.forward_labels(panel(spark, {"SPY": 1.0, "WIN": 1.02}, 29, {("WIN", 7)}), c)
    assert at(lab, "WIN", sessions(29)[0]).max_adverse_return is None and at(lab, "WIN", sessions(29)[8]).max_adverse_return is not None


def ledger(spark, returns, day=DAY0, size=None):
    rows = [("s", f"T{i:02}", day, i + 1, size or len(returns), r, -0.2 if r is not None and r < 0 else 0.0) for i, r in enumerate(returns)]
    return spark.createDataFrame(rows, "strategy_version string, ticker string, decision_date date, rank long, universe_size long, forward_return double, max_adverse_return double")


def test_thresholds_and_daily_metrics(spark):
    c = Contract()
    returns = [0.5 if i == 3 else -0.3 if i == 0 else -0.12 if i == 1 else 0.01 for i in range(20)]
    m = L.mature(ledger(spark, returns), c)
    assert {r.hit_threshold for r in m.collect()} == {0.15} and m.filter("is_explosion").count() == 1
    d = E.daily_rankings(m, c).first()
    assert (d.precision_at_k, d.base_explosion_rate, d.downside_at_k, d.catastrophic_loss_at_k, d.adverse_path_at_k, d.passed) == (0.1, 0.05, 0.2, 0.1, 0.2, True)
    m = L.mature(ledger(spark, [*returns[:-1], None]), c)
    assert m.filter("is_explosion IS NOT NULL").isEmpty() and E.daily_rankings(m, c).isEmpty()
    cal = C.indexed(spark.createDataFrame([(DAY0 + dt.timedelta(days=i),) for i in range(40)], "session date"))
    latest = cal.agg(F.max("session").alias("session"))
    status = lambda rs, **k: E.evidence(L.mature(ledger(spark, rs, **k), c), E.daily_rankings(L.mature(ledger(spark, rs, **k), c), c), c, cal, latest).first().status
    assert status(returns) == "EVALUATED" and status(returns[:9]) == "eligible_universe_below_top_10" and status([*returns[:-1], None]) == "complete_universe_outcomes_required"
    assert status([None, *returns[1:]]) == "top_10_outcomes_incomplete" and status([*returns[:10], *[None] * 10]) == "outcome_coverage_below_90pct"
    with pytest.raises(ValueError):
        Contract(severe_return=0.1)


def test_nearest_rank_threshold_against_sorting(spark):
    rng = random.Random(1)
    for n in (10, 19, 20, 21, 40):
        rs = [rng.random() for _ in range(n)]
        assert L.thresholds(ledger(spark, rs), Contract()).first().hit_threshold == max(0.15, sorted(rs)[math.ceil(n * 0.95) - 1])


def test_streaks_and_shortfall(spark):
    days = sessions(8)
    rows = [("s", d, p) for d, p in zip(days, [True, True, False, True, True, True, True, True])]
    daily = spark.createDataFrame(rows, "strategy_version string, decision_date date, passed boolean")
    cal = C.indexed(spark.createDataFrame([(d,) for d in days], "session date"))
    assert E.longest_streak(daily, cal).first().longest_streak == 5
    assert E.longest_streak(daily.filter(F.col("decision_date") != F.lit(days[5])), cal).first().longest_streak == 2
    v = spark.createDataFrame([("s", float(i)) for i in range(11)], "s string, v double")
    assert E.shortfall(v, "v", ["s"], 0.1).first().expected_shortfall == 0.5


def test_panel_hygiene(spark):
    p = panel(spark, {"SPY": 1.0}, 5)
    bad = p.withColumn("close", F.when(F.dayofmonth("dt") == 2, F.lit(float("nan"))).otherwise(F.col("close")))
    with pytest.raises(ValueError):
        P.checked_bars(bad)
    assert P.checked_bars(bad, "drop").count() == 4 and P.checked_bars(p).count() == 5
    d = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("b", 1, "y")], "k string, seq int, v string")
    assert {tuple(r) for r in P.keep_last(d, ["k"], "seq").select("k", "v").collect()} == {("a", "x"), ("b", "y")}
    assert [r.k for r in P.conflicts(d, ["k"], ["v"]).collect()] == ["a"] and P.duplicates(d, ["k"]).first().k == "a"
    with pytest.raises(ValueError):
        P.join_checked(d, d.select("k"), ["k"])
    assert P.union_all(d, d.select("k", F.col("seq").cast("long").alias("seq")), relaxed=True).count() == 6
    assert P.ready_tickers(p, 5).count() == 1 and P.ready_tickers(p, 6).count() == 0


def fold_states(filings):
    """The state machine as a loop over an issuer's filings in order."""
    state, reason = "none", "no_definitive_transaction_filing"
    for form, pos, fin, trm, sfin, strm in filings:
        if form in ("SC TO", "S-4"):
            continue
        event = None
        if state == "active" and (fin or trm):
            event = "completed" if fin else "terminated"
        elif form == "SC 14D9":
            event = "active"
        elif form == "SC 14D9/A":
            event = "unknown" if state == "none" else None
        elif pos:
            event = "active"
        if event is None and state == "active" and form in ("8-K", "6-K") and (sfin or strm):
            event = "completed" if sfin else "terminated"
        if event:
            state, reason = event, form
    return state


def test_transaction_states_equal_the_fold(spark):
    rng = random.Random(8)
    issuers = {f"I{k}": [(rng.choice(["8-K", "8-K", "DEFM14A", "SC 14D9", "SC 14D9/A", "SC TO", "6-K"]), *[rng.random() < 0.3 for _ in range(5)]) for _ in range(rng.randint(0, 9))] for k in range(400)}
    rows = [(t, dt.datetime(2025, 1, 1) + dt.timedelta(hours=i), f"{i:03}", *f) for t, fs in issuers.items() for i, f in enumerate(fs)]
    f = spark.createDataFrame(rows, "ticker string, accepted_at timestamp, accession_number string, form string, positive boolean, completed boolean, terminated boolean, supp_completed boolean, supp_terminated boolean")
    got = {r.ticker: r.state for r in X.transaction_states(f, spark.createDataFrame([(t,) for t in issuers], "ticker string")).collect()}
    assert got == {t: fold_states(fs) for t, fs in issuers.items()}
    with pytest.raises(ValueError):
        X.transaction_states(f, f.select("ticker"), strict=True)


def test_transaction_wording(spark):
    texts = [("The Company will be acquired by Parent.", (True, False, False)), ("the parties completed the merger today", (False, True, False)), ("mutually agreed to terminate the planned merger", (False, False, True)), ("each outstanding share was\nconverted into the right to receive cash", (True, False, False)), (None, (False, False, False))]
    got = X.with_events(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, text string")).orderBy("i").collect()
    assert [(r.positive, r.completed, r.terminated) for r in got] == [w for _, w in texts]


def test_parsers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(S.ticker(F.lit(" brk.b "))) == "BRK-B" and one(S.ticker(F.lit("a b"))) is None
    assert one(S.items(F.lit("2.02, 9.01;2.02 12.034"))) == ["2.02", "9.01", "12.034"]
    assert [one(S.date(F.lit(x))) for x in ("2025-02-03", "20250203", "02/03/2025", "03-FEB-2025", "February 3, 2025")] == [dt.date(2025, 2, 3)] * 5 and one(S.date(F.lit("3.2.25"))) is None
    assert one(S.number(F.lit("1,234"))) == 1234 and one(S.number(F.lit("-1"))) is None and one(S.number(F.lit(""))) is None
    assert one(S.instant(F.lit("2025-01-02T10:00:00-05:00"))) == one(S.instant(F.lit("20250102100000"))) and one(S.instant(F.lit("2025-01-02T10:00:00"))) is None
    assert one(S.html_text(F.lit("<p>a &eacute;<script>x</script> b&nbsp;c</p>"))) == "a é b c" and one(S.html_text(F.lit("<p> </p>"))) is None
    assert one(S.clip(F.lit(None).cast("double"), 0.0, 1.0)) is None and one(S.security_type(F.lit("X Corp Warrants"), F.lit("N"), F.lit("N"))) == "warrant"


def small_calendar(spark, n=200):
    days = sessions(n, dt.date(2024, 1, 1))
    return C.indexed(spark.createDataFrame([(d,) for d in days], "session date")).withColumn("close_ts", F.col("session").cast("timestamp") + F.expr("INTERVAL 21 HOURS")), days


def test_events_after_the_close_belong_to_the_next_session(spark):
    cal, days = small_calendar(spark)
    fri = next(d for d in days if d.weekday() == 4)
    stamps = [dt.datetime.combine(fri, dt.time(20)), dt.datetime.combine(fri, dt.time(21)), dt.datetime.combine(fri, dt.time(21, 0, 1)), dt.datetime.combine(fri + dt.timedelta(days=1), dt.time(3)), dt.datetime(2031, 1, 1)]
    ev = spark.createDataFrame([(i, t) for i, t in enumerate(stamps)], "i int, available_at timestamp")
    got = [r.session for r in C.effective_session(ev, cal).orderBy("i").collect()]
    assert got == [fri, fri, fri + dt.timedelta(days=3), fri + dt.timedelta(days=3), None]
    nxt = C.next_session(spark.createDataFrame([(fri,)], "d date"), cal, "d").first().next_session
    assert nxt == fri + dt.timedelta(days=3)


def test_late_revisions_replace_their_own_cycle_alone(spark):
    cal, days = small_calendar(spark)
    ts = lambda i: dt.datetime.combine(days[i], dt.time(12))
    pos = spark.createDataFrame([("A", days[10], ts(17), 100.0, False, False), ("A", days[20], ts(27), 150.0, False, False), ("A", days[10], ts(40), 120.0, False, True)], "symbol string, settlement_date date, available_at timestamp, short_interest double, stock_split_flag boolean, revision_flag boolean")
    dec = spark.createDataFrame([("A", days[i]) for i in (16, 18, 30, 45, 90)] + [("B", days[30])], "ticker string, decision_date date")
    got = {(r.ticker, r.decision_date): (r.short_interest, r.short_interest_delta and round(r.short_interest_delta, 6)) for r in B.short_interest_features(dec, pos, cal).collect()}
    assert got == {("A", days[16]): (None, None), ("A", days[18]): (100.0, None), ("A", days[30]): (150.0, 0.5), ("A", days[45]): (150.0, 0.25), ("A", days[90]): (None, None), ("B", days[30]): (None, None)}


def test_missing_coverage_is_null_and_complete_coverage_zero(spark):
    cal, days = small_calendar(spark)
    d = spark.createDataFrame([("A", days[100]), ("B", days[100]), ("C", days[100])], "ticker string, decision_date date")
    iv = [("A", s, days[0], days[150], "complete") for s in ("filings", "insider")] + [("B", s, days[60], days[150], "complete") for s in ("filings", "insider")]
    cov = spark.createDataFrame(iv, "ticker string, source string, coverage_start date, coverage_end date, status string")
    fil = spark.createDataFrame([("B", dt.datetime.combine(days[90], dt.time(3)), "8-K", "2.02", "x")], "ticker string, available_at timestamp, form string, items string, accession_number string")
    ins = spark.createDataFrame([("A", dt.datetime.combine(days[90], dt.time(3)), "P", 10.0, 2.0, o, None, "t1") for o in ("p", "q")], "ticker string, available_at timestamp, transaction_code string, shares double, price double, insider_id string, is_10b5_1 boolean, transaction_id string")
    got = {r.ticker: r for r in B.event_features(d, fil, ins, cov, cal).collect()}
    assert (got["A"].sec_coverage, got["A"].current_report_count, got["A"].form4_open_market_buy_usd, got["A"].distinct_insider_buyers, got["A"].cluster_buy) == ("complete", 0, 20.0, 2, True)
    assert (got["B"].sec_coverage, got["B"].current_report_count) == ("partial", None) and (got["C"].sec_coverage, got["C"].distinct_insider_buyers) == ("missing", None)


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(3)
    rows = [(DAY0 + dt.timedelta(days=int(d)), bool(rng.random() < 0.4), *map(float, rng.normal(size=3))) for d in rng.integers(0, 6, 80)]
    f = spark.createDataFrame(rows, "decision_date date, is_explosion boolean, a double, b double, c double")
    r = K.RidgeRanker(["a", "b", "c"], 10.0).fit(f)
    x = np.array([[1.0, *q[2:]] for q in rows])
    y = np.array([float(q[1]) for q in rows])
    days = [q[0] for q in rows]
    w = np.array([1 / days.count(d) for d in days])
    for k in (0, 1):
        w[y == k] *= 0.5 / w[y == k].sum()
    w *= len(rows)
    want = np.linalg.solve(x.T @ (x * w[:, None]) + np.diag([0, 10.0, 10.0, 10.0]), x.T @ (w * y))
    assert r.weights == pytest.approx(want)
    got = sorted(q[0] for q in f.select(r.expression()).collect())
    assert got == pytest.approx(sorted(x @ want))
    with pytest.raises(ValueError):
        K.RidgeRanker(["a"]).fit(f.filter("is_explosion"))
    assert K.date_weights(f).agg(F.avg("weight")).first()[0] == pytest.approx(1)


def test_folds_are_purged(spark):
    days = sessions(120)
    q = spark.createDataFrame([(d, days[i + 3], True) for i, d in enumerate(days[:-3])], "decision_date date, result_date date, date_valid boolean")
    rows = K.folds(q, FIXTURE_RESEARCH)
    audit = K.fold_audit(rows, FIXTURE_RESEARCH).collect()
    assert len(audit) == 4 and all(a.clean and a.test_dates == 4 and a.validation_dates == 8 for a in audit)
    assert not any(a.clean for a in K.fold_audit(rows, ResearchConfig(validation_dates=8)).collect())


def daily(spark, shift):
    rng = random.Random(2)
    rows = []
    for i, d in enumerate(sessions(60)):
        base = rng.random() * 0.3
        rows += [("rank-v6", d, base, 0.3, 0.2, -0.1, 0.01 * (i % 2) - 0.005), ("new", d, base + shift, 0.2, 0.1, -0.05, 0.01 * (i % 2) - 0.005)]
    return spark.createDataFrame(rows, "strategy string, decision_date date, precision_at_10 double, downside_at_10 double, catastrophic_loss_at_10 double, basket_return double, spy_return_20d double")


def test_bootstrap_draws_are_independent(spark):
    """Starts are uniform, neighbouring blocks of a replicate don't follow from each other, and a mean's variance is that of moving blocks."""
    rng = np.random.default_rng(5)
    n, block, reps = 252, 14, 4000
    values = rng.normal(size=n)
    pairs = spark.createDataFrame([(DAY0 + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)], "decision_date date, v double")
    s = K.samples(pairs, block, reps, 20260723)
    rows = s.select("rep", "at", "pos", "v").toPandas().sort_values(["rep", "at"])
    assert (rows.groupby("rep").size() == n).all()
    starts = rows[rows["at"] % block == 0]["pos"].to_numpy().reshape(reps, n // block)
    assert len(np.unique(starts, axis=0)) == reps and starts.min() == 0 and starts.max() == n - block
    expected = starts.size / (n - block + 1)
    chi = ((np.bincount(starts.ravel(), minlength=n - block + 1) - expected) ** 2 / expected).sum()
    assert abs(chi - (n - block)) < 6 * np.sqrt(2 * (n - block))
    assert len(np.unique(np.diff(starts, axis=1))) > 400 and abs(np.corrcoef(starts[:, 0], starts[:, 1])[0, 1]) < 0.06
    means = np.lib.stride_tricks.sliding_window_view(values, block).mean(axis=1)
    assert rows.groupby("rep")["v"].mean().var() == pytest.approx(means.var() / (n // block), rel=0.1)


def test_pools_belong_to_strategies(spark):
    """An open row of one strategy takes nothing from another, and each has its own threshold."""
    c = Contract()
    whole = ledger(spark, [0.01 * i for i in range(20)]).withColumn("strategy_version", F.lit("x"))
    open_ = ledger(spark, [None, 0.5]).withColumn("strategy_version", F.lit("y"))
    other = ledger(spark, [0.4] * 12).withColumn("strategy_version", F.lit("z"))
    m = L.mature(whole.unionByName(open_).unionByName(other), c)
    assert {(r.strategy_version, r.hit_threshold and round(r.hit_threshold, 6)) for r in m.collect()} == {("x", 0.18), ("y", None), ("z", 0.4)}
    assert m.filter("strategy_version = 'y' AND is_adverse_path IS NULL AND max_adverse_return IS NOT NULL").isEmpty()


def test_cutoffs_are_instants_of_the_past(spark):
    cal, days = small_calendar(spark)
    now = F.lit("2030-01-01").cast("timestamp")
    of = lambda *texts: C.cutoffs(spark.createDataFrame([(t,) for t in texts], "at string"), cal, "at", now)
    assert {r.cutoff for r in of(str(days[3]), "2024-01-04T12:00:00-05:00").collect()} == {dt.datetime.combine(days[3], dt.time(21)), dt.datetime(2024, 1, 4, 17)}
    for bad in ("2024-01-04T12:00:00", "2024-01-06", "2031-01-01T00:00:00Z", "soon"):
        with pytest.raises(ValueError):
            of(bad)


def test_lookups_in_a_calendar(spark):
    cal, days = small_calendar(spark)
    assert [r.session for r in C.sessions_between(cal, str(days[2]), str(days[4])).orderBy("idx").collect()] == days[2:5]
    assert [(r.session, r.idx) for r in C.spanning(cal, spark.createDataFrame([(days[5],), (days[7],)], "dt date")).orderBy("idx").collect()] == [(days[5], 0), (days[6], 1), (days[7], 2)]
    assert C.future_session(cal, spark.createDataFrame([(days[1],)], "decision_date date"), 3).first().result_date == days[4]
    with pytest.raises(ValueError):
        C.future_session(cal, spark.createDataFrame([(dt.date(2024, 1, 6),)], "decision_date date"), 3)
    assert C.latest_completed(cal, F.lit(f"{days[4]} 20:59:59").cast("timestamp")).first().session == days[3]
    old = spark.createDataFrame([(dt.datetime(1990, 1, 1), dt.date(1990, 1, 1))], "available_at timestamp, d date")
    assert C.effective_session(old, cal).first().session == days[0] and C.next_session(old, cal, "d").first().next_session == days[0]


def test_known_positions_equal_brute_force(spark):
    """Random versions, late cycles, revisions and ties: at each decision the newest two cycles that are known, each in its newest version."""
    rng = random.Random(6)
    day = lambda i: DAY0 + dt.timedelta(days=i)
    at = lambda i: dt.datetime.combine(day(i), dt.time(12))
    drawn = [(f"T{rng.randrange(6)}", day(rng.randrange(12)), at(rng.randrange(60)), float(rng.randrange(9)), rng.random() < 0.2, rng.random() < 0.3) for _ in range(300)]
    # Valid ones: not available before their settlement, and one of a cycle at one instant.
    versions = list({v[:3]: v for v in drawn if v[2].date() >= v[1]}.values())
    decisions = [(f"T{t}", day(i), at(i)) for t in range(7) for i in range(0, 60, 3)]
    p = spark.createDataFrame(versions, "symbol string, settlement_date date, available_at timestamp, short_interest double, stock_split_flag boolean, revision_flag boolean")
    d = spark.createDataFrame(decisions, "ticker string, decision_date date, cutoff timestamp")
    want = set()
    for t, decision, cutoff in decisions:
        newest = {}
        for s, settled, *v in versions:
            if s == t and v[0] <= cutoff:
                newest[settled] = max(newest.get(settled, v), v)
        two = [(k, *newest[k]) for k in sorted(newest, reverse=True)[:2]]
        if two:
            want.add((t, decision, *two[0], *((two[1][2], two[1][3]) if len(two) > 1 else (None, None))))
    assert {tuple(r) for r in B.known_positions(d, p).collect()} == want


def test_enrichment_is_checked(spark):
    panel_ = spark.createDataFrame([("A", DAY0), ("B", DAY0)], "ticker string, decision_date date")
    f = spark.createDataFrame([("A", DAY0, 2.0, None)], "ticker string, decision_date date, x double, y double")
    assert {(r.ticker, r.x, r.y) for r in B.enrich(panel_, f, "s1").collect()} == {("A", 2.0, 0.0), ("B", 0.0, 0.0)}
    digest = lambda a, b: spark.range(1).select(B.enriched_digest(a, b)).first()[0]
    assert digest("p", "s1") != digest("p", "s2") and digest("p", "s1") == digest("p", "s1")
    for bad, name in ((f, " "), (f.union(f), "s"), (f.withColumn("ticker", F.lit("C")), "s"), (f.withColumn("x", F.lit(float("nan"))), "s")):
        with pytest.raises(ValueError):
            B.enrich(panel_, bad, name)


def test_fold_rows_need_labels(spark):
    rows = spark.createDataFrame([("A", DAY0, True, False, False), ("B", DAY0, None, None, None)], "ticker string, decision_date date, is_explosion boolean, is_severe_downside boolean, is_catastrophic_loss boolean")
    fold = spark.createDataFrame([(1, "test", DAY0)], "fold int, role string, decision_date date")
    assert K.rows_of(rows.limit(1), fold, 1, "test").count() == 1 and K.group_sizes(rows).first().rows == 2
    with pytest.raises(ValueError):
        K.rows_of(rows, fold, 1, "test")


def test_boosted_models_learn_and_stop_on_validation(spark):
    """The settings are the declared ones, scores follow the signal, and weights of dates don't let a large one rule."""
    rng = random.Random(3)
    rows = []
    for i in range(8):
        for k in range(40):
            x = rng.random()
            rows.append((f"T{k}", DAY0 + dt.timedelta(days=i), x, rng.random(), 2 if x > 0.8 else 0 if x < 0.2 else 1, x < 0.2))
    m = spark.createDataFrame(rows, "ticker string, decision_date date, a double, b double, ranking_relevance int, is_severe_downside boolean")
    training, validation = m.filter(F.dayofmonth("decision_date") <= 6), m.filter(F.dayofmonth("decision_date") > 6)
    boom, risk = K.fit_boom(training, validation, ["a", "b"], 5), K.fit_risk(training, validation, ["a", "b"], 5)
    for model in (boom, risk):
        assert (model.getMaxDepth(), model.getStepSize(), model.getSubsamplingRate(), model.getValidationIndicatorCol(), model.getWeightCol()) == (4, 0.03, 0.8, "is_validation", "weight")
        assert 1 <= model.getNumTrees <= 5
    got = K.predict(risk, K.predict(boom, validation, ["a", "b"], "boom"), ["a", "b"], "risk", True)
    r = got.agg(F.corr("a", "boom"), F.corr(F.col("a"), F.col("risk")), F.avg(F.when(F.col("a") > 0.8, F.col("boom"))), F.avg(F.when(F.col("a") < 0.8, F.col("boom")))).first()
    assert r[0] > 0.5 and r[1] < -0.5 and r[2] > r[3] and got.columns[-2:] == ["boom", "risk"]


def test_bootstrap_and_promotion(spark):
    d = daily(spark, 0.05)
    pairs = K.paired(d, "new")
    b = K.bootstrap(pairs, FIXTURE_RESEARCH, Contract(horizon=3))
    r = b.first()
    assert r.estimate == pytest.approx(0.05) and r.lower_95 == pytest.approx(0.05) and r.probability_positive == 1
    assert [tuple(x) for x in K.tail_bootstrap(pairs, FIXTURE_RESEARCH, Contract(horizon=3)).orderBy("metric").select("metric").collect()] == [("catastrophic_loss",), ("downside",), ("expected_shortfall",)]
    summary = spark.createDataFrame([("rank-v6", 60, 0.15, 0.5, 0.3, 0.2, -0.1), ("new", 60, 0.2, 0.6, 0.2, 0.1, -0.05)], "strategy string, valid_dates long, precision_at_10 double, passing_date_rate double, downside_at_10 double, catastrophic_loss_at_10 double, expected_shortfall_10 double")
    blocks = pairs.select("decision_date", F.lit("test").alias("role"), (F.dayofmonth("decision_date") % 2).alias("fold"))
    st = K.stability(pairs, blocks, Contract())
    ok = K.promotion(summary, b, K.recent_uplift(pairs), st, "new", 60, FIXTURE_RESEARCH).first()
    assert ok.passed and ok.reasons == ["all_gates_passed"]
    no = K.promotion(summary, b, K.recent_uplift(pairs), st, "new", 61, FIXTURE_RESEARCH, exploratory=True).first()
    assert not no.passed and no.reasons == ["locked_valid_dates", "exploratory_external_data"]
    with pytest.raises(ValueError):
        K.paired(d.filter("strategy = 'new' OR decision_date > '2025-01-10'"), "new")
