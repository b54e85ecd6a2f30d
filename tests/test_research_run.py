"""The listwise ranker, and the walk-forward run: resumed after a stop, blind to what comes after a model."""

import dataclasses
import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_panel_operators import DAY0
from tidemark.contract import FIXTURE_RESEARCH, Contract
from tidemark.operators import boosting as BO
from tidemark.operators import research as K
from tidemark.operators import walkforward as WF
from tidemark.plans import fixtures as FX

GAINS = (0.0, 1.0, 31.0)


def brute(rows, truncation=13):
    """gradient, hessian of each row of one date by all its pairs. rows: (ticker, relevance, score)."""
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    best = sum(g / math.log2(2 + k) for k, g in enumerate(sorted((GAINS[r[1]] for r in rows), reverse=True)[:truncation]))
    out, total = {r[0]: [0.0, 0.0] for r in rows}, 0.0
    spread = order[0][2] > order[-1][2]
    for i, a in enumerate(order[:truncation]):
        for j in range(i + 1, len(order)):
            b = order[j]
            if a[1] == b[1] or not best:
                continue
            hi, lo = (a, b) if a[1] > b[1] else (b, a)
            w = abs(GAINS[a[1]] - GAINS[b[1]]) * abs(1 / math.log2(2 + i) - 1 / math.log2(2 + j)) / best
            w = w / (0.01 + abs(hi[2] - lo[2])) if spread else w
            push = 1 / (1 + math.exp(hi[2] - lo[2]))
            for r, sign in ((hi, -1), (lo, 1)):
                out[r[0]][0] += sign * push * w
                out[r[0]][1] += push * (1 - push) * w
            total += 2 * push * w
    scale = math.log2(1 + total) / total if total > 0 else 1.0
    return {t: (g * scale, h * scale) for t, (g, h) in out.items()}


def test_gradients_equal_all_pairs(spark):
    rng = random.Random(9)
    rows = []
    for i, n in enumerate((1, 5, 14, 40, 30, 20)):
        for k in range(n):
            score = 0.0 if i == 4 else round(rng.gauss(0, 1), 1)  # ties; a date without spread; one without gain
            rows.append((DAY0 + dt.timedelta(days=i), f"T{k:02}", 0 if i == 5 else rng.choice([0, 1, 1, 2]), score))
    frame = spark.createDataFrame(rows, "decision_date date, ticker string, ranking_relevance int, score double").repartition(3)
    got = {(r.decision_date, r.ticker): (r.gradient, r.hessian) for r in BO.lambdas(frame).collect()}
    for day in {r[0] for r in rows}:
        for t, want in brute([r[1:] for r in rows if r[0] == day]).items():
            assert got[day, t] == pytest.approx(want, abs=1e-12)


def made(spark, days, names, seed=3, drift=0.0):
    """Explosions come where two signals meet, which no single one tells. drift: how much the first signal's level differs from date to date."""
    rng = random.Random(seed)
    rows = []
    for i in range(days):
        level = drift * rng.random()
        for k in range(names):
            a, b, c = rng.random(), rng.random(), rng.random()
            z = a * b + 0.2 * rng.random()
            a += level
            rows.append((f"T{k:02}", DAY0 + dt.timedelta(days=i), DAY0 + dt.timedelta(days=i + 3), names, z - 0.4, z > 0.7, z < 0.2, z < 0.1, a, k + 1, 0.01 * (-1) ** (i // 2), True, 2 if z > 0.7 else 0 if z < 0.2 else 1, a, b, c))
    return spark.createDataFrame(rows, "ticker string, decision_date date, result_date date, universe_size long, forward_return double, is_explosion boolean, is_severe_downside boolean, is_catastrophic_loss boolean, rank_v6_score double, rank_v6 int, spy_return_20d double, date_valid boolean, ranking_relevance int, a double, b double, c double")


QUICK = BO.ListwiseSettings(rounds=6, learning_rate=0.3, leaf_rows=20, l2=0.1, patience=3)


def test_a_listwise_model_learns_what_no_signal_tells(spark):
    m = made(spark, 24, 50)
    part = lambda lo, hi: m.filter(F.dayofmonth("decision_date").between(lo, hi))
    training, validation, test = part(1, 14), part(15, 18), part(19, 24)
    cuts = []
    model = BO.fit_listwise(training, validation, ["a", "b", "c"], QUICK, lambda x: cuts.append(1) or FX.stored(x, "t-cut"))
    again = BO.ListwiseModel.of(model.state())
    own = again.predict(test, "score")
    assert {(r.ticker, r.decision_date): r.score for r in own.collect()} == {(r.ticker, r.decision_date): r.score for r in model.predict(test, "score").collect()}
    at = lambda f: BO.ndcg(f).agg(F.avg("ndcg")).first()[0]
    assert at(own) > 0.85 > 0.2 + max(at(test.withColumn("score", F.col(c))) for c in "abc")
    assert len(cuts) == 2 and len(model.trees) <= 6 and model.history[len(model.trees) - 1] == max(model.history)
    # What a tree says as an expression is what its arrays say.
    tree = model.trees[-1]
    x = np.array([[r.a, r.b, r.c] for r in test.select("a", "b", "c").collect()])
    assert [r[0] for r in test.select("a", "b", "c", tree.expression(["a", "b", "c"], lambda k: F.lit(tree.value[k])).alias("v")).select("v").collect()] == pytest.approx(list(tree.values(x)))


def test_gram_at_full_width(spark):
    rng = np.random.default_rng(2)
    x, y, w = rng.normal(size=(500, 39)), rng.integers(0, 2, 500), rng.random(500)
    names = [f"f{k}" for k in range(39)]
    frame = spark.createDataFrame([(*map(float, r), bool(b), float(v)) for r, b, v in zip(x, y, w, strict=True)], ", ".join(f"{n} double" for n in names) + ", y boolean, weight double").repartition(7)
    full = np.column_stack([np.ones(500), x])
    a, b = full.T @ (full * w[:, None]), full.T @ (w * y)
    got = {(r.i, r.j): r.value for r in K.gram(frame, names, "y").collect()}
    assert len(got) == 40 * 41 // 2 + 40 and all(v == pytest.approx(b[i] if j < 0 else a[i, j]) for (i, j), v in got.items())
    assert K.gram(frame.limit(0), names, "y").agg(F.sum("value")).first()[0] in (None, 0.0)


CONFIG = dataclasses.replace(FIXTURE_RESEARCH, minimum_training_dates=8, validation_dates=4, locked_test_dates=15, retrain_interval=8, bootstrap_replications=200)


def test_a_run_goes_on_where_it_was_stopped_and_sees_no_later_outcome(spark, monkeypatch):
    m = made(spark, 34, 14)
    quality = m.groupBy("decision_date", "result_date").agg(F.count("*").alias("universe_size")).withColumn("date_valid", F.lit(True))
    place, contract = FX.scratch(spark, "t-run"), Contract(horizon=3, inspect=12)
    make = lambda panel: WF.Run(spark, panel, quality, place, ["a", "b", "c"], config=CONFIG, contract=contract, listwise=dataclasses.replace(QUICK, rounds=2), risk_rounds=2)
    run = make(m)
    assert run.folds() == [1, 2]
    run.fit(2)
    with pytest.raises(ValueError, match=r"folds \[1\] aren't fitted"):
        run.report()
    again = make(m)
    assert again.digest == run.digest and not again.done(1) and again.done(2)
    assert again.fit_all() == [1] and again.fit_all() == []
    report = again.report()
    assert {n: f.count() for n, f in report.items() if n in ("daily", "summary", "bootstrap", "tail_bootstrap", "recent", "promotion", "folds", "run")} == {"daily": 45, "summary": 3, "bootstrap": 1, "tail_bootstrap": 3, "recent": 1, "promotion": 1, "folds": 2, "run": 1}
    assert {r.segment for r in report["stability"].collect()} == {"test_block_1", "test_block_2", "spy_20d_nonnegative", "spy_20d_negative"}
    first = again.scored().filter("fold = 1").select("ticker", "decision_date", "linear_score", "boom", "risk", "boosted_score")
    # Everything that happened from the first fold's model on comes out otherwise; its scores don't.
    since = run.audit.filter("fold = 1").first().model_as_of
    other = m.withColumns({c: F.when(F.col("decision_date") >= F.lit(since), v).otherwise(F.col(c)) for c, v in (("forward_return", -F.col("forward_return")), ("is_explosion", ~F.col("is_explosion")), ("is_severe_downside", ~F.col("is_severe_downside")), ("ranking_relevance", 2 - F.col("ranking_relevance")))})
    blind = make(other)
    assert blind.digest != run.digest and not blind.done(1)
    blind.fit(1)
    told = spark.read.parquet(f"{blind.root}/scored/fold=1").select(first.columns)
    assert sorted(told.collect()) == sorted(first.collect()) and first.count() == 8 * 14
    # A model that was written before a stop is read, not fitted again.
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{blind.root}/audits/fold=1")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    monkeypatch.setattr(WF, "fit_listwise", lambda *a, **k: pytest.fail("fitted again"))
    blind.fit(1)
    assert blind.done(1)


def test_runs_are_checked(spark):
    m = made(spark, 12, 12)
    quality = m.groupBy("decision_date", "result_date").agg(F.count("*").alias("universe_size")).withColumn("date_valid", F.lit(True))
    make = lambda panel, q=quality, features=("a",): WF.Run(spark, panel, q, FX.scratch(spark, "t-run"), list(features), config=CONFIG)
    for change, what in (({"panel": m.drop("spy_return_20d")}, "lacks"), ({"panel": m.unionByName(m.limit(1))}, "repeats"), ({"panel": m.withColumn("a", F.lit(float("nan")))}, "finite"), ({"features": ("a", "a")}, "names repeat"), ({"q": quality.filter("date_valid = false")}, "too few"), ({}, "too small|too few")):
        with pytest.raises(ValueError, match=what):
            make(**({"panel": m} | change))
