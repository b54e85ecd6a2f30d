"""Walk-forward back-test: every decision date of one plan, with the first reason that makes it invalid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..contract import Contract
from .calendar import indexed, later_session, spanning
from .evaluation import daily_pools, evaluable, passing
from .features import with_index
from .labels import forward_labels, mature, with_outcomes
from .panel import benchmark_problems
from .ranking import rank_dates, replace_flagged

SOURCE = "stored_panel"


def backtest(bars: DataFrame, contract: Contract, days: int | None = None, statuses: DataFrame | None = None, sessions: DataFrame | None = None, sequence: str | None = None) -> DataFrame:
    """One record per matured decision date of the last ``days``: status VALID with metrics, or INVALID with invalid_reason.

    ``sessions`` (session) is the exchange calendar; without it the panel's own dates are its sessions, so that a session which the whole panel
    lacks would move every horizon over it. ``statuses`` (ticker, decision_date, flagged; ``transactions.status_flags``) are as of each date; a
    date on which a rank that is met has none is INVALID, the others go on. ``sequence`` decides between bars of one ticker and session (``with_index``)."""
    days = contract.backtest_days if days is None else days
    if not 1 <= days <= contract.max_backtest_days:
        raise ValueError(f"days must be in 1..{contract.max_backtest_days}")
    k = contract.top_k
    data = with_index(bars, sessions, sequence)
    calendar = indexed(bars, "dt") if sessions is None else spanning(sessions, bars)
    dates = later_session(calendar, contract.horizon).filter("result_date IS NOT NULL")
    last = dates.agg(F.max("idx").alias("last"))
    dates = dates.crossJoin(F.broadcast(last)).filter(F.col("idx") > F.col("last") - days).select(F.col("session").alias("decision_date"), "idx", "result_date")
    problems = benchmark_problems(bars, calendar, contract.lookback, contract.benchmark).withColumnRenamed("session", "decision_date")
    ranking = rank_dates(data, contract, dates)
    lacking = None
    if statuses is not None:
        if "decision_date" not in statuses.columns:
            raise ValueError("statuses of a back-test are as of each decision_date")
        ranking = replace_flagged(ranking, statuses, contract.inspect, strict=False)
        lacking = ranking.filter("uncovered").select("decision_date", "uncovered").distinct()
        ranking = ranking.drop("uncovered", "checked")
    ledger = ranking.withColumn("universe_size", F.count("*").over(Window.partitionBy("decision_date"))).withColumn("strategy_version", F.lit(contract.strategy))
    matured = mature(with_outcomes(ledger, forward_labels(data, contract, None if sessions is None else calendar)).drop("result_date"), contract)
    pool = daily_pools(matured, contract).withColumn("evaluable", evaluable(contract)).withColumn("passed", passing(contract)).drop("strategy_version")
    d = dates.join(F.broadcast(problems), "decision_date", "left").join(F.broadcast(pool), "decision_date", "left")
    d = d.withColumn("uncovered", F.lit(False)) if lacking is None else d.join(F.broadcast(lacking), "decision_date", "left")
    n = F.coalesce("universe_size", F.lit(0))
    cover = F.col("m") / F.col("universe_size")
    reason = (
        F.when(F.col("idx") < contract.lookback - 1, "insufficient_history")
        .when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.col("uncovered"), "corporate_action_status_unavailable")
        .when(n < k, f"eligible_universe_below_top_{k}")
        .when(cover < contract.min_coverage, "outcome_coverage_below_90pct")
        .when(F.col("top_ranks") < k, f"top_{k}_outcomes_incomplete")
        .when(cover < 1, "complete_universe_outcomes_required")
        .when(~F.coalesce("evaluable", F.lit(False)), "evaluation_failed")
    )
    d = d.withColumn("invalid_reason", reason)
    valid = F.col("invalid_reason").isNull()
    known = F.col("invalid_reason").isNull() | ~F.col("invalid_reason").isin("insufficient_history", "spy_missing_on_decision_date", "spy_history_incomplete")
    when = lambda c: F.when(valid, F.col(c))
    return d.select(
        F.lit(contract.strategy).alias("strategy_version"), "decision_date", "result_date",
        F.when(valid, "VALID").otherwise("INVALID").alias("status"), "invalid_reason",
        F.when(known, n).alias("universe_size"), F.when(known & (n >= k) & ~F.coalesce("uncovered", F.lit(False)), cover).alias("outcome_coverage"),
        F.when(valid, F.round(F.col("precision_at_k") * k).cast("long")).alias("hits_at_10"),
        when("precision_at_k").alias("precision_at_10"), when("base_explosion_rate").alias("base_explosion_rate"), when("downside_at_k").alias("downside_at_10"),
        when("catastrophic_loss_at_k").alias("catastrophic_loss_at_10"), when("adverse_path_at_k").alias("adverse_path_at_10"), when("basket_return").alias("basket_return_14"),
        when("passed").alias("passed"), F.lit(SOURCE).alias("universe_source"),
    )


def summary(records: DataFrame, requested: int) -> DataFrame:
    """One row: valid and invalid dates, pooled precision, mean risk, passing days, COMPLETE or INCONCLUSIVE."""
    v = F.col("status") == "VALID"
    s = records.agg(
        F.count(F.when(v, 1)).alias("valid_dates"),
        F.count(F.when(~v, 1)).alias("invalid_dates"),
        F.avg("precision_at_10").alias("precision_at_10"),
        F.avg("base_explosion_rate").alias("base_explosion_rate"),
        F.avg("downside_at_10").alias("downside_at_10"),
        F.avg("catastrophic_loss_at_10").alias("catastrophic_loss_at_10"),
        F.when(F.count(F.when(v & F.col("adverse_path_at_10").isNull(), 1)) == 0, F.avg("adverse_path_at_10")).alias("adverse_path_at_10"),
        F.count(F.when(F.col("passed"), 1)).alias("passing_days"),
    )
    return s.withColumn("conclusion", F.when((F.col("invalid_dates") == 0) & (F.col("valid_dates") == requested), "COMPLETE").otherwise("INCONCLUSIVE"))
