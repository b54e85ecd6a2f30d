"""Outcome labels on the exact n-th later session, thresholds of complete pools, graded relevance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..contract import Contract
from ..functions.windows import Panel, ceil_share, place
from .calendar import later_session
from .features import with_index

P = Panel()


def forward_labels(bars: DataFrame, contract: Contract, calendar: DataFrame | None = None) -> DataFrame:
    """ticker, dt, result_date, close, future_close, future_min_close, forward_return, max_adverse_return.

    A row needs the ticker's own bar on the horizon's session: a later bar never stands in for it, and without it there is no label.
    The least close in between counts only where every session in between has a bar."""
    h = contract.horizon
    data = bars if "idx" in bars.columns else with_index(bars, calendar)
    days = data.select(F.col("dt").alias("session"), "idx").distinct() if calendar is None else calendar.select("session", "idx")
    if calendar is not None:
        data = data.drop("idx").join(F.broadcast(days.withColumnRenamed("session", "dt")), "dt")
    later = later_session(days, h).select(F.col("session").alias("dt"), "result_date")
    path = F.min("close").over(P.ordered.rowsBetween(1, h))
    rows = data.select("ticker", "dt", "close", "idx", F.when(P.lead("idx", h) - F.col("idx") == h, path).alias("future_min_close")).join(F.broadcast(later), "dt")
    future = data.select(F.col("ticker").alias("f_ticker"), F.col("dt").alias("result_date"), F.col("close").alias("future_close"))
    out = rows.join(future, (rows.ticker == future.f_ticker) & (rows.result_date == future.result_date)).drop("f_ticker").drop(future.result_date)
    return out.select(
        "ticker", "dt", "result_date", "close", "future_close", "future_min_close",
        (F.try_divide("future_close", "close") - 1.0).alias("forward_return"),
        (F.try_divide("future_min_close", "close") - 1.0).alias("max_adverse_return"),
    )


def with_outcomes(rows: DataFrame, labels: DataFrame, date: str = "decision_date") -> DataFrame:
    """rows with their label's result_date and returns; null where there is no label."""
    names = ["result_date", "forward_return", "max_adverse_return"]
    lab = labels.select(F.col("ticker").alias("l_ticker"), F.col("dt").alias("l_dt"), *names)
    return rows.join(lab, (rows.ticker == lab.l_ticker) & (rows[date] == lab.l_dt), "left").drop("l_ticker", "l_dt")


def pool_keys(outcomes: DataFrame) -> list[str]:
    """What makes a pool: the decision date, and the strategy where rows name one."""
    return [c for c in ("strategy_version", "decision_date") if c in outcomes.columns]


def date_quality(outcomes: DataFrame, contract: Contract) -> DataFrame:
    """Per decision date (and strategy_version where there is one): universe_size, outcome_count, outcome_coverage, date_valid, invalid_reason."""
    q = outcomes.groupBy(*pool_keys(outcomes)).agg(F.max("result_date").alias("result_date"), F.count("*").alias("universe_size"), F.count("forward_return").alias("outcome_count"))
    small, short = F.col("universe_size") < contract.top_k, F.col("outcome_count") != F.col("universe_size")
    return q.select(
        "*",
        (F.col("outcome_count") / F.col("universe_size")).alias("outcome_coverage"),
        (~small & ~short).alias("date_valid"),
        F.when(small, f"eligible_universe_below_top_{contract.top_k}").when(short, "complete_universe_outcomes_required").alias("invalid_reason"),
    )


def with_thresholds(outcomes: DataFrame, contract: Contract) -> DataFrame:
    """Adds hit_threshold: the nearest-rank quantile of a complete pool's returns, at least ``hit_return``; null in incomplete pools.

    Counts, places and the pick share one partitioning by pool, so it is read and shuffled once."""
    by = pool_keys(outcomes)
    w = Window.partitionBy(*by)
    n, m = F.count("*").over(w), F.count("forward_return").over(w)
    k = place(by, F.col("forward_return"), F.col("ticker"))
    at = F.when((n == m) & (k == ceil_share(n, contract.hit_quantile)), F.col("forward_return"))
    cut = F.max("_at").over(w)
    return outcomes.withColumn("_at", at).withColumn("hit_threshold", F.when(cut.isNotNull(), F.greatest(cut, F.lit(contract.hit_return)))).drop("_at")


def thresholds(outcomes: DataFrame, contract: Contract) -> DataFrame:
    """decision_date (and strategy_version where there is one), hit_threshold of complete pools."""
    return with_thresholds(outcomes, contract).filter("hit_threshold IS NOT NULL").groupBy(*pool_keys(outcomes)).agg(F.max("hit_threshold").alias("hit_threshold"))


def mature(outcomes: DataFrame, contract: Contract) -> DataFrame:
    """Labels of complete pools, nulls in incomplete ones: hit_threshold, is_explosion, is_severe_downside, is_catastrophic_loss, ranking_relevance.

    is_adverse_path is known wherever the path is, whatever else the pool lacks."""
    out = with_thresholds(outcomes, contract)
    whole = F.col("hit_threshold").isNotNull()
    on = lambda c: F.when(whole, c)
    r = F.col("forward_return")
    out = out.select(
        "*",
        on(r >= F.col("hit_threshold")).alias("is_explosion"),
        on(r <= contract.severe_return).alias("is_severe_downside"),
        on(r <= contract.catastrophic_return).alias("is_catastrophic_loss"),
        (F.col("max_adverse_return") <= contract.adverse_return).alias("is_adverse_path"),
    )
    grade = F.when(~whole, F.lit(None)).when(F.col("is_explosion"), 2).when(F.col("is_severe_downside"), 0).otherwise(1)
    return out.withColumn("ranking_relevance", grade.cast("int"))
