"""Daily precision and tail risk, summaries, streaks, expected shortfall, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contract import Contract
from ..functions.windows import ceil_share, place
from .labels import date_quality, pool_keys


def _rate(c: str, when: Column) -> Column:
    return F.avg(F.when(when, F.col(c).cast("double")))


def daily_pools(matured: DataFrame, contract: Contract) -> DataFrame:
    """Counts and metrics of every strategy and decision date, whole or not: one aggregation."""
    k = contract.top_k
    top = F.col("rank") <= k
    return matured.groupBy("strategy_version", "decision_date").agg(
        F.max("universe_size").alias("universe_size"),
        (F.min("universe_size") == F.max("universe_size")).alias("one_size"),
        F.count("*").alias("n"),
        F.count("forward_return").alias("m"),
        F.countDistinct(F.when(top & F.col("forward_return").isNotNull(), F.col("rank"))).alias("top_ranks"),
        _rate("is_explosion", top).alias("precision_at_k"),
        _rate("is_explosion", F.lit(True)).alias("base_explosion_rate"),
        _rate("is_severe_downside", top).alias("downside_at_k"),
        _rate("is_catastrophic_loss", top).alias("catastrophic_loss_at_k"),
        F.when(F.count(F.when(top & F.col("is_adverse_path").isNull(), 1)) == 0, _rate("is_adverse_path", top)).alias("adverse_path_at_k"),
        F.avg(F.when(top, F.col("forward_return"))).alias("basket_return"),
    )


def evaluable(contract: Contract) -> Column:
    """Whether a pool of daily_pools gives a metric: one size of at least top_k, every outcome there, ranks 1..top_k complete."""
    whole = (F.col("m") == F.col("n")) & (F.col("n") == F.col("universe_size")) & (F.col("top_ranks") == contract.top_k)
    return F.col("one_size") & (F.col("universe_size") >= contract.top_k) & (F.col("m") / F.col("universe_size") >= contract.min_coverage) & whole


def passing(contract: Contract) -> Column:
    return (F.col("precision_at_k") >= contract.daily_target) & (F.col("precision_at_k") > F.col("base_explosion_rate"))


def daily_rankings(matured: DataFrame, contract: Contract) -> DataFrame:
    """Metrics per strategy and decision date of a matured ledger, of evaluable dates alone."""
    d = daily_pools(matured, contract).filter(evaluable(contract))
    cover = F.col("m") / F.col("universe_size")
    return d.select("strategy_version", "decision_date", "universe_size", cover.alias("outcome_coverage"), "precision_at_k", "base_explosion_rate", "downside_at_k", "catastrophic_loss_at_k", "adverse_path_at_k", "basket_return", passing(contract).alias("passed"))


def daily_scores(scored: DataFrame, score_column: str, contract: Contract, by: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """Metrics per date of the top_k rows by any score (ties by ticker); base rate over all rows."""
    keys = [*by, "decision_date"]
    top = F.col("_k") <= contract.top_k
    ranked = scored.withColumn("_k", place(keys, F.col(score_column).desc(), F.col("ticker")))
    d = ranked.groupBy(*keys).agg(
        _rate("is_explosion", top).alias("precision_at_10"),
        _rate("is_explosion", F.lit(True)).alias("base_explosion_rate"),
        _rate("is_severe_downside", top).alias("downside_at_10"),
        _rate("is_catastrophic_loss", top).alias("catastrophic_loss_at_10"),
        F.avg(F.when(top, F.col("forward_return"))).alias("basket_return"),
        F.sum(F.when(top, F.col("is_explosion").cast("long"))).alias("hits_at_10"),
        F.max("spy_return_20d").alias("spy_return_20d"),
    )
    return d.withColumn("passed", (F.col("precision_at_10") >= contract.daily_target) & (F.col("precision_at_10") > F.col("base_explosion_rate")))


def shortfall(frame: DataFrame, value: str, by: list[str], tail: float) -> DataFrame:
    """by..., expected_shortfall: mean of the lowest max(1, ceil(n * tail)) values."""
    n = F.count(value).over(Window.partitionBy(*by))
    low = frame.filter(F.col(value).isNotNull()).select(*by, value, n.alias("_n"), place(by, F.col(value)).alias("_k"))
    return low.filter(F.col("_k") <= ceil_share(F.col("_n"), tail)).groupBy(*by).agg(F.avg(value).alias("expected_shortfall"))


def summarize(daily: DataFrame, contract: Contract, by: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """Pooled precision, mean rates, share of passing dates and expected shortfall of the daily baskets."""
    keys = list(by)
    s = daily.groupBy(*keys).agg(
        F.count("*").alias("valid_dates"),
        (F.sum("hits_at_10") / (F.count("*") * contract.top_k)).alias("precision_at_10"),
        F.avg("base_explosion_rate").alias("base_explosion_rate"),
        F.avg("downside_at_10").alias("downside_at_10"),
        F.avg("catastrophic_loss_at_10").alias("catastrophic_loss_at_10"),
        F.avg("basket_return").alias("basket_return"),
        F.avg(F.col("passed").cast("double")).alias("passing_date_rate"),
    )
    return s.join(shortfall(daily, "basket_return", keys, contract.shortfall_tail).withColumnRenamed("expected_shortfall", "expected_shortfall_10"), keys)


def longest_streak(daily: DataFrame, calendar: DataFrame, by: str = "strategy_version") -> DataFrame:
    """by, longest_streak: most passing dates in a row on adjacent sessions. A failing date, one off the calendar or a gap ends a run."""
    w = Window.partitionBy(by).orderBy("decision_date")
    d = daily.select(by, "decision_date", "passed").join(F.broadcast(calendar.select(F.col("session").alias("decision_date"), "idx")), "decision_date", "left")
    goes_on = F.col("passed") & F.col("idx").isNotNull() & (F.col("idx") == F.lag("idx").over(w) + 1)
    d = d.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    runs = d.groupBy(by, "_run").agg(F.count(F.when(F.col("passed") & F.col("idx").isNotNull(), 1)).alias("n"))
    return runs.groupBy(by).agg(F.max("n").alias("longest_streak"))


def evidence(outcomes: DataFrame, evaluated: DataFrame, contract: Contract, calendar: DataFrame, latest: DataFrame) -> DataFrame:
    """strategy_version where there is one, decision_date, result_date, counts, status: the first reason in order why a ledger date is no evidence, else EVALUATED.

    A date whose result session lies after the panel's last (``latest``: one row, column session) isn't due and isn't returned. A pool's size is what its
    rows say; where they disagree it is none."""
    from .calendar import later_session

    k, keys = contract.top_k, pool_keys(outcomes)
    due = later_session(calendar, contract.horizon).select(F.col("session").alias("decision_date"), "result_date").crossJoin(F.broadcast(latest.select(F.col("session").alias("latest")))).filter("result_date <= latest").drop("latest")
    told = F.when(F.min("universe_size") == F.max("universe_size"), F.max("universe_size")).otherwise(0) if "universe_size" in outcomes.columns else F.count("*")
    d = outcomes.groupBy(*keys).agg(
        told.cast("long").alias("n"),
        F.count("forward_return").alias("m"),
        F.countDistinct(F.when((F.col("rank") <= k) & F.col("forward_return").isNotNull(), F.col("rank"))).alias("top_ranks"),
    )
    both = [c for c in keys if c in evaluated.columns]
    d = d.join(F.broadcast(due), "decision_date").join(F.broadcast(evaluated.select(*both, F.lit(True).alias("done")).distinct()), both, "left")
    cover = F.when(F.col("n") > 0, F.col("m") / F.col("n")).otherwise(0.0)
    status = (
        F.when(F.col("n") < k, f"eligible_universe_below_top_{k}")
        .when(cover < contract.min_coverage, "outcome_coverage_below_90pct")
        .when(F.col("top_ranks") < k, f"top_{k}_outcomes_incomplete")
        .when(cover < 1, "complete_universe_outcomes_required")
        .when(F.col("done").isNull(), "evaluation_failed")
        .otherwise("EVALUATED")
    )
    return d.select(*keys, "result_date", F.col("n").alias("universe_size"), F.col("m").alias("outcome_count"), status.alias("status"))


def ledger_requirements(ledger: DataFrame, calendar: DataFrame, bars: DataFrame, contract: Contract) -> DataFrame:
    """ticker, decision_date, result_date of ledger rows whose outcome's bar isn't stored."""
    from .calendar import later_session

    due = later_session(calendar, contract.horizon).select(F.col("session").alias("decision_date"), "result_date").filter("result_date IS NOT NULL")
    need = ledger.select("ticker", "decision_date").distinct().join(F.broadcast(due), "decision_date")
    return need.join(bars.select("ticker", F.col("dt").alias("result_date")), ["ticker", "result_date"], "left_anti").select("ticker", "decision_date", "result_date")


def prefetch_starts(requirements: DataFrame) -> DataFrame:
    """ticker, start: from when on a ticker's bars are needed for its open ledger outcomes."""
    return requirements.groupBy("ticker").agg(F.min("decision_date").alias("start"))


__all__ = ["daily_rankings", "daily_scores", "date_quality", "evidence", "ledger_requirements", "longest_streak", "prefetch_starts", "shortfall", "summarize"]
