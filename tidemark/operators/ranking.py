"""Eligibility, liquidity preselection, tie-averaged ranking, replacement and re-ranking within a date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..contract import Contract
from ..functions.windows import average_rank, place
from .features import base_features
from .panel import duplicates, last_sessions

# The signals that the score averages.
SIGNALS = ("return_5d", "return_20d", "distance_to_60d_high", "volume_zscore_20", "relative_strength_20d")


def eligible(features: DataFrame, contract: Contract) -> DataFrame:
    """Rows that meet every threshold; a null fails."""
    return features.filter(
        F.col("history_complete_60d")
        & (F.col("raw_close") >= contract.min_close)
        & (F.col("average_dollar_volume_20d") >= contract.min_average_dollar_volume)
        & (F.col("median_dollar_volume_prior_20d") >= contract.min_median_dollar_volume_prior)
        & (F.col("valid_price_volume_sessions_prior_20d") >= contract.min_valid_sessions)
    )


def candidates(features: DataFrame, contract: Contract, dates: DataFrame | None = None) -> DataFrame:
    """Eligible rows on dates on which the benchmark is eligible, without it: the most liquid ``max_candidates`` a date."""
    if dates is not None:
        features = features.join(F.broadcast(dates.select(F.col("decision_date").alias("dt")).distinct()), "dt", "left_semi")
    ok = eligible(features, contract)
    gate = ok.filter(F.col("ticker") == contract.benchmark).select("dt").distinct()
    ok = ok.filter(F.col("ticker") != contract.benchmark).join(F.broadcast(gate), "dt", "left_semi")
    liquid = place(["dt"], F.col("average_dollar_volume_20d").desc(), F.col("ticker"))
    return ok.withColumn("liquidity_rank", liquid).filter(F.col("liquidity_rank") <= contract.max_candidates)


def score(rows: DataFrame, signals=SIGNALS, by: str = "dt") -> DataFrame:
    """ticker, decision_date, score (mean of tie-averaged signal ranks, nulls as 0), rank."""
    filled = rows.select("ticker", F.col(by).alias("decision_date"), *[F.coalesce(F.col(s), F.lit(0.0)).alias(s) for s in signals])
    ranked = filled.select("ticker", "decision_date", *[average_rank(F.col(s), ["decision_date"]).alias(s) for s in signals])
    total = F.col(signals[0])
    for s in signals[1:]:
        total = total + F.col(s)
    return ranked.select("ticker", "decision_date", (total / len(signals)).alias("score")).withColumn("rank", place(["decision_date"], F.col("score").desc(), F.col("ticker")))


def rank_dates(bars: DataFrame, contract: Contract, dates: DataFrame | None = None) -> DataFrame:
    """Rankings of many decision dates from one feature panel."""
    return score(candidates(base_features(bars, contract), contract, dates))


def rank_latest(bars: DataFrame, contract: Contract) -> DataFrame:
    """The ranking of the panel's last date, from its last ``lookback`` sessions alone."""
    window = bars.join(F.broadcast(last_sessions(bars, contract.lookback)), "dt", "left_semi")
    last = window.agg(F.max("dt").alias("decision_date"))
    return rank_dates(window, contract, last)


def benchmark_reason(features: DataFrame, contract: Contract) -> DataFrame:
    """dt, reason: the first rule that the benchmark's row fails; null where it is eligible, "missing" without a row."""
    days = features.select("dt").distinct()
    b = features.filter(F.col("ticker") == contract.benchmark).withColumn("there", F.lit(True))
    r = days.join(F.broadcast(b.drop("ticker")), "dt", "left")
    reason = (
        F.when(F.col("there").isNull(), "missing")
        .when(~F.col("history_complete_60d"), "insufficient_history")
        .when(F.col("raw_close") < contract.min_close, "low_price")
        .when(F.col("average_dollar_volume_20d") < contract.min_average_dollar_volume, "low_dollar_volume")
        .when(F.coalesce("valid_price_volume_sessions_prior_20d", F.lit(-1)) < contract.min_valid_sessions, "insufficient_liquidity_history")
        .when(F.coalesce("median_dollar_volume_prior_20d", F.lit(-1.0)) < contract.min_median_dollar_volume_prior, "low_median_dollar_volume")
    )
    return r.select("dt", reason.alias("reason"))


def replace_flagged(ranking: DataFrame, statuses: DataFrame, inspect: int = 30, strict: bool = True) -> DataFrame:
    """Walks ranks until ``inspect`` unflagged names are seen; flagged names met on the way go, ranks close up.

    statuses: ticker, decision_date, flagged, each as of its date; without decision_date, one of a ticker holds for all dates of the ranking.
    A row is met while fewer than ``inspect`` unflagged rows stand before it. Without a status for a row that is met: an error. Not strict: that
    date keeps all its rows as they are and is marked in ``uncovered``, while the others go on."""
    keys = ["ticker", *(c for c in ("decision_date",) if c in statuses.columns)]
    if not duplicates(statuses, keys).isEmpty():
        raise ValueError("a status comes more than once")
    day = Window.partitionBy("decision_date")
    w = day.orderBy("rank")
    before = F.coalesce(F.sum(F.when(F.coalesce("flagged", F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seen = ranking.join(statuses.select(*keys, "flagged"), keys, "left").withColumn("checked", before < inspect)
    lacking = F.col("checked") & F.col("flagged").isNull()
    if strict:
        if not seen.filter(lacking).isEmpty():
            raise ValueError("statuses don't cover the ranks that are inspected")
        return close_up(seen.filter("NOT (checked AND flagged)").drop("flagged"))
    seen = seen.withColumn("uncovered", F.max(lacking).over(day))
    return close_up(seen.filter("uncovered OR NOT (checked AND flagged)").drop("flagged"))


def close_up(ranking: DataFrame) -> DataFrame:
    return ranking.withColumn("rank", place(["decision_date"], F.col("rank")))


def leaders(ranking: DataFrame, n: int = 30) -> DataFrame:
    """Distinct tickers that some date has among its first n."""
    return ranking.filter(F.col("rank") <= n).select("ticker").distinct()


def top_n(frame: DataFrame, score_column: str, n: int) -> DataFrame:
    """Rows of each date's n best scores, ties by ticker."""
    k = place(["decision_date"], F.col(score_column).desc(), F.col("ticker"))
    return frame.withColumn("_k", k).filter(F.col("_k") <= n).drop("_k")


def blend(frame: DataFrame, first: str, second: str, weight, by=("decision_date",), name: str = "blend") -> DataFrame:
    """(1 - weight) * percentile of the first score + weight * percentile of the second; best is 1, ties averaged, alone is 1."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    share = lambda c: F.when(n > 1, 1.0 - (average_rank(-F.col(c), list(by)) - 1.0) / (n - 1.0)).otherwise(1.0)
    w = weight if not isinstance(weight, (int, float)) else F.lit(float(weight))
    return frame.withColumn(name, (1.0 - w) * share(first) + w * share(second))


def risk_adjusted(frame: DataFrame, boom: str, risk: str, strength, top: int = 30, by=("decision_date",), name: str = "adjusted") -> DataFrame:
    """Re-ranks each date's ``top`` boom scores by at most ``strength`` places by quarter of risk; the score is minus the final rank."""
    by = list(by)
    s = strength if not isinstance(strength, (int, float)) else F.lit(float(strength))
    out = frame.withColumn("_b", place(by, F.col(boom).desc(), F.col("ticker"))).withColumn("_in", F.col("_b") <= top)
    size = F.sum(F.col("_in").cast("long")).over(Window.partitionBy(*by))
    at = place([*by, "_in"], F.col(risk), F.col("ticker")) - 1
    out = out.withColumn("_q", F.least(F.lit(3), F.floor(4 * at / size)))
    key = F.when(F.col("_in"), F.col("_b") + F.least(s, F.col("_q").cast("double")))
    out = out.withColumn("_key", key)
    final = place(by, (~F.col("_in")).cast("int"), F.col("_key"), F.when(F.col("_in"), F.col(risk)), F.col("_b"), F.col("ticker"))
    return out.withColumn(name, -final.cast("double")).drop("_b", "_in", "_q", "_key")
