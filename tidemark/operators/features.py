"""Point-in-time features of bars: 60-session base features and the research set.

Every window partitions by ticker and orders by session position, so each builder shuffles its panel once; the
benchmark's series, one row a session, is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contract import Contract
from ..functions.scalars import finite
from ..functions.windows import Panel, Rolls, percentile_rank
from ..schemas import require_columns
from . import calendar as C
from .panel import keep_last, with_session_index

P = Panel()

# Names of the model's features.
STOCK_FEATURES = (
    "return_1d", "return_2d", "return_5d", "return_10d", "return_20d", "return_40d", "return_59d",
    "momentum_20d_ex_last_5d", "momentum_40d_ex_last_5d", "positive_day_fraction_20d", "trend_efficiency_20d",
    "distance_to_20d_high", "distance_to_60d_high", "distance_to_20d_low", "range_position_60d",
    "realized_volatility_5d", "realized_volatility_20d", "realized_volatility_59d", "downside_volatility_20d",
    "max_daily_return_20d", "min_daily_return_20d", "jump_ratio_20d", "normalized_atr_5d", "normalized_atr_20d", "parkinson_range_20d",
    "intraday_return_mean_5d", "overnight_gap_mean_5d", "close_location_mean_5d", "log_average_dollar_volume_20d",
    "dollar_volume_ratio_5d_20d", "dollar_volume_zscore_20d", "zero_volume_fraction_20d", "amihud_20d",
    "return_dollar_volume_correlation_20d", "excess_return_5d", "excess_return_20d", "beta_40d", "residual_momentum_20d", "idiosyncratic_volatility_20d",
)
MARKET_FEATURES = ("spy_return_20d", "spy_realized_volatility_20d", "spy_distance_to_60d_high")


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def change(n: int) -> Column:
    return ratio(F.col("close"), P.lag("close", n)) - 1.0


def with_index(bars: DataFrame, calendar: DataFrame | None = None, sequence: str | None = None) -> DataFrame:
    """Bars on sessions, with a default raw close and their position. Without a calendar the panel's own dates are its sessions.

    A ticker has one bar a session: of several the one with the largest ``sequence`` stays, whose column goes; without a sequence they are an
    error, which the run itself raises, as the check sorts by ticker and position like all windows after it."""
    require_columns(bars, ("ticker", "dt", "close", "volume"), "OHLCV data")
    if "raw_close" not in bars.columns:
        bars = bars.withColumn("raw_close", F.col("close"))
    bars = bars.withColumn("dt", F.col("dt").cast("date"))
    if sequence:
        bars = keep_last(bars, ["ticker", "dt"], sequence).drop(sequence)
    data = with_session_index(bars, C.indexed(bars, "dt") if calendar is None else C.spanning(calendar, bars))
    if sequence:
        return data
    again = P.lag("idx", 1) == F.col("idx")
    return data.withColumn("idx", F.when(again, F.raise_error(F.concat(F.lit("OHLCV data repeats "), F.col("ticker"), F.lit(" on "), F.col("dt").cast("string"))).cast("long")).otherwise(F.col("idx")))


def base_features(bars: DataFrame, contract: Contract = Contract()) -> DataFrame:
    """Bars plus history_complete_60d, returns, distance to the high, liquidity and volume measures, relative strength."""
    n = contract.lookback
    data = bars if "idx" in bars.columns else with_index(bars)
    raw, volume = F.col("raw_close"), F.col("volume")
    ok = finite(raw) & (raw > 0) & volume.isNotNull() & (volume > 0)
    own = data.columns
    data = data.withColumns({"_valid": F.coalesce(ok, F.lit(False)).cast("long"), "_paid": raw * volume}).withColumn("_dollars", F.when(F.col("_valid") == 1, F.col("_paid")))
    w = Rolls(P)
    mean, dev, high, paid = w.get("avg", "volume", 20), w.get("std", "volume", 20), w.get("max", "close", n), w.get("avg", "_paid", 20)
    before = data.select(
        "*",
        F.coalesce(F.col("idx") - P.lag("idx", n - 1) == n - 1, F.lit(False)).alias("history_complete_60d"),
        change(5).alias("return_5d"),
        change(20).alias("return_20d"),
        P.some(lambda c: F.percentile(c, 0.5), F.col("_dollars"), 20, 1).alias("median_dollar_volume_prior_20d"),
        P.roll(F.sum, F.col("_valid"), 20, 1).alias("valid_price_volume_sessions_prior_20d"),
    )
    out = w.add(before).select(
        *own, "history_complete_60d", "return_5d", "return_20d",
        (ratio(F.col("close"), high) - 1.0).alias("distance_to_60d_high"), paid.alias("average_dollar_volume_20d"), mean.alias("average_volume_20d"),
        "median_dollar_volume_prior_20d", "valid_price_volume_sessions_prior_20d", F.when(dev > 0, (volume - mean) / dev).otherwise(0.0).alias("volume_zscore_20"),
    )
    return with_market(out, {"return_20d": "market_return_20d"}, contract).withColumn("relative_strength_20d", F.col("return_20d") - F.col("market_return_20d"))


def with_market(data: DataFrame, columns: dict[str, str], contract: Contract) -> DataFrame:
    """Adds the benchmark's columns by date."""
    market = data.filter(F.col("ticker") == contract.benchmark).select("dt", *[F.col(a).alias(b) for a, b in columns.items()])
    return data.join(F.broadcast(market), "dt", "left")


def session_moves(data: DataFrame) -> DataFrame:
    """Adds what one session and the one before it give: dollar volume _dv, split-adjusted _open, _high, _low, log return _r, change of log dollar
    volume _dlv, moves within and between sessions, location of the close, true range _tr and squared log range _pk."""
    factor = ratio(F.col("close"), F.col("raw_close"))
    data = data.select("*", (F.col("raw_close") * F.col("volume")).alias("_dv"), (F.col("open") * factor).alias("_open"), (F.col("high") * factor).alias("_high"), (F.col("low") * factor).alias("_low"))
    prior, span = P.lag("close", 1), F.col("_high") - F.col("_low")
    return data.select(
        "*",
        F.log(ratio(F.col("close"), prior)).alias("_r"),
        (F.log1p("_dv") - P.lag(F.log1p("_dv"), 1)).alias("_dlv"),
        (ratio(F.col("close"), F.col("_open")) - 1.0).alias("_intraday"),
        (ratio(F.col("_open"), prior) - 1.0).alias("_gap"),
        F.when(F.abs(span) > 1e-12, (F.col("close") - F.col("_low")) / span).otherwise(0.5).alias("_location"),
        ratio(F.greatest(span, F.abs(F.col("_high") - prior), F.abs(F.col("_low") - prior)), prior).alias("_tr"),
        F.pow(F.log(ratio(F.col("_high"), F.col("_low"))), 2).alias("_pk"),
    )


def research_features(bars: DataFrame, contract: Contract = Contract()) -> DataFrame:
    """base_features plus the research set: three window stages over one partitioning."""
    require_columns(bars, ("open", "high", "low", "raw_close"), "research OHLCV data")
    data = session_moves(base_features(bars, contract))
    r, dv, close = F.col("_r"), F.col("_dv"), F.col("close")
    data = data.select(
        "*", F.abs(r).alias("_ar"), (r * F.col("_dlv")).alias("_rdlv"), (r > 0).cast("double").alias("_up"), F.when(r < 0, r * r).otherwise(0.0).alias("_down"),
        (F.col("volume") == 0).cast("double").alias("_idle"), (ratio(F.abs(r), dv) * 1_000_000.0).alias("_illiquid"),
    )
    w = Rolls(P)
    total, moves = w.get("sum", "_r", 20), w.get("sum", "_ar", 20)
    vol = {n: w.get("std", "_r", n) for n in (5, 20, 59)}
    m5, m20, dvs = w.get("avg", "_dv", 5), w.get("avg", "_dv", 20), w.get("std", "_dv", 20)
    covariance = w.get("avg", "_rdlv", 20) - w.get("avg", "_r", 20) * w.get("avg", "_dlv", 20)
    both = vol[20] * w.get("std", "_dlv", 20)
    hi20, lo20, hi60, lo60 = w.get("max", "close", 20), w.get("min", "close", 20), w.get("max", "close", 60), w.get("min", "close", 60)
    zero_if = lambda ok, value: F.when(ok, value).otherwise(0.0)
    made = [
        zero_if(moves > 1e-12, ratio(F.abs(total), moves)).alias("trend_efficiency_20d"),
        (ratio(close, hi20) - 1.0).alias("distance_to_20d_high"),
        (ratio(close, lo20) - 1.0).alias("distance_to_20d_low"),
        F.when(F.abs(hi60 - lo60) > 1e-12, ratio(close - lo60, hi60 - lo60)).otherwise(0.5).alias("range_position_60d"),
        *[zero_if(vol[n] > 1e-6, vol[n]).alias(f"realized_volatility_{n}d") for n in vol],
        F.sqrt(w.get("avg", "_down", 20)).alias("downside_volatility_20d"),
        w.get("max", "_r", 20).alias("max_daily_return_20d"),
        w.get("min", "_r", 20).alias("min_daily_return_20d"),
        zero_if(vol[20] > 1e-6, ratio(w.get("max", "_ar", 20), vol[20])).alias("jump_ratio_20d"),
        F.log1p(m20).alias("log_average_dollar_volume_20d"),
        zero_if(m20 > 0, ratio(m5, m20) - 1.0).alias("dollar_volume_ratio_5d_20d"),
        zero_if(dvs > 1e-6, ratio(dv - m20, dvs)).alias("dollar_volume_zscore_20d"),
        zero_if(F.abs(both) > 1e-12, ratio(covariance, both)).alias("return_dollar_volume_correlation_20d"),
    ]
    means = {
        "positive_day_fraction_20d": ("_up", 20), "normalized_atr_5d": ("_tr", 5), "normalized_atr_20d": ("_tr", 20), "parkinson_range_20d": ("_pk", 20),
        "intraday_return_mean_5d": ("_intraday", 5), "overnight_gap_mean_5d": ("_gap", 5), "close_location_mean_5d": ("_location", 5),
        "zero_volume_fraction_20d": ("_idle", 20), "amihud_20d": ("_illiquid", 20),
    }
    made += [w.get("avg", c, n).alias(name) for name, (c, n) in means.items()]
    changes = [change(n).alias(f"return_{n}d") for n in (1, 2, 10, 40, 59)] + [(ratio(P.lag("close", 5), P.lag("close", n)) - 1.0).alias(f"momentum_{n}d_ex_last_5d") for n in (20, 40)]
    data = w.add(data.select("*", *changes)).select("*", *made)
    data = with_market(data, {"_r": "_m", "return_5d": "_m5", "return_20d": "spy_return_20d", "realized_volatility_20d": "spy_realized_volatility_20d", "distance_to_60d_high": "spy_distance_to_60d_high"}, contract)
    m = F.col("_m")
    data = data.select("*", (r * m).alias("_rm"), (m * m).alias("_mm"))
    v = Rolls(P)
    mean_m = v.get("avg", "_m", 40)
    cov = v.get("avg", "_rm", 40) - v.get("avg", "_r", 40) * mean_m
    var = v.get("avg", "_mm", 40) - mean_m * mean_m
    betas = [zero_if(var > 1e-12, ratio(cov, var)).alias("beta_40d"), (F.col("return_5d") - F.col("_m5")).alias("excess_return_5d"), (F.col("return_20d") - F.col("spy_return_20d")).alias("excess_return_20d")]
    data = v.add(data).select("*", *betas).withColumn("_e", r - F.col("beta_40d") * m)
    u = Rolls(P)
    noise = u.get("std", "_e", 20)
    rest = [u.get("sum", "_e", 20).alias("residual_momentum_20d"), zero_if(noise > 1e-6, noise).alias("idiosyncratic_volatility_20d")]
    data = u.add(data).select("*", *rest)
    return data.drop(*[c for c in data.columns if c.startswith("_")])


def cross_sectional_ranks(candidates: DataFrame, columns=STOCK_FEATURES, by: str = "dt") -> DataFrame:
    """Adds xrank_<column>: percentile rank within the date, in -1..1, of values rounded to 12 places."""
    rounded = candidates.withColumns({c: F.round(c, 12) for c in columns})
    return rounded.select("*", *[percentile_rank(F.col(c), [by]).alias(f"xrank_{c}") for c in columns])
