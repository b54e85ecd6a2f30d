"""The parameters of a screening contract. Everything that thresholds or counts reads them from here."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Contract:
    benchmark: str = "SPY"
    strategy: str = "rank-v6"
    lookback: int = 60
    horizon: int = 14
    top_k: int = 10
    backtest_days: int = 30
    max_backtest_days: int = 45
    inspect: int = 30
    max_moves: int = 3
    min_close: float = 5.0
    min_average_dollar_volume: float = 10_000_000.0
    min_median_dollar_volume_prior: float = 5_000_000.0
    min_valid_sessions: int = 18
    max_candidates: int = 2000
    hit_return: float = 0.15
    hit_quantile: float = 0.95
    severe_return: float = -0.10
    catastrophic_return: float = -0.20
    adverse_return: float = -0.15
    shortfall_tail: float = 0.10
    min_coverage: float = 0.90
    daily_target: float = 0.10
    passes_required: int = 5

    def __post_init__(self):
        if min(self.lookback, self.horizon, self.top_k, self.max_candidates, self.inspect) < 1:
            raise ValueError("lookback, horizon, top_k, max_candidates and inspect are positive")
        if not 1 <= self.backtest_days <= self.max_backtest_days:
            raise ValueError(f"backtest_days must be in 1..{self.max_backtest_days}")
        if not 0 < self.hit_quantile <= 1 or not 0 < self.shortfall_tail <= 1 or not 0 <= self.min_coverage <= 1:
            raise ValueError("hit_quantile, shortfall_tail and min_coverage are shares")
        if not -1 <= self.catastrophic_return <= self.severe_return < 0 or not -1 <= self.adverse_return < 0:
            raise ValueError("loss thresholds are negative, the catastrophic one lowest")
        if self.hit_return <= 0:
            raise ValueError("hit_return is positive")
        if self.max_moves < 0 or self.inspect < self.top_k:
            raise ValueError("inspect covers top_k; max_moves isn't negative")

    @property
    def history(self) -> int:
        """Sessions that a full back-test needs."""
        return self.lookback + self.horizon + self.max_backtest_days - 1


@dataclass(frozen=True)
class ResearchConfig:
    minimum_training_dates: int = 504
    validation_dates: int = 126
    locked_test_dates: int = 252
    retrain_interval: int = 63
    l2: float = 10.0
    bootstrap_block: int = 14
    bootstrap_replications: int = 10_000
    seed: int = 20260723
    minimum_uplift: float = 0.01
    blend_weights: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)
    risk_lambdas: tuple[float, ...] = (0.0, 1.0, 2.0, 3.0)
    precision_tolerance: float = 0.005
    downside_improvement: float = 0.01
    catastrophic_improvement: float = 0.005
    shortfall_improvement: float = 0.05

    def __post_init__(self):
        if min(self.minimum_training_dates, self.validation_dates, self.locked_test_dates, self.retrain_interval, self.bootstrap_block, self.bootstrap_replications) < 1:
            raise ValueError("research counts are positive")
        if self.l2 < 0 or not 0 <= self.precision_tolerance <= 1:
            raise ValueError("l2 isn't negative; precision_tolerance is a share")
        if 0.0 not in self.blend_weights or any(not 0 <= w <= 1 for w in self.blend_weights):
            raise ValueError("blend weights include zero and stay in [0, 1]")
        if not self.risk_lambdas or min(self.risk_lambdas) < 0:
            raise ValueError("risk lambdas aren't negative")


#: Thresholds at the scale of the driver's tables.
FIXTURE = Contract(min_average_dollar_volume=400_000.0, min_median_dollar_volume_prior=250_000.0, max_candidates=80)
SMALL_FIXTURE = Contract(min_average_dollar_volume=200_000.0, min_median_dollar_volume_prior=150_000.0, max_candidates=80)
FIXTURE_RESEARCH = ResearchConfig(minimum_training_dates=20, validation_dates=8, locked_test_dates=16, retrain_interval=4, bootstrap_block=3)
