"""Declared schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

OHLCV = "ticker string, dt date, open double, high double, low double, close double, raw_close double, volume bigint"
UNIVERSE = "symbol string, security_name string, exchange string, security_type string, flags array<string>, source string, file_creation_time timestamp, available_at timestamp"
LEDGER = "ticker string, decision_date date, score double, rank bigint, strategy_version string, universe_size bigint"
FILINGS = "ticker string, accepted_at timestamp, available_at timestamp, form string, items string, accession_number string"
INSIDER = "ticker string, available_at timestamp, accepted_at timestamp, transaction_code string, shares double, price double, insider_id string, is_10b5_1 boolean, transaction_id string"
COVERAGE = "ticker string, source string, coverage_start date, coverage_end date, status string"
SHORT_INTEREST = "symbol string, settlement_date date, publication_date date, available_at timestamp, short_interest double, stock_split_flag boolean, revision_flag boolean"


def require_columns(df: DataFrame, columns, what: str = "table") -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} misses columns: {missing}")
