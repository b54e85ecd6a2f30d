"""A stream of bitemporal facts: each version stands from its own availability on, and what would be known too early is set aside.

State lives per bucket of symbols and quarter of settlements, on disk and without expiry: each cycle's versions that have come, appended to a list. So a
symbol with many facts is split by time, what a call reads is bounded by a quarter's cycles of a bucket's symbols, and a call's work is done on columns:
its cost is per bucket, not per symbol. A row that is invalid by itself is told so by the plan and passes by the state. A version that came before
is nothing new; one that says otherwise of the same instant, or that claims to have been available before anyone saw it, goes to the rejects with
its reason. Accepted versions are only ever appended, under their batch's number, so a repeated batch replaces itself. As availability is the
fact's own and not its arrival, any order and split of arrivals gives the same table, and a decision as of any instant reads the same rows from it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: observed_at: when the file that holds the fact was seen; null where it is known from its publication alone.
FACTS = "symbol string, settlement_date date, publication_date date, available_at timestamp, short_interest bigint, stock_split_flag boolean, revision_flag boolean, observed_at timestamp"
#: What goes through the state: numbers, so that no null turns a column into floats; these stand for null.
_NO_DAY, _NO_INSTANT, _NO_FLAG = -(2**31), -(2**63), -1
_ROWS = "symbol string, settlement_date int, publication_date int, available_at bigint, short_interest bigint, stock_split_flag int, revision_flag int, observed_at bigint"
_OUT = f"{_ROWS}, newest boolean, reason string"
_COLUMNS = [c.split()[0] for c in _OUT.split(", ")]
_IDENTITY, _PAYLOAD = ["symbol", "settlement_date", "available_at"], ["short_interest", "stock_split_flag", "revision_flag"]
_ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true", "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true"}


class Versions(StatefulProcessor):
    """Per bucket of symbols and quarter of settlements: the payload of each symbol, cycle and availability."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.versions = handle.getListState("versions", "symbol string, settlement_date int, available_at bigint, short_interest bigint, stock_split_flag int, revision_flag int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows), ignore_index=True).assign(newest=False)
        valid = got["reason"].isna()
        told = got.loc[~valid, _COLUMNS]
        if len(told):
            yield told
        # Within a batch the order is by availability, whatever the files' was.
        own = got[valid].sort_values(["available_at", *_PAYLOAD], kind="stable", ignore_index=True)
        if not len(own):
            return
        known = pd.DataFrame(list(self.versions.get()), columns=[*_IDENTITY, *_PAYLOAD])
        both = pd.concat([known, own[[*_IDENTITY, *_PAYLOAD]]], ignore_index=True) if len(known) else own[[*_IDENTITY, *_PAYLOAD]]
        first = both.groupby(_IDENTITY, sort=False)[_PAYLOAD].transform("first")
        came = len(known)
        fresh = ~both.duplicated(_IDENTITY).to_numpy()[came:]
        odd = (both[_PAYLOAD].to_numpy()[came:] != first.to_numpy()[came:]).any(axis=1)
        own.loc[odd, "reason"] = "conflicting_version"
        # Versions of one batch come in the order of their availability, so only those that came before can be later.
        own["newest"] = fresh
        if came:
            last = known.groupby(_IDENTITY[:2], sort=False)["available_at"].max().rename("last").reset_index()
            before = own[_IDENTITY].merge(last, "left", _IDENTITY[:2])
            own["newest"] = fresh & (before["last"].isna().to_numpy() | (own["available_at"].to_numpy() > before["last"].fillna(_NO_INSTANT).astype("int64").to_numpy()))
        new = own.loc[fresh, [*_IDENTITY, *_PAYLOAD]]
        if len(new):
            self.versions.appendList(list(zip(*(new[c].tolist() for c in new.columns))))
        out = own.loc[fresh | odd, _COLUMNS]
        if len(out):
            yield out

    def close(self) -> None:
        pass


def judged(rows: DataFrame) -> DataFrame:
    """Rows with the reason for which each is invalid by itself, if any."""
    col = F.col
    incomplete = col("short_interest") < 0
    for c in ("symbol", *_IDENTITY[1:], *_PAYLOAD):
        incomplete = incomplete | col(c).isNull()
    day = F.to_date("available_at")
    reason = (
        F.when(incomplete, "incomplete")
        .when(day < col("settlement_date"), "available_before_settlement")
        .when(day < col("publication_date"), "available_before_publication")
        .when(col("revision_flag") & col("observed_at").isNull(), "revision_without_observation")
        .when(col("revision_flag") & (col("available_at") < col("observed_at")), "back_dated")
    )
    return rows.withColumn("reason", reason)


def _in_numbers(rows: DataFrame) -> DataFrame:
    day = lambda c: F.coalesce(F.unix_date(c), F.lit(_NO_DAY)).alias(c)
    at = lambda c: F.coalesce(F.unix_micros(c), F.lit(_NO_INSTANT)).alias(c)
    flag = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(_NO_FLAG)).alias(c)
    quantity = F.coalesce("short_interest", F.lit(_NO_INSTANT)).alias("short_interest")
    return rows.select("symbol", day("settlement_date"), day("publication_date"), at("available_at"), quantity, flag("stock_split_flag"), flag("revision_flag"), at("observed_at"), *[c for c in rows.columns if c not in _COLUMNS[:8]])


def _in_facts(rows: DataFrame) -> DataFrame:
    day = lambda c: F.when(F.col(c) != _NO_DAY, F.date_from_unix_date(c)).alias(c)
    at = lambda c: F.when(F.col(c) != _NO_INSTANT, F.timestamp_micros(c)).alias(c)
    flag = lambda c: F.when(F.col(c) != _NO_FLAG, F.col(c) == 1).alias(c)
    quantity = F.when(F.col("short_interest") != _NO_INSTANT, F.col("short_interest")).alias("short_interest")
    return rows.select("symbol", day("settlement_date"), day("publication_date"), at("available_at"), quantity, flag("stock_split_flag"), flag("revision_flag"), at("observed_at"), "newest", "reason")


def stream_facts(spark: SparkSession, incoming: str, out: str, work: str, files_per_batch: int = 20, buckets: int = 128) -> None:
    """Bring all fact files that arrived (FACTS) into ``<out>/facts`` and ``<out>/rejected``. A restart goes on from the state that is there.

    buckets: into how many the symbols are dealt, fixed with the state. One holds the versions of its symbols in a quarter at once."""
    before = {k: spark.conf.get(k, None) for k in _ROCKS}
    for k, v in _ROCKS.items():
        spark.conf.set(k, v)

    def commit(batch: DataFrame, number: int) -> None:
        rows = _in_facts(batch).persist()
        try:
            rows.filter("reason IS NULL").drop("reason").write.mode("overwrite").parquet(f"{out}/facts/batch={number}")
            rows.filter("reason IS NOT NULL").drop("newest").write.mode("overwrite").parquet(f"{out}/rejected/batch={number}")
        finally:
            rows.unpersist()

    try:
        rows = spark.readStream.schema(FACTS).option("maxFilesPerTrigger", files_per_batch).parquet(incoming)
        span = F.year("settlement_date") * 4 + F.quarter("settlement_date")
        bucket = F.pmod(F.xxhash64("symbol"), F.lit(buckets))
        keyed = _in_numbers(judged(rows).withColumns({"span": span, "bucket": bucket}))
        versions = keyed.groupBy("bucket", "span").transformWithStateInPandas(Versions(), _OUT, "Append", "None")
        versions.writeStream.option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).foreachBatch(commit).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def facts(spark: SparkSession, out: str) -> DataFrame:
    """All accepted versions, for ``bitemporal.known_positions``."""
    return spark.read.schema(f"{FACTS}, newest boolean").parquet(f"{out}/facts").drop("newest", "batch")


def rejected(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(f"{FACTS}, reason string").parquet(f"{out}/rejected").drop("batch")


def newest(spark: SparkSession, out: str) -> DataFrame:
    """The newest version of each cycle: of those that were newest when they came, so a fraction of all versions is looked at."""
    fields = [c.split()[0] for c in FACTS.split(", ") if c.split()[0] not in ("symbol", "settlement_date")]
    rows = spark.read.schema(f"{FACTS}, newest boolean").parquet(f"{out}/facts").filter("newest")
    top = F.max_by(F.struct(*fields), "available_at").alias("t")
    return rows.groupBy("symbol", "settlement_date").agg(top).select("symbol", "settlement_date", "t.*")
