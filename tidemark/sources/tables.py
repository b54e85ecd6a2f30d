"""Stored tables: partitioned bars with upsert, immutable ledger, content-addressed snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.panel import checked_bars, keep_last
from ..schemas import LEDGER, OHLCV, require_columns


#: Up to so many rows a table's digests are gathered under one hexadecimal digit.
DIGESTS_PER_BUCKET = 1 << 16


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def scan_bars(spark: SparkSession, path: str, date: str | None = None) -> DataFrame:
    """Bars by declared schema (missing columns are null); one date reads one partition. No rows for the filter: error."""
    df = spark.read.schema(OHLCV).parquet(path)
    if date is not None:
        df = df.filter(F.col("dt") == F.lit(date).cast("date"))
    if df.isEmpty():
        raise FileNotFoundError(f"no bars at {path}" + (f" for {date}" if date else ""))
    return df


def upsert_bars(df: DataFrame, path: str, staging: str) -> None:
    """Merge rows by (ticker, dt), new ones winning, and rewrite the dates they touch alone."""
    spark = df.sparkSession
    new = checked_bars(df).select("ticker", "dt", "open", "high", "low", "close", "raw_close", F.col("volume").cast("long")).withColumn("_seq", F.lit(1))
    rows = new
    if exists(spark, path):
        days = new.select("dt").distinct()
        old = spark.read.schema(OHLCV).parquet(path).join(F.broadcast(days), "dt", "left_semi").withColumn("_seq", F.lit(0))
        rows = new.unionByName(old, allowMissingColumns=True)
    keep_last(rows, ["ticker", "dt"], "_seq").drop("_seq").write.mode("overwrite").parquet(staging)
    merged = spark.read.parquet(staging).repartition("dt").sortWithinPartitions("dt", "ticker")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path)


def checked_predictions(p: DataFrame) -> DataFrame:
    """Predictions of one date and strategy: size equals rows, ranks are 1..n, tickers differ. Anything else: error."""
    require_columns(p, ("ticker", "decision_date", "score", "rank", "strategy_version", "universe_size"), "predictions")
    r = p.agg(F.count("*").alias("n"), F.countDistinct("decision_date", "strategy_version", "universe_size").alias("heads"), F.max("universe_size").alias("size"), F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.countDistinct("rank").alias("ranks"), F.countDistinct("ticker").alias("names"), F.max("strategy_version").alias("s")).first()
    if not r.n or r.heads != 1 or not (r.size == r.n == r.hi == r.ranks == r.names) or r.lo != 1:
        raise ValueError("predictions aren't one complete ranking")
    if not all(ch.isalnum() or ch in "._-" for ch in r.s):
        raise ValueError("strategy name holds other signs than letters, digits, dot, hyphen and underscore")
    return p


def append_ledger(p: DataFrame, path: str) -> None:
    """Write one ranking where none is stored for its date and strategy; what is stored is never replaced."""
    spark = p.sparkSession
    checked_predictions(p)
    head = p.select("decision_date", "strategy_version").first()
    at = f"{path}/decision_date={head.decision_date}/strategy_version={head.strategy_version}"
    if exists(spark, at):
        raise FileExistsError(f"a ranking is stored at {at}")
    p.select("ticker", "score", "rank", "universe_size").sortWithinPartitions("rank").write.mode("errorifexists").parquet(at)


def scan_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(path)


def record_or_restore(p: DataFrame, path: str) -> DataFrame:
    """The stored ranking of the date and strategy, which is ``p`` itself unless one was stored before."""
    spark = p.sparkSession
    head = p.select("decision_date", "strategy_version").first()
    at = f"{path}/decision_date={head.decision_date}/strategy_version={head.strategy_version}"
    if not exists(spark, at):
        append_ledger(p, path)
    return scan_ledger(spark, path).filter((F.col("decision_date") == F.lit(head.decision_date)) & (F.col("strategy_version") == head.strategy_version))


def content_digest(rows: DataFrame, columns: list[str]) -> str:
    """A digest of a table's content whatever its order: rows' digests, sorted and hashed together by bucket, then the buckets' digests.

    Buckets hold some thousands of rows each, so no task gathers more than that."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    n = rows.count()
    wide = 1 if n < DIGESTS_PER_BUCKET else 2 if n < DIGESTS_PER_BUCKET << 8 else 4
    while True:
        rows = rows.select(row.alias("d")).groupBy(F.substring("d", 1, wide).alias("b")).agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("d"))), 256).alias("d"))
        if wide == 1:
            break
        row, wide = F.concat_ws(":", "b", "d"), wide // 2
        row = F.sha2(row, 256)
    last = rows.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "b", "d"))), ",").alias("d"))
    return last.select(F.sha2(F.concat_ws(":", F.lit(n), "d"), 256)).first()[0]


def save_snapshot(rows: DataFrame, path: str, as_of: str, available_at: str) -> str:
    """Store a directory under as_of=/digest=. Saving the same content again keeps the first observation. Returns the digest."""
    spark = rows.sparkSession
    names = sorted(rows.columns)
    digest = content_digest(rows, names)
    at = f"{path}/as_of={as_of}/digest={digest}"
    if not exists(spark, at):
        if available_at[:10] < as_of:
            raise ValueError("a snapshot can't be available before its date")
        rows.withColumn("available_at", F.lit(available_at).cast("timestamp")).write.mode("errorifexists").parquet(at)
    return digest


def read_snapshot(spark: SparkSession, path: str, as_of: str, digest: str) -> DataFrame:
    """A stored snapshot; one whose content doesn't give its digest, or with several observation times, is refused."""
    rows = spark.read.parquet(f"{path}/as_of={as_of}/digest={digest}")
    if rows.select("available_at").distinct().count() > 1 or content_digest(rows, sorted(c for c in rows.columns if c != "available_at")) != digest:
        raise ValueError("snapshot content doesn't match its digest")
    return rows


def universe(listed: DataFrame, keep: Column, benchmark: str = "SPY") -> DataFrame:
    """Tickers of kept directory rows and the benchmark."""
    spark = listed.sparkSession
    return listed.filter(keep).select(F.col("symbol").alias("ticker")).union(spark.createDataFrame([(benchmark,)], "ticker string")).distinct()
