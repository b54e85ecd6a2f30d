"""The driver's tables, reshaped to bars, events and directories that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_ticker(key) -> F.Column:
    return F.concat(F.lit("S"), F.lpad(key.cast("string"), 6, "0"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly OHLCV per supplier and a benchmark: one aggregation of lineitem, with map-side combine."""
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity", "l_extendedprice")
    px = F.col("l_extendedprice") / F.col("l_quantity")
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", px.alias("px"))
    month = F.trunc(F.col("l_shipdate").cast("date"), "month")
    own = li.groupBy("l_suppkey", month.alias("dt")).agg(
        F.min(at)["px"].alias("open"), F.max(px).alias("high"), F.min(px).alias("low"), F.max(at)["px"].alias("raw_close"), F.sum("l_quantity").cast("long").alias("volume")
    )
    halved = (F.col("l_suppkey") % 7 == 0) & (F.col("dt") < F.lit("1998-01-01").cast("date"))
    close = F.when(halved, F.col("raw_close") * 0.5).otherwise(F.col("raw_close"))
    own = own.select(supplier_ticker(F.col("l_suppkey")).alias("ticker"), "dt", "open", "high", "low", close.alias("close"), "raw_close", "volume")
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    market = own.groupBy("dt").agg(mean("open"), mean("high"), mean("low"), mean("raw_close"), F.sum("volume").alias("volume"))
    market = market.select(F.lit("SPY").alias("ticker"), "dt", "open", "high", "low", F.col("raw_close").alias("close"), "raw_close", "volume")
    return own.unionByName(market)


def daily_calendar(spark: SparkSession) -> DataFrame:
    """Weekday sessions 1995-2001: session, idx, close_ts (18:00 UTC on a month's last session, else 21:00)."""
    days = spark.sql("SELECT explode(sequence(DATE'1995-01-02', DATE'2001-12-31', INTERVAL 1 DAY)) AS session").filter(F.weekday("session") < 5)
    month = Window.partitionBy(F.trunc("session", "month"))
    last = F.max("session").over(month) == F.col("session")
    close = F.col("session").cast("timestamp") + F.when(last, F.expr("INTERVAL 18 HOURS")).otherwise(F.expr("INTERVAL 21 HOURS"))
    return days.select("session", (F.row_number().over(Window.orderBy("session")) - 1).cast("long").alias("idx"), close.alias("close_ts"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, decision_date: every supplier at the last session of each quarter 1996Q1..2001Q3."""
    days = daily_calendar(spark).filter("session >= '1996-01-01' AND session < '2001-10-01'")
    quarters = days.groupBy(F.date_trunc("quarter", "session")).agg(F.max("session").alias("decision_date")).select("decision_date")
    who = read(spark, sf_dir, "supplier").select(supplier_ticker(F.col("s_suppkey")).alias("ticker"))
    return who.crossJoin(F.broadcast(quarters))


# Forms and items that order keys are dealt to.
FORMS = ("8-K", "6-K", "S-3", "424B5", "NT 10-Q", "SC 13D", "SC 13D/A", "10-K")
ITEMS = ("2.02,9.01", "1.01", "9.01", "8.01", "")


def _dealt(values, key) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, accepted_at, available_at, form, items, accession_number from orders."""
    n = F.broadcast(read(spark, sf_dir, "supplier").agg(F.count("*").alias("n_suppliers")))
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").crossJoin(n)
    at = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") % 24) * 3600)
    return o.select(
        supplier_ticker(F.col("o_custkey") % F.col("n_suppliers")).alias("ticker"),
        at.alias("accepted_at"),
        at.alias("available_at"),
        _dealt(FORMS, F.col("o_orderkey")).alias("form"),
        _dealt(ITEMS, F.col("o_orderkey")).alias("items"),
        F.col("o_orderkey").cast("string").alias("accession_number"),
    )


def insider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insider trades from lineitem; every third line number has a second owner."""
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    own = F.col("l_partkey") % 50
    owners = F.when(F.col("l_linenumber") % 3 == 0, F.array(own, own + 100)).otherwise(F.array(own))
    at = F.col("l_shipdate").cast("timestamp")
    code = F.when(F.col("l_returnflag") == "A", "P").when(F.col("l_returnflag") == "N", "S").otherwise("P")
    return li.select(
        supplier_ticker(F.col("l_suppkey")).alias("ticker"),
        at.alias("available_at"),
        at.alias("accepted_at"),
        code.alias("transaction_code"),
        F.col("l_quantity").alias("shares"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.explode(owners.cast("array<string>")).alias("insider_id"),
        F.when(F.col("l_linenumber") != 7, F.col("l_linestatus") == "O").alias("is_10b5_1"),
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("transaction_id"),
    )


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources per supplier: missing for keys divisible by 10, with a hole in March 1998 for remainder 1, else complete."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey")
    row = lambda a, b, st: F.struct(F.lit(a).cast("date").alias("coverage_start"), F.lit(b).cast("date").alias("coverage_end"), F.lit(st).alias("status"))
    whole, hole = [row("1995-01-01", "2001-12-31", "complete")], [row("1995-01-01", "1998-02-28", "complete"), row("1998-04-01", "2001-12-31", "complete")]
    parts = F.when(F.col("s_suppkey") % 10 == 0, F.array(row("1995-01-01", "2001-12-31", "missing"))).when(F.col("s_suppkey") % 10 == 1, F.array(*hole)).otherwise(F.array(*whole))
    base = s.select(supplier_ticker(F.col("s_suppkey")).alias("ticker"), F.explode(F.array(F.lit("filings"), F.lit("insider"))).alias("source"), parts.alias("p"))
    return base.select("ticker", "source", F.inline("p"))


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, flagged: suppliers whose key is divisible by 9 are under a definitive transaction."""
    s = read(spark, sf_dir, "supplier")
    return s.select(supplier_ticker(F.col("s_suppkey")).alias("ticker"), (F.col("s_suppkey") % 9 == 0).alias("flagged"))


def securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part rows as securities, in three versions of a directory by key."""
    p = read(spark, sf_dir, "part")
    version = (F.col("p_partkey") % 3).cast("int")
    as_of = F.date_add(F.lit("2000-01-01").cast("date"), version * 10)
    return p.select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"),
        F.col("p_name").alias("security_name"),
        F.col("p_type").alias("category"),
        as_of.alias("as_of"),
        (as_of.cast("timestamp") + F.expr("INTERVAL 30 HOURS")).alias("available_at"),
    )
