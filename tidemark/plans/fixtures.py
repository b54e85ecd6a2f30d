"""Inputs that queries derive from the driver's tables by way of files: written in the shared folder, read by the readers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import driver_tables as T
from ..functions.scalars import r6
from ..operators import bitemporal as B
from ..operators import calendar as C
from ..operators import research as K
from ..operators import transactions as X
from ..sources import archives as RA
from ..sources import readers as RD
from ..streaming import facts as SF
from ..streaming import ingest as SI


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share; a local one where the session names none."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tidemark.files", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.tidemark.files", at)
    return f"{at.rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex[:12]}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def written(rows: DataFrame, name: str, sep: str = "|", header: bool = True) -> str:
    path = scratch(rows.sparkSession, name)
    rows.write.option("sep", sep).option("header", header).option("emptyValue", "").csv(path)
    return path


def lines(rows: DataFrame, name: str) -> str:
    path = scratch(rows.sparkSession, name)
    rows.select(F.col("value")).write.text(path)
    return path


#: The driver's months as sessions that close on their last day.
def month_calendar(spark: SparkSession) -> DataFrame:
    from pyspark.sql import Window

    months = spark.sql("SELECT explode(sequence(DATE'1994-01-01', DATE'2003-12-01', INTERVAL 1 MONTH)) AS session")
    return months.select("session", (F.row_number().over(Window.orderBy("session")) - 1).cast("long").alias("idx"), (F.last_day("session").cast("timestamp") + F.expr("INTERVAL 21 HOURS")).alias("close_ts"))


def receptions(spark: SparkSession, sf_dir: str) -> str:
    """An archive of filing indexes and insider files by quarter: one quarter observed twice, one while it was open, one never."""
    root = scratch(spark, "archive")
    o = T.read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    for period, first, upto, told in (("1996Q1", "1996-01-01", "1996-03-31", ("1996-02-15", "1996-03-31")), ("1996Q2", "1996-04-01", "1996-06-30", ("1996-06-28",)), ("1996Q3", "1996-07-01", "1996-09-30", ("1996-08-14",))):
        for day in told:
            own = o.filter(F.col("d").between(first, min(upto, day))).select(F.concat_ws("|", F.lit("1"), F.lit("Name"), F.lit("8-K"), F.date_format("d", "yyyy-MM-dd"), F.concat(F.lit("edgar/data/1/"), _accession(F.col("o_orderkey")), F.lit(".txt"))).alias("value"))
            said = spark.range(1).select(F.concat(F.lit("Last Data Received: "), F.date_format(F.lit(day).cast("date"), "MMMM d, yyyy")).alias("value"))
            RA.store(own.unionByName(said), root, "filing-index", period, day if day < upto else "1996-04-20")
    for period, day in (("1996Q1", "1996-04-15"), ("1996Q2", "1996-06-30"), ("1996Q4", "1997-01-10")):
        RA.store(spark.range(1).select(F.lit(period).alias("value")), root, "insider", period, day)
    return root


def directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    yes = lambda m: F.when(k % m == 0, "Y").otherwise("N")
    p = T.read(spark, sf_dir, "part").select(F.concat(F.lit("P"), k.cast("string")).alias("Symbol"), F.col("p_name").alias("Security Name"), F.expr("substring(p_brand, 7)").alias("Market Category"), yes(13).alias("Test Issue"), yes(11).alias("ETF"), F.lit("N").alias("NextShares"), k)
    foot = p.limit(1).select(F.lit("File Creation Time: 0101200000:00").alias("Symbol"), *[F.lit("").alias(c) for c in ("Security Name", "Market Category", "Test Issue", "ETF", "NextShares")])
    listed = p.filter(k % 2 == 0).drop("p_partkey").unionByName(foot)
    other = p.filter(k % 2 == 1).select(F.col("Symbol").alias("ACT Symbol"), "Security Name", F.lit("N").alias("Exchange"), "ETF", "Test Issue")
    return RD.symbol_directories(spark, written(listed, "listed"), written(other, "other"), F.lit("2000-01-02").cast("timestamp"))


def short_positions(spark: SparkSession, sf_dir: str, cal: DataFrame) -> DataFrame:
    """suppkey, settlement_date, quantity: line quantities summed to the cycle that ends on or after the ship date."""
    ends = C.reporting_cycles(cal).select(F.col("settlement_date").alias("session"))
    days = C.all_days(ends)
    li = T.read(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_shipdate").cast("date").alias("day"), "l_quantity")
    per = li.join(F.broadcast(days), "day").groupBy("l_suppkey", F.col("session").alias("settlement_date")).agg(F.sum("l_quantity").alias("quantity"))
    return per


def short_interest_read(spark: SparkSession, sf_dir: str, cal: DataFrame | None = None) -> DataFrame:
    """The positions by way of the archive: delimited files with their own header names and thousands separators, one per observation.

    Some suppliers' cycles of two years come again as revised rows, a tenth more, in files observed at later dates."""
    root, cal = scratch(spark, "archive"), T.daily_calendar(spark) if cal is None else cal
    # Every file reads them twice, for its digest and its rows.
    s = stored(short_positions(spark, sf_dir, cal), "quantities")

    def put(rows: DataFrame, quantity, mark: str, period: str, observed_at: str) -> None:
        own = rows.select(
            T.supplier_ticker(F.col("l_suppkey")).alias("symbolCode"), F.format_number(quantity, 0).alias("currentShortPositionQuantity"), F.when(F.col("l_suppkey") % 17 == 0, "S").otherwise("").alias("stockSplitFlag"),
            F.lit(mark).alias("revisionFlag"), F.date_format("settlement_date", "yyyyMMdd").alias("settlementDate"),
        )
        RA.store(own, root, "short-interest", period, observed_at, "|")

    quantity = F.col("quantity").cast("long")
    put(s, quantity, "", "all", "2001-12-01")
    again = s.filter((F.col("l_suppkey") + F.month("settlement_date")) % 11 == 0)
    for year, mark in ((1998, "R"), (1999, "revised")):
        put(again.filter(F.year("settlement_date") == year), F.floor(quantity * 1.1), mark, f"revised-{year}", f"{year + 1}-06-15")
    return RA.observed_positions(spark, root, "2001-12-15", cal, C.reporting_cycles(cal).filter("publication_date IS NOT NULL"))


def positions(spark: SparkSession, sf_dir: str, cal: DataFrame | None = None) -> DataFrame:
    """Positions with revisions: a tenth more, observed 20 sessions after settlement, for some suppliers and months."""
    cal = T.daily_calendar(spark) if cal is None else cal
    first = stored(short_interest_read(spark, sf_dir, cal).filter("NOT revision_flag").withColumn("short_interest", F.col("short_interest").cast("double")), "positions")
    key = F.expr("cast(substring(symbol, 2) AS long)")
    late = first.filter((key + F.month("settlement_date")) % 11 == 0).join(F.broadcast(cal.select(F.col("session").alias("settlement_date"), (F.col("idx") + 21).alias("k"))), "settlement_date")
    late = late.join(F.broadcast(cal.select(F.col("idx").alias("k"), F.col("close_ts").alias("seen"))), "k")
    late = late.select("symbol", "settlement_date", "publication_date", F.col("seen").alias("available_at"), F.floor(F.col("short_interest") * 1.1).cast("double").alias("short_interest"), "stock_split_flag", F.lit(True).alias("revision_flag"))
    return first.filter("available_at IS NOT NULL").unionByName(late)


def short_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.short_interest_features(T.decisions(spark, sf_dir), positions(spark, sf_dir), T.daily_calendar(spark))


def event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.event_features(T.decisions(spark, sf_dir), T.filings(spark, sf_dir), T.insider(spark, sf_dir), T.coverage(spark, sf_dir), T.daily_calendar(spark))


def external(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """Event and short-interest features of every decision. Calendar and decisions are tables, which plans scan where they would make them again and again.

    whole: event features are a table as well, which halves the plan where all of them are read; what reads a few prunes the others."""
    cal, asked = stored(T.daily_calendar(spark), "calendar"), stored(T.decisions(spark, sf_dir), "decisions")
    events = B.event_features(asked, T.filings(spark, sf_dir), T.insider(spark, sf_dir), T.coverage(spark, sf_dir), cal)
    events = stored(events, "events") if whole else events
    return events.join(B.by_key(B.short_interest_features(asked, positions(spark, sf_dir, cal), cal)), ["ticker", "decision_date"], "left")


def _accession(k) -> F.Column:
    return F.concat(F.lpad(k.cast("string"), 10, "0"), F.lit("-24-"), F.lpad((k % 1000000).cast("string"), 6, "0"))


def filing_index_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = T.read(spark, sf_dir, "orders").withColumn("cik", (F.col("o_custkey") % 10).cast("string"))
    row = F.concat_ws("|", "cik", F.lit("Some Company"), T._dealt(T.FORMS, k), F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat(F.lit("edgar/data/"), F.col("cik"), F.lit("/"), _accession(k), F.lit(".txt")))
    head = spark.createDataFrame([("Description: Master Index",), ("Last Data Received: March 31, 1998",), ("CIK|Company Name|Form Type|Date Filed|Filename",), ("-----",)], "value string")
    who = spark.range(10).select(F.col("id").alias("cik"), T.supplier_ticker(F.col("id")).alias("ticker"))
    return RD.filing_index(spark, lines(head.unionByName(o.select(row.alias("value"))), "index"), who, T.daily_calendar(spark), ("8-K", "6-K", "SC 13D"))


def insider_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = T.read(spark, sf_dir, "lineitem").withColumn("ACCESSION_NUMBER", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    sub = li.select("ACCESSION_NUMBER", F.upper(F.date_format("l_shipdate", "dd-MMM-yyyy")).alias("FILING_DATE"), F.lit("4").alias("DOCUMENT_TYPE"), (F.col("l_suppkey") + 1).alias("ISSUERCIK"), F.when(F.col("l_linestatus") == "O", "1").otherwise("").alias("AFF10B5ONE"))
    tx = li.select("ACCESSION_NUMBER", F.lit(1).alias("NONDERIV_TRANS_SK"), F.when(F.col("l_returnflag") == "A", "P").otherwise("S").alias("TRANS_CODE"), F.lit("A").alias("TRANS_ACQUIRED_DISP_CD"), F.col("l_quantity").alias("TRANS_SHARES"), F.col("l_extendedprice").alias("TRANS_PRICEPERSHARE"))
    own = F.col("l_partkey") % 50
    who = li.select("ACCESSION_NUMBER", F.explode(F.when(F.col("l_partkey") % 2 == 0, F.array(own, own + 100)).otherwise(F.array(own))).alias("RPTOWNERCIK"))
    keys = T.read(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1).alias("cik"), T.supplier_ticker(F.col("s_suppkey")).alias("ticker"))
    return RD.insider_archive(spark, written(sub, "submission", "\t"), written(tx, "transactions", "\t"), written(who, "owners", "\t"), keys, T.daily_calendar(spark))


def ticker_map_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by way of JSON objects of objects, one object per line of a hundred keys' worth."""
    s = T.read(spark, sf_dir, "supplier").select(F.floor(F.col("s_suppkey") / 100).alias("g"), F.col("s_suppkey").cast("string").alias("k"), F.struct((F.col("s_suppkey") + 1).alias("cik_str"), F.concat(F.lit(" s."), F.col("s_suppkey").cast("string")).alias("ticker")).alias("v"))
    objects = s.groupBy("g").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("value"))
    path = scratch(spark, "tickers")
    objects.repartition("g").select("value", "g").write.partitionBy("g").text(path)
    return RD.ticker_map(spark, f"{path}/*")


def filing_table_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    at = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + (k % 24) * 3600)
    o = T.read(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("cik"), _accession(k).alias("a"), F.when(k % 2 == 0, "8-k").otherwise(" 6-K").alias("f"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"),
        F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000Z")).alias("t"), T._dealt(T.ITEMS, k).alias("i"), F.concat(F.lit("d"), k.cast("string"), F.lit(".htm")).alias("p"),
    )
    # Several objects of some hundred filings each per issuer, as one with many filings would be one value.
    rows = o.groupBy("cik", F.floor(k / 1000).alias("chunk")).agg(F.collect_list(F.struct("a", "f", "d", "t", "i", "p")).alias("r"))
    json = F.to_json(F.struct(F.col("r.a").alias("accessionNumber"), F.col("r.f").alias("form"), F.col("r.d").alias("filingDate"), F.col("r.t").alias("acceptanceDateTime"), F.col("r.i").alias("items"), F.col("r.p").alias("primaryDocument")))
    return RD.filing_table(rows.select("cik", json.alias("value")))


def vendor_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = T.read(spark, sf_dir, "lineitem").select(F.trunc(F.col("l_shipdate").cast("date"), "month").alias("dt"), "l_returnflag", "l_extendedprice", "l_quantity")
    names = ["A", "N", "R"]
    on = lambda t, c: F.when(F.col("l_returnflag") == t, F.col(c))
    wide = li.groupBy("dt").agg(*[a for t in names for a in (F.max(on(t, "l_extendedprice")).alias(f"Adj Close:{t}"), F.min(on(t, "l_extendedprice")).alias(f"Close:{t}"), F.sum(on(t, "l_quantity")).cast("long").alias(f"Volume:{t}"))])
    return RD.vendor_bars(wide, names, {"Adj Close": "close", "Close": "raw_close", "Volume": "volume"})


def conversation_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as issuers' filings: turns in order, some of them as tender-offer forms."""
    c = T.read(spark, sf_dir, "conversations")
    form = F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") == 1), "SC 14D9/A").when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 2), "SC 14D9").otherwise("8-K")
    f = c.select(F.col("conv_id").cast("string").alias("ticker"), F.timestamp_seconds("turn").alias("accepted_at"), form.alias("form"), "text", F.col("turn"))
    f = X.with_events(f, positive=(r"\bthe\b.{0,30}\bof\b",), completion=(r"\band\b.{0,20}\bthe\b",), termination=(r"\bthat\b",))
    order = F.concat_ws("-", F.col("turn").cast("string"), F.col("form"), *[F.col(x).cast("int").cast("string") for x in ("positive", "completed", "terminated")])
    return f.withColumn("accession_number", order).drop("turn")


#: Forms of the filings that the states as of decisions are taken from.
DEAL_FORMS = ("8-K", "SC 14D9/A", "6-K", "SC 14D9", "S-4", "DEFM14A")


def deal_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as filings of their suppliers, with event flags by key: beginnings, ends, both at once, late amendments."""
    k = F.col("accession_number").cast("long")
    flag = lambda a, b, c: (F.floor(k / a) % b) == c
    f = T.filings(spark, sf_dir).select("ticker", "accepted_at", "accession_number", T._dealt(DEAL_FORMS, F.floor(k / 3)).alias("form"))
    return f.select("*", flag(2, 5, 0).alias("positive"), flag(7, 6, 1).alias("completed"), flag(5, 7, 2).alias("terminated"), flag(11, 4, 0).alias("supp_completed"), flag(3, 5, 1).alias("supp_terminated"))


def deal_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = T.daily_calendar(spark).select(F.col("session").alias("decision_date"), F.col("close_ts").alias("decision_at"))
    return T.decisions(spark, sf_dir).join(F.broadcast(days), "decision_date")


def dated_statuses(spark: SparkSession, ranking: DataFrame) -> DataFrame:
    """Flags that change from month to month; some dates lack the status of one name in eleven."""
    key = F.expr("cast(substring(ticker, 2) AS long)")
    k = key + F.month("decision_date")
    rows = ranking.select("ticker", "decision_date", (k % 9 == 0).alias("flagged"), k.alias("k"))
    return rows.filter(~((F.month("decision_date") % 5 == 0) & (F.col("k") % 11 == 0))).drop("k")


def boosted(spark: SparkSession, sf_dir: str, matured: DataFrame, risk: bool) -> DataFrame:
    m = matured.filter("is_explosion IS NOT NULL").select("ticker", "decision_date", "score", F.col("rank").cast("double").alias("rank"), "ranking_relevance", "is_severe_downside", F.col("rank").alias("rank_v6"))
    day = F.month("decision_date") + 12 * F.year("decision_date")
    training, validation = m.filter(day % 3 != 0), m.filter(day % 3 == 0)
    fit = K.fit_risk if risk else K.fit_boom
    model = fit(training, validation, ["score", "rank"], rounds=20)
    return K.predict(model, m, ["score", "rank"], "predicted", risk).select("ticker", "decision_date", r6(F.col("predicted")).alias("predicted"))


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bars arrive as files, first with other volumes and some of them broken, then as they are; the stored table holds each bar once."""
    from ..sources.tables import scan_bars

    incoming, path, work = scratch(spark, "incoming"), scratch(spark, "bars"), scratch(spark, "work")
    b = stored(T.bars(spark, sf_dir), "bars")
    b.withColumn("volume", F.col("volume") + 5).write.parquet(incoming)
    SI.stream_bars(spark, incoming, path, work)
    b.unionByName(b.filter("volume % 7 = 0").withColumn("close", F.lit(-1.0))).write.mode("append").parquet(incoming)
    SI.stream_bars(spark, incoming, path, work)
    return scan_bars(spark, path).select("ticker", "dt", "open", "high", "low", "close", "raw_close", "volume")


def late_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "facts")
    e = T.read(spark, sf_dir, "events").select("event_id", "user_id", "value", F.col("ts").cast("timestamp").alias("available_at"))
    SI.append_facts(e, path)
    SI.append_facts(e.filter("event_id % 5 = 0").select("event_id", "user_id", (F.col("value") + 1).alias("value"), (F.col("available_at") + F.expr("INTERVAL 2 DAYS")).alias("available_at")), path)
    return B.newest_known(spark.read.parquet(path), ["event_id"], F.col("available_at") <= F.lit("2024-01-10").cast("timestamp"), ["available_at"])


def streamed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    incoming, out, work = scratch(spark, "events"), scratch(spark, "counts"), scratch(spark, "work")
    e = T.read(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    e.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(incoming)
    SI.stream_counts(spark, incoming, "event_type string, ts timestamp, value double", out, work, late="3650 days")
    return SI.latest_counts(spark, out)


def late_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arrive in two halves by time; after them every seventh event comes again, once two hours late and once days late.

    The watermark of a day lets the former in and leaves the latter out, which the events' spread of weeks makes a real choice."""
    incoming, out, work = scratch(spark, "events"), scratch(spark, "counts"), scratch(spark, "work")
    e = stored(T.read(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value", "event_id"), "events")
    top = e.agg(F.max("ts").alias("top"))
    rows = e.crossJoin(F.broadcast(top))
    again = rows.filter("event_id % 7 = 0")
    near, far = again.filter(F.col("ts") >= F.col("top") - F.expr("INTERVAL 20 HOURS")), again.filter(F.col("ts") < F.col("top") - F.expr("INTERVAL 50 HOURS"))
    # A watermark moves after a batch, so the late rows come in a run of their own, behind one that has moved it.
    last = rows.filter("ts = top").limit(1).withColumn("value", F.lit(0.0))
    for part in (rows, last, near.unionByName(far)):
        part.select("event_type", "ts", "value").coalesce(4).write.mode("append").parquet(incoming)
        SI.stream_counts(spark, incoming, "event_type string, ts timestamp, value double", out, work, late="1 day")
    return SI.latest_counts(spark, out)


def arrivals(spark: SparkSession, sf_dir: str) -> str:
    """Positions and their revisions as files that arrive out of order: revisions first, repeats, some back-dated, some at odds with what came before."""
    incoming, out, work = scratch(spark, "arrivals"), scratch(spark, "facts"), scratch(spark, "work")
    read = positions(spark, sf_dir).withColumn("short_interest", F.col("short_interest").cast("long"))
    seen = F.when(F.col("revision_flag"), F.col("available_at"))
    p = stored(read.select("symbol", "settlement_date", "publication_date", "available_at", "short_interest", "stock_split_flag", "revision_flag", seen.alias("observed_at")), "versions")
    late, first = p.filter("revision_flag"), p.filter("NOT revision_flag")
    early = late.withColumn("available_at", F.col("available_at") - F.expr("INTERVAL 15 DAYS"))
    odd = first.filter("day(settlement_date) > 15").withColumn("short_interest", F.col("short_interest") + 1)
    for rows in (late.unionByName(first.filter("year(settlement_date) >= 1998")), first.unionByName(early), odd.unionByName(late)):
        rows.repartition(4, "settlement_date").write.mode("append").parquet(incoming)
        SF.stream_facts(spark, incoming, out, work)
    return out
