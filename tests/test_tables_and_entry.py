import datetime as dt
import pathlib
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.test_panel_operators import panel
from tidemark.contract import Contract
from tidemark.operators import backtest as BT
from tidemark.operators import bitemporal as B
from tidemark.operators import calendar as C
from tidemark.plans import fixtures as FX
from tidemark.plans import queries as plans
from tidemark.sources import readers as RD
from tidemark.sources import tables as ST
from tidemark.streaming import ingest as SI

ROOT = pathlib.Path(__file__).parent.parent


def test_upsert_rewrites_touched_dates_alone(spark):
    path = FX.scratch(spark, "t-bars")
    ST.upsert_bars(panel(spark, {"SPY": 1.0, "A": 1.1}, 5), path, FX.scratch(spark, "t-s"))
    new = panel(spark, {"A": 1.1}, 5).filter("dt = '2025-01-03'").withColumn("volume", F.lit(7).cast("long"))
    ST.upsert_bars(new, path, FX.scratch(spark, "t-s"))
    rows = ST.scan_bars(spark, path).collect()
    assert len(rows) == 10 and sum(r.volume == 7 for r in rows) == 1 and ST.scan_bars(spark, path, "2025-01-03").count() == 2
    with pytest.raises(FileNotFoundError):
        ST.scan_bars(spark, path, "2031-01-01")


def ranking(spark, n=3, **change):
    rows = [(f"T{i}", dt.date(2025, 1, 2), 1.0 / i, i, change.get("name", "rank-v6"), change.get("size", n)) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "ticker string, decision_date date, score double, rank long, strategy_version string, universe_size long")


def test_the_ledger_is_immutable(spark):
    path = FX.scratch(spark, "t-ledger")
    ST.append_ledger(ranking(spark), path)
    with pytest.raises(FileExistsError):
        ST.append_ledger(ranking(spark), path)
    assert ST.record_or_restore(ranking(spark, 5), path).count() == 3 and ST.record_or_restore(ranking(spark, 4, name="other"), path).count() == 4
    for bad in (ranking(spark, size=9), ranking(spark, name="a b"), ranking(spark).filter("rank > 1"), ranking(spark).limit(0)):
        with pytest.raises(ValueError):
            ST.checked_predictions(bad)


def test_streamed_bars_keep_the_last_and_set_bad_ones_aside(spark):
    incoming, path, work = (FX.scratch(spark, f"t-{n}") for n in ("in", "table", "work"))
    p = panel(spark, {"SPY": 1.0, "A": 1.1}, 3)
    p.write.parquet(incoming)
    SI.stream_bars(spark, incoming, path, work)
    again = p.filter("ticker = 'A'").withColumn("volume", F.lit(5).cast("long"))
    later = again.withColumn("volume", F.lit(9).cast("long")).unionByName(again.withColumn("high", F.lit(float("nan"))))
    again.coalesce(1).write.mode("append").parquet(incoming)
    time.sleep(1.1)
    later.coalesce(1).write.mode("append").parquet(incoming)
    SI.stream_bars(spark, incoming, path, work)
    rows = ST.scan_bars(spark, path).collect()
    assert len(rows) == 6 and {r.volume for r in rows if r.ticker == "A"} == {9}
    assert spark.read.parquet(f"{work}/rejected").count() == 3


def test_facts_stand_from_their_own_availability(spark):
    path = FX.scratch(spark, "t-facts")
    rows = lambda *r: spark.createDataFrame(r, "k int, v int, available_at timestamp")
    SI.append_facts(rows((1, 10, dt.datetime(2025, 1, 1))), path)
    SI.append_facts(rows((1, 11, dt.datetime(2025, 1, 5))), path)
    known = lambda day: B.newest_known(spark.read.parquet(path), ["k"], F.col("available_at") <= F.lit(day).cast("timestamp"), ["available_at"]).first().v
    assert known("2025-01-04") == 10 and known("2025-01-05") == 11
    with pytest.raises(ValueError):
        SI.append_facts(rows((2, 1, None)), path)


def test_strict_readers_refuse_what_is_malformed(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(60)]
    cal = C.indexed(spark.createDataFrame([(d,) for d in days], "session date")).withColumn("close_ts", F.col("session").cast("timestamp") + F.expr("INTERVAL 21 HOURS"))
    published = spark.createDataFrame([(dt.date(2024, 1, 15), dt.date(2024, 1, 24))], "settlement_date date, publication_date date")
    head = ["symbolCode|currentShortPositionQuantity|stockSplitFlag|revisionFlag|settlementDate"]

    def read(line, **kw):
        path = FX.lines(spark.createDataFrame([(x,) for x in head + [line]], "value string").coalesce(1), "t-short")
        return RD.short_interest_file(spark, path, cal, published, **kw).collect()

    assert read("ABC|1,000||N|20240115")[0].short_interest == 1000
    for bad in ("ABC|-5|||20240115", "ABC|many|||20240115", "ABC|||N|20240115", "ABC|5|maybe||20240115", "A B|5|||20240115", "ABC|5|||15.1.2024"):
        with pytest.raises(ValueError):
            read(bad)
        read(bad, strict=False)
    note = FX.lines(spark.createDataFrame([("Description: x",), ("Last Data Received:  March 31, 2024",), ("1|A|8-K|2024-01-02|edgar/data/1/x.txt",)], "value string"), "t-index")
    assert RD.index_last_received(spark, note).first().last_received == dt.date(2024, 3, 31)


def test_a_session_that_the_panel_lacks_moves_no_horizon(spark):
    c = Contract(lookback=5, horizon=2, top_k=1, inspect=1, min_average_dollar_volume=1.0, min_median_dollar_volume_prior=1.0, backtest_days=45)
    bars = panel(spark, {"SPY": 1.0, "A": 1.01, "B": 1.02}, 40)
    sessions = bars.select(F.col("dt").alias("session")).distinct()
    gap = sorted(r.session for r in sessions.collect())[30]
    less = bars.filter(F.col("dt") != F.lit(gap))
    with_calendar = {r.decision_date: (r.result_date, r.status) for r in BT.backtest(less, c, sessions=sessions).collect()}
    assert with_calendar[gap][1] == "INVALID" and (with_calendar[gap - dt.timedelta(days=1)][0] - gap).days >= 1
    assert gap not in {r.decision_date for r in BT.backtest(less, c).collect()}


def test_snapshots_are_content_addressed(spark):
    path = FX.scratch(spark, "t-snap")
    rows = spark.createDataFrame([("A", "x"), ("B", None)], "symbol string, name string")
    d = ST.save_snapshot(rows, path, "2025-01-02", "2025-01-03 00:00:00")
    assert ST.save_snapshot(rows.orderBy(F.desc("symbol")), path, "2025-01-02", "2025-01-09 00:00:00") == d
    assert {r.available_at for r in ST.read_snapshot(spark, path, "2025-01-02", d).collect()} == {dt.datetime(2025, 1, 3)}
    with pytest.raises(ValueError):
        ST.save_snapshot(rows.limit(1), path, "2025-01-02", "2025-01-01 00:00:00")
    rows.withColumn("available_at", F.lit("2025-01-03").cast("timestamp")).write.mode("append").parquet(f"{path}/as_of=2025-01-02/digest={d}")
    with pytest.raises(ValueError):
        ST.read_snapshot(spark, path, "2025-01-02", d)


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def text(v):
    return "-" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_queries_equal_their_sql(spark, sf, duck, name):
    df = plans.QUERIES[name](spark, sf)
    cur = duck.execute(plans.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(map(text, r)) for r in df.select(*names).collect()) == sorted(tuple(map(text, r)) for r in cur.fetchall())


def test_what_has_no_sql_is_known():
    assert set(plans.QUERIES) - set(plans.ORACLE) == {"k02_ridge_scores", "k03_boosted_ranker", "k03_listwise_ranker", "k04_boosted_risk", "k07_walk_forward"}


def test_entry_returns_the_screen(spark):
    rows = entry.entry(spark).collect()
    assert rows and [r["rank"] for r in sorted(rows, key=lambda r: r["rank"])] == list(range(1, len(rows) + 1))


def test_nothing_outside_imports_the_corpus_operators():
    for p in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", p.read_text(), re.M), p


def test_page_texts_are_those_of_their_sql(spark, tmp_path):
    """References that lack their semicolon, others than the four, a reference of a reference, white space beyond ASCII, nothing at all."""
    pages = ["<p>a&amp;&amp b&ampc &copy &quot;d&quot;</p>", "x &lt;y&gt; &eacute; &#39; &nbsp;", "&amp;copy; &amp;amp;", "a\u00a0b\x0bc\u2003d \t\n e", "<script>x</SCRIPT >&middot;", " <p> </p> ", "", None]
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.text for r in entry.queries()["b18_html_text"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == dict(con.execute(entry.oracle_sql()["b18_html_text"]).fetchall()) and len(got) == len(pages)
