"""What a stored panel lacks, judged against a calendar: readiness, staleness, and from when on each ticker's bars are to be fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .calendar import latest_completed
from .panel import history

#: Sessions that a prediction and a back-test need.
RECENT, HISTORY = 60, 118


def panel_state(bars: DataFrame, calendar: DataFrame, now: Column, benchmark: str = "SPY") -> DataFrame:
    """One row: expected (the last completed session), benchmark_date (the benchmark's last bar up to it, or null)."""
    expected = latest_completed(calendar, now).withColumnRenamed("session", "expected")
    own = bars.filter(F.col("ticker") == benchmark).select("dt").distinct().crossJoin(F.broadcast(expected)).filter("dt <= expected")
    return expected.crossJoin(F.broadcast(own.agg(F.max("dt").alias("benchmark_date"))))


def ready_on(bars: DataFrame, calendar: DataFrame, state: DataFrame, n: int) -> DataFrame:
    """Tickers with a raw close on each of the n sessions up to the benchmark's last bar; none where the calendar has fewer."""
    upto = calendar.crossJoin(F.broadcast(state)).filter("session <= benchmark_date")
    tail = upto.withColumn("k", F.row_number().over(Window.orderBy(F.col("session").desc()))).filter(F.col("k") <= n).select(F.col("session").alias("dt"))
    have = bars.filter("raw_close IS NOT NULL").join(F.broadcast(tail), "dt", "left_semi").groupBy("ticker").agg(F.countDistinct("dt").alias("sessions"))
    return have.filter(F.col("sessions") == n).select("ticker")


def sync_status(bars: DataFrame, requested: DataFrame, calendar: DataFrame, now: Column, n: int = RECENT, benchmark: str = "SPY") -> DataFrame:
    """One row: requested, ready, coverage, as_of (the benchmark's last bar), expected, fresh (as_of is the expected session)."""
    state = panel_state(bars, calendar, now, benchmark)
    ready = ready_on(bars, calendar, state, n).join(requested.select("ticker").distinct(), "ticker", "left_semi").agg(F.count("*").alias("ready"))
    one = requested.agg(F.countDistinct("ticker").alias("requested")).crossJoin(ready).crossJoin(state)
    cover = F.when(F.col("requested") == 0, F.lit(1.0)).otherwise(F.col("ready") / F.col("requested"))
    return one.select("requested", "ready", cover.alias("coverage"), F.col("benchmark_date").alias("as_of"), "expected", F.coalesce(F.col("benchmark_date") == F.col("expected"), F.lit(False)).alias("fresh"))


def sync_plan(
    bars: DataFrame, requested: DataFrame, calendar: DataFrame, now: Column, requirements: DataFrame | None = None, recent: int = RECENT, whole: int = HISTORY, min_coverage: float = 0.9, backfill_days: int = 210, margin: int = 7, benchmark: str = "SPY"
) -> DataFrame:
    """ticker, start, end (exclusive), actions: one interval per ticker that covers all it is needed for.

    backfill: requested names without ``whole`` ready sessions, from ``backfill_days`` ago; refresh: the others that are behind the
    benchmark, or all where the benchmark is behind the expected session, from ``margin`` days before its last bar; outcome: open outcomes of a ledger
    (``requirements``: ticker, decision_date, result_date), requested or not, from ``margin`` days before the earliest decision. An outcome of a
    requested name that isn't due yet waits. Nothing is planned for requested names while the benchmark is fresh, ready and enough of
    them are ready, unless an outcome is open."""
    names = requested.select("ticker").distinct()
    state = panel_state(bars, calendar, now, benchmark)
    short, long = (ready_on(bars, calendar, state, n).withColumn(c, F.lit(True)) for n, c in ((recent, "short"), (whole, "long")))
    known = history(bars.crossJoin(F.broadcast(state)).filter("dt <= expected")).select("ticker", "last_dt")
    rows = names.join(short, "ticker", "left").join(long, "ticker", "left").join(known, "ticker", "left")
    day = F.to_date(now)
    parts = []
    open_outcomes = F.lit(False)
    if requirements is not None:
        asked = requirements.join(names.withColumn("asked", F.lit(True)), "ticker", "left").crossJoin(F.broadcast(state)).filter("asked IS NULL OR result_date <= expected")
        parts.append(asked.groupBy("ticker").agg(F.date_sub(F.min("decision_date"), margin).alias("start")).withColumn("action", F.lit("outcome")))
        open_outcomes = F.col("open") > 0
        state = state.crossJoin(F.broadcast(asked.agg(F.count("*").alias("open"))))
    own = F.col("ticker") == benchmark
    counts = rows.agg(F.count("*").alias("n"), F.count("short").alias("n_short"), F.count("long").alias("n_long"), F.coalesce(F.bool_or(own & F.col("short") & F.col("long")), F.lit(False)).alias("leads"))
    enough = (F.col("benchmark_date") == F.col("expected")) & F.col("leads") & (F.col("n_short") >= min_coverage * F.col("n")) & (F.col("n_long") >= min_coverage * F.col("n")) & ~open_outcomes
    judged = rows.crossJoin(F.broadcast(state.crossJoin(counts))).filter(~F.coalesce(enough, F.lit(False)))
    stale = ~F.col("benchmark_date").eqNullSafe(F.col("expected")) | ~F.col("last_dt").eqNullSafe(F.col("benchmark_date"))
    action = F.when(F.col("long").isNull(), "backfill").when(stale, "refresh")
    start = F.when(F.col("long").isNull(), F.date_sub(day, backfill_days)).otherwise(F.date_sub(F.coalesce("benchmark_date", day), margin))
    parts.append(judged.select("ticker", start.alias("start"), action.alias("action")).filter("action IS NOT NULL"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    ends = state.select(F.date_add("expected", 1).alias("end"))
    merged = every.groupBy("ticker").agg(F.min("start").alias("start"), F.sort_array(F.collect_set("action")).alias("actions"))
    return merged.crossJoin(F.broadcast(ends)).select("ticker", "start", "end", "actions")
