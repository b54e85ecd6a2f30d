"""Trading calendars as tables (session, idx, close_ts): lookups, windows, reporting cycles, coverage intervals.

A calendar has one row per session, so it is small whatever the data; joins with it are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import instant


def indexed(days: DataFrame, session: str = "session") -> DataFrame:
    """Distinct sessions with their position; one row each is all that the window sees."""
    d = days.select(F.col(session).cast("date").alias("session")).filter("session IS NOT NULL").distinct()
    return d.withColumn("idx", (F.row_number().over(Window.orderBy("session")) - 1).cast("long"))


def sessions_between(calendar: DataFrame, start: str, end: str) -> DataFrame:
    return calendar.filter(F.col("session").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def spanning(calendar: DataFrame, panel: DataFrame, dt: str = "dt") -> DataFrame:
    """Sessions between the first and the last date of a panel, positions from 0."""
    span = panel.agg(F.min(dt).cast("date").alias("lo"), F.max(dt).cast("date").alias("hi"))
    return indexed(calendar.join(F.broadcast(span), F.col("session").between(F.col("lo"), F.col("hi"))))


def later_session(calendar: DataFrame, n: int, name: str = "result_date") -> DataFrame:
    """Adds the n-th later session; null at the end."""
    return calendar.withColumn(name, F.lead("session", n).over(Window.orderBy("idx")))


def future_session(calendar: DataFrame, dates: DataFrame, n: int, column: str = "decision_date") -> DataFrame:
    """dates with ``result_date``; a date that is no session is an error."""
    found = dates.join(F.broadcast(later_session(calendar, n).select(F.col("session").alias(column), F.lit(True).alias("known"), "result_date")), column, "left")
    if not found.filter("known IS NULL").isEmpty():
        raise ValueError(f"{column} holds a date that is no session")
    return found.drop("known")


def latest_completed(calendar: DataFrame, now: Column) -> DataFrame:
    return calendar.filter(F.col("close_ts") <= now).agg(F.max("session").alias("session"))


def cutoffs(decisions: DataFrame, calendar: DataFrame, column: str, now: Column, name: str = "cutoff") -> DataFrame:
    """decisions with ``name``: the instant up to which a decision knows things.

    ``column`` holds dates, whose session's close it is, or texts: an ISO date, or an instant with its offset. An instant without
    offset, a date that is no session, and a cutoff after ``now`` are errors."""
    text = F.col(column).cast("string")
    closes = calendar.select(F.col("session").cast("string").alias("_day"), "close_ts")
    out = decisions.join(F.broadcast(closes), text == F.col("_day"), "left").withColumn(name, F.coalesce("close_ts", instant(text))).drop("_day", "close_ts")
    if not out.filter(F.col(name).isNull()).isEmpty():
        raise ValueError(f"{column} holds a date that is no session, or an instant without offset")
    if not out.filter(F.col(name) > now).isEmpty():
        raise ValueError(f"{column} holds a decision in the future")
    return out


def effective_session(events: DataFrame, calendar: DataFrame, at: str = "available_at") -> DataFrame:
    """Adds session, idx of the first session whose close isn't before the instant; null after the last close. What comes before the first
    session, however early, belongs to it.

    Closes are bucketed by day, so that the lookup is an equality: an instant belongs to its own day's session, or to the
    next one where the day has none or has closed."""
    w = Window.orderBy("idx")
    steps = calendar.select("session", "idx", "close_ts", F.lead("session").over(w).alias("next_session"), F.lead("idx").over(w).alias("next_idx"))
    days = all_days(calendar).join(steps, "session")
    same = days.select("day", "session", "idx", "close_ts", "next_session", "next_idx")
    opens = calendar.agg(F.min("session").alias("_opens"))
    out = events.crossJoin(F.broadcast(opens)).withColumn("day", F.greatest(F.to_date(at), F.when(F.col(at).isNotNull(), F.col("_opens")))).join(F.broadcast(same), "day", "left")
    late = (F.col("day") == F.col("session")) & (F.col(at) > F.col("close_ts"))
    own = [c for c in events.columns]
    return out.select(*own, F.when(late, F.col("next_session")).otherwise(F.col("session")).alias("session"), F.when(late, F.col("next_idx")).otherwise(F.col("idx")).alias("idx"))


def all_days(calendar: DataFrame) -> DataFrame:
    """day, session: for every day up to the last session, the session on or after it. Days a year before the first are included;
    the lookups above take earlier ones for the first session's."""
    w = Window.orderBy("session")
    runs = calendar.select("session", F.coalesce(F.date_add(F.lag("session").over(w), 1), F.date_sub("session", 366)).alias("first"))
    return runs.select(F.explode(F.sequence("first", "session")).alias("day"), "session")


def next_session(events: DataFrame, calendar: DataFrame, day: str, name: str = "next_session") -> DataFrame:
    """Adds the first session strictly after a day, and its close as ``<name>_close``. After a day before the first session, it is the first."""
    days = all_days(calendar).join(calendar.select("session", "close_ts"), "session")
    after = days.select(F.date_sub("day", 1).alias("n_day"), F.col("session").alias(name), F.col("close_ts").alias(f"{name}_close"))
    opens = calendar.agg(F.date_sub(F.min("session"), 1).alias("_opens"))
    asked = F.when(F.col(day).isNotNull(), F.greatest(F.col(day).cast("date"), F.col("_opens")))
    return events.crossJoin(F.broadcast(opens)).join(F.broadcast(after), asked == F.col("n_day"), "left").drop("n_day", "_opens")


def by_session(calendar: DataFrame, counts: DataFrame, column: str) -> DataFrame:
    """session, idx, and the count of each session: zero where there is none, so that gaps show."""
    return calendar.join(counts, "session", "left").select("session", "idx", F.coalesce(column, F.lit(0)).alias(column))


def session_age(frame: DataFrame, calendar: DataFrame, a: str, b: str, name: str = "age_sessions") -> DataFrame:
    """Adds the sessions from date a to date b; null where either is no session."""
    pos = calendar.select("session", "idx")
    out = frame.join(F.broadcast(pos.withColumnsRenamed({"session": a, "idx": "a_idx"})), a, "left")
    out = out.join(F.broadcast(pos.withColumnsRenamed({"session": b, "idx": "b_idx"})), b, "left")
    return out.withColumn(name, F.col("b_idx") - F.col("a_idx")).drop("a_idx", "b_idx")


def window_before(decisions: DataFrame, calendar: DataFrame, count: int, column: str = "decision_date") -> DataFrame:
    """decisions with d_idx, first_idx: the last ``count`` sessions up to the decision are first_idx..d_idx."""
    pos = calendar.select(F.col("session").alias(column), F.col("idx").alias("d_idx"), "close_ts") if "close_ts" in calendar.columns else calendar.select(F.col("session").alias(column), F.col("idx").alias("d_idx"))
    return decisions.join(F.broadcast(pos), column).withColumn("first_idx", F.col("d_idx") - (count - 1))


def reporting_cycles(calendar: DataFrame, lag: int = 7) -> DataFrame:
    """settlement_date, publication_date: a month's last session up to the 15th and its last session, published ``lag`` sessions later."""
    later = later_session(calendar, lag, "publication_date")
    month = F.trunc("session", "month")
    ends = calendar.groupBy(month.alias("m")).agg(F.max(F.when(F.dayofmonth("session") <= 15, F.col("session"))).alias("mid"), F.max("session").alias("end"))
    cycles = ends.select(F.explode(F.array("mid", "end")).alias("session")).filter("session IS NOT NULL")
    return cycles.join(later.select("session", "publication_date"), "session").select(F.col("session").alias("settlement_date"), "publication_date")


def quarters(spark, start: str, end: str, last_received: str) -> DataFrame:
    """quarter_start, quarter_end clipped to start..end, and whether the quarter is still open at ``last_received``."""
    q = spark.range(1).select(F.explode(F.sequence(F.date_trunc("quarter", F.lit(start).cast("date")).cast("date"), F.lit(end).cast("date"), F.expr("INTERVAL 3 MONTHS"))).alias("q"))
    close = F.date_sub(F.add_months("q", 3), 1)
    return q.select("q", F.greatest("q", F.lit(start).cast("date")).alias("quarter_start"), F.least(close, F.lit(end).cast("date")).alias("quarter_end"), (F.lit(last_received).cast("date") < close).alias("is_open"))


def coverage_intervals(quarter_rows: DataFrame, tickers: DataFrame, archives: DataFrame, calendar: DataFrame) -> DataFrame:
    """Coverage rows per ticker and quarter.

    tickers: ticker, mapped. archives: q, last_received (null q row absent = no archive). Unmapped, or without archive: missing.
    An open quarter is complete up to the session after the last reception and missing beyond; a closed one is complete."""
    days = next_session(archives, calendar, "last_received", "known_to")
    grid = quarter_rows.join(F.broadcast(days.select(F.col("q"), "last_received", "known_to")), "q", "left").crossJoin(tickers)
    part = lambda a, b, s: F.struct(a.alias("coverage_start"), b.alias("coverage_end"), F.lit(s).alias("status"))
    start, end, to = F.col("quarter_start"), F.col("quarter_end"), F.col("known_to")
    none = ~F.col("mapped") | F.col("last_received").isNull()
    rows = (
        F.when(none, F.array(part(start, end, "missing")))
        .when(~F.col("is_open") | (to >= end), F.array(part(start, end, "complete")))
        .when(to < start, F.array(part(start, end, "missing")))
        .otherwise(F.array(part(start, to, "complete"), part(F.date_add(to, 1), end, "missing")))
    )
    return grid.select("ticker", F.inline(rows))


def insider_intervals(quarter_rows: DataFrame, tickers: DataFrame, archives: DataFrame) -> DataFrame:
    """Coverage rows per ticker and quarter of a source that comes as one archive a quarter.

    tickers: ticker, mapped. archives: q, observed_at (a date). A quarter that was still open when its archive was last observed is partial as a whole,
    as nothing says up to where; one observed after its end is complete; unmapped, or without archive: missing. quarter_rows: of ``quarters``."""
    seen = archives.groupBy("q").agg(F.max("observed_at").alias("observed_at"))
    grid = quarter_rows.drop("is_open").join(F.broadcast(seen), "q", "left").crossJoin(tickers)
    closes = F.date_sub(F.add_months("q", 3), 1)
    status = F.when(~F.col("mapped") | F.col("observed_at").isNull(), "missing").when(F.col("observed_at") <= closes, "partial").otherwise("complete")
    return grid.select("ticker", F.col("quarter_start").alias("coverage_start"), F.col("quarter_end").alias("coverage_end"), status.alias("status"))
