"""Panel hygiene: validity, keep-last, key checks, readiness, work lists, set operations on keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite
from ..schemas import require_columns

PRICES = ("open", "high", "low", "close", "raw_close")


def valid_bar(columns: Sequence[str] = PRICES) -> Column:
    """Ticker not blank, prices finite and positive, volume finite and not negative."""
    ok = F.coalesce(F.trim("ticker") != "", F.lit(False)) & F.col("dt").isNotNull()
    for c in columns:
        ok = ok & finite(F.col(c)) & (F.col(c) > 0)
    return ok & F.col("volume").isNotNull() & (F.col("volume") >= 0)


def checked_bars(df: DataFrame, mode: str = "fail") -> DataFrame:
    """All rows if valid; ``mode="drop"`` leaves bad rows out, "fail" refuses the table for one of them."""
    if "raw_close" not in df.columns:
        df = df.withColumn("raw_close", F.col("close"))
    require_columns(df, ("ticker", "dt", "volume", *PRICES), "OHLCV data")
    ok = valid_bar()
    if mode == "drop":
        return df.filter(ok)
    if not df.filter(~ok | ok.isNull()).isEmpty():
        raise ValueError("OHLCV data holds invalid rows")
    return df


def keep_last(df: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """Of rows with one key the one with the largest sequence. An aggregate, so copies of a key combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    top = F.max(F.struct(F.col(sequence).alias("_s"), F.struct(*rest).alias("_r"))) if rest else None
    return df.groupBy(*keys).agg(top.alias("_t")).select(*keys, "_t._r.*")


def with_session_index(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """Rows on sessions, with their position (an inner join: other dates go)."""
    return df.join(F.broadcast(calendar.select(F.col("session").alias("dt"), "idx")), "dt")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def conflicts(df: DataFrame, keys: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Keys that come with more than one payload."""
    h = F.struct(*payload)
    return df.groupBy(*keys).agg(F.min(h).alias("a"), F.max(h).alias("b")).filter("NOT a <=> b").select(*keys)


def require_unique(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    if not duplicates(df, keys).isEmpty():
        raise ValueError(f"{what} repeats a key of {list(keys)}")
    return df


def require_instants(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Instants must be instants: a time without zone, or a text, means another instant under each session's zone."""
    kinds = dict(df.dtypes)
    wrong = [c for c in columns if kinds.get(c, "timestamp") != "timestamp"]
    if wrong:
        raise ValueError(f"{wrong} must hold instants with a zone")
    return df


def join_checked(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", validate: str = "m:1") -> DataFrame:
    """A join whose one-sides are checked to be unique first."""
    one_left, one_right = validate.split(":")
    if one_left == "1":
        require_unique(left, on, "left side")
    if one_right == "1":
        require_unique(right, on, "right side")
    return left.join(right, list(on), how)


def not_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: how many rows hold a null, NaN or infinity, in any of the columns and in each."""
    bad = [(c, ~finite(F.col(c).cast("double"))) for c in columns]
    some = bad[0][1]
    for _, b in bad[1:]:
        some = some | b
    count = lambda b: F.coalesce(F.sum(b.cast("long")), F.lit(0))
    return df.agg(count(some).alias("bad_rows"), *[count(b).alias(f"bad_{c}") for c, b in bad])


def require_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if df.select(*columns).transform(lambda d: not_finite(d, columns)).first().bad_rows:
        raise ValueError("feature columns hold values that aren't finite")
    return df


def require_benchmark(df: DataFrame, benchmark: str = "SPY") -> DataFrame:
    if df.filter(F.col("ticker") == benchmark).isEmpty():
        raise ValueError(f"benchmark {benchmark} is missing")
    return df


def bounds(df: DataFrame) -> DataFrame:
    return df.agg(F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))


def history(df: DataFrame) -> DataFrame:
    return df.groupBy("ticker").agg(F.count("*").alias("rows"), F.max("dt").alias("last_dt"))


def last_sessions(df: DataFrame, n: int) -> DataFrame:
    """The panel's last ``n`` dates: dt. One row per session goes through the window."""
    d = df.select("dt").distinct()
    return d.withColumn("k", F.row_number().over(Window.orderBy(F.col("dt").desc()))).filter(F.col("k") <= n).select("dt")


def ready_tickers(df: DataFrame, n: int) -> DataFrame:
    """Tickers with a stored raw close on each of the last n sessions."""
    tail = F.broadcast(last_sessions(df, n))
    return df.filter("raw_close IS NOT NULL").join(tail, "dt", "left_semi").groupBy("ticker").agg(F.countDistinct("dt").alias("sessions")).filter(F.col("sessions") == n).select("ticker")


def sync_report(df: DataFrame, requested: DataFrame, n: int, benchmark: str = "SPY") -> DataFrame:
    """One row: requested, ready, coverage, as_of (the benchmark's last date, else the panel's), fresh (as_of is the panel's last)."""
    ready = ready_tickers(df, n).join(requested, "ticker", "left_semi").agg(F.count("*").alias("ready"))
    ends = df.agg(F.max(F.when(F.col("ticker") == benchmark, F.col("dt"))).alias("b"), F.max("dt").alias("m"))
    one = requested.agg(F.countDistinct("ticker").alias("requested")).crossJoin(ready).crossJoin(ends)
    cover = F.when(F.col("requested") == 0, F.lit(1.0)).otherwise(F.col("ready") / F.col("requested"))
    return one.select("requested", "ready", cover.alias("coverage"), F.coalesce("b", "m").alias("as_of"), F.coalesce(F.col("b") == F.col("m"), F.lit(False)).alias("fresh"))


def work_list(df: DataFrame, requested: DataFrame, n: int, benchmark: str = "SPY") -> DataFrame:
    """ticker, action of requested tickers that need data: backfill without n ready sessions, refresh behind the benchmark (all where it is behind)."""
    ends = df.agg(F.max(F.when(F.col("ticker") == benchmark, F.col("dt"))).alias("b"), F.max("dt").alias("m"))
    ready = ready_tickers(df, n).withColumn("ready", F.lit(True))
    rows = requested.select("ticker").distinct().join(ready, "ticker", "left").join(history(df).select("ticker", "last_dt"), "ticker", "left").crossJoin(F.broadcast(ends))
    stale = F.col("b").isNull() | (F.col("b") < F.col("m"))
    action = F.when(F.col("ready").isNull(), "backfill").when(stale | (F.col("last_dt") != F.col("b")), "refresh")
    return rows.select("ticker", action.alias("action")).filter("action IS NOT NULL")


def benchmark_problems(df: DataFrame, calendar: DataFrame, lookback: int, benchmark: str = "SPY") -> DataFrame:
    """session, problem: missing on the day, or a gap in the last ``lookback`` sessions; null where there is none."""
    days = df.filter(F.col("ticker") == benchmark).select(F.col("dt").alias("session"), F.lit(1).alias("there")).distinct()
    w = Window.orderBy("idx").rowsBetween(-(lookback - 1), 0)
    seen = calendar.join(days, "session", "left").withColumn("n", F.count("there").over(w))
    return seen.select("session", F.when(F.col("there").isNull(), "spy_missing_on_decision_date").when(F.col("n") < lookback, "spy_history_incomplete").alias("problem"))


def split_panel(df: DataFrame, requested: DataFrame, n: int) -> DataFrame:
    """The panel with in_requested and in_ready per row."""
    r = requested.select("ticker").distinct().withColumn("in_requested", F.lit(True))
    ok = ready_tickers(df, n).withColumn("in_ready", F.lit(True))
    out = df.join(r, "ticker", "left").join(ok, "ticker", "left")
    return out.withColumn("in_requested", F.coalesce("in_requested", F.lit(False))).withColumn("in_ready", F.coalesce("in_ready", F.lit(False)) & F.col("in_requested"))


def inverted(df: DataFrame, key: str, value: str, most: int = 1000) -> DataFrame:
    """A key map turned round: per value of ``value`` its keys in order, in parts of ``most``, so that no row holds more than that."""
    k = F.row_number().over(Window.partitionBy(value).orderBy(key)) - 1
    placed = df.select(key, value).distinct().withColumn("part", F.floor(k / most))
    return placed.groupBy(value, "part").agg(F.array_sort(F.collect_list(key)).alias(f"{key}s"))


def key_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys with side: left or right for keys of one side alone. Empty where the key sets are equal."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.join(y, list(keys), "left_anti").withColumn("side", F.lit("left")).unionByName(y.join(x, list(keys), "left_anti").withColumn("side", F.lit("right")))


def union_all(*frames: DataFrame, relaxed: bool = False) -> DataFrame:
    """Rows of all frames; relaxed: missing columns become null and numbers widen."""
    out = frames[0]
    for f in frames[1:]:
        if relaxed:
            kinds = dict(out.dtypes)
            wide = {("int", "bigint"), ("bigint", "double"), ("int", "double"), ("float", "double")}
            for c, t in f.dtypes:
                if (t, kinds.get(c)) in wide:
                    f = f.withColumn(c, F.col(c).cast(kinds[c]))
                elif (kinds.get(c), t) in wide:
                    out = out.withColumn(c, F.col(c).cast(t))
        out = out.unionByName(f, allowMissingColumns=relaxed)
    return out


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: rows, tickers, first and last date, sums, and a digest of them."""
    one = df.agg(F.count("*").alias("rows"), F.countDistinct("ticker").alias("tickers"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"), F.round(F.sum("close"), 2).alias("close_sum"), F.sum("volume").alias("volume_sum"))
    text = F.concat_ws("|", "rows", "tickers", "first_dt", "last_dt", F.format_string("%.2f", "close_sum"), "volume_sum")
    return one.withColumn("digest", F.sha2(text, 256))
