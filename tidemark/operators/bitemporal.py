"""What was known when: as-of versions, coverage of windows, event features, short positions, newest snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import base_form, clip, form, items
from ..functions.windows import observed_percentile_rank
from . import calendar as C
from .panel import require_finite, require_instants, require_unique

# Form and item families.
MATERIAL_ITEMS = (
    "1.01", "1.02", "1.03", "1.04", "2.01", "2.02", "2.03", "2.04", "2.05", "2.06", "3.01", "3.02", "3.03", "4.01", "4.02",
    "5.01", "5.02", "5.03", "5.04", "5.05", "5.06", "5.07", "5.08", "6.01", "6.02", "6.03", "6.04", "6.05", "7.01", "8.01",
)
OFFERING_FORMS = ("S-3", "424B5", "EFFECT")
LATE_FORMS = ("NT 10-Q", "NT 10-K")


def by_key(rows: DataFrame) -> DataFrame:
    """Rows of a panel's grain, one or more per ticker and decision: joined by a shuffle whatever a plan takes them for.

    Estimates don't see that every ticker meets every date (dates come from an exploded calendar, which counts as a row), so millions of
    decisions pass for a few MB and would be broadcast, whole, through the driver."""
    return rows.hint("merge")


def newest_known(rows: DataFrame, keys: list[str], known: Column, order: list[str]) -> DataFrame:
    """Per key the row with the largest order among those that ``known`` admits; an aggregate, so versions combine early."""
    rest = [c for c in rows.columns if c not in keys]
    top = F.max(F.struct(*order, F.struct(*rest).alias("_r")))
    got = rows.filter(known)
    if not keys:
        return got.agg(top.alias("_t")).filter("_t IS NOT NULL").select("_t._r.*")
    return got.groupBy(*keys).agg(top.alias("_t")).select(*keys, "_t._r.*")


def snapshot_as_of(rows: DataFrame, as_of: str, known_at: str) -> DataFrame:
    """Rows of the newest snapshot with as_of <= the date and available_at <= the instant, ties by digest."""
    heads = rows.select("as_of", "available_at", "digest").distinct()
    ok = (F.col("as_of") <= F.lit(as_of).cast("date")) & (F.col("available_at") <= F.lit(known_at).cast("timestamp"))
    pick = newest_known(heads, [], ok, ["as_of", "available_at", "digest"])
    return rows.join(F.broadcast(pick), ["as_of", "available_at", "digest"], "left_semi")


def known_positions(decisions: DataFrame, positions: DataFrame) -> DataFrame:
    """Per (ticker, decision): the newest settlement known then and the one before it, each in its newest known version.

    decisions: ticker, decision_date, cutoff. positions: symbol, settlement_date, available_at, short_interest, stock_split_flag, revision_flag.
    A late revision of an older cycle replaces that cycle alone. Versions and decisions lie in one timeline per ticker, over which two running
    maxima go: the newest cycle, and the largest of what has ever been second to it, which is whatever a newer cycle displaced or an older one
    brought. So the work is linear in versions and decisions, and no decision meets the versions before it.

    Errors, which the run itself raises: a position without one of these values, below zero, or available before its settlement, and two of one
    cycle that differ and were available at the same instant (they lie side by side in the timeline)."""
    fields = ("settlement_date", "available_at", "short_interest", "stock_split_flag", "revision_flag")
    require_instants(positions, ["available_at"])
    bad = F.col("short_interest") < 0
    for c in fields:
        bad = bad | F.col(c).isNull()
    bad = bad | (F.to_date("available_at") < F.col("settlement_date"))
    told = F.when(bad, F.raise_error(F.concat(F.lit("a short-interest position is invalid: "), F.coalesce("symbol", F.lit("no symbol"))))).otherwise(F.struct(*fields))
    known = positions.select(F.col("symbol").alias("ticker"), F.coalesce("available_at", F.lit(0).cast("timestamp")).alias("at"), F.lit(0).alias("kind"), told.alias("v"))
    asked = decisions.select("ticker", F.col("cutoff").alias("at"), F.lit(1).alias("kind"), "decision_date")
    rows = known.unionByName(asked, allowMissingColumns=True).filter("at IS NOT NULL")
    timeline = Window.partitionBy("ticker").orderBy("at", "kind", "v")
    last = F.lag("v").over(timeline)
    clash = (F.col("v.settlement_date") == last["settlement_date"]) & (F.col("v.available_at") == last["available_at"]) & (F.col("v") != last)
    rows = rows.withColumn("v", F.when(clash, F.raise_error(F.concat(F.lit("conflicting short-interest positions of "), F.col("ticker")))).otherwise(F.col("v")))
    to_here, before = timeline.rowsBetween(Window.unboundedPreceding, 0), timeline.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("c", F.max("v").over(to_here)).withColumn("top", F.max("v").over(before))
    second = F.when(F.col("v.settlement_date") > F.col("top.settlement_date"), F.col("top")).when(F.col("v.settlement_date") < F.col("top.settlement_date"), F.col("v"))
    rows = rows.withColumn("second", second).withColumn("p", F.max("second").over(to_here)).filter("kind = 1 AND c IS NOT NULL")
    return rows.select(
        "ticker", "decision_date",
        "c.settlement_date", "c.available_at", "c.short_interest", F.col("c.stock_split_flag").alias("split_flag"), "c.revision_flag",
        F.col("p.short_interest").alias("previous_interest"), F.col("p.stock_split_flag").alias("previous_split_flag"),
    )


def checked_decisions(decisions: DataFrame, calendar: DataFrame) -> DataFrame:
    """Decisions as they are; a ticker and date that repeats, or a date that is no session, is an error."""
    require_unique(decisions, ["ticker", "decision_date"], "decisions")
    off = decisions.select("decision_date").distinct().join(F.broadcast(calendar.select(F.col("session").alias("decision_date"))), "decision_date", "left_anti")
    if not off.isEmpty():
        raise ValueError("decision_date holds a date that is no session")
    return decisions


def short_interest_features(decisions: DataFrame, positions: DataFrame, calendar: DataFrame, volumes: DataFrame | None = None, shares: DataFrame | None = None, max_age: int = 60) -> DataFrame:
    """Short-interest features of every decision; all null where nothing is known or what is known is older than ``max_age`` sessions.

    volumes: ticker, decision_date, average_daily_volume; shares: ticker, shares_outstanding."""
    checked_decisions(decisions, calendar)
    cut = decisions.select("ticker", "decision_date").join(F.broadcast(calendar.select(F.col("session").alias("decision_date"), F.col("close_ts").alias("cutoff"))), "decision_date")
    k = C.session_age(known_positions(cut, positions), calendar, "settlement_date", "decision_date")
    fresh = F.col("age_sessions") <= max_age
    k = k.filter(fresh)
    split = F.col("previous_interest").isNotNull() & (F.col("split_flag") | F.coalesce("previous_split_flag", F.lit(False)))
    k = k.withColumn("split_suppressed", split).withColumn("short_interest_delta", F.when((F.col("previous_interest") > 0) & ~split, F.col("short_interest") / F.col("previous_interest") - 1.0))
    out = decisions.select("ticker", "decision_date").join(by_key(k), ["ticker", "decision_date"], "left")
    out = out.join(by_key(volumes), ["ticker", "decision_date"], "left") if volumes is not None else out.withColumn("average_daily_volume", F.lit(None).cast("double"))
    out = out.join(shares, "ticker", "left") if shares is not None else out.withColumn("shares_outstanding", F.lit(None).cast("double"))
    over = lambda c: F.when(F.col(c) > 0, F.col("short_interest") / F.col(c))
    return out.select(
        "ticker", "decision_date", "settlement_date", "available_at", F.col("age_sessions").alias("short_interest_age_sessions"), "short_interest", "short_interest_delta",
        over("average_daily_volume").alias("days_to_cover"), over("shares_outstanding").alias("short_pct"), "split_flag", "previous_split_flag", "split_suppressed", "revision_flag",
    )


def window_coverage(decisions: DataFrame, coverage: DataFrame, calendar: DataFrame, source: str, lookback: int = 60) -> DataFrame:
    """ticker, decision_date (each pair once), status, start, end of a source: complete if every session of the window lies in a complete interval,
    partial if one that isn't missing overlaps it, else missing.

    Intervals become session positions, so that overlap is arithmetic: complete intervals of a ticker don't touch after merging, so a whole
    window lies in one of them. Decisions meet all intervals, merged and as they came, in one join by ticker, whose partitions the aggregate keeps."""
    w = C.window_before(decisions.select("ticker", "decision_date"), calendar, lookback).select("ticker", "decision_date", "first_idx", "d_idx")
    pos = calendar.select("session", "idx")
    iv = coverage.filter(F.col("source") == source).select("ticker", "coverage_start", "coverage_end", "status")
    days = C.all_days(calendar)
    lo = days.join(pos, "session").select(F.col("day").alias("coverage_start"), F.col("idx").alias("lo"))
    after = days.join(pos, "session").select(F.date_sub("day", 1).alias("coverage_end"), (F.col("idx") - 1).alias("hi"))
    top = calendar.agg(F.max("idx").alias("top"))
    iv = iv.join(F.broadcast(lo), "coverage_start", "left").join(F.broadcast(after), "coverage_end", "left").crossJoin(F.broadcast(top)).withColumn("hi", F.coalesce("hi", "top"))
    whole = _merge(iv.filter("status = 'complete' AND lo IS NOT NULL AND hi >= lo")).withColumn("whole", F.lit(True))
    told = iv.select("ticker", "lo", "hi", F.expr("status != 'missing' AND lo IS NOT NULL AND hi >= lo").alias("told"), "coverage_start", "coverage_end")
    met = by_key(w).join(told.unionByName(whole, allowMissingColumns=True), "ticker", "left")
    out = met.groupBy("ticker", "decision_date").agg(
        F.max(F.expr("whole AND lo <= first_idx AND hi >= d_idx")).alias("all"), F.max(F.expr("told AND lo <= d_idx AND hi >= first_idx")).alias("some"),
        F.min("coverage_start").alias("start"), F.max("coverage_end").alias("end"),
    )
    status = F.when(F.col("all"), "complete").when(F.col("some"), "partial").otherwise("missing")
    return out.select("ticker", "decision_date", status.alias("status"), "start", "end")


def _merge(iv: DataFrame) -> DataFrame:
    """Unions of touching or overlapping intervals lo..hi per ticker."""
    w = Window.partitionBy("ticker").orderBy("lo", "hi")
    new = F.when(F.col("lo") <= F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1, 0).otherwise(1)
    runs = iv.select("ticker", "lo", "hi", new.alias("new")).withColumn("run", F.sum("new").over(w))
    return runs.groupBy("ticker", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run")


def in_window(decisions: DataFrame, events: DataFrame, calendar: DataFrame, lookback: int = 60) -> DataFrame:
    """Every decision with every event whose session lies in its window and that was available at its cutoff.

    Events and windows are cut into blocks of ``lookback`` sessions: a window touches two of them, so the join is an equality."""
    require_instants(events, ["available_at"])
    w = C.window_before(decisions.select("ticker", "decision_date"), calendar, lookback)
    w = w.withColumn("block", F.explode(F.array_distinct(F.array(F.floor(F.col("first_idx") / lookback), F.floor(F.col("d_idx") / lookback)))))
    e = C.effective_session(events, calendar).filter("idx IS NOT NULL").withColumn("block", F.floor(F.col("idx") / lookback))
    hit = by_key(w).join(e, ["ticker", "block"])
    return hit.filter((F.col("idx") >= F.col("first_idx")) & (F.col("idx") <= F.col("d_idx")) & (F.col("available_at") <= F.col("close_ts"))).drop("block")


def filing_features(decisions: DataFrame, filings: DataFrame, calendar: DataFrame, lookback: int = 60) -> DataFrame:
    """Counts and flags of filings in each decision's window; decisions without filings aren't returned."""
    base, item_list = base_form(form(F.col("form"))), items(F.col("items"))
    own = F.arrays_overlap(item_list, F.array(*[F.lit(x) for x in MATERIAL_ITEMS]))
    # What a filing counts as, before its copies are dropped: flags take a hash aggregate and little of a shuffle, texts a sort.
    f = filings.select(
        "ticker", "accession_number", "available_at",
        ((base == "8-K") & F.array_contains(item_list, "2.02")).alias("earnings"), base.isin("8-K", "6-K").alias("current"), ((base == "6-K") | ((base == "8-K") & own)).alias("material"),
        base.isin(*OFFERING_FORMS).alias("offering"), base.isin(*LATE_FORMS).alias("late"), (form(F.col("form")) == "SC 13D").alias("new_13d"),
    )
    e = in_window(decisions, f.dropDuplicates(["ticker", "accession_number"]), calendar, lookback)
    has = lambda c: F.max(F.col(c).cast("int")) == 1
    return e.groupBy("ticker", "decision_date").agg(
        (F.max("d_idx") - F.max(F.when(F.col("earnings"), F.col("idx")))).alias("days_since_8k_earnings"),
        F.count(F.when(F.col("current"), 1)).alias("current_report_count"),
        F.count(F.when(F.col("material"), 1)).alias("material_event_count"),
        has("offering").alias("recent_offering_risk"),
        has("late").alias("late_filing_risk"),
        has("new_13d").alias("new_13d"),
    )


def insider_features(decisions: DataFrame, trades: DataFrame, calendar: DataFrame, lookback: int = 60, cluster: int = 2) -> DataFrame:
    """Open-market purchases in each decision's window: a transaction's dollars once, however many owners report it; owners all counted.

    A transaction that comes with two amounts or plan flags is an error, which the run itself raises."""
    buys = trades.filter("transaction_code = 'P' AND shares > 0 AND price > 0").withColumn("amount", F.col("shares") * F.col("price"))
    e = in_window(decisions, buys, calendar, lookback)
    keys = ["ticker", "decision_date"]
    plan = F.col("is_10b5_1").cast("int")
    spread = (F.min("amount").alias("a"), F.max("amount").alias("z"), F.min(plan).alias("p"), F.max(plan).alias("q"), F.count(plan).alias("told"), F.count("*").alias("rows"))
    once = e.filter("transaction_id IS NOT NULL").groupBy(*keys, "transaction_id").agg(*spread)
    differ = ~F.col("a").eqNullSafe(F.col("z")) | ~F.col("p").eqNullSafe(F.col("q")) | ((F.col("told") > 0) & (F.col("told") < F.col("rows")))
    clash = F.raise_error(F.concat(F.lit("conflicting reports of transaction "), F.col("transaction_id")))
    once = once.select(*keys, F.when(differ, clash.cast("double")).otherwise(F.col("z")).alias("amount"), F.when(differ, clash.cast("boolean")).otherwise(F.col("q") == 1).alias("is_10b5_1"))
    money = once.unionByName(e.filter("transaction_id IS NULL").select(*keys, "amount", "is_10b5_1"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("amount"))), F.lit(0.0))
    plan = F.col("is_10b5_1")
    sums = money.groupBy(*keys).agg(
        total(F.lit(True)).alias("form4_open_market_buy_usd"), total(plan).alias("form4_10b5_1_buy_usd"), total(~plan).alias("form4_non_10b5_1_buy_usd"), total(plan.isNull()).alias("form4_unknown_10b5_1_buy_usd")
    )
    who = e.groupBy(*keys).agg(F.countDistinct("insider_id").alias("distinct_insider_buyers"))
    return sums.join(by_key(who), keys).withColumn("cluster_buy", F.col("distinct_insider_buyers") >= cluster)


def event_features(decisions: DataFrame, filings: DataFrame, trades: DataFrame, coverage: DataFrame, calendar: DataFrame, lookback: int = 60) -> DataFrame:
    """Filing and insider features of every decision: null where the source isn't complete over the window, zero where it is and nothing happened."""
    keys = ["ticker", "decision_date"]
    out = checked_decisions(decisions, calendar).select(*keys)
    for name, rows in (("filings", filing_features(decisions, filings, calendar, lookback)), ("insider", insider_features(decisions, trades, calendar, lookback))):
        c = window_coverage(decisions, coverage, calendar, name, lookback).select(*keys, F.col("status").alias(f"{name}_coverage"))
        out = out.join(by_key(c), keys, "left").join(by_key(rows), keys, "left")
        for column, kind in rows.dtypes:
            if column in keys:
                continue
            zero = {"boolean": F.lit(False), "double": F.lit(0.0)}.get(kind, F.lit(0))
            value = F.col(column) if column == "days_since_8k_earnings" else F.coalesce(F.col(column), zero)
            out = out.withColumn(column, F.when(F.col(f"{name}_coverage") == "complete", value))
    f, i = F.col("filings_coverage"), F.col("insider_coverage")
    both = F.when((f == "complete") & (i == "complete"), "complete").when((f == "missing") & (i == "missing"), "missing").otherwise("partial")
    return out.withColumn("sec_coverage", both)


# Names of the model's external features.
ALTERNATIVE_RANKS = {"alt_form4_buy_log": "alt_xrank_form4_buy", "alt_short_interest_log": "alt_xrank_short_interest", "alt_short_interest_delta": "alt_xrank_short_interest_delta", "alt_days_to_cover_log": "alt_xrank_days_to_cover"}


def alternative_features(source: DataFrame) -> DataFrame:
    """ticker, decision_date and 20 external features: coverage flags, clipped and scaled values (nulls kept), ranks among what is observed."""
    num = lambda c: F.col(c).cast("double")
    done = lambda c: F.coalesce(F.col(c) == "complete", F.lit(False)).cast("double")
    t = source.select(
        "ticker", "decision_date",
        done("sec_coverage").alias("alt_sec_coverage"), done("filings_coverage").alias("alt_filing_coverage"), done("insider_coverage").alias("alt_insider_coverage"),
        F.log1p(clip(num("current_report_count"), 0.0, 20.0)).alias("alt_current_report_count"),
        num("recent_offering_risk").alias("alt_offering_risk"), num("late_filing_risk").alias("alt_late_filing_risk"), num("new_13d").alias("alt_new_13d"),
        F.log1p(clip(num("form4_open_market_buy_usd"), 0.0)).alias("alt_form4_buy_log"), F.log1p(clip(num("form4_non_10b5_1_buy_usd"), 0.0)).alias("alt_form4_non_plan_buy_log"),
        (clip(num("distinct_insider_buyers"), 0.0, 5.0) / 5.0).alias("alt_distinct_insider_buyers"), num("cluster_buy").alias("alt_cluster_buy"),
        F.col("short_interest").isNotNull().cast("double").alias("alt_short_interest_coverage"), F.log1p(clip(num("short_interest"), 0.0)).alias("alt_short_interest_log"),
        clip(num("short_interest_delta"), -1.0, 5.0).alias("alt_short_interest_delta"), F.log1p(clip(num("days_to_cover"), 0.0, 50.0)).alias("alt_days_to_cover_log"),
        (clip(num("short_interest_age_sessions"), 0.0, 60.0) / 60.0).alias("alt_short_interest_age"),
    )
    return t.select("*", *[observed_percentile_rank(F.col(a), ["decision_date"]).alias(b) for a, b in ALTERNATIVE_RANKS.items()])


def enrich(panel: DataFrame, features: DataFrame, source_snapshot: str) -> DataFrame:
    """panel left-joined 1:1 with external features; missing ones become neutral zeros (their coverage flags say so).

    The features' snapshot must be named, their keys be unique and lie in the panel, and no value may be NaN or infinite; else: error."""
    keys = ["ticker", "decision_date"]
    extra = [c for c in features.columns if c not in keys]
    if not source_snapshot.strip():
        raise ValueError("the snapshot of external features needs a name")
    require_unique(features, keys, "external features")
    if not features.join(by_key(panel.select(*keys)), keys, "left_anti").isEmpty():
        raise ValueError("external features hold keys outside the panel")
    filled = features.select(*keys, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in extra])
    require_finite(filled, extra)
    return panel.join(by_key(filled), keys, "left").withColumns({c: F.coalesce(F.col(c), F.lit(0.0)).cast("float") for c in extra})


def enriched_digest(panel_snapshot: str, source_snapshot: str) -> Column:
    """The identity of an enriched panel: of its own snapshot and the external one."""
    return F.sha2(F.to_json(F.struct(F.lit(source_snapshot).alias("alternative_snapshot"), F.lit(panel_snapshot).alias("ohlcv_snapshot"))), 256)


def coverage_by_date(features: DataFrame) -> DataFrame:
    flags = ("alt_filing_coverage", "alt_insider_coverage", "alt_short_interest_coverage")
    return features.groupBy("decision_date").agg(*[F.avg(c).alias(c) for c in flags])
