"""Corporate-transaction states from ordered filings, by windows instead of a fold.

Each filing acts on (is the issuer under an active transaction?) as one of four functions: it sets active, sets
inactive, toggles, or leaves it. So the state before a filing is the last setting one, turned by the toggles since; that is a
running window, which spills, and no issuer's filings are gathered in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import any_pattern, base_form, is_amendment, items

# Form families and the wording that marks events.
IGNORED_FORMS = ("SC TO", "SC TO-I", "SC TO-T", "S-4")
TEXT_FORMS = ("8-K", "6-K")
TARGET_FORMS = ("DEFM14A", "PREM14A", "SC 13E3", "SC 14D9")
RELEVANT_ITEMS = ("1.01", "1.02", "2.01", "5.01", "8.01")
POSITIVE = (
    r"\b(?:the\s+)?company\s+(?:will|would)\s+be\s+acquired\s+by\b",
    r"\bparent.{0,240}\b(?:will|would)\s+acquire\s+(?:the\s+)?company\b",
    r"\bmerger\s+sub(?:sidiary)?.{0,240}\bmerge\s+with\s+and\s+into\s+(?:the\s+)?company\b",
    r"\b(?:the\s+)?company\s+(?:will|would)\s+become\s+(?:an?\s+)?(?:direct\s+or\s+indirect\s+)?wholly[\s-]+owned\s+subsidiary\b",
    r"\beach\s+(?:outstanding\s+)?share.{0,320}\bconverted\s+into\s+(?:the\s+)?right\s+to\s+receive\b",
)
TERMINATION = (
    r"\bmutually\s+agreed\s+to\s+terminate.{0,160}\b(?:merger|transaction|tender\s+offer|acquisition)\b",
    r"\b(?:merger\s+agreement|tender\s+offer|going[- ]private\s+transaction)\s+(?:has|have|had|was|were|is|are)\s+(?:been\s+)?(?:terminated|withdrawn)\b",
    r"\b(?:terminated|terminate|withdrew|withdrawn?)\s+(?:the\s+)?(?:merger\s+agreement|tender\s+offer|going[- ]private\s+transaction)\b",
    r"\btermination\s+of\s+(?:the\s+)?(?:merger\s+agreement|tender\s+offer|proposed\s+transaction)\b",
)
COMPLETION = (
    r"\b(?:completed|consummated)\s+(?:the\s+)?merger\b",
    r"\bmerger\s+(?:was|has\s+been)\s+(?:completed|consummated)\b",
    r"\bmerger\s+became\s+effective\b",
    r"\btender\s+offer.{0,240}\bexpired\b.{0,240}\baccepted\s+for\s+payment\b",
    r"\baccepted\s+for\s+payment.{0,240}\btendered\s+shares\b",
)


def with_events(filings: DataFrame, text: str = "text", extra: str | None = None, positive=POSITIVE, completion=COMPLETION, termination=TERMINATION) -> DataFrame:
    """Adds positive, completed, terminated of the primary text, and supp_completed, supp_terminated of the supplemental one; texts go."""
    find = lambda c, p: any_pattern(F.col(c), p) if c else F.lit(False)
    out = filings.select("*", find(text, positive).alias("positive"), find(text, completion).alias("completed"), find(text, termination).alias("terminated"), find(extra, completion).alias("supp_completed"), find(extra, termination).alias("supp_terminated"))
    return out.drop(*[c for c in (text, extra) if c])


def _terminal(completed: Column, terminated: Column) -> Column:
    return F.when(completed, F.struct(F.lit("completed").alias("state"), F.lit("transaction_completed").alias("reason"))).when(
        terminated, F.struct(F.lit("terminated").alias("state"), F.lit("transaction_terminated_or_withdrawn").alias("reason"))
    )


def _acting(filings: DataFrame) -> DataFrame:
    """Filings that can matter, with what each does: _act begins a transaction, _late is an amendment that needs a base, _toggle begins or ends one, _set settles the state."""
    f = filings.withColumn("_base", base_form(F.col("form"))).withColumn("_amended", is_amendment(F.col("form")))
    f = f.filter(~F.col("_base").isin(*IGNORED_FORMS))
    if "in_search" in f.columns:
        f = f.filter(~F.col("_base").isin(*TEXT_FORMS) | F.col("in_search"))
    target = F.col("_base") == "SC 14D9"
    f = f.withColumn("_act", F.when(target, ~F.col("_amended")).otherwise(F.col("positive"))).withColumn("_late", target & F.col("_amended"))
    f = f.withColumn("_primary", F.col("completed") | F.col("terminated"))
    f = f.withColumn("_supp", F.col("_base").isin(*TEXT_FORMS) & (F.col("supp_completed") | F.col("supp_terminated")))
    # What a filing does to the active state: 1 sets it, 0 ends it, null leaves it; a toggle does either.
    f = f.withColumn("_toggle", (F.col("_act") & F.col("_primary")).cast("int"))
    f = f.withColumn("_set", F.when(F.col("_toggle") == 1, F.lit(None)).when(F.col("_act"), F.lit(1)).when(F.col("_primary") | F.col("_supp"), F.lit(0)))
    begun = F.struct(F.lit("active").alias("state"), F.when(target, "target_tender_offer_form_SC_14D9").otherwise("definitive_target_transaction_language").alias("reason"))
    ended = F.when(F.col("_primary"), _terminal(F.col("completed"), F.col("terminated"))).when(F.col("_supp"), _terminal(F.col("supp_completed"), F.col("supp_terminated")))
    return f.withColumn("_begun", begun).withColumn("_ended", ended)


def _lost() -> Column:
    return F.struct(F.lit("unknown").alias("state"), F.lit("transaction_amendment_without_base_filing").alias("reason"))


#: States that events bring about, with their reasons, which tell them apart.
EVENTS = (
    ("active", "target_tender_offer_form_SC_14D9"), ("active", "definitive_target_transaction_language"), ("completed", "transaction_completed"),
    ("terminated", "transaction_terminated_or_withdrawn"), ("unknown", "transaction_amendment_without_base_filing"),
)
#: Rows of the timeline that a task is given.
_LINE_ROWS = 100_000


def _code(event: Column) -> Column:
    """The number of an event in EVENTS, from 1; null without one."""
    return F.nullif(F.array_position(F.array(*[F.lit(reason) for _, reason in EVENTS]), event["reason"]).cast("int"), F.lit(0))


def transaction_events(filings: DataFrame) -> DataFrame:
    """filings (ticker, accepted_at, accession_number, form, event flags, optional in_search) with the event that each brings about, if any."""
    f = _acting(filings)
    w = Window.partitionBy("ticker").orderBy("accepted_at", "accession_number")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    f = f.withColumn("_turns", F.sum("_toggle").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    mark = F.when(F.col("_set").isNotNull(), F.struct(F.col("_set").alias("s"), F.col("_turns").alias("t")))
    f = f.withColumn("_last", F.last(mark, ignorenulls=True).over(past))
    turned = F.coalesce(F.lag("_turns").over(w), F.lit(0)) - F.coalesce(F.col("_last.t"), F.lit(0))
    f = f.withColumn("_active", (F.coalesce(F.col("_last.s"), F.lit(0)) + turned) % 2 == 1)
    f = f.withColumn("_none", F.coalesce(F.sum((F.col("_act") | F.col("_late")).cast("int")).over(past), F.lit(0)) == 0)
    event = F.when(F.col("_active") & F.col("_primary"), F.col("_ended")).when(F.col("_act"), F.col("_begun")).when(F.col("_late") & F.col("_none"), _lost()).when(F.col("_active") & F.col("_supp"), F.col("_ended"))
    return f.withColumn("event", event).drop(*[c for c in f.columns if c.startswith("_")])


def states_as_of(filings: DataFrame, decisions: DataFrame, lookback_days: int = 732, strict: bool = False) -> DataFrame:
    """ticker, decision_date, state, reason, form, accession_number, accepted_at: the state of each decision from the filings known then.

    decisions: ticker, decision_date, decision_at. Known are filings accepted by decision_at, from the start of the day ``lookback_days`` before
    on; whatever lies earlier is as if it had never been. Filings, decisions and starts of windows form one timeline per ticker, which windows run
    along once in each direction:

    the last filing that begins or toggles a transaction (within the window) always brings an event; whether the transaction is active after it
    follows from the last setting one and the toggles since, or where none lies in the window, from the toggles since its start. If active, the
    next filing that ends one, should it come by then, brings the last event. Without a beginning, the first late amendment leaves the state unknown.

    An accession number comes once per ticker (``selected_filings``); repeated decisions are an error; strict: an unknown state is an error."""
    from .panel import require_unique

    decisions = require_unique(decisions.select("ticker", "decision_date", "decision_at"), ["ticker", "decision_date"], "decisions")
    f = _acting(filings)
    # Events travel as numbers, and a filing's names once in its own row: windows sort all rows of a task.
    marks = f.select(
        "ticker", F.col("accepted_at").alias("at"), F.lit(1).alias("kind"), "accession_number", "form", F.lit(None).cast("date").alias("decision_date"), F.lit(None).cast("timestamp").alias("until"),
        F.coalesce("_toggle", F.lit(0)).alias("toggle"), F.col("_set").alias("set"), F.when(F.col("_act"), _code(F.col("_begun"))).alias("begins"),
        F.when(F.col("_toggle") == 1, _code(F.col("_ended"))).alias("turns_to"), F.when(~F.col("_act"), _code(F.col("_ended"))).alias("ends"), F.when(F.col("_late"), _code(_lost())).alias("late"),
    )
    start = (F.to_date("decision_at") - lookback_days).cast("timestamp")
    at = lambda when, kind: decisions.select("ticker", when.alias("at"), F.lit(kind).alias("kind"), F.lit("").alias("accession_number"), "decision_date", F.col("decision_at").alias("until"))
    line = marks.unionByName(at(start, 0), allowMissingColumns=True).unionByName(at(F.col("decision_at"), 2), allowMissingColumns=True)
    # Whole tickers in as many parts as their rows ask for, so that what a task sorts doesn't grow with the input.
    line = line.repartition(max(1, -(-line.count() // _LINE_ROWS)), "ticker")
    row = lambda event: F.when(F.col(event).isNotNull(), F.struct("at", "accession_number", "form", F.col(event).alias("event")))
    back = Window.partitionBy("ticker").orderBy(F.col("at").desc(), F.col("kind").desc(), F.col("accession_number").desc()).rowsBetween(Window.unboundedPreceding, -1)
    line = line.withColumn("next_end", F.last(row("ends"), ignorenulls=True).over(back)).withColumn("next_late", F.last(row("late"), ignorenulls=True).over(back))
    # The next end is asked for by what begins, the next late amendment by the start of a window.
    line = line.withColumns({"next_end": F.when(F.col("begins").isNotNull(), F.col("next_end")), "next_late": F.when(F.col("kind") == 0, F.col("next_late"))}).drop("ends", "late")
    ahead = Window.partitionBy("ticker").orderBy("at", "kind", "accession_number").rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("turns", F.coalesce(F.sum("toggle").over(ahead), F.lit(0)))
    line = line.withColumn("setter", F.last(F.when(F.col("set").isNotNull(), F.struct("at", F.col("set").alias("s"), F.col("turns").alias("t"))), ignorenulls=True).over(ahead))
    begun = F.when(F.col("begins").isNotNull(), F.struct(row("begins").alias("own"), "turns_to", "turns", "setter", "next_end"))
    line = line.withColumn("begun", F.last(begun, ignorenulls=True).over(ahead)).filter("kind <> 1").select("ticker", "at", "kind", "decision_date", "until", "turns", "next_late", "begun")
    of = lambda kind, *columns: F.max_by(F.struct(*columns), F.when(F.col("kind") == kind, 1))  # noqa: E731  one row of each kind
    met = line.groupBy("ticker", "decision_date").agg(F.first("until").alias("until"), of(0, "at", "turns", "next_late").alias("a"), of(2, "begun").alias("z"))
    met = met.select("ticker", "decision_date", "until", "a", F.col("z.begun").alias("b"))
    inside = F.coalesce(F.col("b.own.at") >= F.col("a.at"), F.lit(False))
    since = F.when(F.col("b.setter.at") >= F.col("a.at"), F.col("b.setter.s") + F.col("b.turns") - F.col("b.setter.t")).otherwise(F.col("b.turns") - F.col("a.turns"))
    active = since % 2 == 1
    turned = F.struct(F.col("b.own.at").alias("at"), F.col("b.own.accession_number").alias("accession_number"), F.col("b.own.form").alias("form"), F.col("b.turns_to").alias("event"))
    last = (
        F.when(inside & active & (F.col("b.next_end.at") <= F.col("until")), F.col("b.next_end"))
        .when(inside & ~active & F.col("b.turns_to").isNotNull(), turned)
        .when(inside, F.col("b.own"))
        .when(F.col("a.next_late.at") <= F.col("until"), F.col("a.next_late"))
    )
    named = lambda k: F.coalesce(*[F.when(F.col("l.event") == i, F.lit(told[k])) for i, told in enumerate(EVENTS, 1)], F.lit(("none", "no_definitive_transaction_filing")[k]))
    out = met.withColumn("l", last).select(
        "ticker", "decision_date", named(0).alias("state"), named(1).alias("reason"),
        F.col("l.form").alias("form"), F.col("l.accession_number").alias("accession_number"), F.col("l.at").alias("accepted_at"),
    )
    if strict and not out.filter("state = 'unknown'").isEmpty():
        raise ValueError("a transaction state is incomplete")
    return out


def status_flags(states: DataFrame) -> DataFrame:
    """ticker, decision_date, flagged: under a definitive transaction. A decision whose state is unknown has no status, so that its date fails if the rank is met."""
    return states.filter("state <> 'unknown'").select("ticker", "decision_date", (F.col("state") == "active").alias("flagged"))


def transaction_states(filings: DataFrame, tickers: DataFrame, strict: bool = False) -> DataFrame:
    """ticker, state, reason, form, accession_number, accepted_at: the last event of each ticker. strict: an unknown state is an error."""
    e = transaction_events(filings).filter("event IS NOT NULL")
    last = e.groupBy("ticker").agg(F.max(F.struct("accepted_at", "accession_number", "form", "event")).alias("l"))
    out = tickers.select("ticker").distinct().join(last, "ticker", "left").select(
        "ticker",
        F.coalesce(F.col("l.event.state"), F.lit("none")).alias("state"),
        F.coalesce(F.col("l.event.reason"), F.lit("no_definitive_transaction_filing")).alias("reason"),
        F.col("l.form").alias("form"), F.col("l.accession_number").alias("accession_number"), F.col("l.accepted_at").alias("accepted_at"),
    )
    if strict and not out.filter("state = 'unknown'").isEmpty():
        raise ValueError("a transaction state is incomplete")
    return out


def retained(tickers: DataFrame, states: DataFrame) -> DataFrame:
    """Tickers that aren't under a definitive transaction; by decision date where both sides have one."""
    keys = ["ticker", *(c for c in ("decision_date",) if c in tickers.columns and c in states.columns)]
    return tickers.join(states.filter("state = 'active'").select(*keys), keys, "left_anti")


def selected_filings(filings: DataFrame, decision_at: Column, lookback_days: int = 732) -> DataFrame:
    """Filings within the lookback, accepted by the cutoff, of relevant forms; 8-Ks only with a relevant item. Conflicting metadata of an accession: error."""
    from .panel import conflicts

    if not conflicts(filings, ["ticker", "accession_number"], ["form", "accepted_at"]).isEmpty():
        raise ValueError("an accession number comes with conflicting metadata")
    base, rest = base_form(F.col("form")), [c for c in filings.columns if c not in ("ticker", "accession_number")]
    ok = (F.col("accepted_at") <= decision_at) & (F.col("accepted_at") >= decision_at - F.expr(f"INTERVAL {lookback_days} DAYS"))
    own = F.arrays_overlap(items(F.col("items")), F.array(*[F.lit(x) for x in RELEVANT_ITEMS]))
    return filings.filter(ok & base.isin(*TARGET_FORMS, *IGNORED_FORMS, *TEXT_FORMS) & ((base != "8-K") | own)).groupBy("ticker", "accession_number").agg(F.min(F.struct(*rest)).alias("_r")).select("ticker", "accession_number", "_r.*").select(*filings.columns)


def candidate_documents(hits: DataFrame, filings: DataFrame, decision_at: Column, guard_days: int = 7) -> DataFrame:
    """ticker, accession_number, documents: search hits, and text filings of the last days, which a search index may lag behind."""
    late = filings.filter(base_form(F.col("form")).isin(*TEXT_FORMS) & (F.col("accepted_at") >= decision_at - F.expr(f"INTERVAL {guard_days} DAYS")) & (F.col("accepted_at") <= decision_at))
    both = hits.select("ticker", "accession_number", "document").unionByName(late.select("ticker", "accession_number", F.lit(None).cast("string").alias("document")))
    return both.groupBy("ticker", "accession_number").agg(F.array_sort(F.collect_set("document")).alias("documents"))
