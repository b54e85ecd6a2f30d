"""Readers of delimited, columnar-JSON and index files into declared tables. All splitting and parsing stays in Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.calendar import next_session
from ..operators.panel import conflicts, duplicates, valid_bar

# Exchange codes of symbol directories, and header names of short-interest files by meaning.
EXCHANGES = {"N": "NYSE", "A": "NYSE American", "P": "NYSE Arca", "Z": "Cboe BZX", "V": "IEX"}
ALIASES = {
    "symbol": ("symbolcode", "symbol", "issuesymbolidentifier"),
    "short_interest": ("currentshortpositionquantity", "currentshortshares", "shortinterest"),
    "settlement_date": ("settlementdate",),
    "stock_split_flag": ("stocksplitflag", "splitflag"),
    "revision_flag": ("revisionflag",),
}


def _csv(spark: SparkSession, path: str, sep: str) -> DataFrame:
    return spark.read.option("sep", sep).option("header", True).option("mode", "PERMISSIVE").csv(path)


def _or_null(df: DataFrame, *names: str) -> Column:
    found = [F.col(f"`{n}`") for n in names if n in df.columns]
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in found]) if found else F.lit(None).cast("string")


def symbol_directories(spark: SparkSession, listed: str, other: str, available_at: Column) -> DataFrame:
    """Two pipe-delimited directories as one universe table; their creation-time footers go. Empty or repeated symbols: error."""
    parts = []
    for path, source in ((listed, "listed"), (other, "other")):
        d = _csv(spark, path, "|")
        first = d.columns[0]
        d = d.filter(~F.coalesce(F.col(f"`{first}`").startswith("File Creation Time"), F.lit(False)))
        code = _or_null(d, "Exchange")
        exchange = F.lit("NASDAQ") if source == "listed" else F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in EXCHANGES.items() for x in kv]), code), code)
        etf, nxt, test = (_or_null(d, n) for n in ("ETF", "NextShares", "Test Issue"))
        name = _or_null(d, "Security Name")
        parts.append(
            d.select(
                F.translate(_or_null(d, "NASDAQ Symbol", "Symbol", "ACT Symbol"), ".", "-").alias("symbol"),
                name.alias("security_name"),
                exchange.alias("exchange"),
                S.security_type(name, etf, nxt).alias("security_type"),
                S.set_flags(test_issue=test == "Y", etf=etf == "Y", nextshares=nxt == "Y", market_category=_or_null(d, "Market Category"), financial_status=_or_null(d, "Financial Status")).alias("flags"),
                F.lit(source).alias("source"),
                available_at.alias("available_at"),
            )
        )
    out = parts[0].unionByName(parts[1])
    if not out.filter("symbol IS NULL").isEmpty() or not duplicates(out, ["symbol"]).isEmpty():
        raise ValueError("a directory holds empty or repeated symbols")
    return out


def refuse(rows: DataFrame, bad: dict[str, Column], what: str) -> None:
    """An error that names what is bad and in how many rows; one aggregation."""
    counts = rows.agg(*[F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0)).alias(n) for n, c in bad.items()]).first().asDict()
    found = {n: k for n, k in counts.items() if k}
    if found:
        raise ValueError(f"{what} holds malformed values: {found}")


def short_interest_file(spark: SparkSession, path: str | list[str], calendar: DataFrame, publications: DataFrame, observed_at: Column | None = None, strict: bool = True) -> DataFrame:
    """Short interest under any known header names, delimiter and date format.

    A position is available at the close of the session after its publication; a revised one after the later of its publication and its
    observation (``observed_at``, which may read ``_metadata.file_path`` to differ by file). Errors: malformed symbols, dates, whole numbers
    and flags, a settlement without publication, a publication before its settlement, and a revised row that nobody observed. With ``strict=False``
    malformed values are null, and so is the availability of such a row, so that nothing is known early."""
    paths = [path] if isinstance(path, str) else list(path)
    head = spark.read.text(paths[0]).first()[0]
    sep = max("|,\t", key=head.count)
    d = spark.read.option("sep", sep).option("header", True).option("mode", "PERMISSIVE").csv(paths)
    plain = {"".join(ch for ch in c.lower() if ch.isalnum()): c for c in d.columns}
    col = lambda n: next((F.col(f"`{plain[a]}`") for a in ALIASES[n] if a in plain), F.lit(None).cast("string"))
    revised = S.flag(col("revision_flag"), S.REVISED_YES)
    # A row that isn't revised needs no observation, whose date is often taken from a path.
    seen = F.when(F.coalesce(revised, F.lit(True)), F.to_date(observed_at)) if observed_at is not None else F.lit(None).cast("date")
    rows = d.select(
        S.ticker(col("symbol")).alias("symbol"), S.date(col("settlement_date")).alias("settlement_date"), S.count(col("short_interest")).alias("short_interest"),
        S.flag(col("stock_split_flag"), S.SPLIT_YES).alias("stock_split_flag"), revised.alias("revision_flag"), seen.alias("_seen"),
        S.bad_count(col("short_interest"), required=True).alias("_bad_count"), S.bad_flag(col("stock_split_flag"), S.SPLIT_YES).alias("_bad_split"), S.bad_flag(col("revision_flag"), S.REVISED_YES).alias("_bad_revision"),
    )
    rows = rows.join(F.broadcast(publications.select("settlement_date", "publication_date")), "settlement_date", "left")
    unseen, early = F.col("revision_flag") & F.col("_seen").isNull(), F.col("publication_date") < F.col("settlement_date")
    if strict:
        bad = {"symbol": F.col("symbol").isNull(), "settlement_date": F.col("settlement_date").isNull(), "short_interest": F.col("_bad_count"), "stock_split_flag": F.col("_bad_split"), "revision_flag": F.col("_bad_revision")}
        bad |= {"settlement without publication": F.col("settlement_date").isNotNull() & F.col("publication_date").isNull(), "publication before settlement": early, "revision without observation": unseen}
        refuse(rows, bad, "a short-interest file")
    known = F.when(~F.coalesce(unseen, F.lit(True)) & ~F.coalesce(early, F.lit(True)), F.greatest("publication_date", F.when(F.col("revision_flag"), F.col("_seen"))))
    rows = next_session(rows.withColumn("_from", known), calendar, "_from", "_session").withColumnRenamed("_session_close", "available_at")
    return rows.select("symbol", "settlement_date", "publication_date", "available_at", "short_interest", "stock_split_flag", "revision_flag").distinct()


def filing_index(spark: SparkSession, path: str | list[str], tickers: DataFrame, calendar: DataFrame, forms: tuple[str, ...]) -> DataFrame:
    """CIK|Company|Form|Date|File lines of the wanted base forms, one row per ticker of the issuer; preamble lines have no five fields."""
    p = F.split("value", r"\|", 5)
    lines = spark.read.text(path).select(p.alias("p")).filter((F.size("p") == 5) & F.col("p")[0].rlike(r"^\d+$"))
    rows = lines.select(F.col("p")[0].cast("long").alias("cik"), S.form(F.col("p")[2]).alias("form"), S.date(F.col("p")[3]).alias("filed_date"), F.trim(F.col("p")[4]).alias("filing_path"))
    rows = rows.filter(S.base_form(F.col("form")).isin(*forms) & S.is_archive_path(F.col("filing_path")))
    rows = rows.withColumn("accession_number", F.regexp_extract("filing_path", r"([^/]+)\.txt$", 1)).join(tickers.select("cik", "ticker"), "cik")
    out = next_session(rows, calendar, "filed_date", "_s").withColumnRenamed("_s_close", "available_at")
    return out.select("ticker", "cik", "filed_date", "available_at", "form", "accession_number", "filing_path")


def index_last_received(spark: SparkSession, path: str) -> DataFrame:
    """One row: the date that a filing index's preamble names as last received."""
    said = F.regexp_extract("value", r"(?i)^Last Data Received:\s*(.+)$", 1)
    return spark.read.text(path).select(S.date(F.trim(said)).alias("last_received")).filter("last_received IS NOT NULL").agg(F.max("last_received").alias("last_received"))


def insider_archive(spark: SparkSession, submission: str, transactions: str, owners: str, tickers: DataFrame, calendar: DataFrame, strict: bool = True) -> DataFrame:
    """Open-market purchases from three tab-separated files, one row per transaction, owner and ticker; the first in order of price where these
    and the shares repeat. Malformed flags, dates and numbers are errors; with ``strict=False`` they are null."""
    plan = S.YES, S.NO
    forms = _csv(spark, submission, "\t").filter(F.col("DOCUMENT_TYPE") == "4")
    if strict:
        refuse(forms, {"FILING_DATE": S.date(F.col("FILING_DATE")).isNull(), "AFF10B5ONE": S.bad_flag(F.col("AFF10B5ONE"), *plan)}, "a submission file")
        buys = _csv(spark, transactions, "\t").filter("TRANS_CODE = 'P' AND TRANS_ACQUIRED_DISP_CD = 'A'")
        refuse(buys, {c: S.bad_number(F.col(c)) for c in ("TRANS_SHARES", "TRANS_PRICEPERSHARE")}, "a transaction file")
    s = forms.select("ACCESSION_NUMBER", S.date(F.col("FILING_DATE")).alias("filed"), F.col("ISSUERCIK").cast("long").alias("cik"), S.flag(F.col("AFF10B5ONE"), *plan).alias("is_10b5_1"))
    t = _csv(spark, transactions, "\t").filter("TRANS_CODE = 'P' AND TRANS_ACQUIRED_DISP_CD = 'A'").select("ACCESSION_NUMBER", "NONDERIV_TRANS_SK", S.number(F.col("TRANS_SHARES")).alias("shares"), S.number(F.col("TRANS_PRICEPERSHARE")).alias("price"))
    o = _csv(spark, owners, "\t").select("ACCESSION_NUMBER", F.col("RPTOWNERCIK").alias("insider_id"))
    rows = t.filter("shares IS NOT NULL AND price IS NOT NULL").join(s, "ACCESSION_NUMBER").join(o, "ACCESSION_NUMBER").join(tickers.select("cik", "ticker"), "cik")
    out = next_session(rows, calendar, "filed", "_s").withColumnRenamed("_s_close", "available_at")
    out = out.select("ticker", "available_at", F.lit("P").alias("transaction_code"), "shares", "price", "insider_id", "is_10b5_1", F.concat_ws(":", "ACCESSION_NUMBER", "NONDERIV_TRANS_SK").alias("transaction_id"), F.col("ACCESSION_NUMBER").alias("accession_number"))
    keys = ["ticker", "accession_number", "transaction_id", "insider_id", "shares"]
    rest = F.min(F.struct("price", *[c for c in out.columns if c not in (*keys, "price")])).alias("r")
    return out.groupBy(*keys).agg(rest).select(*keys, "r.*").select(*out.columns)


def ticker_map(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """ticker, cik from a JSON object of objects or a two-column tab-separated text. A ticker with two numbers: error."""
    if kind == "json":
        raw = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", "map<string,struct<cik_str:bigint,ticker:string>>")).alias("k", "v")).select(S.ticker(F.col("v.ticker")).alias("ticker"), F.col("v.cik_str").alias("cik"))
    else:
        raw = spark.read.option("sep", "\t").schema("ticker string, cik bigint").csv(path).select(S.ticker(F.col("ticker")).alias("ticker"), "cik")
    rows = raw.filter("ticker IS NOT NULL AND cik > 0").distinct()
    if not conflicts(rows, ["ticker"], ["cik"]).isEmpty():
        raise ValueError("a ticker maps to two issuers")
    return rows


def filing_table(tables: DataFrame, column: str = "value") -> DataFrame:
    """Columnar JSON (parallel arrays) as rows: accession_number, form, filed_date, accepted_at, items, primary_document.

    Tables whose arrays differ in length, and rows whose accession or document name is malformed, are errors."""
    kind = "struct<accessionNumber:array<string>,form:array<string>,filingDate:array<string>,acceptanceDateTime:array<string>,items:array<string>,primaryDocument:array<string>>"
    names = [x.split(":")[0] for x in kind[7:-1].split(",")]
    keys = [c for c in tables.columns if c != column]
    t = tables.withColumn("t", F.from_json(column, kind))
    n = F.size(F.col(f"t.{names[0]}"))
    uneven = F.lit(False)
    for c in names[1:]:
        uneven = uneven | (F.size(F.col(f"t.{c}")) != n)
    if not t.filter(uneven | F.col("t").isNull()).isEmpty():
        raise ValueError("a filing table's columns differ in length")
    rows = t.select(*keys, F.inline(F.arrays_zip(*[F.col(f"t.{c}") for c in names])))
    rows = rows.toDF(*keys, *names)
    ok = S.is_accession(F.col("accessionNumber")) & S.is_base_name(F.col("primaryDocument"))
    if not rows.filter(~ok).isEmpty():
        raise ValueError("a filing table holds a malformed name")
    return rows.select(*keys, F.col("accessionNumber").alias("accession_number"), S.form(F.col("form")).alias("form"), S.date(F.col("filingDate")).alias("filed_date"), S.instant(F.col("acceptanceDateTime")).alias("accepted_at"), "items", F.col("primaryDocument").alias("primary_document"))


def vendor_bars(wide: DataFrame, tickers: list[str], fields: dict[str, str]) -> DataFrame:
    """Wide vendor columns ``<field>:<ticker>`` as long bars; invalid rows go. fields: vendor field -> column (adjusted close as close)."""
    rows = F.array(*[F.struct(F.lit(t).alias("ticker"), *[F.col(f"`{v}:{t}`").alias(c) for v, c in fields.items()]) for t in tickers])
    return wide.select("dt", F.inline(rows)).select("ticker", "dt", *fields.values()).filter(valid_bar([c for c in fields.values() if c != "volume"]))
