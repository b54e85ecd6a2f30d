"""A versioned ledger of source files: which file of a source and period was observed when, by its digest, and which one counts as of a date.

A file's version is told by its path, ``<root>/<source>/<period>/observed_at=YYYY-MM-DD/<sha256>.<suffix>``, so the listing is the ledger: nothing is
overwritten, and a query as of an earlier date finds the files of then. Listings read no file's content; contents of all files that count are
read in one plan, with each row's observation taken from its own path.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import calendar as C
from ..operators.bitemporal import newest_known
from .readers import filing_index, short_interest_file

_PATH = r"/([^/]+)/([^/]+)/observed_at=(\d{4}-\d{2}-\d{2})/([0-9a-f]{64})\.[^/]+$"


def observed(path: Column) -> Column:
    """The date at which the file of a path was observed; null for other paths."""
    return F.to_date(F.nullif(F.regexp_extract(path, _PATH, 3), F.lit("")))


def store(rows: DataFrame, root: str, source: str, period: str, observed_at: str, sep: str | None = None) -> str:
    """Write rows as one version of a source's period, as lines of text or, with ``sep``, delimited under a header: its path.

    The name is a digest of the rows, in whatever order, so the same rows observed again at that date are the same version; others are another.
    A version is a folder of part files that becomes visible by a rename."""
    spark = rows.sparkSession
    own = rows.select(F.to_json(F.struct(*rows.columns)).alias("r"))
    sums = [F.coalesce(F.sum(F.xxhash64("r", F.lit(k)).cast("decimal(38,0)")), F.lit(0)).cast("string") for k in (1, 2)]
    digest = own.agg(F.sha2(F.concat_ws("|", F.count("*"), *sums), 256).alias("d")).first().d
    at, new = f"{root}/{source}/{period}/observed_at={observed_at}/{digest}.{'csv' if sep else 'txt'}", f"{root}/_new-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path(at)):
        return at
    if sep:
        rows.write.option("sep", sep).option("header", True).option("emptyValue", "").csv(new)
    else:
        rows.write.text(new)
    fs.mkdirs(path(at).getParent())
    if not fs.rename(path(new), path(at)) and not fs.exists(path(at)):
        raise OSError(f"{at} can't be written")
    return at


def versions(spark: SparkSession, root: str) -> DataFrame:
    """source, period, observed_at, digest, written, path of every version under ``root``; other paths are passed over."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime")
    folder = F.regexp_replace("path", r"/[^/]+$", "")
    at = F.when(folder.rlike(_PATH), folder).otherwise(F.col("path"))
    part = lambda k: F.regexp_extract("at", _PATH, k)
    rows = files.select(at.alias("at"), "modificationTime").filter(F.col("at").rlike(_PATH)).groupBy("at").agg(F.max("modificationTime").alias("written"))
    return rows.select(part(1).alias("source"), part(2).alias("period"), F.to_date(part(3)).alias("observed_at"), part(4).alias("digest"), "written", F.col("at").alias("path"))


def latest(ledger: DataFrame, source: str, known_at: str) -> DataFrame:
    """Of each period of a source the version observed last up to ``known_at``; ties by the time of writing, then digest."""
    own = ledger.filter(F.col("source") == source)
    return newest_known(own, ["source", "period"], F.col("observed_at") <= F.lit(known_at).cast("date"), ["observed_at", "written", "digest"])


def _paths(picked: DataFrame) -> list[str]:
    """One path per period of a source: names, not rows of data."""
    return sorted(r.path for r in picked.select("path").collect())


def every_version(ledger: DataFrame, source: str, known_at: str) -> DataFrame:
    return ledger.filter((F.col("source") == source) & (F.col("observed_at") <= F.lit(known_at).cast("date")))


def observed_positions(spark: SparkSession, root: str, known_at: str, calendar: DataFrame, publications: DataFrame, source: str = "short-interest") -> DataFrame:
    """Short-interest versions of all files observed up to ``known_at``, in one plan; a revised row is available after its own file's observation."""
    at = observed(F.regexp_replace("_metadata.file_path", r"/[^/]+$", ""))
    return short_interest_file(spark, _paths(every_version(versions(spark, root), source, known_at)), calendar, publications, at)


def quarter(period: Column) -> Column:
    """The first day of a quarter named like 1998Q1."""
    return F.make_date(F.substring(period, 1, 4).cast("int"), (F.substring(period, 6, 1).cast("int") - 1) * 3 + 1, F.lit(1))


def index_receptions(spark: SparkSession, root: str, known_at: str, source: str = "filing-index") -> DataFrame:
    """q, observed_at, last_received of each quarter's filing index that counts at ``known_at``; a reception after its observation is an error."""
    picked = latest(versions(spark, root), source, known_at)
    said = F.regexp_extract("value", r"(?i)^Last Data Received:\s*(.+)$", 1)
    lines = spark.read.text(_paths(picked)).select(F.regexp_replace("_metadata.file_path", r"/[^/]+$", "").alias("path"), S.date(F.trim(said)).alias("day")).filter("day IS NOT NULL")
    out = lines.groupBy("path").agg(F.max("day").alias("last_received")).select(quarter(F.regexp_extract("path", _PATH, 2)).alias("q"), observed(F.col("path")).alias("observed_at"), "last_received")
    if not out.filter("last_received > observed_at").isEmpty():
        raise ValueError("a filing index names a reception after its own observation")
    return out


def observed_filings(spark: SparkSession, root: str, known_at: str, tickers: DataFrame, calendar: DataFrame, forms: tuple[str, ...], source: str = "filing-index") -> DataFrame:
    """Filings of the indexes that count at ``known_at``."""
    return filing_index(spark, _paths(latest(versions(spark, root), source, known_at)), tickers, calendar, forms)


def observed_coverage(spark: SparkSession, root: str, start: str, end: str, known_at: str, tickers: DataFrame, calendar: DataFrame) -> DataFrame:
    """ticker, source, coverage_start, coverage_end, status of filings and insider archives per quarter, from what the ledger holds as of ``known_at``.

    tickers: ticker, mapped. Filings are complete up to the session after each index's last reception; an insider quarter whose archive was observed
    while it was open is partial."""
    received = index_receptions(spark, root, known_at).select("q", "last_received")
    quarters = C.quarters(spark, start, end, known_at)
    # An index tells by itself up to where it goes, whether its quarter has ended or not.
    filings = C.coverage_intervals(quarters.withColumn("is_open", F.lit(True)), tickers, received, calendar)
    archives = latest(versions(spark, root), "insider", known_at).select(quarter(F.col("period")).alias("q"), "observed_at")
    insider = C.insider_intervals(quarters, tickers, archives)
    return filings.withColumn("source", F.lit("filings")).unionByName(insider.withColumn("source", F.lit("insider"))).select("ticker", "source", "coverage_start", "coverage_end", "status")
