"""Mixing sources to target weights.

Sizes are summed per source, targets follow from the weights with a cap on repetition, and every document is
taken floor(rate) times plus one hash-seeded Bernoulli copy with the fraction as its probability.

Nulls and odd input: a null text has size 0; the null source is a source of its own and sorts last; rows that repeat a doc_id draw
the same number and are each mixed, rows without doc_id draw by their texts; an empty table gives an empty result; a source
without words has target 0 and its documents are taken 0 times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, as_row, hub_join, stage

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
#: Source tables up to this many rows are broadcast; of larger ones the sources with many documents are, and the others are joined by key.
BROADCAST_SOURCES = 10_000


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: words of the whole text. salt: the text's hash where there is no doc_id."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size.alias("size"), salt().alias("salt"))


def salt() -> Column:
    return F.when(F.col("doc_id").isNull(), F.xxhash64("text"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target, n (documents): ``share`` of all words dealt by weight, no source above ``most`` times its size.

    Level filling in closed form: with sources in order of cap / weight, the first k are capped, where k is the
    last position whose own cap is still below the level that the rest would get. Its windows run over one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (place + 1).cast("int")).cast("long"))
    per = per.withColumn("cap", F.col("source_size") * F.lit(int(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("all_size", F.sum("source_size").over(every))
    per = per.withColumn("left", F.col("all_size") * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    per = per.withColumn("level", F.col("left") / F.sum("weight").over(rest))
    per = per.withColumn("free", F.col("level") * F.col("weight") <= F.col("cap")).withColumn("place", F.row_number().over(order))
    level = F.min(F.when(F.col("free"), F.struct("place", "level"))).over(every)["level"]
    per = per.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(level * F.col("weight"), F.col("cap").cast("double"))))
    return per.select("source", "source_size", "target", "n")


def draw(seed: int) -> Column:
    """A number in [0, 1) from the document's id, or its salt where it has none, and the seed: the same in every run and on every machine."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("salt").cast("string")), F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{seed}"))), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def with_copies(rows: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """Adds source_size, target, rate and copies to rows that have doc_id and source. Rows keep their partition while sources are few;
    beyond, those of large sources do."""
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("t_source")
    t, own = targets.select(name, "source_size", "target", "n"), rows.select("*", name)
    if targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        out = own.join(F.broadcast(t.drop("n")), "t_source").drop("t_source")
    else:
        out = hub_join(own, t, "t_source", targets.agg(F.sum("n")).first()[0]).drop("t_source")
    out = out.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    whole = F.floor("rate")
    return out.withColumn("copies", (whole + F.when(draw(seed) < F.col("rate") - whole, F.lit(1)).otherwise(F.lit(0))).cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken. Texts are read once."""
    sizes = stage(document_sizes(docs), "sizes")
    targets = stage(source_targets(sizes, weights, share, most), "targets")
    return with_copies(sizes, targets, seed).drop("salt").withColumn("taken", F.col("copies") * F.col("size"))


def emit(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 7) -> DataFrame:
    """The mix itself: every row of ``docs``, as many times as it is taken, with its own columns."""
    targets = stage(source_targets(document_sizes(docs), weights, share, most), "targets")
    own = docs.select(as_row(docs), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"), salt().alias("salt"))
    taken = with_copies(own, targets, seed).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return taken.select("row.*")
