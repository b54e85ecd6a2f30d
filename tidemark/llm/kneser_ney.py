"""Quality classifier: an interpolated modified Kneser-Ney model of character n-grams.

The model is trained on trusted text, per language. All n-gram types of the corpus and their trusted counts are gathered
in one aggregation; sharded joins of types, contexts and lower orders give each type its probability, and a document's
log probability is the sum over its n-grams. Thresholds are quantiles of trusted documents that training left out. Trusted is what labels call
good and not toxic.

The types that are frequent in the corpus, a bounded number, are broadcast to where the texts are; positions of all other types are summed
per document and type and joined with the sharded table by key.

Short texts vary much, so a score counts PRIOR further characters at the language's mean.

Nulls and odd input: a null language is a language of its own; a null or wordless text has no perplexity and isn't kept; a
language without trusted text has no threshold and loses nothing else; a null doc_id is scored and is never trusted; rows that
repeat a doc_id are scored each, and with a column ``number`` (a key per row) verdicts name it; characters beyond 16 bits count as their two halves; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, sized, stage, without_rows

ORDER, QUANTILE, PRIOR = 5, 0.995, 200
#: N-gram types whose probabilities are broadcast, the most frequent ones; all others are joined by key.
BROADCAST_TYPES = 500_000


def _texts(docs: DataFrame, order: int) -> DataFrame:
    """row, doc_id, language, units (UTF-16 text behind a start of line), n of its n-grams."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    units = F.encode(F.concat(F.lit("\n" * (order - 1)), text), "UTF-16BE")
    row = F.col("number") if "number" in docs.columns else F.monotonically_increasing_id()
    out = docs.select(row.alias("row"), F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("language"), units.alias("units"))
    return out.withColumn("n", (F.length("units") / 2).cast("int") - (order - 1))


def _positions(texts: DataFrame, order: int) -> DataFrame:
    at = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")
    return texts.filter("n > 0").select("*", at).withColumn("gram", F.expr(f"substring(units, 2 * i + 1, {2 * order})"))


def half(doc_id: Column) -> Column:
    """Which half of the trusted documents an id belongs to: 0 trains, 1 sets thresholds."""
    return F.conv(F.substring(F.md5(F.concat(doc_id.cast("string"), F.lit(":half"))), 1, 1), 16, 10).cast("int") % 2


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id, half of documents that labels call good and don't call toxic."""
    toxic = F.coalesce(F.col("toxic") == 1, F.lit(False)) if "toxic" in labels.columns else F.lit(False)
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").filter(~toxic).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return good.withColumn("half", half(F.col("doc_id")))


def gram_types(docs: DataFrame, trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """language, gram, c, n: every n-gram type of the corpus, how often training text has it, and how often the corpus does."""
    train = sized(trusted.filter("half = 0").select(F.col("doc_id").alias("t_doc")))
    texts = _texts(docs, order).join(train, F.col("doc_id") == F.col("t_doc"), "left")
    weight = F.when(F.col("t_doc").isNotNull(), F.lit(1)).otherwise(F.lit(0))
    return _positions(texts.withColumn("w", weight), order).groupBy("language", "gram").agg(F.sum("w").alias("c"), F.count("*").alias("n"))


def _prefix(n: int) -> Column:
    return F.expr(f"substring(gram, 1, {2 * (n - 1)})")


def _suffix(n: int) -> Column:
    return F.expr(f"substring(gram, 3, {2 * (n - 1)})")


def discounts(types: DataFrame) -> DataFrame:
    """language, d1, d2, d3, v: the three discounts from the counts of counts, and the seen types."""
    count = lambda k: F.sum((F.col("c") == k).cast("double"))
    d = types.groupBy("language").agg(*[count(k).alias(f"n{k}") for k in (1, 2, 3, 4)], F.sum((F.col("c") > 0).cast("long")).alias("v"))
    y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(F.lit(0.5))
    each = [F.least(F.greatest(F.when(F.col(f"n{k}") > 0, k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")).otherwise(F.lit(0.5)), F.lit(0.1)), F.lit(float(k))) for k in (1, 2, 3)]
    return d.select("language", *[e.alias(f"d{k}") for k, e in zip((1, 2, 3), each)], "v")


def probabilities(types: DataFrame, order: int = ORDER) -> DataFrame:
    """language, gram, p (and n, where types have it) of every type of the corpus, from the lowest order up. Joins run on types, never on positions,
    by 64-bit keys of contexts and lower grams; these tables are broadcast while they are small."""
    kept = ["n"] if "n" in types.columns else []
    levels = {order: types}
    for n in range(order - 1, 0, -1):
        levels[n] = levels[n + 1].groupBy("language", _suffix(n + 1).alias("gram")).agg(F.sum((F.col("c") > 0).cast("long")).alias("c"))
        levels[n] = stage(levels[n], f"grams-{n}")
    low = None
    for n in range(1, order + 1):
        d = stage(discounts(levels[n]), f"discounts-{n}")
        key = lambda of: F.xxhash64("language", of)
        counts = levels[n].groupBy("language", key(_prefix(n)).alias("context")).agg(
            F.sum("c").alias("total"), *[F.sum((F.col("c") == k if k < 3 else F.col("c") >= 3).cast("long")).alias(f"m{k}") for k in (1, 2, 3)]
        )
        spare = F.when(F.col("total") > 0, (F.col("d1") * F.col("m1") + F.col("d2") * F.col("m2") + F.col("d3") * F.col("m3")) / F.col("total"))
        contexts = stage(counts.join(sized(d), "language").select("context", "total", spare.alias("spare")), f"contexts-{n}")
        rows = levels[n].join(sized(d), "language").withColumn("context", key(_prefix(n))).join(sized(contexts), "context")
        if low is None:
            below = F.lit(1.0) / (F.col("v") + 1)
        else:
            rows = rows.withColumn("tail", key(_suffix(n))).join(sized(low.select(key("gram").alias("tail"), F.col("p").alias("below"))), "tail")
            below = F.col("below")
        cut = F.when(F.col("c") == 0, F.lit(0.0)).when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        p = F.when(F.col("total") > 0, F.greatest(F.col("c") - cut, F.lit(0.0)) / F.col("total") + F.col("spare") * below).otherwise(below)
        low = stage(rows.select("language", "gram", p.alias("p"), *(kept if n == order else [])), f"probabilities-{n}")
    return low


def document_scores(docs: DataFrame, table: DataFrame, order: int = ORDER, most: int = BROADCAST_TYPES) -> DataFrame:
    """row, doc_id, language, n, log_prob, from one pass over whole texts: frequent types are summed where they are met, rare ones are counted
    per document and joined by key."""
    key, own = F.xxhash64("language", "gram"), ["row", "doc_id", "language", "n"]
    logs = stage(table.select(key.alias("key"), F.log("p").alias("logp"), F.col("n").alias("often")), "log-probabilities")
    texts = _texts(docs, order)
    at = _positions(texts, order).select(*own, key.alias("key"))
    n_types = logs.count()
    cut = 0
    if n_types > most:
        cut = logs.agg(F.percentile_approx("often", 1 - most / n_types, 10_000)).first()[0]
        while logs.filter(F.col("often") > cut).count() > most:
            cut *= 2
    known = logs.filter(F.col("often") > cut).drop("often")
    if n_types > most:
        met = at.join(F.broadcast(known), "key", "left").withColumn("rare", F.when(F.col("logp").isNull(), F.col("key")))
        met = stage(met.groupBy(*own, "rare").agg(F.sum("logp").alias("log_prob"), F.count("*").alias("times")), "type-counts")
        rest = met.filter("rare IS NOT NULL").join(logs.filter(F.col("often") <= cut), F.col("rare") == F.col("key"))
        rest = rest.groupBy(*own).agg(F.sum(F.col("logp") * F.col("times")).alias("log_prob"))
        found = met.filter("rare IS NULL").select(*own, "log_prob").unionByName(rest).groupBy(*own).agg(F.sum("log_prob").alias("log_prob"))
    else:
        found = at.join(F.broadcast(known), "key").groupBy(*own).agg(F.sum("logp").alias("log_prob"))
    wordless = texts.filter("n <= 0").select("row", "doc_id", "language", "n", F.lit(None).cast("double").alias("log_prob"))
    return found.unionByName(wordless)


def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, prior: int = PRIOR, most: int = BROADCAST_TYPES) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang, n_chars16, log_prob, perplexity, threshold, kept, and number where ``docs`` has it."""
    trusted = stage(trusted_ids(labels), "trusted")
    types = stage(gram_types(docs, trusted, order), "gram-types")
    scores = stage(document_scores(docs, probabilities(types, order), order, most), "scores")
    apart = scores.join(trusted.filter("half = 1").select(F.col("doc_id").alias("t_doc")), F.col("doc_id") == F.col("t_doc"))
    mean = apart.groupBy("language").agg((F.sum("log_prob") / F.sum("n")).alias("mean"))
    score = -(F.col("log_prob") + prior * F.coalesce(F.col("mean"), F.lit(0.0))) / (F.col("n") + F.when(F.col("mean").isNotNull(), prior).otherwise(0))
    mean = stage(mean, "means")
    limits = apart.join(mean, "language").groupBy("language").agg(F.percentile_approx(score, quantile, 100_000).alias("limit"))
    rules = stage(mean.join(limits, "language"), "limits")
    out = scores.join(rules, "language", "left").withColumn("score", score)
    return out.select(
        "doc_id",
        F.col("language").alias("lang"),
        F.greatest("n", F.lit(0)).cast("long").alias("n_chars16"),
        "log_prob",
        F.exp("score").alias("perplexity"),
        F.exp("limit").alias("threshold"),
        (F.col("log_prob").isNotNull() & F.coalesce(F.col("score") <= F.col("limit"), F.lit(True))).alias("kept"),
        *([F.col("row").alias("number")] if "number" in docs.columns else []),
    )


def rejected(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """doc_id of documents of which no row is kept."""
    found = classify(docs, labels, **settings)
    return stage(found.groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("NOT kept").select("doc_id"), "rejected")


def accepted(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that are kept, each by its own verdict, with all their columns."""
    own = numbered(docs)
    found = classify(own.select("number", "row.doc_id", "row.text", "row.lang"), labels, **settings)
    return without_rows(own, stage(found.filter("NOT kept").select("number"), "rejected-rows"))
