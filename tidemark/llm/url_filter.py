"""URL filters: pattern rules indexed by their rarest literal token.

A rule's pattern contains literal tokens; it is filed under the one that is rarest among all urls. A url's
tokens fetch its candidate rules and only those run their regular expression; the longest match wins. Rules come from lists of hosts with
paths, of words in host names, and of wildcard patterns, in code or from a table (``load_rules``). A rule without a token is refused.

Nulls and odd input: a null url, or one without ``://``, has empty host and path, fits no rule and is allowed;
repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, hub_join, sized, stage

#: Rule sets up to this size go into the plan as a map; larger ones are joined by token. A rule table may have so many rows.
INLINE_RULES, MOST_RULES = 2_000, 1_000_000


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` runs on host and path joined; ``tokens`` are literals that any match contains."""

    rule: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    listed: bool = True


def host_rule(verdict: str, rule: str) -> UrlRule:
    """``host/path``: fits the host and its subdomains where the url's path starts with the rule's."""
    host, slash, path = rule.partition("/")
    cut = slash + path
    ends = cut if cut[-1:].isalnum() is False else re.sub(r"[A-Za-z0-9]+$", "", cut)
    tokens = re.findall(r"[a-z0-9]+", host) + re.findall(r"[a-z0-9]+", ends.lower())
    return UrlRule(rule, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(cut)}", tuple(dict.fromkeys(tokens)))


def word_rule(verdict: str, word: str) -> UrlRule:
    """Fits hosts that have ``word`` (or words joined by hyphens) in one of their labels, between dots and hyphens."""
    return UrlRule(f"word {word}", verdict, rf"^(?:[^/]*[.-])?{re.escape(word)}(?:[.-]|/|$)", tuple(re.findall("[a-z0-9]+", word)), listed=False)


def wildcard_rule(verdict: str, pattern: str) -> UrlRule:
    """``*`` stands for any run of characters; the pattern fits host and path as a whole. Its tokens are the literals that no ``*`` touches."""
    parts = pattern.split("*")
    tokens = []
    for k, part in enumerate(parts):
        own = part if k == 0 else re.sub(r"^[A-Za-z0-9]+", "", part)
        own = own if k == len(parts) - 1 else re.sub(r"[A-Za-z0-9]+$", "", own)
        tokens += re.findall("[a-z0-9]+", own.lower())
    return UrlRule(f"pattern {pattern}", verdict, "(?s)^" + ".*".join(map(re.escape, parts)) + "$", tuple(dict.fromkeys(tokens)), listed=False)


MAKERS = {"host": host_rule, "word": word_rule, "wildcard": wildcard_rule}


def load_rules(table: DataFrame, most: int = MOST_RULES) -> tuple[UrlRule, ...]:
    """Rules from a table with the columns kind (host, word or wildcard), verdict and rule, ``most`` rows at most."""
    rows = table.select("kind", "verdict", "rule").distinct()
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rules")
    if not rows.filter("kind IS NULL OR kind NOT IN ('host', 'word', 'wildcard') OR verdict IS NULL OR verdict NOT IN ('allow', 'block') OR rule IS NULL").isEmpty():
        raise ValueError("a rule needs a kind (host, word or wildcard), a verdict (allow or block) and a text")
    return tuple(MAKERS[r.kind](r.verdict, r.rule) for r in rows.orderBy("kind", "rule", "verdict").collect())


LISTED = (
    host_rule("allow", "org/"),
    host_rule("block", "example.org/es/"),
    host_rule("block", "example.org/en/1"),
    host_rule("allow", "com/fr/"),
    host_rule("block", "com/de/"),
)
#: Without a listed rule the verdict comes from these patterns, and is allow where none fits: words that hosts of unwanted pages
#: carry, and paths of logins, carts, trackers and feeds.
WORDS = ("adult", "betting", "bingo", "casino", "cialis", "cracks", "escorts", "gambling", "jackpot", "keygen", "lottery", "payday", "pharmacy", "pills", "poker", "porn", "replica", "roulette", "slots", "spam", "torrents", "viagra", "warez", "xxx")
WILDCARDS = ("*/wp-login.php", "*/wp-admin/*", "*/cgi-bin/*", "*/cart/checkout/*", "*/tracking/pixel.gif", "*/ads/banner/*", "*/feed/rss.xml")
PATTERNS = (*[word_rule("block", w) for w in WORDS], *[wildcard_rule("block", p) for p in WILDCARDS])


def with_parts(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, the joined form that rules see, and its distinct tokens."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    out = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"))
    out = out.withColumn("host", ascii_lower(F.coalesce(F.regexp_extract("url", parts, 1), F.lit(""))))
    out = out.withColumn("path", F.coalesce(F.regexp_extract("url", parts, 2), F.lit("")))
    out = out.withColumn("seen", F.concat("host", "path"))
    return out.withColumn("tokens", F.array_distinct(F.split(F.lower("seen"), "[^a-z0-9]+")))


def rarest_tokens(urls: DataFrame, rules: tuple[UrlRule, ...], inline: int = INLINE_RULES) -> dict[str, list[int]]:
    """token -> rules filed under it. What comes to the driver is one count per token of the rule set.

    Beyond ``inline`` rules their tokens are a table that the urls' tokens are joined with, so the work is that of urls plus rules."""
    names = sorted({t for r in rules for t in r.tokens})
    if len(rules) <= inline:
        used = F.array_intersect("tokens", F.array(*[F.lit(t) for t in names]).cast("array<string>"))
        met = urls.select(F.explode(used).alias("token"))
    else:
        table = urls.sparkSession.createDataFrame(pd.DataFrame({"token": names}), "token string")
        met = urls.select(F.explode("tokens").alias("token")).join(sized(table), "token")
    counts = {r["token"]: r["n"] for r in met.groupBy("token").agg(F.count("*").alias("n")).collect()}
    filed: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        if not rule.tokens:
            raise ValueError(f"rule {rule.rule} has no literal token to be filed under")
        filed.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(i)
    return filed


def _best(cands):
    """The longest fitting rule; of equally long ones the first in order."""
    return F.array_max(F.transform(cands, lambda c: F.struct(c["size"].alias("size"), (-c["i"]).alias("i"), c["rule"].alias("rule"), c["verdict"].alias("verdict"))))


def judge_urls(pages: DataFrame, listed: tuple[UrlRule, ...] = LISTED, patterns: tuple[UrlRule, ...] = PATTERNS, inline: int = INLINE_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, method_rule. Rows keep their partition: no shuffle while the rules fit ``inline``."""
    urls, rules = with_parts(pages), (*listed, *patterns)
    filed = rarest_tokens(urls, rules, inline)
    entry = lambda i: (i, rules[i].pattern, len(rules[i].rule) if rules[i].listed else -1, rules[i].rule, rules[i].verdict)
    if len(rules) <= inline:
        item = lambda i: F.struct(*[F.lit(v).alias(k) for k, v in zip(("i", "pattern", "size", "rule", "verdict"), entry(i))])
        index = F.create_map(*[x for t, ids in filed.items() for x in (F.lit(t), F.array(*[item(i) for i in ids]))])
        keys = F.array(*[F.lit(t) for t in filed])
        cands = F.flatten(F.transform(F.array_intersect("tokens", keys), lambda t: F.element_at(index, t)))
        fits = F.filter(cands, lambda c: F.regexp(F.col("seen"), c["pattern"]))
        judged = urls.withColumn("best", _best(fits))
    else:
        spark = pages.sparkSession
        told = pd.DataFrame([(t, *entry(i)) for t, ids in filed.items() for i in ids], columns=["token", "i", "pattern", "size", "rule", "verdict"])
        rows = stage(spark.createDataFrame(told, "token string, i int, pattern string, size int, rule string, verdict string"), "rules")
        # Each different host and path meets its rules once; a hot one is split by hub_join where its verdict goes back to the rows.
        different = stage(urls.groupBy("seen").agg(F.first("tokens").alias("tokens"), F.count("*").alias("n")), "urls")
        hits = different.select("seen", "n", F.explode("tokens").alias("token")).join(sized(rows), "token").filter(F.regexp("seen", F.col("pattern")))
        best = hits.groupBy("seen").agg(F.max(F.struct("size", (-F.col("i")).alias("i"), "rule", "verdict")).alias("best"), F.max("n").alias("n"))
        best = different.select("seen", "n").join(best.select("seen", "best"), "seen", "left")
        judged = hub_join(urls, best, "seen", different.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    listed_hit = F.col("best")["size"] >= 0
    return judged.select(
        "page_id",
        "host",
        "path",
        F.when(listed_hit, F.col("best")["rule"]).alias("rule"),
        F.coalesce(F.col("best")["verdict"], F.lit("allow")).alias("verdict"),
        F.when(~listed_hit, F.col("best")["rule"]).alias("method_rule"),
    )
