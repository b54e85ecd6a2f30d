"""Quality rules as a bitmask ledger.

Each rule is evaluated once per document; the ledger keeps the measurements and one failure bit per rule.
Policies are versioned masks over these bits, so that a new policy, or a rule's ablation, is bitwise
arithmetic on the ledger and never touches the texts again.

Nulls and odd input: a null or empty text has no words and fails the length rule; a null doc_id passes
through as a row of its own; repeated rows give repeated ledger rows; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SYMBOLS = tuple(bytes([c]) for c in b"#*$%&|<>")


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL predicate over the ledger's measurements."""

    name: str
    bit: int
    fails: str


RULES = (
    Rule("too_short", 0, "n_words < 50"),
    Rule("repeated_words", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbol_heavy", 2, "10 * n_symbols > n_words"),
    Rule("repeated_lines", 3, "5 * n_dup_lines > 3 * n_lines"),
    Rule("word_length", 4, "word_chars > 20 * n_words OR word_chars < 2 * n_words"),
    Rule("shouting", 5, "5 * n_upper > 2 * word_chars"),
)

#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base": ("too_short", "repeated_words"),
    "v1": ("too_short", "repeated_words", "symbol_heavy", "repeated_lines"),
    "v2": ("too_short", "repeated_words", "symbol_heavy", "repeated_lines", "word_length", "shouting"),
}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
_UPPER = bytes(range(65, 91))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more, its first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    code: dict[bytes, int] = {}
    put = code.setdefault
    a = np.array([put(w, len(code)) for w in words], np.int64)
    v = len(code)
    if v == n:
        return 0
    pairs = a[:-2] * v + a[1:-1]
    if v > 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, inverse, counts = np.unique(pairs * v + a[2:], return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : n - 2 + k] |= twice
    return int(hit.sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """The measurements of one UTF-8 text, in the order of MEASURES."""
    text = text or b""
    words = text.split()
    spaces = len(text) - sum(map(len, words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text.decode("utf-8", "replace")) - spaces,
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(text) - len(text.translate(None, _UPPER)),
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(x.as_py()) for x in batch.column(1)]
        columns = [pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * len(MEASURES))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *MEASURES])


def rule_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits + F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0))
    return bits


def mask(policy: str, rules: tuple[Rule, ...] = RULES) -> int:
    names = POLICIES[policy]
    return sum(1 << r.bit for r in rules if r.name in names)


def rule_ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measurements and ``fail_bits``: one pass over whole texts, no shuffle."""
    small_batches(docs.sparkSession)
    narrow = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    schema = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
    return narrow.select(F.col("doc_id").cast("long"), "text").mapInArrow(_measured, schema).withColumn("fail_bits", rule_bits(rules))


def apply_policy(ledger: DataFrame, policy: str = "v2") -> DataFrame:
    """Adds ``base_failed`` and ``kept`` (policy's mask hits no failure bit) to a ledger."""
    failed = lambda p: F.col("fail_bits").bitwiseAND(F.lit(mask(p))) != 0
    return ledger.withColumn("base_failed", failed("base")).withColumn("kept", ~failed("base") & ~failed(policy))


def ablation(ledger: DataFrame, policy: str = "v2", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of the policy: failures, failures by it alone, and documents kept without it.

    The ledger is first folded to counts by failure pattern, of which there are 2 ** len(rules) at most."""
    full = mask(policy, rules)
    patterns = ledger.groupBy(F.col("fail_bits").bitwiseAND(F.lit(full)).alias("bits")).agg(F.count("*").alias("n"))
    one = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("one")) for r in rules if full >> r.bit & 1])
    each = patterns.select("bits", "n", F.explode(one).alias("r")).select("bits", "n", "r.rule", "r.one")
    has = F.col("bits").bitwiseAND(F.col("one")) != 0
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("rule").agg(
        total(has).alias("failed"),
        total(F.col("bits") == F.col("one")).alias("failed_alone"),
        total((F.col("bits") == 0) | (F.col("bits") == F.col("one"))).alias("kept_without"),
    )


def failure_profile(ledger: DataFrame, by: str) -> DataFrame:
    """Rules that some row (``any_bits``) and that every row (``all_bits``) of a group fails."""
    return ledger.groupBy(by).agg(F.bit_or("fail_bits").alias("any_bits"), F.bit_and("fail_bits").alias("all_bits"), F.count("*").alias("n"))
