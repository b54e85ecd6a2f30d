"""Ranked lexical search over impact lists by the Best Position Algorithm.

One pass over whole texts counts the terms that the queries ask for; documents' lengths and terms' document counts give integer weights. The
counts are written once, and tasks read them back in shards of at most SHARD_POSTINGS: no shuffle, and a shard bounds what a task holds. In a
shard, each term has a list by impact and the same list by document. A query reads its lists from the top in parallel; a document that is met for the
first time is looked up in all other lists, which gives its full score and its position in each. Positions seen from the top without a gap bound
what any document not yet seen can score, by the impacts at the first gaps. Reading stops once that bound lies strictly below the k-th
score: equal scores are decided by doc_id, so at equality it goes on. Each shard's k best meet in a ranking that Spark limits before it shuffles.

Queries are handled in blocks of about BLOCK_TERMS terms, so what is sent to tasks doesn't grow with the number of queries; a further block
reads the texts again.

Nulls and odd input: null texts have no terms; a row without doc_id is ranked after others of its score; rows that repeat a doc_id are
ranked each; a null or repeated item_id is a query of its own; queries or tables without terms give no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batched, small_batches, stage

TOP = 20
#: Terms of queries that one pass over the texts takes; postings that a task holds at once.
BLOCK_TERMS, SHARD_POSTINGS = 200_000, 4_000_000
#: Entries that a query first reads of each list at once; twice as many each time.
FIRST_STEP = 64

_KEPT = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(0x80, 0x100))
_FOLD = bytes(c if c in _KEPT else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and anything beyond ASCII; only A-Z are lower-cased."""
    return (text or b"").translate(_FOLD).split()


def query_terms(items: DataFrame) -> DataFrame:
    """query, item_id, term, times: of each row of ``items``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for query, item, text in zip(b.column(0), b.column(1), b.column(2), strict=True):
                own = Counter(terms(text.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([query.as_py()] * len(own), pa.int64()), pa.array([item.as_py()] * len(own), pa.int64()), pa.array(list(own), pa.binary()), pa.array(own.values(), pa.int64())], ["query", "item_id", "term", "times"])

    own = items.select(F.monotonically_increasing_id(), F.col("item_id").cast("long"), F.col("text").cast("string").cast("binary"))
    with batched(items.sparkSession):
        return stage(own.mapInArrow(run, "query long, item_id long, term binary, times long"), "query-terms")


def counted(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """number, doc_id, n (terms of the text, at least one), terms, times: the places in ``known`` that the text holds, and how often."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = sent.value
        for b in batches:
            rows = []
            for number, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                own = terms(text.as_py())
                if own:
                    held = Counter(map(place.get, own))
                    held.pop(None, None)
                    rows.append((number, doc, len(own), list(held), list(held.values())))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["number", "doc_id", "n", "terms", "times"])

    own = docs.select(F.monotonically_increasing_id(), F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    with batched(docs.sparkSession):
        return stage(own.mapInArrow(run, "number long, doc_id long, n long, terms array<int>, times array<long>"), "term-counts")


class Shard:
    """Impact lists of some documents. ``by_doc`` holds them list after list in order of documents, ``ranked`` by impact."""

    def __init__(self, lengths: np.ndarray, held: np.ndarray, term: np.ndarray, times: np.ndarray, documents: int, total: int):
        weight = 75 + (25 * lengths * documents) // total
        doc = np.repeat(np.arange(len(lengths), dtype=np.int32), held)
        impact = (1_000_000_000 * times) // (1000 * times + 12 * weight[doc])
        by_term = np.argsort(term, kind="stable")
        self.doc, self.impact = doc[by_term], impact[by_term]
        self.names, self.starts = np.unique(term[by_term], return_index=True)
        self.ends = np.r_[self.starts[1:], len(term)]
        ranked = np.lexsort((-self.impact, term[by_term]))
        self.ranked_doc, self.ranked_impact = self.doc[ranked], self.impact[ranked]
        self.position = np.empty(len(term), np.int64)  # of each entry of by_doc in ranked
        self.position[ranked] = np.arange(len(term))
        self.seen = np.zeros(len(term), bool)  # positions of ranked
        self.met = np.zeros(len(lengths), bool)
        self.score = np.zeros(len(lengths), np.int64)

    def search(self, wanted: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents that may be among the k best and their scores; the entries read in order. wanted: terms; weights: of each, repeats included."""
        at = np.searchsorted(self.names, wanted)
        there = (at < len(self.names)) & (self.names[np.minimum(at, len(self.names) - 1)] == wanted) & (weights > 0)
        lists = [(int(self.starts[i]), int(self.ends[i]), int(w)) for i, w in zip(at[there], weights[there], strict=True)]
        best = [a for a, _, _ in lists]  # the first position of each list not seen yet
        found, depth, step, read = [], 0, FIRST_STEP, 0
        least = -1
        while lists:
            new = []
            for a, z, _ in lists:
                if a + depth < z:
                    part = self.ranked_doc[a + depth : min(z, a + depth + step)]
                    read += len(part)
                    fresh = part[~self.met[part]]
                    self.met[fresh] = True
                    new.append(fresh)
            depth, step = depth + step, 2 * step
            docs = np.sort(np.concatenate(new)) if new else np.empty(0, np.int32)
            bound = 0
            for j, (a, z, w) in enumerate(lists):
                if len(docs):
                    own = self.doc[a:z]
                    place = np.minimum(np.searchsorted(own, docs), z - a - 1)
                    hit = own[place] == docs
                    place = place[hit] + a
                    self.score[docs[hit]] += w * self.impact[place]
                    self.seen[self.position[place]] = True
                while best[j] < z:
                    gap = int(np.argmin(self.seen[best[j] : min(z, best[j] + 4096)]))
                    if not self.seen[best[j] + gap]:
                        best[j] += gap
                        break
                    best[j] = min(z, best[j] + 4096)
                if best[j] < z:
                    bound += w * int(self.ranked_impact[best[j]])
            found.append(docs)
            if sum(map(len, found)) >= k:
                own = self.score[np.concatenate(found)]
                least = int(np.partition(own, len(own) - k)[len(own) - k])
            if least > bound or all(b >= z for b, (_, z, _) in zip(best, lists, strict=True)):
                break
        docs = np.concatenate(found) if found else np.empty(0, np.int32)
        scores = self.score[docs]
        self.met[docs], self.score[docs] = False, 0
        for a, z, _ in lists:
            self.seen[a:z] = False
        keep = scores >= max(1, least)
        return docs[keep], scores[keep], read


def _search(queries: list[tuple[int, np.ndarray, np.ndarray]], documents: int, total: int, k: int, most: int):
    """Over rows of ``counted``: each shard's best documents of each query."""

    def settle(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(parts).combine_chunks()
        column = {c: whole[c].combine_chunks() for c in ("number", "n", "terms", "times")}
        ids = whole["doc_id"].to_pylist()
        numbers, lengths, held = column["number"].to_numpy(), column["n"].to_numpy(), np.diff(column["terms"].offsets.to_numpy())
        shard = Shard(lengths, held, column["terms"].flatten().to_numpy(), column["times"].flatten().to_numpy(), documents, total)
        for query, wanted, weights in queries:
            docs, scores, read = shard.search(wanted, weights, k)
            if len(docs):
                # Of equal scores at the end, those of the smallest ids; all that tie are kept by rank below.
                order = sorted(range(len(docs)), key=lambda i: (-int(scores[i]), ids[docs[i]] is None, ids[docs[i]] or 0, int(numbers[docs[i]])))[:k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([query] * len(order), pa.int64()), pa.array([ids[docs[i]] for i in order], pa.int64()), pa.array(numbers[docs[order]]), pa.array(scores[order]), pa.array([read] * len(order), pa.int64())],
                    ["query", "doc_id", "number", "score", "n_read"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for b in batches:
            if parts and size + len(b.column(3).flatten()) > most:
                yield from settle(parts)
                parts, size = [], 0
            parts.append(b)
            size += len(b.column(3).flatten())
        if size:
            yield from settle(parts)

    return run


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """item_id, rank, doc_id, score, n_read (entries that the document's shard read for the query): the k best of each item, scores above 0."""
    spark = docs.sparkSession
    asked = query_terms(items)
    blocks = max(1, math.ceil(asked.count() / block_terms))
    found = []
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block)
        known = {bytes(r.term): i for i, r in enumerate(rows.select("term").distinct().sort("term").collect())}
        counts = counted(docs, known)
        documents, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        holding = dict(counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
        weight = np.zeros(len(known), np.int64)
        for term, df in holding.items():
            weight[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
        of: dict[int, list[tuple[int, int]]] = {}
        for r in rows.select("query", "term", "times").toLocalIterator():
            of.setdefault(r.query, []).append((known[bytes(r.term)], r.times))
        queries = []
        for query, own in sorted(of.items()):
            wanted = np.array(sorted(own), np.int64)
            queries.append((query, wanted[:, 0], wanted[:, 1] * weight[wanted[:, 0]]))
        if total:
            small_batches(spark, 4096)
            found.append(stage(counts.mapInArrow(_search(queries, documents, total, k, shard_postings), "query long, doc_id long, number long, score long, n_read long"), "best-of-shards"))
    names = asked.groupBy("query").agg(F.first("item_id").alias("item_id"))
    if not found:
        return names.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"), F.lit(0).cast("long").alias("n_read")).limit(0)
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "number")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(names, "query").select("item_id", "rank", "doc_id", "score", "n_read")
