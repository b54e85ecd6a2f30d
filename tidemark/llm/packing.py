"""Bounded-space online packing of token ids into sequences.

Each task keeps a fixed number of open windows. Full lengths of a document leave at once; its tail goes where it fits
best; if it fits nowhere and no window may be opened, the fullest window is filled with the tail's head and emitted. What is open at the
end of a task is merged in a second pass over bounded groups of tasks. The last sequence of such a group is cut at powers of two, which
need no padding.

Nulls and odd input: a null text counts as empty and packs its end id alone; a null doc_id is carried; rows that repeat a
doc_id are packed each; an empty table gives no sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, stage
from .tokenize import encoder

LENGTH, WINDOWS, TASKS_PER_MERGE = 1024, 32, 64
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [x.split()[0] for x in PIECE.split(", ")]
#: Sequences of the second pass are numbered from here.
MERGED = 1 << 62


class Packer:
    """Online best-fit with ``windows`` open windows; ``out`` gets the pieces of sequences that are emitted."""

    def __init__(self, length: int, windows: int, first_id: int):
        self.length, self.windows, self.next_id = length, windows, first_id
        self.open: list[list] = []
        self.free: list[int] = []
        self.out: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next_id, at))
            at += len(ids)
        self.next_id += 1

    def _close(self, k: int) -> None:
        self.emit(self.open.pop(k))
        self.free.pop(k)

    def _put(self, k: int, piece: tuple) -> None:
        self.open[k].append(piece)
        self.free[k] -= len(piece[2])
        if not self.free[k]:
            self._close(k)

    def add(self, doc, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.length:
            self.emit([(doc, start, ids[start : start + self.length], total)])
            start += self.length
        while start < total:
            need = total - start
            fits = [(f, k) for k, f in enumerate(self.free) if f >= need]
            if fits:
                self._put(min(fits)[1], (doc, start, ids[start:], total))
                return
            if len(self.open) < self.windows:
                self.open.append([(doc, start, ids[start:], total)])
                self.free.append(self.length - need)
                return
            room = min(self.free)
            self._put(self.free.index(room), (doc, start, ids[start : start + room], total))
            start += room


def _table(rows: list[tuple], held: list[tuple]) -> pa.RecordBatch:
    """Finished pieces, and pieces of windows that are still open with their ids."""
    every = [*((*r, None, None) for r in rows), *held]
    kinds = [pa.int64()] * len(_NAMES) + [pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*every) if every else [[]] * len(kinds), kinds)], [*_NAMES, "task", "ids"])


def _pack(tokenizer: str, end_id: int, length: int, windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(tokenizer), TaskContext.get().partitionId()
        end, packer = np.array([end_id], enc.dtype), Packer(length, windows, task << 32)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc, np.concatenate([enc.encode(text.as_py() or ""), end]))
            yield _table(packer.out, [])
            packer.out = []
        held = [(doc, start, len(ids), None, total, k, None, task, ids.astype("<u4").tobytes()) for k, w in enumerate(packer.open) for doc, start, ids, total in w]
        yield _table([], held)

    return run


def _merge(length: int):
    def run(key: tuple[pa.Scalar], rows: pa.Table) -> pa.Table:
        """Pieces one after another, cut at ``length``; of the rest, the largest power of two again and again."""
        packer = Packer(length, 1, MERGED | key[0].as_py() << 32)
        rows = rows.sort_by([("task", "ascending"), ("window", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        pieces, held = [], 0
        for doc, start, total, ids in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))):
            got = np.frombuffer(ids, "<u4")
            while held + len(got) >= length:
                cut = length - held
                packer.emit([*pieces, (doc, start, got[:cut], total)])
                pieces, held, start, got = [], 0, start + cut, got[cut:]
            if len(got):
                pieces.append((doc, start, got, total))
                held += len(got)
        while pieces:
            room, take = 1 << (held.bit_length() - 1), []
            held -= room
            while room:
                doc, start, got, total = pieces.pop(0)
                take.append((doc, start, got[:room], total))
                if len(got) > room:
                    pieces.insert(0, (doc, start + room, got[room:], total))
                room -= min(room, len(got))
            packer.emit(take)
        return pa.Table.from_batches([_table(packer.out, [])]).select(_NAMES)

    return run


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, length: int = LENGTH, windows: int = WINDOWS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Texts never shuffle."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    with batched(docs.sparkSession):
        first = stage(rows.mapInArrow(_pack(tokenizer, end_id, length, windows), f"{PIECE}, task int, ids binary"), "packed")
    done = first.filter("task IS NULL").select(*_NAMES)
    held = first.filter("task IS NOT NULL").withColumn("merge", F.floor(F.col("task") / TASKS_PER_MERGE).cast("long"))
    held = held.select("merge", "task", F.col("sequence_id").alias("window"), "doc_id", "start", "doc_tokens", "ids")
    return done.unionByName(held.groupBy("merge").applyInArrow(_merge(length), PIECE))
