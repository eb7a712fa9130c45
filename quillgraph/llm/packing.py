"""Bounded-space online packing of documents into sequences of a fixed token budget.

Each task encodes whole documents (ids, then the end id) and places them online. A piece
goes to the open window it fills best; where none has room, the fullest open window is
topped up with the piece's head and emitted full, and the tail is placed next. Tokens of
a document that fill whole windows are emitted at once. A fixed number of windows is open
per task, so memory holds that many sequences besides one document.

What is left open at the end of a task (at most ``open_windows`` sequences) is merged by
the same placement in groups of tasks: a group holds a fixed number of tasks, so a merge
task's input is bounded whatever the table's size; each leaves one short sequence.

Null texts count as empty (the end id alone). Repeated rows and repeated doc_ids are packed each in
its own pieces. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import byte_bpe
from ._shared import Scratch, small_batches

WINDOW, OPEN_WINDOWS, END_ID = 2048, 16, 1
#: Tasks whose leftovers one merge task takes.
MERGE_TASKS = 64
_ALL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, leftover boolean, grp long, ids binary"
_TYPES = [pa.int64()] * 7 + [pa.bool_(), pa.int64(), pa.binary()]
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "leftover", "grp", "ids"]


class Packer:
    """Places pieces (doc_id, start, ids, doc_tokens) and hands out full sequences."""

    def __init__(self, size: int, windows: int):
        self.size, self.windows = size, windows
        self.open: list[list] = []  # [used, pieces]
        self.full: list[list[tuple]] = []

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.size:
            self.full.append([(doc, start, ids[: self.size], total)])
            start, ids = start + self.size, ids[self.size :]
        while len(ids):
            fits = [w for w in self.open if w[0] + len(ids) <= self.size]
            if fits:
                self._put(max(fits, key=lambda w: w[0]), doc, start, ids, total)
                return
            if len(self.open) < self.windows:
                self.open.append([0, []])
                continue
            fullest = max(self.open, key=lambda w: w[0])
            room = self.size - fullest[0]
            self._put(fullest, doc, start, ids[:room], total)
            start, ids = start + room, ids[room:]

    def _put(self, window, doc, start, ids, total) -> None:
        window[1].append((doc, start, ids, total))
        window[0] += len(ids)
        if window[0] == self.size:
            self.full.append(window[1])
            self.open.remove(window)

    def take_full(self):
        out, self.full = self.full, []
        return out


def _rows(sequences, first_id: int, leftover: bool, grp: int, keep_ids: bool):
    cols = [[] for _ in _NAMES]
    for n, pieces in enumerate(sequences):
        at = 0
        for doc, start, ids, total in pieces:
            raw = ids.astype("<u4").tobytes()
            for c, v in zip(cols, (doc, start, len(ids), zlib.crc32(raw), total, first_id + n, at, leftover, grp, raw if keep_ids else None)):
                c.append(v)
            at += len(ids)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], _NAMES)


def _pack_task(size: int, windows: int, end_id: int, keep_ids: bool):
    def run(batches):
        task = TaskContext.get().partitionId()
        packer, made = Packer(size, windows), task << 36
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.append(byte_bpe.encode(text or ""), np.uint32(end_id))
                packer.add(doc, 0, ids, len(ids))
            full = packer.take_full()
            if full:
                yield _rows(full, made, False, 0, keep_ids)
                made += len(full)
        left = [w[1] for w in packer.open]
        if left:
            yield _rows(left, made, True, task // MERGE_TASKS, True)

    return run


def _merge(size: int, keep_ids: bool):
    def run(tbl: pa.Table) -> pa.Table:
        tbl = tbl.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        c = {n: tbl.column(n).to_pylist() for n in _NAMES}
        # One open window: every sequence but the last is filled to the brim.
        packer = Packer(size, 1)
        for i in range(tbl.num_rows):
            packer.add(c["doc_id"][i], c["start"][i], np.frombuffer(c["ids"][i], "<u4"), c["doc_tokens"][i])
        done = packer.take_full() + [w[1] for w in packer.open]
        first = (1 << 62) + (c["grp"][0] << 28)
        return pa.Table.from_batches([_rows(done, first, False, 0, keep_ids)])

    return run


def pack(docs: DataFrame, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces with their place in a sequence; with ``keep_ids`` their ids as well
    (little-endian unsigned 32-bit)."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "packing")
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _pack_task(window, open_windows, end_id, keep_ids), _ALL
    )
    placed = scratch.keep(scratch.write(placed, "placed"))
    merged = placed.filter("leftover").groupBy("grp").applyInArrow(_merge(window, keep_ids), _ALL)
    cols = _NAMES[:7] + (["ids"] if keep_ids else [])
    return placed.filter("NOT leftover").select(cols).unionByName(merged.select(cols))
