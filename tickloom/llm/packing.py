"""Bounded-space online packing of token sequences."""

from __future__ import annotations

import os
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import slices, stage, worker_state
from tickloom.llm.wordbpe import WordTable

#: Sequences that a partition keeps open at once.
OPEN = 64
#: Partitions whose leftovers meet in one task of a merging round.
FAN_IN = 32
#: Bytes of text tokenized at once.
BATCH_BYTES = 4 << 20

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class OpenWindows:
    """A fixed number of open windows; a piece goes to the fullest window that still holds it.

    If none holds it and no further window may be opened, the fullest window is filled up with the
    head of the piece and emitted, and the tail is placed again.
    """

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.free: list[tuple[int, int]] = []  # (room, window), sorted
        self.held: dict[int, list[tuple]] = {}
        self.n = 0

    def place(self, piece: tuple) -> Iterator[list[tuple]]:
        """Take ``(doc, start, ids, doc_tokens)``; yield windows that are full."""
        doc, start, ids, total = piece
        while len(ids):
            k = bisect_left(self.free, (len(ids), -1))
            if k < len(self.free):  # best fit
                room, w = self.free.pop(k)
                take = len(ids)
            elif len(self.free) < self.most:
                room, w = self.size, self.n
                self.n += 1
                self.held[w] = []
                take = min(len(ids), room)
            else:  # the fullest
                room, w = self.free.pop(0)
                take = room
            self.held[w].append((doc, start, ids[:take], total))
            start, ids = start + take, ids[take:]
            if room > take:
                insort(self.free, (room - take, w))
            else:
                yield self.held.pop(w)

    def rest(self) -> list[list[tuple]]:
        return [self.held[w] for _, w in self.free]


def _batch(windows: list[tuple[int, list[tuple]]], extra: dict | None = None) -> pa.RecordBatch:
    """Rows of numbered windows."""
    doc, start, length, ids, total, seq, off = [], [], [], [], [], [], []
    for number, window in windows:
        at = 0
        for d, s, x, n in window:
            doc.append(d), start.append(s), length.append(len(x)), ids.append(x.tobytes()), total.append(n), seq.append(number), off.append(at)
            at += len(x)
    arrays = [pa.array(v, pa.int64()) for v in (doc, start, length)] + [pa.array(ids, pa.binary())] + [pa.array(v, pa.int64()) for v in (total, seq, off)]
    names = [f.split()[0] for f in PIECES.split(", ")]
    for k, v in (extra or {}).items():
        arrays.append(pa.array([v] * len(doc), pa.int64()))
        names.append(k)
    return pa.RecordBatch.from_arrays(arrays, names=names)


def pack(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 4096,
    end_id: int = 2,
    open_windows: int = OPEN,
) -> DataFrame:
    """Pieces of documents in sequences of at most ``size`` tokens.

    A document is its tokens and ``end_id``. Each partition tokenizes its texts once and packs them
    online into ``open_windows`` windows (best fit; if none fits, the fullest is filled up, emitted
    and replaced). What is open at the end joins the leftovers of other partitions: rounds of FAN_IN
    open sets per task, packed in the same way, until one set is left. Only its windows are
    not full, so padding does not grow with the input.

    Result, one row per piece: ``doc_id``, ``start`` (the document's tokens before the piece),
    ``length``, ``ids`` (binary, little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id``,
    ``offset``. Null and empty texts have one token, ``end_id``. Repeated rows and null ids are
    packed like others; very long texts are cut; an empty table gives an empty result; other
    columns are not looked at. Sequence numbers are unique, not gapless.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        table = worker_state(f"packing {path}", lambda: WordTable(path))
        part = TaskContext.get().partitionId()
        windows, number = OpenWindows(size, open_windows), part << 32
        for b in slices(batches, "text", BATCH_BYTES):
            full = []
            for doc, ids in zip(b.column("id").to_pylist(), table.encode(b.column("text")), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for w in windows.place((doc, 0, ids, len(ids))):
                    full.append((number, w))
                    number += 1
            yield _batch(full, {"open": -1})
        for w in windows.rest():
            yield _batch([(number, w)], {"open": part})
            number += 1

    done, _ = stage(src.mapInArrow(online, PIECES + ", open long"), "pack-online")
    results = [done.where("open < 0").drop("open")]
    left = done.where("open >= 0")
    sets = sorted(r.open for r in left.select("open").distinct().collect())  # one number per partition
    turn = 0
    while sets:
        turn += 1
        last = len(sets) <= FAN_IN
        table, _ = stage(_merge(left, sets, size, open_windows, turn, last), f"pack-merge{turn}")
        results.append(table.where("open < 0").drop("open"))
        left = table.where("open >= 0")
        sets = [] if last else list(range(-(-len(sets) // FAN_IN)))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.select(F.col("doc_id").alias(id_col), *[c for c in out.columns if c != "doc_id"])


def _merge(left: DataFrame, sets: list[int], size: int, most: int, turn: int, last: bool) -> DataFrame:
    """Pack the leftovers of FAN_IN open sets per task."""
    ranks = left.sparkSession.createDataFrame([(s, i // FAN_IN) for i, s in enumerate(sets)], "open long, grp long")

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        grp = key[0].as_py()
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        windows: dict[int, list[tuple]] = {}
        for r in table.select(["sequence_id", "doc_id", "start", "ids", "doc_tokens"]).to_pylist():
            windows.setdefault(r["sequence_id"], []).append((r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"]))
        # Largest first; all pieces of a window are placed anew.
        todo = sorted((p for w in windows.values() for p in w), key=lambda p: -len(p[2]))
        number = turn << 56 | grp << 32
        pack_into, full = OpenWindows(size, most), []
        for piece in todo:
            for w in pack_into.place(piece):
                full.append((number, w))
                number += 1
        rest = list(enumerate(pack_into.rest(), number))
        return pa.Table.from_batches([_batch(full, {"open": -1}), _batch(rest, {"open": -1 if last else grp})])

    return left.join(F.broadcast(ranks), "open").drop("open").groupBy("grp").applyInArrow(merge, PIECES + ", open long")

