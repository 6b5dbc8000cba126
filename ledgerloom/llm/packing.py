"""Packing (operator 10): bounded-space online packing of token ids into windows of fixed size.

Each partition keeps at most `open_windows` windows open. A document is cut into full windows and
a rest. The rest goes to the open window that it fits best; if it fits none and no more may be
opened, its head fills the fullest, which is emitted, and what remains is placed again. Windows
still open at a partition's end are leftovers: a second pass packs their pieces the same way, in
tasks of about `merge_windows` windows, and at its end fills one window after the other, so that
each of these tasks leaves one window unfilled at most."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch, slices
from .word_bpe import SLICE, broadcast_definition, tokenizer_of

FIELDS = "id {0}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class Packer:
    """Windows of one task. Items are (id, start, ids, tokens of the document)."""

    def __init__(self, size: int, most: int, first_sequence: int):
        self.size, self.most, self.next = size, most, first_sequence
        self.slack: list[tuple[int, int]] = []  # (free ids, window), ascending
        self.windows: dict[int, list] = {}
        self.out: list[list] = [[] for _ in range(8)]

    def put(self, window: int, free: int, item) -> None:
        key, start, ids, total = item
        self.windows[window].append((key, start, ids, total, self.size - free))
        if free > len(ids):
            insort(self.slack, (free - len(ids), window))
        else:
            self.emit(window)

    def emit(self, window: int, leftover: bool = False) -> None:
        for key, start, ids, total, offset in self.windows.pop(window):
            for column, value in zip(self.out, (key, start, len(ids), zlib.crc32(ids.astype("<u4")), total, window, offset, ids.astype("<u4").tobytes() if leftover else None), strict=True):
                column.append(value)

    def opened(self) -> int:
        self.next += 1
        self.windows[self.next - 1] = []
        return self.next - 1

    def place(self, key, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.size:
            self.put(self.opened(), self.size, (key, start, ids[: self.size], total))
            start, ids = start + self.size, ids[self.size :]
        while len(ids):
            at = bisect_left(self.slack, (len(ids), -1))
            if at < len(self.slack):
                free, window = self.slack.pop(at)
                return self.put(window, free, (key, start, ids, total))
            if len(self.slack) < self.most:
                return self.put(self.opened(), self.size, (key, start, ids, total))
            free, window = self.slack.pop(0)
            self.put(window, free, (key, start, ids[:free], total))
            start, ids = start + free, ids[free:]

    def close(self, leftover: bool) -> None:
        left = [w for _, w in self.slack]
        self.slack = []
        if leftover:
            for w in left:
                self.emit(w, True)
            return
        items = [p for w in left for p in self.windows.pop(w)]
        self.most = 0
        window, free = None, 0
        for key, start, ids, total, _ in items:
            while len(ids):
                if window is None:
                    window, free = self.opened(), self.size
                n = min(free, len(ids))
                self.windows[window].append((key, start, ids[:n], total, self.size - free))
                start, ids, free = start + n, ids[n:], free - n
                if not free:
                    self.emit(window)
                    window = None
        if window is not None:
            self.emit(window)

    def rows(self, id_type) -> pa.RecordBatch:
        kinds = [id_type, *[pa.int64()] * 6, pa.binary()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(self.out, kinds, strict=True)], names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
        self.out = [[] for _ in range(8)]
        return batch


def first_sequence(level: int) -> int:
    """Sequences are numbered by pass and task, without gaps to be agreed on."""
    return level << 61 | TaskContext.get().partitionId() << 33


def pack(docs: DataFrame, tokenizer_file: str, end_id: int, size: int = 2048, open_windows: int = 64, merge_windows: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null or
    empty text is its end id alone. Rows that repeat an id are documents of their own; null ids
    stay null. Other columns are ignored, whatever their names; an empty table gives no piece."""
    scratch = Scratch(docs.sparkSession)
    shared = broadcast_definition(docs.sparkSession, tokenizer_file)
    id_type = docs.schema[id_col].dataType.simpleString()

    def online(batches):
        packer, kind = Packer(size, open_windows, first_sequence(0)), None
        for b in slices(batches, 1, SLICE):
            kind = b.column(0).type
            ids, sizes = tokenizer_of(shared).ids(b.column(1), end_id)
            at = 0
            for key, n in zip(b.column(0).to_pylist(), sizes.tolist(), strict=True):
                packer.place(key, 0, ids[at : at + n], n)
                at += n
            for window in packer.windows.values():  # the slice's ids can go
                window[:] = [(k, s, i.copy() if i.base is not None else i, t, o) for k, s, i, t, o in window]
            yield packer.rows(kind)
        packer.close(True)
        if kind is not None:
            yield packer.rows(kind)

    def merge(batches):
        packer, kind = Packer(size, open_windows, first_sequence(1)), None
        for b in batches:
            kind = b.column(0).type
            for key, start, total, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 4, 7)), strict=True):
                packer.place(key, start, np.frombuffer(ids, "<u4"), total)
            yield packer.rows(kind)
        packer.close(False)
        if kind is not None:
            yield packer.rows(kind)

    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    fields = FIELDS.format(id_type)
    packed = scratch.write(texts.mapInArrow(online, fields), "packed")
    left = packed.where("ids is not null")
    tasks = max(1, left.select("sequence_id").distinct().count() // merge_windows)
    # Whole first-pass tasks go to one merging task, so the sort makes a repeated task place the same.
    task = F.shiftright("sequence_id", 33)
    merged = left.repartition(tasks, task).sortWithinPartitions("sequence_id", "offset").mapInArrow(merge, fields)
    return packed.where("ids is null").unionByName(merged).drop("ids").withColumnRenamed("id", id_col)
