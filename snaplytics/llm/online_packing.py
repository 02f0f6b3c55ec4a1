"""Packing documents into sequences by bounded-space online best fit.

A partition is packed as it is read, with a fixed number of open windows. Full windows are cut off a
document; its tail goes to the open window that it fills best. When none has room and all are
open, the fullest is emitted, filled up with the head of the tail if that is long enough to
be worth a cut, and a new one is opened. What is open at a partition's end goes, with its
ids, to a second step that merges the leftovers of a fixed number of partitions at a time;
there pieces are cut to fill windows completely, and the last rest is cut into lengths that
are powers of two, which need no padding.

Memory is bounded by one batch of texts and the open windows, and no text is shuffled.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplytics.llm.cached_tokens import encoder
from snaplytics.llm.common import stored, text_or_empty

WINDOW = 1_024
OPEN_WINDOWS = 64
MIN_CUT = 16  # shorter rooms are padded rather than filled with a piece of a document
MERGED_PARTITIONS = 8
TEXTS_AT_ONCE = 512
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class Packer:
    """Open windows of one partition. Pieces are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, first_id: int, window: int = WINDOW, open_windows: int = OPEN_WINDOWS):
        self.next_id, self.window, self.limit = first_id, window, open_windows
        self.rooms: list[tuple[int, int]] = []  # (room, window), ascending
        self.open: dict[int, list] = {}
        self.windows = 0
        self.closed: list[tuple] = []

    def _emit(self, pieces: list) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            self.closed.append((doc_id, start, len(ids), crc(ids), doc_tokens, self.next_id, offset, None))
            offset += len(ids)
        self.next_id += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        n = len(ids)
        whole = n - n % self.window
        for start in range(0, whole, self.window):
            self._emit([(doc_id, start, ids[start : start + self.window], n)])
        if whole < n:
            self._place(doc_id, whole, ids[whole:], n)

    def _place(self, doc_id, start: int, ids: np.ndarray, n: int) -> None:
        at = bisect_left(self.rooms, (len(ids), -1))
        if at == len(self.rooms) and len(self.rooms) == self.limit:
            room, fullest = self.rooms.pop(0)
            pieces = self.open.pop(fullest)
            if room >= MIN_CUT:
                pieces.append((doc_id, start, ids[:room], n))
                start, ids = start + room, ids[room:]
            self._emit(pieces)
            at = bisect_left(self.rooms, (len(ids), -1))
        if at == len(self.rooms):
            room, own = self.window, self.windows
            self.windows += 1
            self.open[own] = []
        else:
            room, own = self.rooms.pop(at)
        self.open[own].append((doc_id, start, ids, n))
        if room == len(ids):
            self._emit(self.open.pop(own))
        else:
            insort(self.rooms, (room - len(ids), own))

    def leftovers(self) -> list[tuple]:
        """Pieces of the open windows, fullest first, with their ids and, as offset, their place here."""
        rows = []
        for _, own in self.rooms:
            for doc_id, start, ids, n in self.open[own]:
                rows.append((doc_id, start, len(ids), None, n, None, len(rows), ids.astype("<u4").tobytes()))
        return rows


def _batch(rows: list[tuple], partition: int) -> pa.RecordBatch:
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    arrays = [pa.array([r[i] for r in rows], pa.int64()) for i in range(7)]
    arrays += [pa.array([r[7] for r in rows], pa.binary()), pa.array([partition] * len(rows), pa.int32())]
    return pa.RecordBatch.from_arrays(arrays, [*names, "ids", "partition"])


def _packed(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        partition = TaskContext.get().partitionId()
        packer = Packer(partition << 31)
        end = np.array([end_id], np.uint16)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    packer.add(doc_id, np.concatenate([np.frombuffer(ids, np.uint16), end]))
            yield _batch(packer.closed, partition)
            packer.closed = []
        yield _batch(packer.leftovers(), partition)

    return run


def _merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Leftover pieces of some partitions one after the other: full windows, then powers of two."""
    rows = rows.sort_values(["partition", "offset"])
    sizes = [WINDOW] * (int(rows["length"].sum()) // WINDOW)
    rest = int(rows["length"].sum()) % WINDOW
    sizes += [1 << b for b in reversed(range(WINDOW.bit_length())) if rest >> b & 1]
    out, sequence, offset = [], 0, 0
    first_id = (1 << 62) + (int(key[0]) << 31)
    doc_ids = rows["doc_id"].astype("Int64")
    for doc_id, start, ids, n in zip(doc_ids, rows["start"], rows["ids"], rows["doc_tokens"]):
        ids = np.frombuffer(ids, "<u4")
        while len(ids):
            take = min(len(ids), sizes[sequence] - offset)
            out.append((doc_id, start, take, crc(ids[:take]), n, first_id + sequence, offset))
            ids, start, offset = ids[take:], start + take, offset + take
            if offset == sizes[sequence]:
                sequence, offset = sequence + 1, 0
    frame = pd.DataFrame(out, columns=[f.split()[0] for f in PIECE.split(", ")])
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    return frame


def pack(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Pieces of all rows of ``docs``: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row is encoded whole by the tokenizer file at ``path`` and gets ``end_id``; a null or
    empty text is that id alone. A null doc_id stays null; repeated rows are packed each. An
    empty table gives no rows. Further columns are ignored. Sequences hold at most 1024 ids.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    packed = stored(texts.mapInArrow(_packed(path, end_id), f"{PIECE}, ids binary, partition int"), "pieces")
    closed = packed.filter("sequence_id is not null").select(*[f.split()[0] for f in PIECE.split(", ")])
    left = packed.filter("sequence_id is null").withColumn("part", F.floor(F.col("partition") / MERGED_PARTITIONS).cast("int"))
    return closed.unionByName(left.groupBy("part").applyInPandas(_merge, PIECE))
