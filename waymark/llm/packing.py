"""Packing documents into fixed token windows with bounded memory.

Each task keeps at most `open_windows` unfinished windows. A document's whole windows leave at
once; its remainder goes where it fits best. When it fits nowhere and no window may be opened,
the fullest window takes what it has room for and leaves full, and the rest is placed anew.
What is open at a task's end (at most `open_windows` windows) meets the leftovers of other
tasks in rounds of `MERGED_TASKS` tasks each until one round holds all; its end is cut
into power-of-two sequences, so no sequence is padded at all.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.shared import small_batches, table, written
from waymark.llm.tokens import shared_encoder, text_list

WINDOW = 2048
OPEN_WINDOWS = 32
MERGED_TASKS = 32
END_ID = 1
# A sequence id is round, group and running number: 6, 27 and 30 bits.
GROUP_BITS, COUNT_BITS = 27, 30
PIECES = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
    "ids binary, task long, open boolean"
)


class Packer:
    """Places pieces of documents; finished sequences gather in `rows`."""

    def __init__(self, window: int, open_windows: int, base: int) -> None:
        self.window, self.limit, self.base = window, open_windows, base
        self.made = 0
        self.rows: list[tuple] = []
        self._gaps: list[tuple[int, int]] = []  # (room left, window) in order
        self._held: dict[int, list[tuple]] = {}

    def _next(self) -> int:
        self.made += 1
        return self.base + self.made

    def _emit(self, number: int, pieces: list[tuple], unfinished: bool = False) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append(
                (doc_id, start, len(ids), total, number, offset, ids.tobytes(), unfinished)
            )
            offset += len(ids)

    def add(self, doc_id, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.window:
            self._emit(self._next(), [(doc_id, start, ids[: self.window], total)])
            start, ids = start + self.window, ids[self.window :]
        while len(ids):
            at = bisect_left(self._gaps, (len(ids), -1))
            if at < len(self._gaps):
                gap, number = self._gaps.pop(at)
            elif len(self._gaps) < self.limit:
                gap, number = self.window, self._next()
                self._held[number] = []
            else:
                gap, number = self._gaps.pop(0)
            part, ids = ids[:gap], ids[gap:]
            self._held[number].append((doc_id, start, part, total))
            start += len(part)
            if len(part) < gap:
                insort(self._gaps, (gap - len(part), number))
            else:
                self._emit(number, self._held.pop(number))

    def leave(self) -> None:
        """Hand over the unfinished windows."""
        for number, pieces in self._held.items():
            self._emit(number, pieces, unfinished=True)
        self._held, self._gaps = {}, []

    def close(self) -> None:
        """Fill windows from what is open; cut the last one into powers of two."""
        pieces = [p for held in self._held.values() for p in held]
        self._held, self._gaps = {}, []
        left = sum(len(p[2]) for p in pieces)
        filled, room = [], 0
        for doc_id, start, ids, total in pieces:
            while len(ids):
                if not room:
                    if filled:
                        self._emit(self._next(), filled)
                    room = self.window if left >= self.window else 1 << (left.bit_length() - 1)
                    left -= room
                    filled = []
                filled.append((doc_id, start, ids[:room], total))
                start, ids, room = start + len(ids[:room]), ids[room:], room - len(ids[:room])
        if filled:
            self._emit(self._next(), filled)

    def frame(self, task: int) -> pd.DataFrame:
        names = "doc_id start length doc_tokens sequence_id offset ids open".split()
        out = pd.DataFrame(self.rows, columns=names)
        out["doc_id"] = out["doc_id"].astype("Int64")
        out["task"] = task
        self.rows = []
        return out[[*names[:-1], "task", "open"]]


def _base(round_number: int, group: int) -> int:
    return (round_number << (GROUP_BITS + COUNT_BITS)) | (group << COUNT_BITS)


def pack_documents(
    docs: DataFrame,
    vocabulary: str | None = None,
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces of the documents' token sequences, packed into windows.

    `docs` has `doc_id` and `text`; other columns are ignored, whatever their names. A null or
    empty text is its end id alone; null and repeated doc ids are packed row by row; an empty
    table gives no rows. Returns `doc_id, start, length, doc_tokens, sequence_id, offset, ids`,
    ids as little-endian unsigned 32-bit integers. Every sequence is `window` long but for
    at most one of each smaller power of two. The pieces are written to the shared folder once.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    spark = docs.sparkSession
    small_batches(spark)

    def by_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        encoder = shared_encoder(vocabulary)
        packer = Packer(window, open_windows, _base(0, task))
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            ids = encoder.encode(text_list(batch["text"]))
            for doc_id, own in zip(batch["doc_id"].astype("Int64"), ids):
                packer.add(doc_id, 0, np.concatenate([own, end]), len(own) + 1)
            yield packer.frame(task)
        packer.leave()
        yield packer.frame(task)

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    packed = written(read.mapInPandas(by_task, PIECES), "packed")
    finished = packed.where(~F.col("open"))
    tasks = (packed.where("open").agg(F.max("task")).first()[0] or 0) + 1
    round_number = 0
    while True:
        round_number += 1
        last = tasks <= MERGED_TASKS
        merged = _merge(packed.where("open"), window, open_windows, round_number, last)
        packed = written(merged, "packed-rest")
        finished = finished.unionByName(packed.where(~F.col("open")))
        if last:
            break
        tasks = -(-tasks // MERGED_TASKS)
    return finished.drop("task", "open")


def _merge(
    rest: DataFrame, window: int, open_windows: int, round_number: int, last: bool
) -> DataFrame:
    """Pack the leftovers of `MERGED_TASKS` tasks at a time: a bounded group each."""

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        packer = Packer(window, open_windows, _base(round_number, int(key[0])))
        group = group.sort_values(["sequence_id", "offset"], kind="stable")
        for row in group.itertuples():
            ids = np.frombuffer(row.ids, dtype="<u4")
            packer.add(row.doc_id, row.start, ids, row.doc_tokens)
        if last:
            packer.close()
        else:
            packer.leave()
        return packer.frame(int(key[0]))

    grouped = rest.withColumn("task", F.expr(f"task div {MERGED_TASKS}")).groupBy("task")
    return grouped.applyInPandas(merge, PIECES)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    pieces = pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )
