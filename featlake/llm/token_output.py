"""Packed token-id matrices: best-fit decreasing with a search tree over capacities.

Documents are tokenised, split without loss where they are longer than a row, and
packed block by block inside the task that tokenised them: no shuffle. A block is a
few thousand rows, far more than best-fit decreasing needs to come close to full rows.
A written row has the ids padded to the capacity, the cumulative lengths of its
segments, and the places where positions start again from 0.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlake.llm.common import slices
from featlake.llm.tokens import encoder
from featlake.session import shared_folder

ROW = (
    "sequence_id bigint, n_tokens int, input_ids binary, cu_seqlens array<int>, position_resets array<int>,"
    " doc_ids array<bigint>, starts array<bigint>"
)


class Capacities:
    """Open rows by room left; finds the least room that is enough in log(capacity) steps."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.any = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.size
        while at:
            self.any[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """A row with the least room of at least ``need``, taken out; the room it has."""
        at = need + self.size
        if not self.any[at]:
            while at > 1 and (at & 1 or not self.any[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.any[2 * at] else 2 * at + 1
        room = at - self.size
        while at:
            self.any[at] -= 1
            at >>= 1
        return self.rows[room].pop(), room


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of piece numbers; pieces longest first, ties in given order."""
    rows: list[list[int]] = []
    tree = Capacities(capacity)
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[piece])
        if found is None:
            rows.append([])
            found = len(rows) - 1, capacity
        row, room = found
        rows[row].append(piece)
        if room > lengths[piece]:
            tree.add(room - lengths[piece], row)
    return rows


def packed_rows(
    docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, pad_id: int = 0, block_tokens: int = 4_000_000
) -> DataFrame:
    """Packed rows of all documents; ids are 16-bit where the vocabulary allows, else 32-bit.

    Null and empty texts are the end id alone; null and repeated ids are kept as they
    are. ``sequence_id`` is the task's number and a count within it. Segments of a row
    are ordered by length. ``starts`` has each segment's place in its document's ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, end_id, "<u2" if _vocabulary(path) <= 1 << 16 else "<u4")
        size = encode.dtype.itemsize
        next_id = TaskContext.get().partitionId() << 32
        parts: list[tuple[int | None, int, bytes]] = []
        held = 0

        def emit() -> pa.RecordBatch:
            nonlocal next_id
            rows = best_fit_decreasing([len(p[2]) // size for p in parts], capacity)
            pad = np.array([pad_id], encode.dtype).tobytes()
            lists = [[parts[i] for i in row] for row in rows]
            ends = [np.cumsum([0] + [len(p[2]) // size for p in row]).tolist() for row in lists]
            ids = [b"".join(p[2] for p in row) for row in lists]
            columns = [
                pa.array(range(next_id, next_id + len(rows)), pa.int64()),
                pa.array([e[-1] for e in ends], pa.int32()),
                pa.array([x + pad * (capacity - e[-1]) for x, e in zip(ids, ends)], pa.binary()),
                pa.array(ends, pa.list_(pa.int32())),
                pa.array([e[:-1] for e in ends], pa.list_(pa.int32())),
                pa.array([[p[0] for p in row] for row in lists], pa.list_(pa.int64())),
                pa.array([[p[1] for p in row] for row in lists], pa.list_(pa.int64())),
            ]
            next_id += len(rows)
            parts.clear()
            names = ["sequence_id", "n_tokens", "input_ids", "cu_seqlens", "position_resets", "doc_ids", "starts"]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for part in slices(batch):
                for doc, raw in zip(part.column(0).to_pylist(), encode(part.column(1))):
                    parts += [(doc, at // size, raw[at : at + size * capacity]) for at in range(0, len(raw), size * capacity)]
                    held += len(raw) // size
                if held >= block_tokens:
                    held = 0
                    yield emit()
        if parts:
            yield emit()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, ROW)


_sizes: dict[str, int] = {}


def _vocabulary(path: str) -> int:
    if path not in _sizes:
        from tokenizers import Tokenizer

        _sizes[path] = max(Tokenizer.from_file(path).get_vocab().values()) + 1
    return _sizes[path]


def write_packed(rows: DataFrame, folder: str | None = None) -> str:
    """Write packed rows as Parquet, zstd, to ``folder`` (default: one in the shared folder); the path."""
    folder = folder or f"{shared_folder(rows.sparkSession)}/packed-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(folder)
    return folder
