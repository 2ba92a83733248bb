"""Best-two-fit packing of tokenised documents into sequences of a fixed capacity.

Pieces of one length are interchangeable, so the packing is planned on counts of
lengths, at most ``capacity`` of them however large the corpus is. A plan is a list
of patterns: the lengths in a sequence and how many sequences are filled that
way. A pattern is filled greedily, the longest piece that fits first; then its
smallest piece gives way to two unpacked pieces that fill the widened gap more
tightly, if there are such two. Each use of a pattern runs until a length gives out, so there
are few patterns. A piece finds its place by its rank among pieces of its length.
"""

from __future__ import annotations

import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featlake.llm.common import by_arrow
from featlake.llm.tokens import encoder
from featlake.session import write_and_read

PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Token pieces of whole texts: every document ends with ``end_id``; only longer ones are cut.

    A null or empty text is the end id alone. Columns other than ``doc_id`` and
    ``text`` aren't read.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, number, start, length, crc = [], [], [], [], []
        encode = encoder(path, end_id, "<u4")
        for doc_id, raw in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
            for at in range(0, len(raw), 4 * capacity):
                part = raw[at : at + 4 * capacity]
                doc.append(doc_id)
                number.append(at // (4 * capacity))
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        columns = [pa.array(x, k) for x, k in zip((doc, number, start, length, crc), kinds)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return by_arrow(docs.select(F.col("doc_id").cast("bigint"), "text"), PIECE, step)


def _longest(counts: np.ndarray, room: int) -> int:
    found = np.flatnonzero(counts[: room + 1])
    return int(found[-1]) if len(found) else 0


def _tightest_pair(counts: np.ndarray, room: int, more_than: int) -> tuple[int, int] | None:
    """The two lengths with the largest sum up to ``room``, if that is more than ``more_than``."""
    sizes = np.flatnonzero(counts[: room + 1])
    if not len(sizes):
        return None
    at = np.searchsorted(sizes, np.minimum(room - sizes, sizes), "right") - 1  # the partner is no longer
    partner = np.where(at >= 0, sizes[np.maximum(at, 0)], 0)
    alone = (partner == sizes) & (counts[sizes] < 2)
    partner[alone] = np.where(at[alone] > 0, sizes[np.maximum(at[alone] - 1, 0)], 0)
    total = np.where(partner > 0, sizes + partner, 0)
    best = int(np.argmax(total))
    return (int(sizes[best]), int(partner[best])) if total[best] > more_than else None


def plan(lengths: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths in a sequence, number of such sequences) that use up all counts."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, count in lengths.items():
        counts[length] = count
    out = []
    while True:
        left = counts.copy()
        inside: list[int] = []
        room = capacity
        while room and (length := _longest(left, room)):
            many = min(int(left[length]), room // length)
            inside += [length] * many
            left[length] -= many
            room -= many * length
        if not inside:
            return out
        if room and len(inside) > 1:
            smallest = inside[-1]
            if pair := _tightest_pair(left, room + smallest, smallest):
                inside[-1:] = pair
        need = np.bincount(inside, minlength=capacity + 1)
        used = np.flatnonzero(need)
        uses = int((counts[used] // need[used]).min())
        counts -= need * uses
        out.append((inside, uses))


def pack(pieces_table: DataFrame, capacity: int = 2048, buckets: int = 64) -> DataFrame:
    """``pieces_table`` with ``sequence_id`` and ``offset``; offsets of a sequence are gapless from 0.

    The input is read several times: hand in a stored table. Lengths are between 1
    and ``capacity``. Rows that repeat an id and piece are separate pieces. Ranks are
    taken within (length, bucket of the id), so that a length shared by a third of
    all pieces isn't one group; an empty table gives an empty result.
    """
    patterns = plan({r["length"]: r["n"] for r in pieces_table.groupBy("length").agg(F.count("*").alias("n")).collect()}, capacity)
    first, sequence, offset = {}, {}, {}
    ranks = [0] * (capacity + 1)
    base = 0
    for inside, uses in patterns:
        for length, place in zip(inside, accumulate(inside, initial=0)):
            first.setdefault(length, []).append(ranks[length])
            sequence.setdefault(length, []).append(base)
            offset.setdefault(length, []).append(place)
            ranks[length] += uses
        base += uses
    tables = {k: tuple(np.array(x[k], np.int64) for x in (first, sequence, offset)) for k in first}

    names = pieces_table.columns
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets))
    keyed = pieces_table.withColumn("_bucket", bucket)
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        keyed.groupBy("length", "_bucket")
        .agg(F.count("*").alias("_n"))
        .select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )
    order = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = (
        keyed.withColumn("_at", F.row_number().over(order) - 1)
        .join(bases, ["length", "_bucket"])
        .select(*names, (F.col("_base") + F.col("_at")).alias("_rank"))
    )

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        length = batch.column("length").to_numpy()
        rank = batch.column("_rank").to_numpy()
        seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for value in np.unique(length):
            here = length == value
            starts, bases_, places = tables[int(value)]
            slot = np.searchsorted(starts, rank[here], "right") - 1
            seq[here] = bases_[slot] + rank[here] - starts[slot]
            off[here] = places[slot]
        kept = [batch.column(c) for c in names]
        return pa.RecordBatch.from_arrays([*kept, pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces_table.schema)
    return by_arrow(ranked, f"{schema}, sequence_id bigint, offset bigint", step)


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenise once, store the pieces (a few numbers each), then pack them."""
    return pack(write_and_read(pieces(docs, path, capacity, end_id), "pieces"), capacity)
