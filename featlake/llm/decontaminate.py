"""Benchmark passages in documents by spaced seeds, verified with substitutions allowed.

A seed is a fixed mask over SPAN consecutive words that looks at some places and
ignores the others, so that changed words at ignored places don't hide an overlap. Hashes of
all seeds of the benchmark and of the documents are joined. Around each hit, document
and item are laid side by side: they overlap if ``percent`` of a hundred of some ``window``
words in a row agree. An item shorter than the span has one seed, all its words.

Documents are read once. A bitmap of fixed size tells the tasks which seeds can
occur in the benchmark; only the words around those leave them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlake.llm.common import MIX_1, Words, bitmap_of, by_arrow, in_bitmap, mixed
from featlake.session import write_and_read

#: Places a mask looks at; all masks span SPAN words.
MASKS = ((0, 1, 3, 4, 7, 9), (0, 2, 3, 5, 8, 9), (0, 1, 2, 6, 7, 9), (0, 4, 5, 6, 8, 9))
SPAN = 10

#: Items with fewer words than this take no part.
LEAST_WORDS = 5

BITS = 1 << 26
AROUND = 40
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def word_hashes(text: str | None, words: Words) -> np.ndarray:
    """Hashes of runs of letters and digits, A-Z lowered; none for null."""
    return words.of(WORD.findall((text or "").encode().lower()))


def seed(hashes: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The mask's hash at each place where it fits."""
    n = len(hashes) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, sum(1 << p for p in mask), np.uint64)
    for place in mask:
        out = (out + hashes[place : place + n]) * MIX_1
        out ^= out >> np.uint64(29)
    return mixed(out)


def slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64(BITS - 1)
    return (hashes & low).astype(np.int64), ((hashes >> np.uint64(32)) & low).astype(np.int64)


def item_seeds(benchmark: DataFrame) -> DataFrame:
    """(item_id, words, seeds) of the items that take part; seeds have a hash and a place."""
    words = Words()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, raw, found = [], [], []
        for item, text in zip(*(c.to_pylist() for c in batch.columns)):
            h = word_hashes(text, words)
            if item is None or len(h) < LEAST_WORDS:
                continue
            masks = MASKS if len(h) >= SPAN else (tuple(range(len(h))),)
            ids.append(item)
            raw.append(h.tobytes())
            found.append([{"hash": x, "at": at} for m in masks for at, x in enumerate(seed(h, m).view(np.int64).tolist())])
        kind = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.binary()), pa.array(found, kind)], ["item_id", "words", "seeds"])

    schema = "item_id bigint, words binary, seeds array<struct<hash: bigint, at: int>>"
    return write_and_read(by_arrow(benchmark.select(F.col("item_id").cast("bigint"), "text"), schema, step), "item-seeds")


def regions(docs: DataFrame, bitmap: np.ndarray, short: list[int]) -> DataFrame:
    """Stretches of documents around seeds that may occur in the benchmark, with those seeds."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)
    masks = [*MASKS, *(tuple(range(n)) for n in short)]
    words = Words()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, starts, raw, found = [], [], [], []
        for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
            h = word_hashes(text, words)
            places, hashes = [], []
            for mask in masks:
                s = seed(h, mask)
                first, second = slots(s)
                at = np.flatnonzero(in_bitmap(sent.value, first))
                at = at[in_bitmap(sent.value, second[at])]
                places.append(at)
                hashes.append(s[at].view(np.int64))
            at, s = np.concatenate(places), np.concatenate(hashes)
            if not len(at):
                continue
            order = np.argsort(at, kind="stable")
            at, s = at[order], s[order]
            new = np.flatnonzero(np.diff(at, prepend=-(10**9)) > 2 * AROUND)
            for k, e in zip(new.tolist(), [*new[1:].tolist(), len(at)]):
                start = max(0, int(at[k]) - AROUND)
                ids.append(doc)
                starts.append(start)
                raw.append(h[start : int(at[e - 1]) + SPAN + AROUND].tobytes())
                found.append([{"hash": x, "at": p} for x, p in zip(s[k:e].tolist(), (at[k:e] - start).tolist())])
        kind = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32())]))
        columns = [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(raw, pa.binary()), pa.array(found, kind)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "around", "hits"])

    schema = "doc_id bigint, start bigint, around binary, hits array<struct<hash: bigint, at: int>>"
    return by_arrow(docs.select(F.col("doc_id").cast("bigint"), "text"), schema, step)


def overlap(doc: np.ndarray, item: np.ndarray, shift: int, window: int) -> tuple[int, int]:
    """Most words that agree in a window on the diagonal, and where in ``doc`` it starts."""
    low, high = max(0, shift), min(len(doc), shift + len(item))
    window = min(window, len(item))
    if high - low < window:
        return 0, low
    sums = np.cumsum(np.concatenate([[0], doc[low:high] == item[low - shift : high - shift]]))
    agree = sums[window:] - sums[:-window]
    best = int(np.argmax(agree))
    return int(agree[best]), low + best


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 13, percent: int = 80) -> DataFrame:
    """One row per document and item that overlap: doc_id, item_id, agreeing (words), window, start.

    ``start`` is the place of the best window among the document's words. Null and
    empty texts overlap nothing, rows without an id take no part; rows that repeat an id count as one,
    with the best of their overlaps.
    """
    items = item_seeds(benchmark)
    seeds = items.select("item_id", F.inline("seeds")).withColumnRenamed("at", "item_at")
    short = [r[0] for r in items.select((F.octet_length("words") / 8).cast("int").alias("n")).where(f"n < {SPAN}").distinct().collect()]
    low = seeds.select(F.explode(F.array(F.col("hash").bitwiseAND(BITS - 1), F.shiftrightunsigned("hash", 32).bitwiseAND(BITS - 1))).alias("slot"))
    found = write_and_read(regions(docs.where("doc_id is not null"), bitmap_of(low, F.col("slot"), BITS), sorted(short)), "regions")
    hits = found.select("doc_id", "start", F.inline("hits"))
    diagonals = hits.join(seeds, "hash").select("doc_id", "start", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    sides = diagonals.join(found.select("doc_id", "start", "around").distinct(), ["doc_id", "start"]).join(items.select("item_id", "words"), "item_id")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, start, item, shift, around, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "item_id", "shift", "around", "words"))):
            a, b = np.frombuffer(around, np.uint64), np.frombuffer(raw, np.uint64)
            size = min(window, len(b))
            agree, at = overlap(a, b, shift, window)
            if 100 * agree >= percent * size:
                rows.append((doc, item, agree, size, start + at))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "agreeing", "window", "start"])

    verified = by_arrow(sides, "doc_id bigint, item_id bigint, agreeing int, window int, start bigint", step)
    best = F.max(F.struct("agreeing", (-F.col("start")).alias("_start"), "window"))
    return verified.groupBy("doc_id", "item_id").agg(best.alias("_best")).select(
        "doc_id", "item_id", "_best.agreeing", "_best.window", (-F.col("_best._start")).alias("start")
    )
