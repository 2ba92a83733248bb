"""Helpers that several operators share: tables, words, hashes, bitmap filters, row batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from featlake.session import storing, write_and_read

#: Words a worker remembers the hash of; later ones are hashed each time.
REMEMBERED_WORDS = 400_000

#: Characters handed to one vectorised step; a single longer text is a step of its own.
STEP_CHARS = 2_000_000

#: Bits of the bitmap that sets rows apart by their key.
APART_BITS = 1 << 26

MIX_1, MIX_2, MIX_3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 0 when divided by 5; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


class Words(dict):
    """64-bit hashes of words (bytes or text), remembered up to a limit."""

    def __missing__(self, word) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBERED_WORDS:
            self[word] = value
        return value

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts one after the other, and where each text's begin, with the end.

    Words lie between ASCII white space, with A-Z lowered on demand; a null text has none. Distinct words are numbered in Arrow and
    hashed once a batch, so nothing is remembered between batches.
    """
    filled = pc.fill_null(texts, "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(filled) if lower else filled)
    words = split.flatten().dictionary_encode()
    distinct = words.dictionary.to_numpy(zero_copy_only=False)
    numbers = words.indices.to_numpy()
    there = np.array([len(w) > 0 for w in distinct], bool)[numbers]  # space at an end leaves an empty word
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    ends = np.append(0, np.cumsum(split.value_lengths().to_numpy()))
    return hashes[numbers[there]], np.append(0, np.cumsum(there))[ends]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * MIX_2
    x = (x ^ (x >> np.uint64(27))) * MIX_3
    return x ^ (x >> np.uint64(31))


def chained(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each ``length`` consecutive values, order included; empty when there are fewer."""
    if len(hashes) < length:
        return np.zeros(0, np.uint64)
    out = hashes[: len(hashes) - length + 1].copy()
    for k in range(1, length):
        out = mixed(out * MIX_1 + hashes[k : len(hashes) - length + 1 + k])
    return out


def _powers(base: int, count: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(0, count - 1), base, np.uint64)]))


_ROLL = 0x9E3779B97F4A7C15
_powers_of = {x: np.zeros(0, np.uint64) for x in (_ROLL, pow(_ROLL, -1, 1 << 64))}


def rolled(hashes: np.ndarray, length: int) -> np.ndarray:
    """Like ``chained``, by sums of powers: the same few steps for any length."""
    n = len(hashes)
    if n < length:
        return np.zeros(0, np.uint64)
    for base, known in _powers_of.items():
        if len(known) < n:
            _powers_of[base] = _powers(base, max(n, 4096))
    up, down = _powers_of.values()
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[:n])])
    return mixed((sums[length:] - sums[:-length]) * down[: n - length + 1])


def by_arrow(df: DataFrame, schema: StructType | str, step: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """Each Arrow batch, cut into slices of about STEP_CHARS, through ``step``, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(step, slices(batch))
        batch = None
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system: a worker waits for the next stage's tasks and would keep it until then."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # absent where the C library isn't glibc
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    rows = max(1, int(batch.num_rows * STEP_CHARS / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _bitmap(df: DataFrame, slot: Column) -> DataFrame:
    """The bitmap of all rows' slots in pieces of 4 kB: bucket (from 1) and bits."""
    slots = df.select((slot + 1).alias("slot"))
    return slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    )


def apart(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose bigint ``key`` may be among ``keys``, and all others (null keys too), which stay in place.

    Tasks get a bitmap of a fixed size. It names all rows that are among ``keys`` and, as it fills up,
    more of the others: the first rows still have to meet ``keys`` exactly, but few long rows are shuffled for it.
    """
    slot = F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(APART_BITS))
    bits = write_and_read(_bitmap(keys.where(F.col(key).isNotNull()), slot), "bitmap")
    bits = bits.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))
    at = F.bitmap_bit_position(slot + 1)
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
    named = F.col(key).isNotNull() & F.coalesce(F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1, F.lit(False))
    met = rows.join(F.broadcast(bits), F.bitmap_bucket_number(slot + 1) == F.col("_bucket"), "left")
    return met.where(named).drop("_bucket", "_bits"), met.where(~named).drop("_bucket", "_bits")


def bitmap_of(df: DataFrame, slot: Column, bits: int) -> np.ndarray:
    """A bitmap of ``bits`` bits with the slots of all rows set: a fixed size, whatever the rows.

    Spark merges partial bitmaps of 4 kB; the driver gets at most bits / 8 bytes.
    """
    with storing(df.sparkSession):
        parts = _bitmap(df, slot).collect()
    out = np.zeros(bits // 8, np.uint8)
    for row in parts:
        at = (row["bucket"] - 1) * 4096
        piece = np.frombuffer(row["bits"], np.uint8)[: max(0, len(out) - at)]
        out[at : at + len(piece)] |= piece
    return out


def in_bitmap(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def int_lists(values: np.ndarray, lengths: list[int], kind: pa.DataType) -> pa.ListArray:
    """One list per length, cut from ``values`` in order."""
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))
