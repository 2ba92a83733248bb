"""Near-duplicate documents by SetSketch registers, bands of registers and full sets.

A document is its set of distinct word shingles. Its sketch holds, for each of
REGISTERS registers, the smallest of exponentially spaced points that the
shingles throw on it, on a logarithmic scale and truncated: sketches of parts merge
by the maximum, and equal registers grow likely with similarity. Documents that
agree in a band of registers are candidates. Similarity is first estimated jointly
from the registers by likelihood, then settled on the full sets.

Rows with equal sets are one class, known by its smallest id. In each of the first bands
every class is compared with the smallest id there, not with all others. From then on only pairs
across components count: with the smallest and the largest id of every band, then with
neighbours in a random order, and at last in full, so that no link is lost. Few classes are
left by then, since a group of copies is one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featlake.llm.common import MIX_1, bitmap_of, by_arrow, chained, give_back, in_bitmap, int_lists, mixed, word_hashes
from featlake.llm.components import components
from featlake.session import write_and_read

REGISTERS, BAND = 160, 5
BASE, RATE, TOP = 1.001, 20.0, 65_535

#: Pairs whose estimate is further below the threshold than this aren't verified: over
#: five standard errors of the estimate at REGISTERS registers.
MARGIN = 0.18

#: Bands looked at first; the others then only have to join what those left apart.
FIRST_BANDS = 8

#: Classes of a band that one task puts in a random order; larger bands are dealt out.
ORDERED = 10_000

#: Classes of a band that are compared in one task; a larger band is cut into chunks that meet in pairs.
CHUNK = 6_000

#: Rounds of random neighbours for bands that are in several components.
ROUNDS = 1

ID_BITS = 1 << 26


def shingles(texts: pa.Array, length: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text: A-Z lowered, ASCII white space between words.

    A text of fewer words is one shingle of all of them; one without words has none.
    """
    hashes, bounds = word_hashes(texts, lower=True)
    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        found = hashes[start:end]
        yield np.unique(chained(found, min(length, len(found)))) if len(found) else found


def sketch(elements: np.ndarray) -> np.ndarray:
    """Registers of a set. Every element throws points on random registers at the times of a
    Poisson process; once all registers have an earlier point, its later points don't matter."""
    best = np.full(REGISTERS, np.inf)
    active, time, drawn = elements, np.zeros(len(elements)), 0
    rounds = max(1, -(-REGISTERS * 6 // max(1, len(elements))))
    while len(active):
        steps = np.arange(drawn + 1, drawn + rounds + 1, dtype=np.uint64) * MIX_1
        x = mixed(active[:, None] + steps)
        gaps = -np.log(((x >> np.uint64(21)) + np.uint64(1)) * 2.0**-43)
        times = time[:, None] + np.cumsum(gaps, axis=1)
        register = ((x & np.uint64(0x1FFFFF)) * np.uint64(REGISTERS)) >> np.uint64(21)
        np.minimum.at(best, register.ravel().astype(np.int64), times.ravel())
        open_ = times[:, -1] < best.max()
        active, time, drawn = active[open_], times[open_, -1], drawn + rounds
    with np.errstate(divide="ignore"):
        value = np.floor(1 - np.log(best / REGISTERS / RATE) / np.log(BASE))
    return np.clip(value, 0, TOP).astype("<u2")


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Most likely similarity of each pair of sketches, given both set sizes, to one hundredth."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    u = (size_a / (size_a + size_b))[:, None]
    grid = np.arange(101) / 100

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = chance(u - (1 - u) * grid), chance((1 - u) - u * grid)
    same = np.clip(1 - up - down, 1e-9, 1)
    likely = more * np.log(up) + less * np.log(down) + (a.shape[1] - more - less) * np.log(same)
    possible = grid <= np.minimum(u / (1 - u), (1 - u) / u) + 0.005
    return grid[np.argmax(np.where(possible, likely, -np.inf), axis=1)]


def sketches(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, set size, set key, registers and band values of every row, in one pass."""
    bands = REGISTERS // BAND

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, keys, registers = [], [], []
        for found in shingles(batch.column(1), length):
            sizes.append(len(found))
            keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            registers.append(sketch(found))
        all_ = np.concatenate(registers).reshape(-1, bands, BAND).astype(np.uint64)
        value = chained_rows(all_) + np.arange(1, bands + 1, dtype=np.uint64) * MIX_1
        full = np.array(sizes) > 0
        columns = [
            batch.column(0),
            pa.array(sizes, pa.int64()),
            pa.array(keys, pa.binary()),
            pa.array([x.tobytes() if f else None for x, f in zip(registers, full)], pa.binary()),
            int_lists(mixed(value[full]).ravel().view(np.int64), [bands if f else 0 for f in full], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_key", "registers", "bands"])

    schema = "doc_id bigint, n_shingles bigint, set_key binary, registers binary, bands array<bigint>"
    return by_arrow(docs.select(F.col("doc_id").cast("bigint"), "text"), schema, step)


def chained_rows(values: np.ndarray) -> np.ndarray:
    out = values[..., 0].copy()
    for k in range(1, values.shape[-1]):
        out = mixed(out * MIX_1 + values[..., k])
    return out


def _likely(pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b with registers and sizes) whose estimate is near the threshold or above."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        of = lambda name: np.frombuffer(b"".join(batch.column(name).to_pylist()), "<u2").reshape(-1, REGISTERS)
        small, large = batch.column("size_a").to_numpy(), batch.column("size_b").to_numpy()
        near = estimate(of("registers_a"), of("registers_b"), small, large) >= threshold - MARGIN
        return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(near))

    sized = pairs.where(F.least("size_a", "size_b") >= threshold * F.greatest("size_a", "size_b"))
    return by_arrow(sized, "a bigint, b bigint", step)


def _full_sets(docs: DataFrame, ids: DataFrame, length: int) -> DataFrame:
    """doc_id and found (sorted shingle hashes) of the documents in ``ids`` (id), and of a few others."""
    slot = lambda name: F.pmod(F.xxhash64(name), F.lit(ID_BITS))
    sent = docs.sparkSession.sparkContext.broadcast(bitmap_of(ids, slot("id"), ID_BITS))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = batch.filter(pa.array(in_bitmap(sent.value, batch.column("slot").to_numpy())))
        lists = [x.tobytes() for x in shingles(batch.column(1), length)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.binary())], ["doc_id", "found"])

    keyed = docs.select(F.col("doc_id").cast("bigint"), "text", slot(F.col("doc_id").cast("bigint")).alias("slot"))
    return write_and_read(by_arrow(keyed, "doc_id bigint, found binary", step), "sets")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share ``percent`` of a hundred of their union."""
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _verified(docs: DataFrame, pairs: DataFrame, length: int, percent: int) -> DataFrame:
    """The pairs that are links on the full sets; sets are built for documents in pairs only."""
    sets = _full_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")), length)
    side = lambda name: sets.select(F.col("doc_id").alias(name), F.col("found").alias(f"found_{name}"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = zip(batch.column("found_a").to_pylist(), batch.column("found_b").to_pylist())
        near = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in both]
        return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    return by_arrow(pairs.join(side("a"), "a").join(side("b"), "b"), "a bigint, b bigint", step)


def _neighbours(rows: DataFrame, seed: int, reach: int) -> DataFrame:
    """Pairs of each row (band, id, n, component) with the ``reach`` before it in a random order of its
    band, across components only."""
    part = F.pmod(F.xxhash64("id", F.lit(seed)), F.ceil(F.col("n") / ORDERED))
    order = Window.partitionBy("band", part).orderBy(F.xxhash64("id", "band", F.lit(seed)), "id")
    before = {f"_{k}": F.lag(F.struct("id", "component"), k).over(order) for k in range(1, reach + 1)}
    found = rows.withColumns(before).withColumn("o", F.explode(F.array(*before))).where("component <> o.component")
    return found.select(F.least("id", "o.id").alias("a"), F.greatest("id", "o.id").alias("b"))


def _pivots(met: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of each row with the smallest and the largest id of its band, across components only."""
    of = lambda name: labels.select(F.col("node").alias(name), F.col("component").alias(f"{name}_in"))
    rows = met.join(of("id"), "id", "left").join(of("low"), "low", "left").join(of("high"), "high", "left")
    own, low, high = (F.coalesce(f"{x}_in", x) for x in ("id", "low", "high"))
    below = rows.where(own != low).select(F.col("low").alias("a"), F.col("id").alias("b"))
    return below.unionByName(rows.where(own != high).select(F.col("id").alias("a"), F.col("high").alias("b")))


def _open(met: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of bands of three classes or more that lie in several components, with the component
    and whether it is the band's largest."""
    labelled = met.where("n > 2").join(labels.withColumnRenamed("node", "id"), "id", "left")
    labelled = labelled.select("band", "place", "id", "n", F.coalesce("component", "id").alias("component"))
    sizes = labelled.groupBy("band", "component").agg(F.count("*").alias("size"))
    bands = sizes.groupBy("band").agg(F.count("*").alias("parts"), F.max(F.struct("size", "component")).alias("most")).where("parts > 1")
    rows = labelled.join(bands, "band").withColumn("largest", F.col("component") == F.col("most.component"))
    return write_and_read(rows.withColumn("n_largest", F.col("most.size")).drop("parts", "most"), "open-bands")


def _chunked(rows: DataFrame) -> DataFrame:
    """Rows of open bands with the groups that they are compared in: ``left``, ``right`` and ``outside``.

    A band's largest component isn't compared with itself: it is outside, all other rows are inside. A band of up to CHUNK rows is
    one group. The rows of a larger one are dealt into chunks, and each chunk inside meets itself and each other chunk
    in a group of its own, so no task holds more than about two chunks.
    """
    whole = F.col("n") <= CHUNK
    n_in = F.ceil((F.col("n") - F.col("n_largest")) / CHUNK).cast("int")
    n_out = F.ceil(F.col("n_largest") / CHUNK).cast("int")
    chunk = F.pmod(F.xxhash64("id", F.lit("chunk")), F.when(F.col("largest"), n_out).otherwise(n_in)).cast("int")
    group = lambda left, right, first: F.struct(left.alias("left"), right.alias("right"), first.alias("is_left"))
    none, inside = F.lit(0), F.sequence(F.lit(0), n_in - 1)
    outside = F.transform(inside, lambda c: group(c, n_in + F.col("_chunk"), F.lit(False)))
    met = F.transform(F.sequence(F.lit(0), n_in + n_out - 1), lambda c: group(F.least(c, F.col("_chunk")), F.greatest(c, F.col("_chunk")), c >= F.col("_chunk")))
    groups = F.when(whole, F.array(group(none, none, ~F.col("largest")))).when(F.col("largest"), outside).otherwise(met)
    return rows.withColumn("_chunk", chunk).withColumn("_group", F.explode(groups)).select("*", "_group.*").drop("_chunk", "_group")


class _Group:
    """Rows compared in one task: arrays of all, with a label per component that links found here merge."""

    def __init__(self, parts: list[pa.RecordBatch]) -> None:
        rows = pa.Table.from_batches(parts)
        of = lambda name: rows.column(name).to_numpy()
        self.ids, self.labels, self.sizes, self.place = of("id"), of("component").copy(), of("size"), rows.column("place")[0].as_py()
        self.left = np.flatnonzero(rows.column("is_left").to_numpy(zero_copy_only=False))
        self.diagonal = rows.column("left")[0].as_py() == rows.column("right")[0].as_py()
        self.registers = np.frombuffer(b"".join(rows.column("registers").to_pylist()), "<u2").reshape(-1, REGISTERS)
        self.sets = rows.column("found").to_pylist()

    def links(self, threshold: float, percent: int) -> Iterator[tuple[int, int]]:
        """Verified links that join components; a row already joined with another isn't compared with it again."""
        done = np.zeros(len(self.ids), bool)
        if not self.diagonal:
            done[self.left] = True
        for u in self.left.tolist():
            done[u] = True
            fits = np.minimum(self.sizes, self.sizes[u]) >= threshold * np.maximum(self.sizes, self.sizes[u])
            at = np.flatnonzero(fits & ~done & (self.labels != self.labels[u]))
            likely = []
            for part in np.array_split(at, -(-len(at) // 1000)) if len(at) else []:
                same = self.registers[part] == self.registers[u]
                part = part[same.reshape(len(part), -1, BAND).all(2).argmax(1) == self.place]
                near = estimate(self.registers[part], self.registers[u][None], self.sizes[part], np.full(len(part), self.sizes[u]))
                likely += [(-x, v) for x, v in zip(near.tolist(), part.tolist()) if x >= threshold - MARGIN]
            own = np.frombuffer(self.sets[u], np.uint64)
            for _, v in sorted(likely):
                if self.labels[v] != self.labels[u] and linked(own, np.frombuffer(self.sets[v], np.uint64), percent):
                    self.labels[self.labels == self.labels[v]] = self.labels[u]
                    yield min(self.ids[u], self.ids[v]), max(self.ids[u], self.ids[v])


def _in_full(docs: DataFrame, rows: DataFrame, threshold: float, length: int, percent: int) -> DataFrame:
    """Links that join components of open bands: every likely pair across them is verified on the full sets where it is
    found, in the first band that it shares, unless links found before have joined the two."""
    sets = _full_sets(docs, rows.select("id").distinct(), length).withColumnRenamed("doc_id", "id")
    names = ["band", "left", "right", "place", "id", "component", "size", "is_left", "registers", "found"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            start = 0
            for at in range(1, len(keys) + 1):
                if at == len(keys) or keys[at] != keys[start]:
                    if keys[start] != key and parts:
                        yield of_group(parts)
                        parts = []
                    key = keys[start]
                    parts.append(batch.slice(start, at - start))
                    start = at
        if parts:
            yield of_group(parts)
        parts = []
        give_back()

    def of_group(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        found = np.array(list(_Group(parts).links(threshold, percent)), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    given = rows.withColumnsRenamed({"registers_id": "registers", "size_id": "size"}).join(sets, "id")
    dealt = _chunked(given).select(names).repartition("band", "left", "right").sortWithinPartitions("band", "left", "right")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Linked are rows whose sets share at least ``percent`` of a hundred of their union. Null
    and empty texts have an empty set and are linked with nothing; their component is
    their own id. Rows that repeat an id are one node. A row without an id takes no
    part: its component is null and it is kept.
    """
    sketched = write_and_read(sketches(docs, shingle_words), "sketches")
    full = sketched.where("n_shingles > 0 and doc_id is not null")
    classes = write_and_read(full.groupBy("set_key").agg(F.min("doc_id").alias("a_class")), "classes")
    reps = full.join(classes, [full.set_key == classes.set_key, full.doc_id == classes.a_class], "left_semi")
    reps = reps.dropDuplicates(["doc_id", "set_key"])
    threshold = percent / 100
    banded = write_and_read(
        reps.select(F.posexplode("bands").alias("place", "band"), F.col("doc_id").alias("id")), "bands"
    )
    shared = write_and_read(
        banded.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).where("low < high"), "shared-bands"
    )
    met = write_and_read(banded.join(shared, "band"), "met")
    pairs = met.where(F.col("place") < FIRST_BANDS).select(F.col("low").alias("a"), F.col("id").alias("b"))
    side = lambda name: reps.select(
        F.col("doc_id").alias(name), F.col("registers").alias(f"registers_{name}"), F.col("n_shingles").alias(f"size_{name}")
    )
    tried = pairs.where("a < b").distinct()
    likely = write_and_read(_likely(tried.join(side("a"), "a").join(side("b"), "b"), threshold).distinct(), "likely")
    links = write_and_read(_verified(docs, likely, shingle_words, percent), "links")
    labels = components(links)

    for turn in range(ROUNDS + 2):
        apart = _open(met, labels) if turn else met
        if turn <= ROUNDS:
            across = (_neighbours(apart, turn, 3) if turn else _pivots(met, labels)).distinct()
            more = write_and_read(_likely(across.join(side("a"), "a").join(side("b"), "b"), threshold).distinct(), "likely-across")
            more = _verified(docs, more, shingle_words, percent)
        else:
            more = _in_full(docs, apart.join(side("id"), "id"), threshold, shingle_words, percent)
        more = write_and_read(more.distinct(), "links-across")
        if not more.isEmpty():
            links = write_and_read(links.unionByName(more), "links")
            labels = components(links)

    by_class = classes.join(labels.withColumnRenamed("node", "a_class"), "a_class", "left").select(
        "set_key", F.coalesce("component", "a_class").alias("_component")
    )
    found = sketched.join(by_class, "set_key", "left").withColumn(
        "component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    )
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
