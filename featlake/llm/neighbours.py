"""Approximate nearest neighbours by inner product: NN-descent, then greedy graph search.

Equal vectors are one node, known by its smallest id; a node remembers its smallest ids,
no more than an answer can hold, since ties go to smaller ids. The neighbour graph starts from
blocks: a tree orders the nodes by the sides of random hyperplanes they lie on, and runs of that order are
blocks, which differ from tree to tree where no plane parts the nodes. Then,
round by round, Spark joins every node with its neighbours and those it is a neighbour of,
and introduces them to each other. In a block or such a meeting a node takes as many partners
as an answer and itself need, and it keeps links to a few nodes chosen by a hash, so that the
nearest don't shut it off from the rest. A query starts at its own node and at a few
chosen by a hash, and expands the best unexpanded nodes it has seen; all queries take a step in the same joins. Every vector is in
the graph; nearness is recomputed in double precision on the vectors as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featlake.llm.common import by_arrow, int_lists
from featlake.session import write_and_read

EDGES = "a bigint, b bigint, score float"

#: Vectors up to this size in all are sent to the tasks; larger tables meet by a shuffle.
BROADCAST_BYTES = 32 << 20

#: Hyperplanes beyond those that would part evenly spread nodes into blocks.
MORE_BITS = 24

#: About so many nodes of a tree's order are cut into blocks by one task.
ORDERED = 65_536

#: Groups by a hash, of about so many nodes, in which each node has links to all others.
FAR_GROUPS, FAR = 2, 4

#: About so many nodes, chosen by a hash, are where a query starts besides its own.
ENTRIES = 8


def kind_of(vectors: DataFrame) -> np.dtype:
    """Single precision where the table holds it, else double: no digit of a vector is lost."""
    return np.dtype(np.float32 if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64)


def nodes(vectors: DataFrame, k: int) -> DataFrame:
    """node, vec (bytes, as precise as the table) and ids (the k + 1 smallest) for each distinct vector that takes part.

    Vectors that are null, empty or zero or hold a null or non-finite component take
    no part, nor do rows without an id or those whose length isn't the commonest one (smallest of
    those in a tie). Rows that repeat an id and vector count once.
    """

    kind = kind_of(vectors)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, keys, raw, sizes = [], [], [], []
        for vec_id, vec in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if vec_id is None or not vec or None in vec:
                continue
            x = np.array(vec, kind) + kind.type(0)  # one zero only
            if np.isfinite(x).all() and x.any():
                ids.append(vec_id)
                raw.append(x.tobytes())
                keys.append(xxhash.xxh3_128_digest(raw[-1]))
                sizes.append(len(x))
        columns = [pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(raw, pa.binary()), pa.array(sizes, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["vec_id", "key", "vec", "size"])

    given = vectors.select(F.col("vec_id").cast("bigint"), in_kind(kind))
    valid = write_and_read(by_arrow(given, "vec_id bigint, key binary, vec binary, size int", step), "vectors")
    usual = valid.groupBy("size").count().orderBy(F.desc("count"), "size").limit(1).select("size").collect()
    valid = valid.where(F.col("size") == (usual[0]["size"] if usual else 0))
    # the smallest ids of a class, k + 1 in each bucket and then of those: no class is one group
    spread = Window.partitionBy("key", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    few = valid.select("key", "vec_id").distinct().withColumn("_at", F.row_number().over(spread)).where(F.col("_at") <= k + 1)
    ids = few.groupBy("key").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids"))
    ids = ids.withColumn("node", F.col("ids")[0])
    rows = valid.select(F.col("vec_id").alias("node"), "key", "vec").dropDuplicates(["node", "key"])
    return write_and_read(ids.join(rows, ["node", "key"]).select("node", "vec", "ids"), "nodes")


def in_kind(kind: np.dtype) -> Column:
    return F.col("embedding").cast("array<float>" if kind == np.float32 else "array<double>")


def for_graph(table: DataFrame, kind: np.dtype) -> DataFrame:
    """node and vec in single precision; doubles are first brought to the size of their largest component."""
    if kind == np.float32:
        return table.select("node", "vec")

    def largest(batch: pa.RecordBatch) -> pa.RecordBatch:
        most = [np.abs(np.frombuffer(x, kind)).max() for x in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(most, pa.float64())], ["most"])

    most = by_arrow(table.select("vec"), "most double", largest).agg(F.max("most")).first()[0] or 1.0

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [(np.frombuffer(x, kind) / most).astype(np.float32).tobytes() for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["node", "vec"])

    return write_and_read(by_arrow(table.select("node", "vec"), "node bigint, vec binary", step), "single")


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple]]:
    """Rows that share the first column, which come in a row; groups over ``most`` are cut."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and (row[0] != rows[0][0] or len(rows) >= most):
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _introduce(width: int, most: int, best: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """In groups of (group, node, vec, least): the ``best`` others of each node that score over ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []

        def batch_of() -> pa.RecordBatch:
            a, b, s = (np.concatenate(x) for x in zip(*found))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s, pa.float32())], ["a", "b", "score"])

        for rows in _groups(batches, most):
            ids = np.array([r[1] for r in rows], np.int64)
            x = np.frombuffer(b"".join(r[2] for r in rows), np.float32).reshape(-1, width)
            least = np.array([r[3] for r in rows], np.float32)
            scores = x @ x.T
            scores[ids[:, None] == ids[None, :]] = -np.inf
            few = min(best, len(ids))
            at = np.argpartition(-scores, few - 1, axis=1)[:, :few]
            top = np.take_along_axis(scores, at, 1)
            ok = top > least[:, None]
            found.append((np.repeat(ids, ok.sum(1)), ids[at[ok]], top[ok]))
            if sum(len(f[0]) for f in found) > 50_000:
                yield batch_of()
        if found:
            yield batch_of()

    return run


def _small(table: DataFrame, column: str) -> bool:
    """Whether all values of a binary column fit into BROADCAST_BYTES, counted now."""
    size = table.agg(F.sum(F.octet_length(column) + 64)).first()[0]
    return (size or 0) <= BROADCAST_BYTES


def _best(edges: DataFrame, degree: int) -> DataFrame:
    order = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    once = edges.groupBy("a", "b").agg(F.max("score").alias("score"))
    return once.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= degree).drop("_at")


def _blocks(given: DataFrame, count: int, width: int, trees: int, block: int, seed: int) -> DataFrame:
    """(grp, node, vec): each node once for each tree, in blocks of about ``block`` and at most 2 * ``block`` nodes.

    A tree orders all nodes by the sides of its hyperplanes they lie on, the first plane first. Spark deals that order over tasks of about
    ORDERED nodes, and a task cuts it into runs of like size, so a dense part of the space is cut by as many planes as it needs.
    Nodes that no plane parts, such as vectors that hardly differ, stand in the order of a hash of node and tree, so
    other trees part other nodes. The runs are written once, as they depend on where the tasks begin.
    """
    bits = min(62, max(0, int(np.ceil(np.log2(max(1, count / block))))) + MORE_BITS)
    planes = np.random.default_rng(seed).normal(size=(width, trees * bits)).astype(np.float32)
    weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)

    def dealt(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, width)
        codes = (x @ planes > 0).reshape(len(x), trees, -1) @ weights
        return pa.RecordBatch.from_arrays([batch.column(0), int_lists(codes.ravel(), [trees] * len(x), pa.int64())], ["node", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        task = TaskContext.get().partitionId()
        if not sum(r.num_rows for r in rows):
            return
        tree, node = (np.concatenate([r.column(k).to_numpy() for r in rows]) for k in range(2))
        starts = np.flatnonzero(np.diff(tree, prepend=-1))
        grp = np.empty(len(node), np.int64)
        first = 0
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(node)]):
            runs = max(1, round((end - start) / block))
            grp[start:end] = first + np.arange(end - start) * runs // (end - start)
            first += runs
        yield pa.RecordBatch.from_arrays([pa.array((task << 32) + grp), pa.array(node)], ["grp", "node"])

    coded = by_arrow(given, "node bigint, codes array<bigint>", dealt)
    exploded = coded.select("node", F.posexplode("codes").alias("tree", "code")).withColumn("chance", F.xxhash64("node", "tree"))
    order = ["tree", "code", "chance", "node"]
    ordered = exploded.repartitionByRange(max(1, -(-count * trees // ORDERED)), *order).sortWithinPartitions(*order)
    placed = write_and_read(ordered.select("tree", "node").mapInArrow(run, "grp bigint, node bigint"), "placed")
    return placed.join(given, "node").select("grp", "node", "vec")


def _by_chance(table: DataFrame, count: int) -> DataFrame:
    """(grp, node): each node in FAR_GROUPS groups of about FAR, whatever its vector is."""
    turns = table.select("node", F.explode(F.array(*map(F.lit, range(FAR_GROUPS)))).alias("turn"))
    return turns.select(F.xxhash64("turn", F.pmod(F.xxhash64("node", "turn"), F.lit(max(1, count // FAR)))).alias("grp"), "node")


def _far_links(table: DataFrame, count: int) -> DataFrame:
    """Links (a, b) within the groups of ``_by_chance``, in both directions."""
    groups = _by_chance(table, count)
    pairs = groups.select("grp", F.col("node").alias("a")).join(groups.select("grp", F.col("node").alias("b")), "grp")
    return pairs.where("a <> b").select("a", "b")


def _entries(asked: DataFrame, table: DataFrame, count: int) -> DataFrame:
    """(query, node): a query's own node and about ENTRIES others; all nodes of a table of less than twice that."""
    slot = F.pmod(F.xxhash64("node", F.lit("entry")), F.lit(max(1, count // ENTRIES))).alias("slot")
    own = asked.select(F.col("node").alias("query"), "node")
    chosen = asked.select(F.col("node").alias("query"), F.pmod(F.xxhash64("node"), F.lit(max(1, count // ENTRIES))).alias("slot"))
    return own.unionByName(chosen.join(table.select("node", slot), "slot").select("query", "node")).distinct()


def graph(
    table: DataFrame, degree: int = 40, rounds: int = 5, trees: int = 8, block: int = 256, seed: int = 11, partners: int = 21
) -> DataFrame:
    """Directed edges (a, b, score): about the ``degree`` nearest of each node.

    The ``partners`` best of each block and each meeting are taken, and all of a small group by chance.

    A node is introduced to its neighbours and to up to ``degree`` nodes, chosen by a
    hash, that it is a neighbour of; the rest reach it through their own neighbours.
    """
    given = table.select("node", "vec")
    count, first = given.count(), given.first()
    if first is None:
        return table.sparkSession.createDataFrame([], EDGES)
    width, small = len(first["vec"]) // 4, _small(given, "vec")
    blocks = _blocks(given, count, width, trees, block, seed).unionByName(_by_chance(given, count).join(given, "node"))
    blocks = blocks.withColumn("least", F.lit(-np.inf).cast("float"))
    spread = blocks.repartition("grp").sortWithinPartitions("grp", "node").select("grp", "node", "vec", "least")
    edges = write_and_read(_best(spread.mapInArrow(_introduce(width, 4 * block, partners), EDGES), degree), "edges")
    for _ in range(rounds):
        back = Window.partitionBy("b").orderBy(F.xxhash64("a", "b"))
        reverse = edges.withColumn("_at", F.row_number().over(back)).where(F.col("_at") <= degree).select(F.col("b").alias("grp"), F.col("a").alias("node"))
        around = edges.select(F.col("a").alias("grp"), F.col("b").alias("node")).unionByName(reverse).unionByName(given.select(F.col("node").alias("grp"), "node"))
        worst = edges.groupBy(F.col("a").alias("node")).agg(F.when(F.count("*") >= degree, F.min("score")).alias("least"))
        known = given.join(worst, "node", "left").select("node", "vec", F.coalesce("least", F.lit(-np.inf).cast("float")).alias("least"))
        pairs = around.distinct()
        met = pairs.repartition("grp").join(F.broadcast(known), "node") if small else pairs.join(known, "node").repartition("grp")
        met = met.select("grp", "node", "vec", "least").sortWithinPartitions("grp")
        new = met.mapInArrow(_introduce(width, 4 * degree, partners), EDGES)
        edges = write_and_read(_best(edges.unionByName(new), degree), "edges")
    return edges


def _scored(pairs: DataFrame, table: DataFrame, queries: DataFrame, small: bool, kind: np.dtype) -> DataFrame:
    """(query, node) pairs with the inner product in double precision."""
    sent = F.broadcast if small else (lambda df: df)
    asked = queries.select(F.col("node").alias("query"), F.col("vec").alias("query_vec"))
    both = pairs.join(sent(table.select("node", "vec")), "node").join(sent(asked), "query")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        of = lambda name: np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(batch.num_rows, -1).astype(np.float64)
        score = np.einsum("nw,nw->n", of("vec"), of("query_vec"))
        return pa.RecordBatch.from_arrays([batch.column("query"), batch.column("node"), pa.array(score)], ["query", "node", "score"])

    return by_arrow(both.select("query", "node", "vec", "query_vec"), "query bigint, node bigint, score double", step)


def search(vectors: DataFrame, every: int = 20, k: int = 20, beam: int = 64, degree: int = 40, descents: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of rows whose vec_id is divisible by ``every``.

    Nearest first, ties to smaller vec_id, never the query's own id; all candidates where there are
    fewer. A search goes on until all of the ``beam`` best nodes that it has seen are opened. Rows that repeat an id with different
    vectors are candidates and queries of their own: such an id has the answers of each of its vectors.
    """
    table, kind = nodes(vectors, k), kind_of(vectors)
    small = _small(table, "vec")
    edges, count = graph(for_graph(table, kind), degree, descents, partners=k + 1), table.count()
    back = Window.partitionBy("b").orderBy(F.xxhash64("a", "b"))
    reverse = edges.withColumn("_at", F.row_number().over(back)).where(F.col("_at") <= degree).select(F.col("b").alias("a"), F.col("a").alias("b"))
    links = write_and_read(edges.select("a", "b").unionByName(reverse).unionByName(_far_links(table, count)).distinct(), "links")

    valid = vectors.select(F.col("vec_id").cast("bigint"), in_kind(kind)).where(F.col("vec_id") % every == 0)
    asked = write_and_read(query_nodes(valid, table, kind), "queries")
    wanted = write_and_read(asked.select("node").distinct().join(table.select("node", "vec"), "node"), "wanted")

    # Only the best ``beam`` of a query are looked at; what it has seen is kept to score nothing twice.
    order = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    best = lambda rows: rows.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= beam).drop("_at")
    seen = write_and_read(_scored(_entries(wanted, table, count), table, wanted, small, kind), "scored")
    top = write_and_read(best(seen.withColumn("opened", F.lit(False))), "top")
    while True:
        opened = top.where("not opened").select("query", "node")
        if opened.isEmpty():
            break
        reached = opened.join(links, opened.node == links.a).select("query", F.col("b").alias("node")).distinct()
        fresh = write_and_read(_scored(reached.join(seen, ["query", "node"], "left_anti"), table, wanted, small, kind), "scored")
        seen = seen.unionByName(fresh)
        top = top.withColumn("opened", F.lit(True)).unionByName(fresh.withColumn("opened", F.lit(False)))
        top = write_and_read(best(top), "top")

    near = top.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= k + 1)
    found = near.join(table.select("node", "ids"), "node").select(F.col("query").alias("node"), "score", F.explode("ids").alias("vec_id"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    answers = asked.select(F.col("vec_id").alias("query_id"), "node").join(found, "node").where("query_id <> vec_id")
    ranked = answers.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def query_nodes(asked: DataFrame, table: DataFrame, kind: np.dtype) -> DataFrame:
    """vec_id and node of the query rows that take part."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, raw = [], []
        for vec_id, vec in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if vec and None not in vec:
                ids.append(vec_id)
                raw.append((np.array(vec, kind) + kind.type(0)).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.binary())], ["vec_id", "vec"])

    return by_arrow(asked, "vec_id bigint, vec binary", step).distinct().join(table.select("vec", "node"), "vec").select("vec_id", "node")
