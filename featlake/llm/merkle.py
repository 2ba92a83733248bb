"""A Merkle manifest of documents: a tree of SHA-256 digests per source, and one over the sources.

A parent hashes the hex digests of up to FANOUT children one after the other, and
keeps a copy of the hash state before each child's slot. What a changed child makes
of its parent is then found by resuming the copy of its slot with the new
digest and the siblings to its right; those to the left aren't read again.

Trees are worked on in blocks of FANOUT ** STEP consecutive nodes, each in one task
however large its source is. Blocks are summed up to their top node, which is a node of the
next layer, until one is left. On the way down every node learns its path: the
siblings left and right of it and of each node above. A hash state lives in one process, so a
task restores the states above its block once, from the left siblings of the path,
and copies them for all leaves of the block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featlake.operators.ordering import global_index
from featlake.session import write_and_read

FANOUT, FANOUT_BITS = 16, 4

#: Levels of a tree inside one block.
STEP = 3

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PATH = "array<struct<before:string,after:string>>"
NODE = "tree string, pos bigint, digest string"


def leaf(*, text: Column | str = "text") -> Column:
    """The digest of a row's FIELDS, each ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    values = [F.col(name).cast("string") if name != "text" else (F.col(text) if isinstance(text, str) else text) for name in FIELDS]
    parts = [F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in values]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def tampered(doc_id: str = "doc_id") -> Column:
    """Whether 5 divides the crc32 of the decimal id; not for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Block:
    """Consecutive nodes with the levels above them, up to ``levels`` of them."""

    def __init__(self, digests: list[str], levels: int) -> None:
        self.rows = [digests]
        self.states: list[list] = []  # by level: the state before each child's slot
        self.before: list[list[str]] = []
        self.after: list[list[str]] = []
        self._known: list[dict] = []
        for _ in range(levels):
            self._add_level()

    def _add_level(self) -> None:
        children, parents = self.rows[-1], []
        states, before, after = [], [], []
        for at in range(0, len(children), FANOUT):
            run = children[at : at + FANOUT]
            state = sha256()
            for slot, child in enumerate(run):
                states.append(state.copy())
                before.append("".join(run[:slot]))
                after.append("".join(run[slot + 1 :]))
                state.update(child.encode())
            parents.append(state.hexdigest())
        self.rows.append(parents)
        self.states.append(states)
        self.before.append(before)
        self.after.append(after)
        self._known.append({})

    @property
    def top(self) -> str:
        (digest,) = self.rows[-1]
        return digest

    def siblings(self, at: int) -> list[dict]:
        """What lies left and right of node ``at`` and of each node above it in the block."""
        out = []
        for before, after in zip(self.before, self.after):
            out.append({"before": before[at], "after": after[at]})
            at //= FANOUT
        return out

    def fold(self, at: int, digest: str) -> str:
        """The block's top node if node ``at`` had ``digest``."""
        for states, after, known in zip(self.states, self.after, self._known):
            found = known.get((at, digest))
            if found is None:
                found = known[at, digest] = resumed(states[at], digest, after[at])
            digest, at = found, at // FANOUT
        return digest


def resumed(state, digest: str, after: str) -> str:
    state = state.copy()
    state.update((digest + after).encode())
    return state.hexdigest()


class Above:
    """The path above a block: its states, restored once from the left siblings."""

    def __init__(self, path: list[dict]) -> None:
        self.states = [sha256(level["before"].encode()) for level in path]
        self.after = [level["after"] for level in path]
        self._known: list[dict] = [{} for _ in path]

    def fold(self, digest: str) -> str:
        for state, after, known in zip(self.states, self.after, self._known):
            found = known.get(digest)
            if found is None:
                found = known[digest] = resumed(state, digest, after)
            digest = found
        return digest


def by_block(batches: Iterator[pa.RecordBatch], keys: int = 2) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted batches by their first ``keys`` columns; a group may run over batches."""
    key, held = None, []
    for batch in batches:
        for found, rows in groupby(zip(*(c.to_pylist() for c in batch.columns)), key=lambda row: row[:keys]):
            if found != key:
                if held:
                    yield key, held
                key, held = found, []
            held.extend(row[keys:] for row in rows)
    if held:
        yield key, held


def _levels(n: Column) -> Column:
    """How often runs of FANOUT are taken until one of ``n`` nodes is left."""
    return sum((F.when(n > FANOUT**k, 1).otherwise(0) for k in range(15)), F.lit(0))


def _block(pos: str = "pos") -> Column:
    return F.shiftright(pos, FANOUT_BITS * STEP)


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _summed(nodes: DataFrame) -> DataFrame:
    """The next layer (tree, pos, digest, levels) of ``nodes``: the top node of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, block), rows in by_block(batches):
            levels = rows[0][2]
            top = Block([digest for _, digest, _ in rows], min(STEP, levels)).top
            columns = [pa.array([tree], pa.string()), pa.array([block], pa.int64()), pa.array([top]), pa.array([max(0, levels - STEP)], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["tree", "pos", "digest", "levels"])

    return _dealt(nodes.select("tree", _block().alias("block"), "pos", "digest", "levels")).mapInArrow(run, f"{NODE}, levels int")


def layers(nodes: DataFrame) -> list[DataFrame]:
    """The stored layers of all trees from ``nodes`` (tree, pos, digest), one block apart; the last has one node a tree."""
    sizes = nodes.groupBy(F.col("tree").alias("_tree")).agg(F.count("*").alias("_n")).withColumn("levels", _levels(F.col("_n")))
    sizes = write_and_read(sizes, "tree-sizes")
    out = [nodes.join(sizes, nodes.tree.eqNullSafe(sizes["_tree"])).select(*nodes.columns, F.col("levels").cast("int").alias("levels"))]
    high = sizes.agg(F.max("levels")).first()[0] or 0
    for _ in range(-(-high // STEP)):
        out.append(write_and_read(_summed(out[-1]), "tree-layer"))
    return out


def _with_paths(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """``nodes`` (tree, pos, digest, levels) with their path, from ``tops`` (tree, pos, path): those of their blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, _), ((_, _, _, path), *rows) in by_block(batches):
            block = Block([row[1] for row in rows], min(STEP, rows[0][2]))
            columns = [
                pa.array([tree] * len(rows), pa.string()),
                pa.array([row[0] for row in rows], pa.int64()),
                pa.array([row[1] for row in rows], pa.string()),
                pa.array([block.siblings(at) + path for at in range(len(rows))], PATH_TYPE),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["tree", "pos", "digest", "path"])

    given = nodes.select("tree", _block().alias("block"), "pos", "digest", "levels", F.lit(None).cast(PATH).alias("path"))
    heads = tops.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("bigint").alias("pos"), F.lit("").alias("digest"), F.lit(0).alias("levels"), "path")
    return _dealt(given.unionByName(heads)).mapInArrow(run, f"{NODE}, path {PATH}")


PATH_TYPE = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


@dataclass
class Manifest:
    """``leaves``: the rows with tree (their source), pos and levels. ``blocks``: tree, pos (of the block), path to the
    root and subroot of every block of leaves. ``root``: the digest over all, None for no rows."""

    leaves: DataFrame
    blocks: DataFrame
    root: str | None


def manifest(rows: DataFrame) -> Manifest:
    """The tree over stored ``rows`` (source, doc_id, digest, salt and others).

    Leaves of a source ascend by doc_id, null first, then by digest. Rows that repeat an id are leaves of
    their own. ``salt`` tells equal rows apart, so that many of them need not meet in one task.
    """
    index = global_index(rows.withColumnRenamed("source", "tree"), ["tree", "doc_id", "digest", "salt"])
    first = index.groupBy(F.col("tree").alias("_tree")).agg(F.min("_index").alias("_first"))
    placed = index.join(first, index.tree.eqNullSafe(first["_tree"])).withColumn("pos", F.col("_index") - F.col("_first"))
    placed = write_and_read(placed.drop("_index", "_tree", "_first", "salt"), "placed-leaves")

    trees = layers(placed)
    subroots = global_index(trees[-1].select(F.col("tree").alias("source"), "digest"), ["source"])
    subroots = write_and_read(subroots.withColumnRenamed("_index", "pos").withColumn("tree", F.lit(None).cast("string")), "subroots")
    above = layers(subroots.select("tree", "pos", "digest"))
    found = above[-1].select("digest").first()
    root = found["digest"] if found else None

    no_path = F.array().cast(PATH).alias("path")
    tops = above[-1].select("tree", "pos", no_path)
    for layer in reversed(above[:-1]):
        tops = _with_paths(layer, tops)
    by_source = subroots.select("source", F.col("pos").alias("_pos"), F.col("digest").alias("subroot"))
    heads = tops.join(by_source, tops.pos == by_source["_pos"]).select(F.col("source").alias("tree"), F.lit(0).cast("bigint").alias("pos"), "path", "subroot")
    heads = write_and_read(heads, "paths")
    blocks = heads.select("tree", "pos", "path")
    for layer in reversed(trees[1:-1]):
        blocks = _with_paths(layer, blocks).select("tree", "pos", "path")
    known = heads.select(F.col("tree").alias("_tree"), "subroot")
    blocks = blocks.join(known, blocks.tree.eqNullSafe(known["_tree"])).drop("_tree")
    return Manifest(trees[0], write_and_read(blocks, "block-paths"), root)


def folded(tree: Manifest, changed: str) -> DataFrame:
    """doc_id, digest, subroot, root, proof_sha256 and folded_root of every leaf.

    ``folded_root`` is the root that the digest in column ``changed`` of the leaf gives with the stored siblings.
    """
    root = tree.root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ((_, _, _, _, _, path, subroot), *rows) in by_block(batches):
            block = Block([row[2] for row in rows], min(STEP, rows[0][4]))
            above = Above(path)
            far = "".join(level["before"] + level["after"] for level in path)
            proofs, roots = [], []
            for at, row in enumerate(rows):
                near = "".join(level["before"] + level["after"] for level in block.siblings(at))
                proofs.append(sha256((near + far).encode()).hexdigest())
                roots.append(above.fold(block.fold(at, row[3])))
            n = len(rows)
            columns = [pa.array([row[1] for row in rows], pa.int64()), *(pa.array(x, pa.string()) for x in ([row[2] for row in rows], [subroot] * n, [root] * n, proofs, roots))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "subroot", "root", "proof_sha256", "folded_root"])

    none = lambda kind: F.lit(None).cast(kind)
    rows = tree.leaves.select(
        "tree", _block().alias("block"), "pos", "doc_id", "digest", F.col(changed).alias("changed"), "levels", none(PATH).alias("path"), none("string").alias("subroot")
    )
    heads = tree.blocks.select(
        "tree", F.col("pos").alias("block"), F.lit(-1).cast("bigint").alias("pos"), none("bigint").alias("doc_id"), F.lit("").alias("digest"),
        F.lit("").alias("changed"), F.lit(0).alias("levels"), "path", "subroot",
    )
    schema = "doc_id bigint, digest string, subroot string, root string, proof_sha256 string, folded_root string"
    return _dealt(rows.unionByName(heads)).mapInArrow(run, schema)


def verified(docs: DataFrame) -> DataFrame:
    """Each row's leaf, subroot, root, digest of its proof, and the root after tampering.

    Tampering lower-cases A-Z of the text where ``tampered`` holds, so a null text and one
    without capitals stay as they are. An empty table gives no rows; columns other than FIELDS aren't read.
    """
    lowered = F.translate("text", UPPER, LOWER)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *(F.col(c) for c in FIELDS[1:]))
    hashed = rows.select(
        "doc_id", F.col("source").cast("string").alias("source"), leaf().alias("digest"),
        F.when(tampered() & F.col("text").isNotNull(), leaf(text=lowered)).alias("changed"), F.monotonically_increasing_id().alias("salt"),
    ).withColumn("changed", F.coalesce("changed", "digest"))
    found = folded(manifest(write_and_read(hashed, "leaves")), "changed")
    return found.withColumnRenamed("digest", "leaf").withColumn("verified", F.col("folded_root") == F.col("root"))
