"""Ranked lexical search over a length-stratified index.

A document's score depends on its length through one whole number, its normaliser m.
Documents of equal m are a stratum: in it the impact of a posting depends on tf alone, so postings lie
by term and tf, and each impact is computed once per tf. A stratum is cut into blocks of at
most BLOCK documents. The largest tf of a term in a block bounds what an item can score there: an
item first visits the blocks with its highest bounds, and then only those whose bound
reaches the last of the best scores found so far.

Items are taken in batches of a bounded number of terms, whose vocabulary, weights and best
scores are sent to the tasks. Each batch reads the documents once; one batch is enough for some
thousands of items.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featlake.llm.common import by_arrow, int_lists
from featlake.session import write_and_read

#: Documents in a block: a place in it takes PLACE_BITS bits.
PLACE_BITS = 11
BLOCK = 1 << PLACE_BITS
TF_BITS = 31
MOST_TF = (1 << TF_BITS) - 1

#: Terms of items that one batch sends to the tasks.
BATCH_TERMS = 200_000

#: Blocks with the highest bounds that an item visits first.
FIRST_VISITS = 2

# Bytes that part terms, and the scale of impacts and weights.
PARTING = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
SCALE, TF_PART, LENGTH_PART, WEIGHT = 1_000_000_000, 1000, 20, 1000

FOLD = bytes.maketrans(PARTING + bytes(range(65, 91)), b" " * len(PARTING) + bytes(range(97, 123)))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all other than ASCII, with only A-Z lowered; none for null."""
    return (text or "").encode().translate(FOLD).split()


def impacts(tf: np.ndarray, m: int) -> np.ndarray:
    return SCALE * tf // (TF_PART * tf + LENGTH_PART * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * df + 1)))


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats) and the numbers and counts of the terms in ``vocabulary``."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        find = sent.value.get
        n, found = [], []
        for at, text in enumerate(batch.column(1).to_pylist()):
            words = terms(text)
            n.append(len(words))
            ids = np.fromiter((x for x in map(find, words) if x is not None), np.int64)
            found.append(ids | (at << 32))
        keys, tf = np.unique(np.concatenate(found), return_counts=True)
        sizes = np.bincount(keys >> 32, minlength=batch.num_rows).tolist()
        ids = (keys & 0xFFFFFFFF).astype(np.int32)
        columns = [batch.column(0), pa.array(n, pa.int64()), int_lists(ids, sizes, pa.int32()), int_lists(tf.astype(np.int32), sizes, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "ids", "tfs"])

    return by_arrow(docs.select(F.col("doc_id").cast("bigint"), "text"), "doc_id bigint, n bigint, ids array<int>, tfs array<int>", step)


STRATUM = "m bigint, docs binary, terms binary, most binary, group_ends binary, tfs binary, posting_ends binary, places binary"


def strata(counted: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The index: stored blocks of strata. A row has its documents in order of id, its terms with their largest tf,
    the tf groups of each term, largest first, and the documents of each group."""
    m = F.lit(100 - 50) + F.expr(f"(50 * n * {n_docs}L) div {max(n_terms, 1)}L")
    dealt = (
        counted.where("n > 0 and size(ids) > 0")
        .select(m.alias("m"), "doc_id", "ids", "tfs")
        .repartitionByRange("m", F.xxhash64("doc_id"))
        .sortWithinPartitions("m")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, held, n = None, [], 0
        for batch in batches:
            ms = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ms)) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                if ms[start] != m and held:
                    yield stratum(m, held)
                    held, n = [], 0
                m = int(ms[start])
                while start < end:
                    some = min(end - start, BLOCK - n)
                    held.append(batch.slice(start, some))
                    start, n = start + some, n + some
                    if n == BLOCK:
                        yield stratum(m, held)
                        held, n = [], 0
        if held:
            yield stratum(m, held)

    blocks = dealt.mapInArrow(run, STRATUM)
    return write_and_read(blocks.withColumn("block", F.monotonically_increasing_id()), "strata")


def stratum(m: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One block from rows (m, doc_id, ids, tfs) of equal m."""
    rows = pa.Table.from_batches(parts).combine_chunks()
    docs = rows.column("doc_id").to_numpy()
    order = np.argsort(docs, kind="stable")
    place = np.empty(len(docs), np.int64)
    place[order] = np.arange(len(docs))
    flat = lambda name: np.concatenate([x.flatten().to_numpy() for x in rows.column(name).chunks]).astype(np.int64)
    sizes = np.concatenate([x.value_lengths().to_numpy() for x in rows.column("ids").chunks])
    keys = flat("ids") << (TF_BITS + PLACE_BITS) | (MOST_TF - flat("tfs")) << PLACE_BITS | np.repeat(place, sizes)
    keys.sort()
    groups = keys >> PLACE_BITS
    group_at = np.flatnonzero(np.diff(groups, prepend=-1))
    term = groups[group_at] >> TF_BITS
    tf = MOST_TF - (groups[group_at] & MOST_TF)
    term_at = np.flatnonzero(np.diff(term, prepend=-1))
    arrays = [
        docs[order], term[term_at].astype("<i4"), tf[term_at].astype("<i4"), np.append(term_at[1:], len(term)).astype("<i4"),
        tf.astype("<i4"), np.append(group_at[1:], len(keys)).astype("<i4"), (keys & (BLOCK - 1)).astype("<u2"),
    ]
    columns = [pa.array([m], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in arrays)]
    return pa.RecordBatch.from_arrays(columns, ["m", "docs", "terms", "most", "group_ends", "tfs", "posting_ends", "places"])


class Items:
    """The items of a batch: for each the numbers and weights of its terms, and the last of its best scores."""

    def __init__(self, wanted: list[list[int]], weights: np.ndarray) -> None:
        self.wanted = [np.array(ids, np.int64) for ids in wanted]
        self.weights = weights
        self.item = np.repeat(np.arange(len(wanted)), [len(x) for x in wanted])
        self.term = np.concatenate([*self.wanted, np.zeros(0, np.int64)])

    def bounds(self, m: int, terms_: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The most that each item can score where the terms' largest tf are ``most``."""
        best = np.zeros(len(self.weights), np.int64)
        best[terms_] = impacts(most.astype(np.int64), m)
        best *= self.weights
        return np.bincount(self.item, best[self.term], len(self.wanted)).astype(np.int64)  # below 2 ** 53, so exact


class Postings:
    """A block of a stratum, read for scoring."""

    def __init__(self, row: dict, n_terms: int) -> None:
        of = lambda name, kind: np.frombuffer(row[name], kind)
        self.docs = of("docs", "<i8")
        self.places = of("places", "<u2")
        tf, ends = of("tfs", "<i4").astype(np.int64), of("posting_ends", "<i4")
        self.impact = np.repeat(impacts(tf, row["m"]), np.diff(ends, prepend=0))
        ends = ends[of("group_ends", "<i4") - 1]
        self.start, self.end = np.zeros(n_terms, np.int64), np.zeros(n_terms, np.int64)
        terms_ = of("terms", "<i4")
        self.start[terms_], self.end[terms_] = np.append(0, ends[:-1]), ends

    def scores(self, ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.docs), np.int64)
        for start, end, w in zip(self.start[ids].tolist(), self.end[ids].tolist(), weights[ids].tolist()):
            if end > start:
                total[self.places[start:end]] += w * self.impact[start:end]
        return total


class Best:
    """The k best (score, doc_id) of each item so far and the score that a further one must reach."""

    def __init__(self, least: np.ndarray, k: int) -> None:
        self.least, self.k = np.maximum(least, 1), k
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, item: int, scores: np.ndarray, docs: np.ndarray) -> None:
        at = np.flatnonzero(scores >= self.least[item])
        if not len(at):
            return
        known = self.found.get(item, (np.zeros(0, np.int64),) * 2)
        scores, docs = np.append(known[0], scores[at]), np.append(known[1], docs[at])
        order = np.lexsort((docs, -scores))[: self.k]
        self.found[item] = scores[order], docs[order]
        if len(order) == self.k:
            self.least[item] = max(self.least[item], int(scores[order[-1]]))

    def rows(self) -> Iterator[pa.RecordBatch]:
        for item, (scores, docs) in self.found.items():
            columns = [pa.array(np.full(len(docs), item), pa.int64()), pa.array(docs), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])


HITS = "item bigint, doc_id bigint, score bigint"


def _first_visits(index: DataFrame, items: Items) -> DataFrame:
    """block and the items that have one of their FIRST_VISITS highest bounds there; reads no postings."""
    sent = index.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        top = np.zeros((FIRST_VISITS + 1, len(items.wanted)), np.int64)
        blocks = np.full(top.shape, -1)
        for batch in batches:
            for row in batch.to_pylist():
                top[-1] = items.bounds(row["m"], np.frombuffer(row["terms"], "<i4"), np.frombuffer(row["most"], "<i4"))
                blocks[-1] = row["block"]
                order = np.argsort(-top, axis=0, kind="stable")
                top, blocks = np.take_along_axis(top, order, 0), np.take_along_axis(blocks, order, 0)
        for bound, block in zip(top[:-1], blocks[:-1]):
            at = np.flatnonzero(bound)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(block[at]), pa.array(bound[at])], ["item", "block", "bound"])

    found = index.select("block", "m", "terms", "most").mapInArrow(run, "item bigint, block bigint, bound bigint")
    highest = Window.partitionBy("item").orderBy(F.desc("bound"), "block")
    first = found.withColumn("_at", F.row_number().over(highest)).where(F.col("_at") <= FIRST_VISITS)
    return first.groupBy("block").agg(F.collect_list("item").alias("items"))


def _scored(blocks: DataFrame, items: Items, least: np.ndarray, k: int) -> DataFrame:
    """The k best hits (item, doc_id, score) that each task finds: of the items named in column ``items``, or of all
    whose bound in a block reaches their least score."""
    sent = blocks.sparkSession.sparkContext.broadcast((items, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, least = sent.value
        best = Best(least.copy(), k)
        for batch in batches:
            for at in range(batch.num_rows):
                (row,) = batch.slice(at, 1).to_pylist()
                visit = row.get("items")
                if visit is None:
                    bound = items.bounds(row["m"], np.frombuffer(row["terms"], "<i4"), np.frombuffer(row["most"], "<i4"))
                    visit = np.flatnonzero(bound >= best.least).tolist()
                if not visit:
                    continue
                postings = Postings(row, len(items.weights))
                for item in visit:
                    best.add(item, postings.scores(items.wanted[item], items.weights), postings.docs)
        yield from best.rows()

    return blocks.mapInArrow(run, HITS)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _item_terms(items: DataFrame) -> DataFrame:
    """item_id, a number of the item's own and each of its terms once; stored."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [sorted(set(terms(t))) for t in batch.column(1).to_pylist()]
        lists = pa.array(found, pa.list_(pa.binary()))
        return pa.RecordBatch.from_arrays([batch.column(0), lists], ["item_id", "terms"])

    listed = by_arrow(items.select(F.col("item_id").cast("bigint"), "text"), "item_id bigint, terms array<binary>", step)
    return write_and_read(listed.where("size(terms) > 0").withColumn("number", F.monotonically_increasing_id()), "item-terms")


def _search_batch(docs: DataFrame, batch: DataFrame, k: int) -> DataFrame:
    rows = batch.select("item_id", "terms").collect()  # at most about BATCH_TERMS terms
    vocabulary: dict[bytes, int] = defaultdict()
    vocabulary.default_factory = vocabulary.__len__
    wanted = [[vocabulary[bytes(t)] for t in row["terms"]] for row in rows]
    counted = write_and_read(term_counts(docs, dict(vocabulary)), "term-counts")
    n_docs, n_terms = counted.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(vocabulary), np.int64)
    for row in counted.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("df")).collect():
        weights[row["id"]] = weight(n_docs, row["df"])
    items = Items(wanted, weights)

    index = strata(counted.where("doc_id is not null"), n_docs, n_terms)
    least = np.zeros(len(rows), np.int64)
    first = _scored(index.join(_first_visits(index, items), "block"), items, least, k)
    for row in _ranked(first, k).where(F.col("rank") == k).collect():  # one score an item at most
        least[row["item"]] = row["score"]
    ids = docs.sparkSession.sparkContext.broadcast([row["item_id"] for row in rows])

    def named(part: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([ids.value[i] for i in part.column("item").to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([found, *(part.column(c) for c in ("rank", "doc_id", "score"))], ["item_id", "rank", "doc_id", "score"])

    best = _ranked(_scored(index, items, least, k), k)
    return by_arrow(best, "item_id bigint, rank int, doc_id bigint, score bigint", named)


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of each row of ``items``.

    Only scores above 0 count, and equal ones go by doc_id. Null and empty texts have no terms: such documents aren't
    counted, such items have no rows. Rows that repeat a document or an item are documents and items
    of their own. Documents without an id are counted, but can't be named and aren't returned. Empty tables
    give no rows; other columns aren't read.
    """
    listed = _item_terms(items)
    size = listed.agg(F.sum(F.size("terms"))).first()[0] or 0
    batches = max(1, -(-size // BATCH_TERMS))
    part = F.pmod(F.xxhash64("number"), F.lit(batches))
    return reduce(DataFrame.unionByName, [_search_batch(docs, listed.where(part == at), k) for at in range(batches)])
