"""Exact removal of repeated passages: confirmed windows, sharded Aho-Corasick automata.

A window is ``span`` consecutive words. Each has an anchor: the gram of ``span // 2`` words
in it with the smallest hash, so equal windows have equal anchors, and an anchor serves
several windows in a row. Anchors are counted first, then the windows of those
that recur; counts are of hashes, by Spark, and only say where to look. The passages left
(runs of such windows with one anchor, with their words) are dealt out by anchor. Every shard
compiles the word sequences that do recur into automata, a few thousand passages at a time,
and streams its passages through them to locate every occurrence. Equal passages are
one row by then, so a passage in a third of all documents is no hot group.

Filters sent to the tasks are bitmaps of a fixed size; when many more passages recur
than they have bits, they let more through, and the results stay the same.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlake.llm.common import apart, bitmap_of, by_arrow, give_back, in_bitmap, rolled, word_hashes
from featlake.session import write_and_read

BITS = 1 << 27
PASSAGE = "anchor bigint, passage_key bigint, passage binary, doc_id bigint, doc_key bigint, start bigint"
SHARD_PASSAGES = 4_000

#: Passages that a task remembers to have handed on with their words.
REMEMBERED = 200_000

#: Windows in a passage at most; a longer run is cut.
RUN = 32


def split(text: str | None) -> list[bytes]:
    """Words between ASCII white space, unchanged; none for null."""
    return (text or "").encode().split()


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each ``width`` consecutive values, in steps that double."""
    out, done = values, 1
    while done < width:
        ahead = min(done, width - done)
        out, done = pick(out[:-ahead], out[ahead:]), done + ahead
    return out


def anchors(hashes: np.ndarray, span: int) -> np.ndarray:
    """The anchor of each window: the smallest hash of its grams of ``span // 2`` words."""
    if len(hashes) < span:
        return np.zeros(0, np.uint64)
    return _sliding(rolled(hashes, span // 2), span - span // 2 + 1, np.minimum)


def anchor_places(hashes: np.ndarray, span: int) -> np.ndarray:
    """The hash at each place that is the anchor of a window over it, once per place."""
    found, width = anchors(hashes, span), span - span // 2 + 1
    if not len(found):
        return found
    edge = np.zeros(width - 1, np.uint64)
    grams = rolled(hashes, span // 2)
    return grams[grams == _sliding(np.concatenate([edge, found, edge]), width, np.maximum)]


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(BITS)).astype(np.int64)


def _recurring(docs: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """A bitmap of the hashes that ``of(word hashes)`` names more than once over all documents."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, bounds = word_hashes(batch.column(0))
        found = [of(hashes[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["h"])

    counted = by_arrow(docs.select("text"), "h bigint", step).groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    return bitmap_of(counted, F.col("h").bitwiseAND(BITS - 1), BITS)


def passages(docs: DataFrame, span: int) -> DataFrame:
    """Runs of windows that may recur, one row per anchor occurrence, with the words they span.

    Equal passages have equal anchors and keys. A task hands the words of one on once and then leaves them out, as a rule.
    """
    send = docs.sparkSession.sparkContext.broadcast

    again = send(_recurring(docs, lambda h: anchor_places(h, span)))

    def of_windows(h: np.ndarray) -> np.ndarray:
        return rolled(h, span)[in_bitmap(again.value, slots(anchors(h, span)))]

    twice = send(_recurring(docs, of_windows))
    told: set[tuple[int, int]] = set()  # in a task: passages whose words have been handed on

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        hashes, bounds = word_hashes(batch.column(1))
        for k, (doc_id, key) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
            h = hashes[bounds[k] : bounds[k + 1]]
            found = anchors(h, span)
            starts = np.flatnonzero(in_bitmap(again.value, slots(found)))
            starts = starts[in_bitmap(twice.value, slots(rolled(h, span)[starts]))]
            if not len(starts):
                continue
            here = found[starts]
            new = (np.diff(starts, prepend=-2) != 1) | (np.diff(here, prepend=~here[:1]) != 0)
            new |= (np.arange(len(starts)) - np.maximum.accumulate(np.where(new, np.arange(len(starts)), 0))) % RUN == 0
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(starts)) - 1
            anchor = here[first].view(np.int64).tolist()
            split_ = split(batch.column(1)[k].as_py())
            for a, s, e in zip(anchor, starts[first].tolist(), starts[last].tolist()):
                passage = b" ".join(split_[s : e + span])
                name = a, xxhash.xxh3_64_intdigest(passage) - (1 << 63)
                out.append((*name, None if name in told else passage, doc_id, key, s))
                if len(told) >= REMEMBERED:
                    told.clear()
                told.add(name)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)]
        return pa.RecordBatch.from_arrays(columns, ["anchor", "passage_key", "passage", "doc_id", "doc_key", "start"])

    return by_arrow(_keyed(docs), PASSAGE, step)


def _keyed(docs: DataFrame) -> DataFrame:
    doc_id = F.col("doc_id").cast("bigint")
    return docs.select(doc_id.alias("doc_id"), "text", F.xxhash64(doc_id, "text").alias("doc_key"))


def _located(shard: list[tuple], span: int) -> Iterator[tuple]:
    """For each passage: bits of the window offsets that repeat something earlier, in the
    passage's first occurrence and in all its other ones."""
    import ahocorasick

    groups = Counter(row[0] for row in shard)
    together = []
    for row in shard:
        anchor, key, passage, doc, start, count = row
        words = passage.split(b" ")
        windows = len(words) - span + 1
        alone = groups[anchor] == 1 and count > 1
        if alone and len({tuple(words[i : i + span]) for i in range(windows)}) == windows:
            yield anchor, key, doc, start, 0, (1 << windows) - 1  # its windows occur nowhere else
        else:
            together.append(row)
    shard = together
    ids: dict[bytes, int] = {}
    number = lambda w: ids.setdefault(w, len(ids))
    read = [tuple(map(number, row[2].split(b" "))) for row in shard]
    seen: dict[tuple, list] = {}
    for (_, _, _, doc, start, count), sequence in zip(shard, read):
        for i in range(len(sequence) - span + 1):
            place = (doc is not None, doc or 0, start + i)  # null ids come first
            entry = seen.setdefault(sequence[i : i + span], [0, place])
            entry[0] += count
            entry[1] = min(entry[1], place)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for window, (count, place) in seen.items():
        if count > 1:
            automaton.add_word(window, place)
    if not len(automaton):
        return
    automaton.make_automaton()
    for (anchor, key, _, doc, start, _), sequence in zip(shard, read):
        first = rest = 0
        for end, place in automaton.iter(sequence):
            i = end - span + 1
            rest |= 1 << i
            if place < (doc is not None, doc or 0, start + i):
                first |= 1 << i
        if rest:
            yield anchor, key, doc, start, first, rest


def located(found: DataFrame, span: int) -> DataFrame:
    """The passages' repeated offsets, by shards of whole anchors.

    A passage alone with its anchor shares no window with another and stays where its occurrences were
    counted; only passages of anchors that have several meet by anchor. A bitmap of those anchors tells them apart, and
    lets more of the others through when it fills up.
    """
    several = found.groupBy("anchor").agg(F.min("passage_key").alias("low"), F.max("passage_key").alias("high")).where("low <> high")
    sent = found.sparkSession.sparkContext.broadcast(bitmap_of(several, F.col("anchor").bitwiseAND(BITS - 1), BITS))

    def crowded(anchors_: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for anchor in anchors_:
            yield pd.Series(in_bitmap(sent.value, anchor.to_numpy() & (BITS - 1)))

    crowded = F.pandas_udf(crowded, "boolean")
    distinct = found.groupBy("anchor", "passage_key").agg(
        F.any_value("passage", ignoreNulls=True).alias("passage"), F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")
    )
    dealt = distinct.select("anchor", "passage_key", "passage", "first.doc_id", "first.start", "n", crowded("anchor").alias("crowded"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(shard) >= SHARD_PASSAGES and row[0] != shard[-1][0]:
                    yield from emit(shard)
                    shard = []
                shard.append(row)
        if shard:
            yield from emit(shard)
        shard = []
        give_back()

    def emit(shard: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows = list(_located(shard, span))
        if rows:
            kinds = (pa.int64(),) * 6
            names = ["anchor", "passage_key", "first_doc", "first_start", "in_first", "in_rest"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = "anchor bigint, passage_key bigint, first_doc bigint, first_start bigint, in_first bigint, in_rest bigint"
    together = dealt.where("crowded").drop("crowded").repartition("anchor").sortWithinPartitions("anchor")
    return together.mapInArrow(run, schema).unionByName(dealt.where("not crowded").drop("crowded").mapInArrow(run, schema))


def removals(docs: DataFrame, span: int) -> DataFrame:
    """doc_id, doc_key and the windows to remove, as (start, bits of offsets from it)."""
    found = write_and_read(passages(docs, span), "passages")
    masks = write_and_read(located(found, span), "repeated")
    is_first = F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("start") == F.col("first_start"))
    hits = found.drop("passage").join(masks, ["anchor", "passage_key"]).select(
        "doc_id", "doc_key", "start", F.when(is_first, F.col("in_first")).otherwise(F.col("in_rest")).alias("bits")
    )
    return hits.where("bits <> 0").groupBy("doc_id", "doc_key").agg(F.collect_set(F.struct("start", "bits")).alias("windows"))


def deduplicated(docs: DataFrame, span: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text of every row, with the other columns of ``docs``.

    A word goes if a window that covers it has the same words as a window that starts earlier:
    in a smaller doc_id, or earlier in the same document. Windows are judged on the
    input. Kept words are joined by one space; a null text has none. A null id counts as
    smaller than any other. Rows that repeat an id are read side by side: what they
    have at the same place isn't earlier in either. The columns n_words, n_removed and
    kept_text replace columns of those names.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "n_words", "n_removed", "kept_text")]
    doc_id = F.col("doc_id").cast("bigint")
    rows = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, "text").alias("_key"), *(F.col(f"`{c}`") for c in others))
    gone = removals(docs, span).select(F.col("doc_id").alias("_id"), F.col("doc_key").alias("_doc_key"), F.col("windows").alias("_windows"))
    gone = write_and_read(gone, "removals")
    # texts that lose nothing stay where they are; the others meet their windows by a shuffle
    hit, whole = apart(rows, gone.select(F.col("_doc_key").alias("_key")), "_key")
    joined = hit.join(gone, hit._key.eqNullSafe(gone._doc_key) & hit.doc_id.eqNullSafe(gone._id), "left")
    columns = ["doc_id", *(F.col(f"`{c}`") for c in others)]
    given = joined.select(*columns, "_windows").unionByName(
        whole.select(*columns, F.lit(None).cast(gone.schema["_windows"].dataType).alias("_windows"))
    )
    text = given.columns.index("text")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_removed, kept = [], [], []
        for t, windows in zip(batch.column(text).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
            words = split(t)
            n_words.append(len(words))
            if windows:
                cover = np.zeros(len(words) + 1, np.int64)
                for w in windows:
                    bits, at = w["bits"], w["start"]
                    while bits:
                        if bits & 1:
                            cover[at] += 1
                            cover[at + span] -= 1
                        bits >>= 1
                        at += 1
                left = np.cumsum(cover[:-1]) == 0
                words = [w for w, k in zip(words, left.tolist()) if k]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words).decode())
        columns = [batch.column(k) for k in range(batch.num_columns - 1)]
        columns += [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", *others, "n_words", "n_removed", "kept_text"])

    schema = given.drop("_windows").schema.add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    return by_arrow(given, schema, step)
