"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, word pairs and pairs that skip one word, hashed
into ``2 ** BITS`` slots. Shards of the labelled sample are trained side by side, with a rate
for each coordinate and an L1 threshold that keeps most weights at zero; their
weights are averaged. The weights left are few and of bounded number, and are sent
to the tasks that score whole texts.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlake.llm.common import MIX_1, MIX_2, Words, by_arrow, held_out, int_lists
from featlake.session import write_and_read

BITS = 20
BIAS = 1 << BITS
WORD = re.compile(r"\w+")


def slots(text: str | None, words: Words) -> np.ndarray:
    """Feature slots of a whole text, repeats included; none if it has no word."""
    h = words.of(WORD.findall((text or "").lower()))
    shift = np.uint64(64 - BITS)
    pair = lambda a, b: ((a * MIX_1) ^ (b * MIX_2 + MIX_1)) * MIX_1 >> shift
    return np.concatenate([h * MIX_1 >> shift, pair(h[:-1], h[1:]), pair(h[:-2], ~h[2:])]).astype(np.int64)


def train(rows: list[tuple[int, np.ndarray]], alpha=3.0, beta=1.0, l1=4.0, l2=0.0, epochs=3) -> np.ndarray:
    """Weights by FTRL-proximal over (label, distinct slots) in order, ``epochs`` times."""
    z, n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for label, found in rows:
            at = np.append(found, BIAS)
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - label
            after = ni + g * g
            z[at] = zi + g - (np.sqrt(after) - np.sqrt(ni)) / alpha * w
            n[at] = after
    return weights(z, n)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, shard_rows: int = 8_000) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights, learned from labelled rows that aren't held out.

    Bounded sample: about ``max_rows`` labelled documents, chosen by a hash of the id.
    Rows with a null label are left out; of repeated ids the larger label counts. Each shard has about ``shard_rows`` or more.
    """
    usable = labels.where(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    rows = usable.count()
    share = min(1.0, max_rows / max(1, rows))
    shards = max(1, min(rows, max_rows) // shard_rows)
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "_toxic")
    words = Words()

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.unique(slots(t, words)) for t in batch.column(1).to_pylist()]
        lists = int_lists(np.concatenate([np.zeros(0, np.int64), *found]), [len(x) for x in found], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), lists], ["doc_id", "toxic", "slots"])

    def learn(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["order", "doc_id"], kind="stable")
        w = train([(y, np.asarray(x)) for y, x in zip(frame.toxic, frame.slots)])
        at = np.flatnonzero(w)
        return pd.DataFrame({"slot": at, "w": w[at]})

    sample = write_and_read(by_arrow(texts, "doc_id bigint, toxic int, slots array<bigint>", features), "toxic-sample")
    order = F.xxhash64("doc_id", F.lit("shard"))
    sharded = sample.withColumn("order", order).withColumn("shard", F.pmod(order, F.lit(shards)))
    found = (
        sharded.groupBy("shard")
        .applyInPandas(learn, "slot bigint, w double")
        .groupBy("slot")
        .agg((F.sum("w") / shards).alias("w"))
        .toPandas()
    )
    return found["slot"].to_numpy(np.int64), found["w"].to_numpy(np.float64)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) and ``predicted`` of every row by its text alone.

    Null and empty texts get the score of the bias.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    state: list = []

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            dense = np.zeros(BIAS + 1, np.float64)
            dense[sent.value[0]] = sent.value[1]
            state.extend([dense, Words()])
        dense, words = state
        total = np.zeros(batch.num_rows)
        for k, text in enumerate(batch.column(1).to_pylist()):
            found = slots(text, words)
            total[k] = dense[np.unique(found[dense[found] != 0])].sum() + dense[BIAS]
        p = 1 / (1 + np.exp(-np.clip(total, -700, 700)))
        columns = [batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted"])

    return by_arrow(docs.select("doc_id", "text"), "doc_id bigint, score double, predicted int", step)
