"""Language of whole texts by cross-parsing against suffix automata of labelled text.

A text is parsed greedily into the longest phrases that occur in a language's
reference text; the language that needs the fewest phrases per letter wins. The
automaton's transitions are one table: a missing transition ends the phrase and
starts the next at the same character, which the table marks by the sign; a letter that a
language doesn't have is passed over after that. Texts are
cut into stretches that are stepped through side by side, whole texts throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from featlake.llm.common import by_arrow, held_out

UNDETERMINED = "und"
PAD, OTHER, GAP = 0, 1, 2  # classes of no character, of unknown letters, of what isn't a letter
STRETCH = 256


def letters_table() -> np.ndarray:
    """For each code point of the basic plane: its lower-case letter, 0 if it is no letter."""
    points = [chr(x) for x in range(0x10000)]
    return np.array([ord(c.lower()[0]) if c.isalpha() else 0 for c in points], np.uint32)


def automaton(text: np.ndarray, classes: int) -> np.ndarray:
    """The table of a suffix automaton: table[state * classes + class] is the next state times
    ``classes``; its complement (negative) where the phrase ended before that character."""
    trans: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for c in text.tolist():
        new = len(trans)
        trans.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        p = last
        while p != -1 and c not in trans[p]:
            trans[p][c] = new
            p = link[p]
        if p != -1:
            q = trans[p][c]
            if longest[p] + 1 == longest[q]:
                link[new] = q
            else:
                clone = len(trans)
                trans.append(dict(trans[q]))
                link.append(link[q])
                longest.append(longest[p] + 1)
                while p != -1 and trans[p].get(c) == q:
                    trans[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    restart = np.zeros(classes, np.int32)
    for c, state in trans[0].items():
        restart[c] = state * classes
    table = np.tile(~restart, (len(trans), 1)).astype(np.int32)
    for state, nexts in enumerate(trans):
        for c, to in nexts.items():
            table[state, c] = to * classes
    table[:, PAD] = np.arange(len(trans)) * classes
    return table.ravel()


class Parser:
    """Reference tables by language, and phrase counts of texts."""

    def __init__(self, references: dict[str, str]) -> None:
        self.languages = sorted(references)
        self.lower = letters_table()
        seen = {}
        for text in references.values():
            points, counts = np.unique(self._letters(text), return_counts=True)
            for p, n in zip(points.tolist(), counts.tolist()):
                seen[p] = seen.get(p, 0) + n
        seen.pop(0, None)
        known = sorted(seen, key=lambda p: (-seen[p], p))[:120]
        self.width = len(known) + 3
        self.classes = np.full(0x110000, OTHER, np.uint8)
        self.classes[0] = GAP
        self.classes[known] = np.arange(3, self.width)
        self.tables = [automaton(self._classed(references[x]), self.width) for x in self.languages]

    def _letters(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        out = self.lower[np.minimum(points, 0xFFFF)]
        for at in np.flatnonzero(points > 0xFFFF):
            out[at] = points[at] if chr(points[at]).isalpha() else 0
        return out

    def _classed(self, text: str) -> np.ndarray:
        """Classes of the letters, runs of anything else as one gap."""
        out = self.classes[self._letters(text)]
        gap = out == GAP
        again = gap.copy()
        again[1:] &= gap[:-1]
        return out[~again]

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Phrase counts (languages x texts) and whether each text has a letter."""
        rows, owner, has = [], [], np.zeros(len(texts), bool)
        for k, text in enumerate(texts):
            if not text:
                continue
            classed = self._classed(text)
            has[k] = bool((classed != GAP).any())
            if has[k]:
                cut = np.zeros(-(-len(classed) // STRETCH) * STRETCH, np.uint8)
                cut[: len(classed)] = classed
                rows.append(cut.reshape(-1, STRETCH))
                owner += [k] * len(rows[-1])
        counts = np.zeros((len(self.tables), len(texts)), np.int64)
        if not rows:
            return counts, has
        steps = np.ascontiguousarray(np.concatenate(rows).T)
        for k, states in enumerate(self.tables):
            at = np.zeros(steps.shape[1], np.int32)
            ended = np.zeros(steps.shape[1], np.int32)
            for step in steps:
                at = states.take(at + step)
                sign = at >> 31
                ended -= sign
                at ^= sign
            counts[k] = np.bincount(owner, ended, len(texts)).astype(np.int64)
        return counts + 1, has


def fit(docs: DataFrame, per_language: int = 64, reference_chars: int = 8192) -> dict[str, str]:
    """Reference text by language from rows with text and lang that aren't held out.

    Bounded sample: ``per_language`` documents of each language, chosen by a hash of
    the id, and ``reference_chars`` characters of them in all.
    """
    usable = docs.where(~held_out() & F.col("lang").isNotNull() & (F.length("text") > 0))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = (
        usable.select("doc_id", "lang")
        .withColumn("_at", F.row_number().over(order))
        .where(F.col("_at") <= per_language)
        .select("doc_id", "lang")
        .distinct()
    )
    chosen = usable.select("doc_id", "lang", F.substring("text", 1, reference_chars // 4).alias("text"))
    texts: dict[str, list[str]] = {}
    for row in chosen.join(F.broadcast(ids), ["doc_id", "lang"]).orderBy("doc_id", "text").collect():
        texts.setdefault(row["lang"], []).append(row["text"])
    out = {}
    for lang, found in texts.items():
        share = -(-reference_chars // len(found))
        out[lang] = "\n".join([x[:share] for x in found] + [x[share:] for x in found])[:reference_chars]
    return out


def predict(docs: DataFrame, references: dict[str, str], carried: list[str] | None = None) -> DataFrame:
    """``carried`` (default: doc_id), ``lang_pred`` and ``score`` of every row by its text alone.

    ``und`` and 0 for a text that is null or has no letter, and where no language was
    learned. Ties go to the language first in order. The score is one minus the ratio
    of the best phrase count to the next best, 1 with one language only.
    """
    sent = docs.sparkSession.sparkContext.broadcast(references)
    parsers: list[Parser] = []
    carried = carried or ["doc_id"]
    given = docs.select("text", *(F.col(f"`{c}`") for c in carried))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not parsers:
            parsers.append(Parser(sent.value))
        parser = parsers[0]
        texts = batch.column(0).to_pylist()
        names = np.array([*parser.languages, UNDETERMINED], object)
        best, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
        if parser.languages:
            counts, has = parser.phrases(texts)
            ranked = np.sort(counts, axis=0)
            sure = 1 - ranked[0] / ranked[1] if len(ranked) > 1 else np.ones(len(texts))
            best = np.where(has, np.argmin(counts, axis=0), best)
            score = np.where(has, sure, 0.0)
        columns = [*batch.columns[1:], pa.array(names[best], pa.string()), pa.array(score, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, [*carried, "lang_pred", "score"])

    schema = StructType([*(docs.schema[c] for c in carried), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return by_arrow(given, schema, step)
