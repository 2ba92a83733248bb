"""Token ids of whole texts by a public tokenizer, each distinct word of a batch looked up once.

The tokenizer drops white space before it splits words, so the ids of a text are
the ids of its white-space-free chunks in order. The chunks of a batch are numbered in Arrow, and only
distinct ones are looked at further. Chunks of plain letters, digits and signs are cut into the tokenizer's own
words, numbered again; new words are encoded many at a time: the last id of each word is one of
those that end a word. Any other chunk goes to the tokenizer whole. The ids of the texts are then gathered
from those of words by offsets, in numpy.
"""

from __future__ import annotations

import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words a worker remembers, some 100 bytes each; those it meets first, so the common ones. Others are
#: encoded anew in each batch.
REMEMBERED = 200_000

#: Words given to the tokenizer as one text.
TOGETHER = 500

# Letters of Latin-1, chunks whose words need no Unicode rule, and the word pattern of the
# tokenizer file for lower-case chunks of that kind.
LETTERS = "a-z\xdf-\xf6\xf8-\xff"
PLAIN = "^[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+$"
WORD = f"('s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+)"


class Runs:
    """Runs of ids, one after the other; ``lengths`` and ``starts`` by number of the run."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.ids, self.lengths = ids, lengths
        self.starts = np.cumsum(lengths) - lengths

    def gathered(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbered runs in order, and the length of each."""
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.starts[numbers] - (ends - lengths), lengths) + np.arange(total)
        return self.ids[at], lengths


class Encoder:
    """Texts to the bytes of their ids (``dtype``, little-endian), the end id last; null is empty."""

    def __init__(self, path: str, end_id: int = 0, dtype: str = "<u4") -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype(dtype)
        self.end = np.array([end_id], self.dtype)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, token_id in vocabulary.items():
            self.ends_word[token_id] = token.endswith("</w>")
        self.known: dict[str, int] = {"": 0}
        self.ids, self.lengths = np.zeros(0, self.dtype), np.zeros(1, np.int64)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.dtype) for x in found]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), TOGETHER):
            some = words[at : at + TOGETHER]
            (found,) = self._encode([" ".join(some)])
            ends = np.flatnonzero(self.ends_word[found]) + 1
            if len(ends) != len(some):
                raise ValueError("the tokenizer file doesn't end each word with an end-of-word token")
            ids.append(found)
            lengths.append(np.diff(ends, prepend=0))
        return np.concatenate(ids), np.concatenate(lengths)

    def _runs_of_words(self, words: np.ndarray) -> tuple[Runs, np.ndarray]:
        """Runs that hold the given distinct words, and the number of each word among them."""
        numbers = np.array(list(map(self.known.get, words, repeat(-1))), np.int64)
        missing = np.flatnonzero(numbers < 0)
        first = len(self.lengths)
        numbers[missing] = np.arange(first, first + len(missing))
        new = words[missing].tolist()
        ids, lengths = self._encode_words(new)
        ids, lengths = np.concatenate([self.ids, ids]), np.concatenate([self.lengths, lengths])
        kept = new[: max(0, REMEMBERED - len(self.known))]
        if kept:
            self.known.update(zip(kept, range(first, first + len(kept))))
            self.lengths = lengths[: first + len(kept)]
            self.ids = ids[: int(self.lengths.sum())]
        return Runs(ids, lengths), numbers

    def _runs_of_chunks(self, chunks: pa.StringArray) -> Runs:
        """One run for each of the distinct chunks."""
        plain = pc.and_not(pc.match_substring_regex(chunks, PLAIN), pc.match_substring(chunks, "<|")).to_numpy(zero_copy_only=False)
        plain |= pc.equal(chunks, "").to_numpy(zero_copy_only=False)
        low = pc.utf8_lower(chunks.filter(pa.array(plain)))
        mixed = pc.match_substring_regex(low, f"[^{LETTERS}]")
        low = pc.replace_with_mask(low, mixed, pc.replace_substring_regex(low.filter(mixed), WORD, r"\1 "))
        cut = pc.ascii_split_whitespace(low)
        words = cut.flatten().dictionary_encode()
        runs, numbers = self._runs_of_words(words.dictionary.to_numpy(zero_copy_only=False))
        ids, lengths = runs.gathered(numbers[words.indices.to_numpy()])
        bounds = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(cut.value_lengths().to_numpy()))]
        others = self._encode(chunks.filter(pa.array(~plain)).to_pylist())
        every = np.empty(len(chunks), np.int64)
        every[plain], every[~plain] = np.diff(bounds), [len(x) for x in others]
        # runs of plain chunks come first, then those of the others; put them in the order of the chunks
        apart = Runs(np.concatenate([ids, *others]), np.append(every[plain], every[~plain]))
        order = np.empty(len(chunks), np.int64)
        order[np.append(np.flatnonzero(plain), np.flatnonzero(~plain))] = np.arange(len(chunks))
        return Runs(*apart.gathered(order))

    def __call__(self, texts: list[str | None] | pa.StringArray) -> list[bytes]:
        given = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.ascii_split_whitespace(pc.fill_null(given, ""))
        words = split.flatten().dictionary_encode()
        runs = self._runs_of_chunks(words.dictionary)
        counts = split.value_lengths().to_numpy()
        ends = np.cumsum(counts + 1) - 1
        numbers = np.full(int(counts.sum()) + len(counts), len(runs.lengths))
        inside = np.ones(len(numbers), bool)
        inside[ends] = False
        numbers[inside] = words.indices.to_numpy()
        ids, lengths = Runs(np.append(runs.ids, self.end), np.append(runs.lengths, 1)).gathered(numbers)
        bounds = np.cumsum(lengths)[ends] * self.dtype.itemsize
        raw = ids.tobytes()
        return [raw[start:end] for start, end in zip([0, *bounds.tolist()], bounds.tolist())]


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int, dtype: str) -> Encoder:
    """One encoder per worker and setting."""
    key = (path, end_id, dtype)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
