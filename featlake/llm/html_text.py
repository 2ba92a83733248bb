"""Main text of web pages by a recurrent block labeller.

A page is read as the sequence of its leaf blocks. Each block is a vector of its
hashed tag path (names, classes, ids), its hashed words and a few measures. A
bidirectional LSTM in numpy reads the whole sequence, so every block is labelled in
the context of the document. It is trained on a bounded sample of pages; the labels come
from the elements that say what they are (article, nav, footer, ...), and half of the pages
are shown without those names, so that the words, measures and context carry weight.
"""

from __future__ import annotations

import html
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlake.llm.common import by_arrow

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>",
    re.DOTALL,
)
NAMES_IN = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
PART = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style noscript template svg math iframe object head textarea select button canvas audio video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike"
    " strong sub sup time tt u var wbr".split()
)
CLOSES = {"li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}

MAIN = frozenset("article main".split())
ASIDE = frozenset(
    "nav header footer aside form menu ad ads advert advertisement sidebar banner cookie consent notice popup promo"
    " sponsor sponsored comment comments reply replies breadcrumb breadcrumbs related share social newsletter subscribe login search"
    " widget copyright disclaimer alert modal toolbar pagination".split()
)

PATH_SIZE, WORD_SIZE, MEASURES, HIDDEN = 96, 32, 6, 16
SIZE = PATH_SIZE + WORD_SIZE + MEASURES

Block = tuple[tuple[str, ...], str, float]  # path names, text, share of the text in links


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order; scripts, styles, head and controls aren't read."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = at = 0
    in_link = False

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            names = tuple(n for _, found in stack for n in found)
            out.append((names, text, min(1.0, linked / max(1, len(text)))))
        parts.clear()
        linked = 0

    def close(names: str, within: int = 0) -> None:
        wanted = names.split()
        for k in range(len(stack) - 1, within - 1, -1):
            if stack[k][0] in wanted:
                del stack[k:]
                return

    while True:
        tag = TAG.search(page, at)
        text = page[at : tag.start() if tag else len(page)]
        if text:
            parts.append(text)
            linked += len(text) * in_link
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        ending, rest = bool(tag[1] or tag[4]), tag[3] or tag[6] or ""
        if not name:
            continue
        if name == "a":
            in_link = not ending
        if name in INLINE:
            if name in ("br", "img"):
                parts.append(" ")
            continue
        flush()
        if ending:
            close(name)
        elif name in UNREAD:
            if not rest.endswith("/"):
                end = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else (at if name == "head" else len(page))
        elif name not in VOID:
            close("p")
            if name in CLOSES:
                lists = [k for k, (n, _) in enumerate(stack) if n in ("ul", "ol", "dl", "table", "select")]
                close(CLOSES[name], lists[-1] if lists else 0)
            given = [p for m in NAMES_IN.finditer(rest) for p in PART.findall((m[1] or m[2] or m[3] or "").lower())]
            stack.append((name, (name, *given)))
    flush()
    return out


def silver(found: list[Block]) -> list[int]:
    """Labels by the elements that name themselves: in an article (or in no place at all, where
    the page has no article) and not in a part that is known to be something else."""
    has_main = any(MAIN.intersection(names) for names, _, _ in found)
    return [int(not ASIDE.intersection(n) and bool(MAIN.intersection(n) or not has_main)) for n, _, _ in found]


_slots: dict[str, int] = {}


def _slot(word: str, size: int) -> int:
    key = f"{size}:{word}"
    if key not in _slots:
        if len(_slots) > 300_000:
            return zlib.crc32(word.encode()) % size
        _slots[key] = zlib.crc32(word.encode()) % size
    return _slots[key]


def vectors(found: list[Block], hide: bool = False) -> np.ndarray:
    """A row per block: hashed path names, hashed words, measures."""
    out = np.zeros((len(found), SIZE), np.float32)
    known = MAIN | ASIDE
    for k, (names, text, links) in enumerate(found):
        for n in names[-12:] if len(names) > 12 else names:
            if not (hide and n in known):
                out[k, _slot(n, PATH_SIZE)] = 1
        words = text.lower().split()
        counts = np.bincount([_slot(w, WORD_SIZE) for w in words], minlength=WORD_SIZE)
        out[k, PATH_SIZE : PATH_SIZE + WORD_SIZE] = counts / max(1.0, math.sqrt(float((counts**2).sum())))
        place = (k + 1) / len(found)
        ends = text.count(".") + text.count("?") + text.count("!")
        out[k, -MEASURES:] = math.log1p(len(text)) / 6, math.log1p(len(words)) / 5, links, place, ends / max(1, len(words)), 1
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, mask: np.ndarray, w: dict, side: str, keep: bool = False) -> tuple[np.ndarray, list]:
    """Hidden states (time, batch, HIDDEN); a masked step keeps the state."""
    steps, batch, _ = x.shape
    h = c = np.zeros((batch, HIDDEN), np.float32)
    out, cache = np.zeros((steps, batch, HIDDEN), np.float32), []
    given = x @ w[side + "x"] + w[side + "b"]
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        z = given[t] + h @ w[side + "h"]
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        c_new = f * c + i * g
        tc = np.tanh(c_new)
        if keep:
            cache.append((t, h, c, i, f, o, g, tc, m))
        h, c = m * (o * tc) + (1 - m) * h, m * c_new + (1 - m) * c
        out[t] = h
    return out, cache


def _lstm_grad(dout: np.ndarray, x: np.ndarray, w: dict, side: str, cache: list, grads: dict) -> None:
    dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
    for t, h0, c0, i, f, o, g, tc, m in reversed(cache):
        dh = dh + dout[t]
        dht = dh * m
        dct = dc * m + dht * o * (1 - tc**2)
        dz = np.concatenate([dct * g * i * (1 - i), dct * c0 * f * (1 - f), dht * tc * o * (1 - o), dct * i * (1 - g**2)], 1)
        grads[side + "x"] += x[t].T @ dz
        grads[side + "h"] += h0.T @ dz
        grads[side + "b"] += dz.sum(0)
        dh = dh * (1 - m) + dz @ w[side + "h"].T
        dc = dc * (1 - m) + dct * f


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((steps, len(pages), SIZE), np.float32), np.zeros((steps, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


def train(pages: list[tuple[np.ndarray, list[int]]], epochs: int = 30, rate: float = 0.01, seed: int = 7) -> dict:
    """Weights of the labeller by Adam over batches of 16 pages of similar length."""
    rng = np.random.default_rng(seed)
    w = {"out": rng.normal(0, 0.1, (2 * HIDDEN, 1)), "skip": np.zeros((SIZE, 1)), "bias": np.zeros(1)}
    for side in "fb":
        w |= {side + "x": rng.normal(0, 0.1, (SIZE, 4 * HIDDEN)), side + "h": rng.normal(0, 0.1, (HIDDEN, 4 * HIDDEN)), side + "b": np.zeros(4 * HIDDEN)}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    pages = sorted((p for p in pages if len(p[1])), key=lambda p: len(p[1]))
    groups = [pages[k : k + 16] for k in range(0, len(pages), 16)]
    for _ in range(epochs):
        for k in rng.permutation(len(groups)):
            x, mask = padded([p for p, _ in groups[k]])
            y = np.zeros(mask.shape, np.float32)
            for j, (_, labels) in enumerate(groups[k]):
                y[: len(labels), j] = labels
            hf, cf = _lstm(x, mask, w, "f", True)
            hb, cb = _lstm(x, mask, w, "b", True)
            hidden = np.concatenate([hf, hb], 2)
            d = ((_sigmoid((hidden @ w["out"] + x @ w["skip"])[:, :, 0] + w["bias"]) - y) * mask / mask.sum())[:, :, None]
            grads = {n: np.zeros_like(v) for n, v in w.items()}
            grads["out"], grads["skip"], grads["bias"] = np.einsum("tbh,tbo->ho", hidden, d), np.einsum("tbh,tbo->ho", x, d), d.sum((0, 1))
            dh = d @ w["out"].T
            _lstm_grad(dh[:, :, :HIDDEN], x, w, "f", cf, grads)
            _lstm_grad(dh[:, :, HIDDEN:], x, w, "b", cb, grads)
            step += 1
            for n in w:
                first[n] = 0.9 * first[n] + 0.1 * grads[n]
                second[n] = 0.999 * second[n] + 0.001 * grads[n] ** 2
                w[n] = w[n] - (rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return w


def chances(pages: list[np.ndarray], w: dict) -> list[np.ndarray]:
    """For each page, the chance of each block to be main text; pages of like length go together."""
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
    at = 0
    while at < len(order):
        few = max(1, min(256, 200_000 // len(pages[order[min(at + 255, len(order) - 1)]])))
        part = order[at : at + few]
        x, mask = padded([pages[k] for k in part])
        hidden = np.concatenate([_lstm(x, mask, w, s)[0] for s in "fb"], 2)
        p = _sigmoid((hidden @ w["out"] + x @ w["skip"])[:, :, 0] + w["bias"])
        for j, k in enumerate(part):
            out[k] = p[: len(pages[k]), j]
        at += few
    return out


def fit(pages: DataFrame, max_pages: int = 400) -> dict:
    """Weights from a bounded sample: ``max_pages`` pages chosen by a hash of the id.

    An empty table gives a labeller that keeps nothing certain: weights at their start.
    """
    rows = pages.where(F.col("html").isNotNull()).select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(max_pages)
    chosen = pages.select("page_id", "html").join(F.broadcast(rows.distinct()), "page_id")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, labels = [], []
        for page_id, page in zip(*(c.to_pylist() for c in batch.columns)):
            found = blocks(page)
            raw.append(vectors(found, hide=zlib.crc32(str(page_id).encode()) % 2 == 0).tobytes())
            labels.append(silver(found))
        columns = [batch.column(0).cast(pa.int64()), pa.array(raw, pa.binary()), pa.array(labels, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, ["page_id", "raw", "labels"])

    sample = by_arrow(chosen, "page_id bigint, raw binary, labels array<int>", step).orderBy("page_id").collect()
    return train([(np.frombuffer(r["raw"], np.float32).reshape(-1, SIZE), r["labels"]) for r in sample])


def extract(pages: DataFrame, weights: dict) -> DataFrame:
    """page_id, url, text and n_chars of every row: the blocks labelled main text, one a line.

    Null and empty html, and pages without main text, give an empty text. Rows that
    repeat are each returned.
    """
    sent = pages.sparkSession.sparkContext.broadcast(weights)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [blocks(p) for p in batch.column(2).to_pylist()]
        labels = chances([vectors(f) for f in found], sent.value)
        texts = ["\n".join(b[1] for b, p in zip(f, c) if p >= 0.5) for f, c in zip(found, labels)]
        columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    given = pages.select(F.col("page_id").cast("bigint"), "url", "html")
    return by_arrow(given, "page_id bigint, url string, text string, n_chars bigint", step)
