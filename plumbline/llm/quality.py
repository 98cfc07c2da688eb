"""Document quality from a linear-chain conditional random field over lines.

Each line gets one of two labels, bad or good, from features of the line and of its two
neighbours and from the label before it. Forward-backward gives every line's marginal
probability of being good; a document's quality is their mean, weighted by line length,
put through a logistic curve fitted on the same labelled sample.

Labels are per document, so learning alternates twice: fit the field to the line labels
(at first the document's label), then let lines of bad documents that the field finds
clearly good become good, as long as the document keeps a bad line.

Learning takes at most SAMPLE labelled documents, those with the smallest hashes of their
ids, and of these as many, in that order, as have LINES lines together; nothing else is
bounded.

Edge cases: a null or empty text is one empty line and is scored as such. Rows without a
label, or with a null one, teach nothing; with no labels at all every score is 0.5.
Repeated rows are scored each. Other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrays

#: Bounds of the learning sample; rounds of relabelling; steps of the optimiser; ridge.
SAMPLE, LINES, ROUNDS, STEPS, RIDGE = 3000, 300_000, 2, 120, 1e-3
_UPPER, _LOWER, _DIGIT, _SPACE, _POINT, _SYMBOL, _BAR, _BANG, _HIGH = range(9)


def _classes() -> np.ndarray:
    out = np.full(256, _SYMBOL, np.uint8)
    for kind, chars in ((_UPPER, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (_LOWER, "abcdefghijklmnopqrstuvwxyz"), (_DIGIT, "0123456789"), (_SPACE, " \t\r"), (_POINT, ".,;:'\"?()-"), (_BAR, "|"), (_BANG, "!")):
        out[[ord(c) for c in chars]] = kind
    out[128:] = _HIGH
    return out


def _letters() -> np.ndarray:
    """The class of the second byte of each two-byte sequence: upper and lower case letters, as Unicode has them."""
    out = np.full(1 << 16, _HIGH, np.uint8)
    for code in range(0x80, 0x800):
        first, second = chr(code).encode()
        if chr(code).isalpha():
            out[first << 8 | second] = _UPPER if chr(code).isupper() else _LOWER
    return out


_CLASS, _TWO = _classes(), _letters()


def kinds(buf: np.ndarray) -> np.ndarray:
    """The class of each byte; of a letter of two bytes the second has the letter's."""
    out = _CLASS[buf]
    high = np.flatnonzero(buf[1:] >= 128) + 1
    out[high] = _TWO[buf[high - 1].astype(np.int32) << 8 | buf[high]]
    return out


def lines(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines, and each text's first line number; a text has one line at least."""
    breaks = np.flatnonzero(buf == 10)
    counts = np.diff(np.searchsorted(breaks, off)) + 1
    first = np.concatenate([[0], np.cumsum(counts)])
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    is_first, is_last = np.zeros(first[-1], bool), np.zeros(first[-1], bool)
    is_first[first[:-1]], is_last[first[1:] - 1] = True, True
    starts[is_first], starts[~is_first] = off[:-1], breaks + 1
    ends[is_last], ends[~is_last] = off[1:], breaks
    return starts, ends, first


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features [lines, width] of zeros and ones, line lengths in bytes, and each text's first line."""
    starts, ends, first = lines(buf, off)
    size = ends - starts
    kind = kinds(buf)

    def count(mask: np.ndarray) -> np.ndarray:
        run = np.zeros(len(mask) + 1, np.int32)
        np.cumsum(mask, out=run[1:], dtype=np.int32)
        return run[ends] - run[starts]

    n = np.maximum(size, 1)
    upper, lower, digit, space, symbol, bar, bang = (count(kind == k) for k in (_UPPER, _LOWER, _DIGIT, _SPACE, _SYMBOL, _BAR, _BANG))
    letters = np.maximum(upper + lower, 1)
    words = space + 1
    sums = arrays.prefix_sums(buf)
    hashes = arrays.range_hash(sums, starts, ends)
    word_from, word_to, _ = arrays.words(buf, off)
    word = arrays.range_hash(sums, word_from, word_to)
    in_line = np.searchsorted(starts, word_from, side="right") - 1
    stuck = np.flatnonzero((word[1:] == word[:-1]) & (in_line[1:] == in_line[:-1])) + 1
    stutter = np.bincount(in_line[stuck], minlength=len(starts))
    owner = np.repeat(np.arange(len(off) - 1), np.diff(first))
    _, codes, times = np.unique(np.stack([hashes, owner.astype(np.uint64)]), axis=1, return_inverse=True, return_counts=True) if len(hashes) else (None, np.zeros(0, int), np.zeros(0, int))
    again = (times[codes.ravel()] > 1) & (size > 0)
    last = np.where(size > 0, buf[np.maximum(ends - 1, 0)] if len(buf) else 0, 0)
    alone = np.repeat(np.diff(first) == 1, np.diff(first))
    got = [
        np.ones(len(size), bool), size == 0, size < 20, size >= 80, size >= 400,
        upper > 0.3 * letters, upper > 0.7 * letters, symbol > 0.02 * n, symbol > 0.1 * n,
        bar > 0.01 * n, bar > 0.05 * n, bang > 0.02 * n, digit > 0.05 * n, digit > 0.2 * n,
        again, (last == 46) | (last == 63), (last == 33), n > 12 * words, n < 4 * words, lower == 0, alone,
        stutter > 0.1 * words, stutter > 0.4 * words,
    ]
    return np.stack(got, 1).astype(np.float32), size, first


def around(base: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Features of each line beside those of the line before and the line after in its text."""
    before, after = np.zeros_like(base), np.zeros_like(base)
    before[1:], after[:-1] = base[:-1], base[1:]
    before[first[:-1]], after[first[1:] - 1] = 0, 0
    return np.concatenate([base, before, after], 1)


def marginals(emit: np.ndarray, first: np.ndarray, trans: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals [lines, 2], transition counts summed over all texts by their weights, and log partition of each text.

    All texts take a step together: those with the most lines stand first.
    """
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    begin, length = first[:-1][order], counts[order]
    steps = int(length[0]) if len(length) else 0
    live = np.searchsorted(-length, -np.arange(1, steps + 1), side="right")
    alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
    for t in range(steps):
        at = begin[: live[t]] + t
        if t == 0:
            alpha[at] = emit[at]
        else:
            x = alpha[at - 1][:, :, None] + trans[None]
            top = x.max(1)
            alpha[at] = emit[at] + top + np.log(np.exp(x - top[:, None, :]).sum(1))
    for t in range(steps - 2, -1, -1):
        at = begin[: live[t + 1]] + t
        x = trans[None] + (emit[at + 1] + beta[at + 1])[:, None, :]
        top = x.max(2)
        beta[at] = top + np.log(np.exp(x - top[:, :, None]).sum(2))
    ends = first[1:] - 1
    top = alpha[ends].max(1)
    z = top + np.log(np.exp(alpha[ends] - top[:, None]).sum(1))
    zs = np.repeat(z, counts)
    inner = np.ones(len(emit), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    pair = np.exp(alpha[at - 1][:, :, None] + trans[None] + (emit[at] + beta[at])[:, None, :] - zs[at][:, None, None])
    pair = pair.sum(0) if weight is None else np.tensordot(np.repeat(weight, counts)[at], pair, 1)
    return np.exp(alpha + beta - zs[:, None]), pair, z


class Field:
    """Weights of the field: features for label good, and transitions."""

    def __init__(self, width: int):
        self.w, self.trans = np.zeros(width), np.zeros((2, 2))
        self.curve = np.array([1.0, 0.0])

    def good(self, base: np.ndarray, first: np.ndarray) -> np.ndarray:
        emit = np.zeros((len(base), 2))
        emit[:, 1] = around(base, first) @ self.w
        return marginals(emit, first, self.trans)[0][:, 1]

    def fit(self, x: np.ndarray, first: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> None:
        """Gradient ascent with adaptive steps on the conditional likelihood, in which each text has its weight."""
        inner = np.ones(len(x), bool)
        inner[first[:-1]] = False
        at = np.flatnonzero(inner)
        seen = np.zeros((2, 2))
        per_line = np.repeat(weight, np.diff(first))
        np.add.at(seen, (labels[at - 1], labels[at]), per_line[at])
        theta = np.concatenate([self.w, self.trans.ravel()])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, STEPS + 1):
            self.w, self.trans = theta[: x.shape[1]], theta[x.shape[1] :].reshape(2, 2)
            emit = np.zeros((len(x), 2))
            emit[:, 1] = x @ self.w
            p, pair, _ = marginals(emit, first, self.trans, weight)
            grad = np.concatenate([x.T @ ((labels - p[:, 1]) * per_line), (seen - pair).ravel()]) / len(x) - RIDGE * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta = theta + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.w, self.trans = theta[: x.shape[1]], theta[x.shape[1] :].reshape(2, 2)


def _mean(good: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    weight = size + 1.0
    return np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])


def _curve(q: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope and offset of the logistic curve from quality to label, by Newton's steps with a small ridge."""
    x, ab = np.stack([q - 0.5, np.ones(len(q))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ ab))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2) * 0.05
        ab = ab + np.linalg.solve(h, x.T @ (y - p) - 0.05 * ab)
    return ab


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Field | None:
    """Fits the field on a bounded sample of labelled documents."""
    chosen = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")  # SAMPLE rows at most

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrays.slices(whole, "text"):
                base, size, first = features(*arrays.buffers(batch.column("text")))
                cut = [slice(a, b) for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array(batch.column("id").to_pylist(), batch.column("id").type), "y": batch.column("y"), "lines": pa.array(np.diff(first), pa.int64()),
                    "base": [base[c].astype(np.uint8).tobytes() for c in cut], "size": [size[c].astype(np.int32).tobytes() for c in cut],
                })

    kind = docs.schema[doc_id].dataType.simpleString()
    got = rows.select("id", "y", "text").mapInArrow(measure, f"id {kind}, y int, lines long, base binary, size binary")
    ahead = Window.orderBy(F.xxhash64("id"), "id", "lines", "size", "base").rowsBetween(Window.unboundedPreceding, 0)  # SAMPLE documents
    got = got.withColumn("ahead", F.sum("lines").over(ahead)).where(F.col("ahead") <= LINES)
    got = got.select(F.col("id").cast("string").alias("id"), "y", "base", "size").toPandas().sort_values("id", kind="stable")
    if not len(got):
        return None
    size = [np.frombuffer(x, np.int32) for x in got["size"]]
    first = np.concatenate([[0], np.cumsum([len(x) for x in size])])
    base = np.frombuffer(b"".join(got["base"]), np.uint8).reshape(first[-1], -1).astype(np.float32)
    size, y = np.concatenate(size), got["y"].to_numpy()
    x, field = around(base, first), Field(base.shape[1] * 3)
    classes = np.bincount(y, minlength=2)
    weight = (len(y) / (2.0 * np.maximum(classes, 1)))[y]
    found = np.repeat(y, np.diff(first))
    for turn in range(ROUNDS):
        field.fit(x, first, found, weight)
        if turn < ROUNDS - 1:
            good = field.good(base, first)
            owner = np.repeat(np.arange(len(y)), np.diff(first))
            worst = np.minimum.reduceat(good, first[:-1])
            found = np.where((y[owner] == 0) & (good > 0.8) & (good > worst[owner]), 1, np.repeat(y, np.diff(first)))
    field.curve = _curve(_mean(field.good(base, first), size, first), y)
    return field


def score(docs: DataFrame, field: Field | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score for every row."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if field is None:
        return rows.select("doc_id", F.lit(0.5).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrays.slices(whole, "text"):
                base, size, first = features(*arrays.buffers(batch.column("text")))
                q = _mean(field.good(base, first), size, first)
                value = 1 / (1 + np.exp(-(field.curve[0] * (q - 0.5) + field.curve[1])))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value)], names=["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, score double")
