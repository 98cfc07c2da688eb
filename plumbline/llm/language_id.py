"""Language identification with unigram piece models whose score sums over all segmentations.

A fixed public vocabulary gives the pieces. For each language a unigram model holds one
probability per piece. A word's likelihood is the sum, over every way to cut it into
pieces, of the product of their probabilities; a forward recursion computes it. Words
are independent, so a text's log likelihood is the sum over its words, and Bayes' rule
with equal priors turns the languages' likelihoods into a posterior.

Learning is one round of expectation maximisation from equal piece probabilities: every
task counts the distinct words of its texts by language, runs forward-backward over each
word, and emits one row per language and piece; Spark sums them. The model is languages
times vocabulary numbers, whatever the size of the corpus.

Edge cases: a null or empty text, or one without any letter, is `und` with score 0. Texts
whose learning language is null teach nothing. If nothing can be learned, all texts are
`und`. Ties go to the alphabetically first language. Repeated rows are scored each on
their own. Columns besides the id, text and language are ignored. Texts are read whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of up to LONG letters go through arrays, AT_ONCE words at a time, and longer ones alone, with the same sums; letters
#: after which forward sums are rescaled.
LONG, AT_ONCE, RESCALE = 32, 8192, 8
#: Pseudo-count of each piece in each language, and a floor for a letter that is no piece.
ALPHA = 0.05
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_MARK = "▁"


def load_pieces(path: str) -> list[str]:
    """Pieces of letters of a public sentencepiece vocabulary, lower case, with their word-start mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(k) for k in range(model.get_piece_size())}
    good = {p for p in found if p.strip(_MARK) and p == p.lower() and p.lstrip(_MARK).isalpha()}
    return sorted(good | {_MARK})


def _batches(by_length: dict[int, list[int]]) -> Iterator[tuple[int, list[int]]]:
    """Rows of one length, at most AT_ONCE at a time, so arrays stay small."""
    for length, rows in by_length.items():
        for lo in range(0, len(rows), AT_ONCE):
            yield length, rows[lo : lo + AT_ONCE]


class Lattice:
    """Forward sums over the segmentations of words, for any number of models at once."""

    def __init__(self, pieces: list[str]):
        self.index = {p: k for k, p in enumerate(pieces)}
        self.unknown = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        codes = [self._hash(p) for p in pieces]
        order = np.argsort(np.array(codes, np.uint64))
        self.hashes = np.array(codes, np.uint64)[order]
        self.ids = order.astype(np.int64)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * 0x100000001B3 + ord(c) + 1) % 2**64
        return (h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 % 2**64

    def edges(self, points: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(start, end, piece number or -1 for each word) over code points [words, length]."""
        words, length = points.shape
        mult = np.uint64(0x100000001B3)
        for start in range(length):
            h = np.zeros(words, np.uint64)
            for end in range(start + 1, min(length, start + self.longest) + 1):
                h = h * mult + points[:, end - 1] + np.uint64(1)
                key = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                at = np.minimum(np.searchsorted(self.hashes, key), len(self.hashes) - 1)
                piece = np.where(self.hashes[at] == key, self.ids[at], -1)
                if end == start + 1:
                    piece = np.where(piece < 0, self.unknown, piece)
                yield start, end, piece

    def score(self, words: list[str], model: np.ndarray) -> np.ndarray:
        """Log likelihood [words, models]; model: probabilities [pieces + 2, models], the last row zeros."""
        out = np.zeros((len(words), model.shape[1]))
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
        for length, rows in _batches(by_length):
            if length > LONG:
                for k in rows:
                    out[k] = self._long(words[k], model)
                continue
            points = np.array([[ord(c) for c in words[k]] for k in rows], np.uint64)
            alpha = np.zeros((length + 1, len(rows), model.shape[1]))
            alpha[0] = 1.0
            scale = np.zeros((len(rows), model.shape[1]))
            for start, end, piece in self.edges(points):
                if start and start % RESCALE == 0 and end == start + 1:  # alpha[start] is complete
                    top = alpha[start].copy()
                    alpha[start : start + self.longest + 1] /= top
                    scale += np.log(top)
                hit = np.flatnonzero(piece >= 0)
                if len(hit):
                    alpha[end][hit] += alpha[start][hit] * model[piece[hit]]
            out[rows] = np.log(alpha[length]) + scale
        return out

    def _ending(self, word: str, end: int) -> Iterator[tuple[int, int]]:
        """Start and number of each piece of the word that ends at `end`."""
        for start in range(max(0, end - self.longest), end):
            piece = self.index.get(word[start:end], self.unknown if end == start + 1 else None)
            if piece is not None:
                yield start, piece

    def _long(self, word: str, model: np.ndarray) -> np.ndarray:
        """The same sum for one long word, rescaled at every letter."""
        n, width = len(word), model.shape[1]
        alpha = [np.ones(width)] + [None] * n
        scale = np.zeros(width)
        for end in range(1, n + 1):
            total = np.zeros(width)
            for start, piece in self._ending(word, end):
                total = total + alpha[start] * model[piece]
            scale += np.log(total)
            for k in range(max(0, end - self.longest + 1), end):
                alpha[k] = alpha[k] / total
            alpha[end] = np.ones(width)
        return scale

    def expected(self, words: list[str], weights: np.ndarray, prior: np.ndarray) -> np.ndarray:
        """Expected piece counts under one model; weights: how often each word occurs."""
        counts = np.zeros(len(prior))
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
        for length, rows in _batches(by_length):
            if length > LONG:
                for k in rows:
                    self._long_expected(words[k], weights[k], prior, counts)
                continue
            points = np.array([[ord(c) for c in words[k]] for k in rows], np.uint64)
            edges = list(self.edges(points))
            forward = np.zeros((length + 1, len(rows)))
            backward = np.zeros((length + 1, len(rows)))
            forward[0] = 1.0
            backward[length] = 1.0
            for start, end, piece in edges:
                forward[end] += forward[start] * prior[piece]
            for start, end, piece in reversed(edges):
                backward[start] += backward[end] * prior[piece]
            share = weights[rows] / forward[length]
            for start, end, piece in edges:
                got = forward[start] * backward[end] * prior[piece] * share
                counts += np.bincount(piece + (piece < 0) * (len(prior)), got, len(prior))[: len(prior)]
        return counts


    def _long_expected(self, word: str, weight: float, prior: np.ndarray, counts: np.ndarray) -> None:
        """Adds the expected piece counts of one long word; sums are divided at every letter by the forward sum there."""
        n = len(word)
        forward, backward, tops = [1.0] + [0.0] * n, [0.0] * n + [1.0], [1.0] * (n + 1)
        edges = [[(start, piece, float(prior[piece])) for start, piece in self._ending(word, end)] for end in range(1, n + 1)]

        def between(start: int, end: int) -> float:
            return math.prod(tops[start + 1 : end])

        for end, found in enumerate(edges, 1):
            # forward[k] is scaled to 1, so an edge from start is divided by the tops between
            tops[end] = sum(p / between(start, end) for start, _, p in found)
            forward[end] = 1.0
        for end in range(n, 0, -1):
            for start, _, p in edges[end - 1]:
                backward[start] += backward[end] * p / between(start, end) / tops[end]
        for end, found in enumerate(edges, 1):
            for start, piece, p in found:
                counts[piece] += weight * p * backward[end] / between(start, end) / tops[end]


def _words(text: str | None) -> list[str]:
    return [_MARK + w for w in _LETTERS.findall(text.lower())] if text else []


def learn(docs: DataFrame, pieces: list[str], text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and piece probabilities [pieces + 2, languages] from all rows with a language.

    What comes to the driver is one number per language and piece.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(shared.value)
        size = len(shared.value) + 2
        prior = np.full(size, 1.0 / size)
        prior[-1] = 0.0
        seen: dict[str, Counter] = {}
        found: dict[str, np.ndarray] = {}

        def flush() -> None:
            for name, counter in seen.items():
                ws = list(counter)
                got = lattice.expected(ws, np.fromiter(counter.values(), float, len(ws)), prior)
                found[name] = found.get(name, 0) + got
            seen.clear()

        for batch in batches:
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name is not None:
                    seen.setdefault(name, Counter()).update(_words(t))
            if sum(map(len, seen.values())) > 300_000:
                flush()
        flush()
        for name, got in found.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_pydict({"lang": [name] * len(at), "piece": at.astype(np.int32), "n": got[at]})

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("lang").isNotNull())
    summed = rows.mapInArrow(count, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    table = summed.toPandas()
    languages = sorted(table["lang"].unique().tolist())
    model = np.zeros((len(pieces) + 2, len(languages)))
    for k, name in enumerate(languages):
        part = table[table["lang"] == name]
        model[part["piece"].to_numpy(), k] = part["n"].to_numpy()
    model[:-1] += ALPHA
    model[-1] = 0.0
    return languages, model / model.sum(axis=0, keepdims=True) if languages else model


class Predictor:
    """Scores texts; remembers the words it has scored."""

    def __init__(self, pieces: list[str], languages: list[str], model: np.ndarray, most: int = 300_000):
        self.lattice, self.names, self.model, self.most = Lattice(pieces), languages, model, most
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(languages)))

    def texts(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text, or `und`, and its posterior."""
        per_text = [_words(t) for t in texts]
        lengths = np.array([len(x) for x in per_text])
        flat = [w for x in per_text for w in x]
        if not flat or not self.names:
            return ["und"] * len(texts), np.zeros(len(texts))
        codes, unique = pd.factorize(np.array(flat, object))
        if len(self.known) > self.most:
            self.known, self.scores = {}, self.scores[:0]
        new = [w for w in unique if w not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.scores), len(self.scores) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, self.lattice.score(new, self.model)])
        rows = np.fromiter((self.known[w] for w in unique), np.int64, len(unique))[codes]
        owner = np.repeat(np.arange(len(texts)), lengths)
        total = np.stack([np.bincount(owner, self.scores[rows, k], len(texts)) for k in range(len(self.names))], 1)
        best = total.argmax(1)
        post = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        some = lengths > 0
        return [self.names[b] if s else "und" for b, s in zip(best, some, strict=True)], np.where(some, post, 0.0)


def identify(docs: DataFrame, languages: list[str], model: np.ndarray, pieces: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (posterior of that language) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast((pieces, languages, model))
    kind = docs.schema[doc_id].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(*shared.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                names, post = predictor.texts(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(post)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text)).mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")


def accept(
    docs: DataFrame, languages: list[str], model: np.ndarray, pieces: list[str], least: float = 0.5, sure: float = 0.999, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """docs without the rows whose language cannot be told (`und`, or a posterior under `least`).

    Rows that stay get the predicted language where they have none, or a learned one while the text has another with a
    posterior of `sure` or more: most of such a text is in the other language, which makes it no worse.
    """
    shared = docs.sparkSession.sparkContext.broadcast((pieces, languages, model))
    at_text, at_lang = docs.columns.index(text), docs.columns.index(lang)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(*shared.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                names, post = predictor.texts(batch.column(at_text).to_pylist())
                own = batch.column(at_lang)
                good = np.array([n != "und" for n in names]) & (post >= least)
                told = pa.array([n if o is None or (o in languages and p >= sure) else o for o, n, p in zip(own.to_pylist(), names, post, strict=True)], own.type)
                columns = [told if k == at_lang else c for k, c in enumerate(batch.columns)]
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(good))
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(keep, docs.schema)
