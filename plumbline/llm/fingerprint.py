"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs are its lines, cut after a full stop, exclamation or question mark that
a space follows, without blank ones and trimmed. They are hashed, and each distinct digest
goes into HASHES cells of a table, one in each of as many equal ranges. A cell holds the
number of digests in it, their exclusive or, and that of their check hashes. The tables of two texts subtract cell by
cell: digests of both cancel. Cells with a single digest left give it up, which
frees others; when all cells are empty, the difference of the two texts is known exactly.
When peeling gets stuck, both texts are sketched again in a table twice as large, and so
on, until it comes through. Likeness is the Jaccard similarity of the sets of paragraph
digests that the recovered difference implies.

All documents of a batch are sketched, subtracted and peeled together, round by round.

The fingerprint string of a text is the digests' number and the cells of its smallest
table, in hexadecimal: equal texts have equal fingerprints.

Edge cases: a null or empty text has no paragraphs and a table of zeros; two texts
without paragraphs have likeness 1. Repeated paragraphs count once. Rows that share an id
follow each other by text. Texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .arrays import U, mix

#: Cells a digest goes into; cells of the smallest table in each range.
HASHES, CELLS = 3, 8
#: Neighbouring documents are dealt into ranges with about this many ids.
GROUP = 2048
_SEEDS = mix(np.arange(1, HASHES + 2, dtype=U) * U(0x9E3779B97F4A7C15))


def paragraphs(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct digests of each text's paragraphs, ascending in each text, and offsets."""
    stops = np.flatnonzero(((buf[:-1] == 46) | (buf[:-1] == 33) | (buf[:-1] == 63)) & (buf[1:] == 32)) + 1
    cut = np.unique(np.concatenate([off[:-1], np.flatnonzero(buf == 10) + 1, stops]))
    cut = cut[cut < len(buf)] if len(buf) else np.zeros(0, np.int64)
    if not len(cut):
        return np.zeros(0, U), np.zeros(len(off), np.int64)
    ink = np.flatnonzero(~((buf == 32) | ((buf >= 9) & (buf <= 13))))
    ends = np.append(cut[1:], len(buf))
    lo, hi = np.searchsorted(ink, cut), np.searchsorted(ink, ends)
    some = hi > lo
    cut, lo, hi = cut[some], lo[some], hi[some]
    digests = arrays.range_hash(arrays.prefix_sums(buf), ink[lo], ink[hi - 1] + 1)
    owner = np.searchsorted(off, cut, side="right") - 1
    order = np.lexsort((digests, owner))
    digests, owner = digests[order], owner[order]
    keep = np.ones(len(digests), bool)
    keep[1:] = (digests[1:] != digests[:-1]) | (owner[1:] != owner[:-1])
    return digests[keep], np.searchsorted(owner[keep], np.arange(len(off)))


def _cells(digests: np.ndarray, size: int) -> np.ndarray:
    """The cells of each digest in a table of HASHES ranges of `size`."""
    return np.stack([(mix(digests + _SEEDS[k]) % U(size)).astype(np.int64) + k * size for k in range(HASHES)])


def _check(digests: np.ndarray) -> np.ndarray:
    return mix(digests ^ _SEEDS[HASHES])


def sketch(digests: np.ndarray, owner: np.ndarray, texts: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, digest sums and check sums, each [texts, cells]."""
    shape = (texts, HASHES * size)
    count, total, check = np.zeros(shape, np.int32), np.zeros(shape, U), np.zeros(shape, U)
    checks = _check(digests)
    for at in _cells(digests, size):
        np.add.at(count, (owner, at), 1)
        np.bitwise_xor.at(total, (owner, at), digests)
        np.bitwise_xor.at(check, (owner, at), checks)
    return count, total, check


def peel(count: np.ndarray, total: np.ndarray, check: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of digests recovered from each difference, and whether it came apart wholly."""
    found = np.zeros(len(count), np.int64)
    while True:
        single = (np.abs(count) == 1) & (_check(total) == check)
        rows, cells = np.nonzero(single)
        if not len(rows):
            break
        digests, signs = total[rows, cells], count[rows, cells]
        _, first = np.unique(np.stack([rows.astype(U), digests]), axis=1, return_index=True)
        rows, digests, signs = rows[first], digests[first], signs[first]
        checks = _check(digests)
        for at in _cells(digests, size):
            np.subtract.at(count, (rows, at), signs)
            np.bitwise_xor.at(total, (rows, at), digests)
            np.bitwise_xor.at(check, (rows, at), checks)
        found += np.bincount(rows, minlength=len(found))
        if found.max() > 1 << 30:
            break
    return found, ~(count.any(1) | total.any(1))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Jaccard similarity of each pair of digest sets, from the difference that peeling recovers."""
    n_a, n_b = np.diff(a[1]), np.diff(b[1])
    pairs = len(n_a)
    owner_a, owner_b = np.repeat(np.arange(pairs), n_a), np.repeat(np.arange(pairs), n_b)
    apart, open_ = np.zeros(pairs, np.int64), np.arange(pairs)
    size = CELLS
    while len(open_):
        # as many pairs at a time as keep the tables small
        left = []
        width = max(1, (1 << 18) // (HASHES * size))
        for lo in range(0, len(open_), width):
            some = open_[lo : lo + width]
            place = np.full(pairs, -1)
            place[some] = np.arange(len(some))
            in_a, in_b = place[owner_a] >= 0, place[owner_b] >= 0
            x = sketch(a[0][in_a], place[owner_a[in_a]], len(some), size)
            y = sketch(b[0][in_b], place[owner_b[in_b]], len(some), size)
            found, whole = peel(x[0] - y[0], x[1] ^ y[1], x[2] ^ y[2], size)
            apart[some[whole]] = found[whole]
            left.append(some[~whole])
        open_ = np.concatenate(left)
        size *= 2
    both = (n_a + n_b - apart) / 2
    union = n_a + n_b - both
    return np.where(union > 0, both / np.maximum(union, 1), 1.0)


def strings(digests: np.ndarray, off: np.ndarray) -> list[str]:
    """The fingerprint of each text."""
    texts = len(off) - 1
    owner = np.repeat(np.arange(texts), np.diff(off))
    count, total, check = sketch(digests, owner, texts, CELLS)
    # check sums shortened to four bytes: a retry starts from the texts, so these serve to compare stored fingerprints
    short = (check & U(0xFFFFFFFF)).astype("<u4")
    raw = [count.astype("<i4").view(np.uint8), total.astype("<u8").view(np.uint8), short.view(np.uint8)]
    sizes = np.diff(off).astype("<u4")
    return [sizes[k : k + 1].tobytes().hex() + b"".join(x[k].tobytes() for x in raw).hex() for k in range(texts)]


def compare(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likenesses; see the module's text.

    The edited text has the last floor(n/3) code points replaced by the first as many (or all) of the next
    document in descending id; the last one's next is the first. Rows are dealt into ranges of ids that end with every
    GROUP-th id there is, and the row with that last id is also a guest in the range above, so texts travel once. Rows with
    a null id have no neighbours and are compared with themselves; of rows with one id each takes its copy as the next.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ids = rows.select("doc_id").where("doc_id is not null").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ends = np.array(sorted(r[0] for r in ids.mapInArrow(_every, "doc_id long").collect()), np.int64)  # one id for GROUP of them
    shared = rows.sparkSession.sparkContext.broadcast(np.unique(ends))

    @F.pandas_udf("array<long>")
    def parts(ids: pd.Series) -> pd.Series:
        """The range of an id, and the one it is a guest in if it ends its own."""
        own = np.searchsorted(shared.value, ids.to_numpy(np.int64))
        last = shared.value[own] == ids.to_numpy(np.int64)
        return pd.Series([[a, (a + 1) % len(shared.value)] if z else [a] for a, z in zip(own.tolist(), last.tolist(), strict=True)])

    known = rows.where("doc_id is not null").select(F.posexplode(parts("doc_id")).alias("role", "part"), "doc_id", "text")
    dealt = known.select("part", "doc_id", "text", (F.col("role") == 1).alias("guest"))
    dealt = dealt.repartition("part").sortWithinPartitions("part", "guest", F.desc("doc_id"), "text")
    alone = rows.where("doc_id is null").select(F.lit(-1).cast("long").alias("part"), "doc_id", "text", F.lit(None).cast("boolean").alias("guest"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(_compared, schema).unionByName(alone.mapInArrow(_compared, schema))


def _every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every GROUP-th of the ascending ids of a partition, and its last."""
    seen, last = 0, None
    for batch in batches:
        if batch.num_rows:
            ids = batch.column(0)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.arange((GROUP - 1 - seen) % GROUP, len(ids), GROUP)))], names=["doc_id"])
            seen, last = seen + len(ids), ids[-1].as_py()
    if last is not None:
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array([last], pa.int64())})


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts, nexts in _followed(batches):
        edited = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for t, n in zip(texts, nexts, strict=True)]
        own = paragraphs(*arrays.buffers(pa.array(texts, pa.large_string())))
        new = paragraphs(*arrays.buffers(pa.array(edited, pa.large_string())))
        after = paragraphs(*arrays.buffers(pa.array(nexts, pa.large_string())))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array(strings(*own)), pa.array(strings(*new)), pa.array(likeness(own, new)), pa.array(likeness(own, after)),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
    """Ids, texts and next texts, some at a time; the last row of a group is a guest and only follows."""
    ids, texts, nexts, size = [], [], [], 0
    last = None
    for batch in batches:
        for k in range(batch.num_rows):
            part, doc, text, guest = (c[k].as_py() for c in batch.columns)
            text = text or ""
            pair = (doc, text) if guest is None else last[1:] if last is not None and last[0] == part else None
            if pair:
                ids.append(pair[0])
                texts.append(pair[1])
                nexts.append(text)
                size += len(pair[1])
            last = (part, doc, text) if guest is False else None
            if size > 1 << 20 or len(ids) >= 1000:
                yield ids, texts, nexts
                ids, texts, nexts, size = [], [], [], 0
    if ids:
        yield ids, texts, nexts
