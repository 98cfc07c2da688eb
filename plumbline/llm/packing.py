"""Packing into training sequences by cutting-stock column generation.

A document is its token ids and one end id. Only documents longer than a sequence are cut,
into whole sequences of LENGTH and a last piece; all others stay whole. Lengths are counted
in units of UNIT tokens, rounded up, so the histogram of at most LENGTH / UNIT sizes is all
that reaches the driver, whatever the corpus, and rounding costs UNIT / 2 tokens a piece on
average.

The solver is Gilmore and Gomory's and runs in one task: a linear program chooses how often
to use each pattern of sizes, from first-fit patterns on; knapsack dynamic programming over
its dual prices finds the next pattern worth adding, until none could save more than a share
GAP of all bins, or PIVOTS steps a size are done; then counts are rounded down, and what is
left over, less than one bin a pattern, is filled by first-fit decreasing into patterns used
once.

Pieces are ranked within their size by counts of size and id bucket, and rank decides
pattern, copy and place by arithmetic against the small pattern table.

Where the rows have an order, pieces are ranked by it instead of by id. The uses of each
pattern are then dealt over ROUNDS rounds, so a bin holds pieces from one stretch of the
order, and sequences are numbered by the mean place of their tokens.

Tokens come from a public tokenizer, word by word: its pre-tokenizer never joins across
white space, so distinct words are encoded once a task and looked up by a 64-bit hash.

Edge cases: a null or empty text is its end id alone. Repeated rows are packed each. Null
ids keep null. Ties in rank go to rows that are alike. Other columns are ignored. Texts
are tokenized whole. An empty table gives no pieces.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrays
from .shared import discard, materialise

#: Tokens of a sequence; tokens of a unit; end id; buckets for ranking; rounds of the patterns where rows have an order.
LENGTH, UNIT, END, BUCKETS, ROUNDS = 4096, 8, 2, 512, 16
#: Share of the bins that a further pattern must be able to save; steps after which the basis is inverted anew; steps a size at most.
GAP, RENEW, PIVOTS = 3e-4, 64, 8
_SEPARATOR, _SEPARATOR_ID = "<|endoftext|>", 49407


class WordTokens:
    """Token ids of words, kept sorted by the words' hashes."""

    def __init__(self, path: str, most: int = 1_200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and their numbers; words are encoded many at a time, parted by the separator."""
        got = []
        for lo in range(0, len(words), 8192):  # what the tokenizer returns for a word takes far more room than its ids
            parts = [_SEPARATOR.join(words[k : k + 256]) for k in range(lo, min(lo + 8192, len(words)), 256)]
            got += [np.array([_SEPARATOR_ID, *x.ids], np.uint32) for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        ids = np.concatenate(got)
        cuts = np.append(np.flatnonzero(ids == _SEPARATOR_ID), len(ids))
        return ids[ids != _SEPARATOR_ID], np.diff(cuts) - 1

    def texts(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each with END after it, and offsets."""
        starts, ends, first = arrays.words(buf, off)
        unique, index, inverse = np.unique(arrays.range_hash(arrays.prefix_sums(buf), starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self.clear()
        at = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        known[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] == unique[at < len(self.keys)]
        missing = np.flatnonzero(~known)
        if len(missing):
            raw = buf.tobytes()
            new = [raw[a:b].decode() for a, b in zip(starts[index[missing]].tolist(), ends[index[missing]].tolist(), strict=True)]
            odd = np.array(["<|" in w for w in new])  # may hold a special token: encoded alone
            missing = np.concatenate([missing[~odd], missing[odd]])
            ids, lengths = self.encode([w for w, o in zip(new, odd, strict=True) if not o]) if not odd.all() else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            alone = [np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32) for w, o in zip(new, odd, strict=True) if o]
            lengths = np.concatenate([lengths, [len(x) for x in alone]]).astype(np.int64)
            begins = len(self.ids) + np.cumsum(lengths) - lengths
            self.ids = np.concatenate([self.ids, ids, *alone])
            order = np.argsort(missing)
            missing, begins, lengths = missing[order], begins[order], lengths[order]
            self.starts = np.insert(self.starts, at[missing], begins)
            self.lengths = np.insert(self.lengths, at[missing], lengths)
            self.keys = np.insert(self.keys, at[missing], unique[missing])
            at = np.searchsorted(self.keys, unique)
        begins, lengths = self.starts[at][inverse], self.lengths[at][inverse]
        owner = np.repeat(np.arange(len(off) - 1), np.diff(first))
        counts = np.bincount(owner, lengths, len(off) - 1).astype(np.int64) + 1
        offsets = np.concatenate([[0], np.cumsum(counts)])
        out = np.full(offsets[-1], END, np.uint32)
        place = np.cumsum(lengths) - lengths + owner
        total = int(lengths.sum())
        within = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[np.repeat(place, lengths) + within] = self.ids[np.repeat(begins, lengths) + within]
        return out, offsets


_KNOWN: dict[str, WordTokens] = {}


def _word_tokens(path: str) -> WordTokens:
    """One table of words a worker process and tokenizer; later tasks go on with it."""
    if path not in _KNOWN:
        _KNOWN[path] = WordTokens(path)
    return _KNOWN[path]


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", order: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of every piece of every row, and its order (0 where none is given)."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_tokens(tokenizer)
        for whole in batches:
            for batch in arrays.slices(whole, "text", 1 << 20):
                ids, off = words.texts(*arrays.buffers(batch.column("text")))
                rows, starts, lengths, sums = [], [], [], []
                for k in range(batch.num_rows):
                    total = int(off[k + 1] - off[k])
                    cuts = [*range(0, total, LENGTH), total]
                    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                        rows.append(k)
                        starts.append(a)
                        lengths.append(b - a)
                        sums.append(zlib.crc32(ids[off[k] + a : off[k] + b]))
                owners = np.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(owners)), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, np.diff(off)[owners])), batch.column("order").take(pa.array(owners))],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "order"],
                )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (F.col(order) if order else F.lit(0)).cast("long").alias("order"))
    return rows.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, `order` long")


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The pattern of greatest value that fits: unbounded knapsack by dynamic programming; sizes ascend."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), side="right").tolist()  # sizes ascend
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if fitting[room]:
            gain = values[: fitting[room]] + best[room - sizes[: fitting[room]]]
            k = gain.argmax()
            if gain[k] > best[room] + 1e-12:
                best[room], choice[room] = gain[k], k
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return pattern


def first_patterns(need: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A basis to start from, a column a pattern: bins filled with the largest sizes first, each pattern used until one of its sizes is done.

    A pattern holds no size that is done before, so ordered that way the basis is triangular: it is regular, and its uses are not negative.
    """
    left, open_sizes = need.astype(float), np.ones(len(sizes), bool)
    basis = np.zeros((len(sizes), len(sizes)))
    for step in range(len(sizes)):
        room = capacity
        for k in np.flatnonzero(open_sizes)[::-1]:
            basis[k, step] = room // sizes[k]
            room -= int(basis[k, step]) * int(sizes[k])
        part = basis[:, step] > 0
        uses = np.where(part, left / np.where(part, basis[:, step], 1), np.inf)
        done = int(uses.argmin())
        left = np.maximum(left - uses[done] * basis[:, step], 0)
        open_sizes[done] = False
    return basis


def cutting_stock(demand: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(uses, {size: items a bin}) so that every size occurs exactly as often as asked for.

    The program ends after PIVOTS steps a size at the latest, as it may stand still where several bases give the same use; the
    basis that it then has is as whole as any other, if perhaps with a few more bins.
    """
    sizes = np.array(sorted(s for s, n in demand.items() if n > 0), np.int64)
    if not len(sizes):
        return []
    need = np.array([demand[int(s)] for s in sizes], np.int64)
    basis = first_patterns(need, sizes, capacity)
    for step in range(PIVOTS * len(sizes)):
        if step % RENEW == 0:  # else rounding errors add up
            inverse = np.linalg.inv(basis)
        use = inverse @ need.astype(float)
        # no further pattern can bring the number of bins below its (1 + GAP)-th part, or none below what the items fill
        if use.sum() <= (1 + GAP) * (need @ sizes) / capacity:
            break
        duals = inverse.sum(axis=0)
        column = price(duals, sizes, capacity)
        if duals @ column <= 1 + GAP:
            break
        way = inverse @ column
        ratios = np.where(way > 1e-9, np.maximum(use, 0) / np.where(way > 1e-9, way, 1), np.inf)
        out = int(ratios.argmin())
        basis[:, out] = column
        row = inverse[out] / way[out]
        inverse -= np.outer(way, row)
        inverse[out] = row
    use = np.maximum(np.linalg.inv(basis) @ need.astype(float), 0)
    left, out = need.copy(), []
    for k in np.argsort(-use):
        pattern = np.rint(basis[:, k]).astype(np.int64)
        part = pattern > 0
        times = int(min(np.floor(use[k] + 1e-9), (left[part] // pattern[part]).min()))
        if times > 0:
            left -= times * pattern
            out.append((times, pattern))
    while left.any():  # first-fit decreasing, bin by bin
        pattern, room = np.zeros(len(sizes), np.int64), capacity
        for k in range(len(sizes) - 1, -1, -1):
            pattern[k] = min(left[k], room // sizes[k])
            room -= int(pattern[k] * sizes[k])
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        left -= times * pattern
        out.append((times, pattern))
    return [(n, {int(s): int(a) for s, a in zip(sizes, p, strict=True) if a}) for n, p in out]


def solved(demand: DataFrame, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """cutting_stock() of a table of size and n, a row a size. It runs in a task: workers use one thread for linear algebra."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = cutting_stock({r["size"]: r["n"] for batch in batches for r in batch.to_pylist()}, capacity)
        lists = [pa.array([list(part(p)) for _, p in plan], pa.list_(pa.int64())) for part in (dict.keys, dict.values)]
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in plan], pa.int64()), *lists], names=["uses", "sizes", "items"])

    rows = demand.select(F.col("size").cast("long").alias("size"), "n").coalesce(1).mapInArrow(solve, "uses long, sizes array<long>, items array<long>").collect()
    return [(r["uses"], dict(zip(r["sizes"], r["items"], strict=True))) for r in rows]  # some patterns a size


def _table(spark, plan: list[tuple[int, dict[int, int]]], base: int) -> DataFrame:
    """size, ranks [lo, hi), items a bin, first bin and place of the size in the bin; a few rows for each size."""
    rows, used = [], {}
    for times, pattern in plan:
        at = 0
        for size, items in sorted(pattern.items(), reverse=True):
            lo = used.get(size, 0)
            used[size] = lo + times * items
            rows.append((size, lo, used[size], items, base, at))
            at += size * items
        base += times
    return spark.createDataFrame(rows, "p_size long, p_lo long, p_hi long, p_items long, p_base long, p_at long")


def _binned(items: DataFrame, table: DataFrame, bin_name: str, place: str) -> DataFrame:
    """Adds the bin of items(size, rank) and their place in it."""
    match = (F.col("size") == F.col("p_size")) & (F.col("rank") >= F.col("p_lo")) & (F.col("rank") < F.col("p_hi"))
    joined = items.join(F.broadcast(table), match)  # some thousand rows, times ROUNDS at most: a pattern for each size
    copy = F.floor((F.col("rank") - F.col("p_lo")) / F.col("p_items"))
    within = (F.col("rank") - F.col("p_lo")) % F.col("p_items")
    return joined.withColumn(bin_name, F.col("p_base") + copy).withColumn(place, F.col("p_at") + within * F.col("p_size")).select(*items.columns, bin_name, place)


def _dealt(plan: list[tuple[int, dict[int, int]]]) -> list[tuple[int, dict[int, int]]]:
    """The plan in ROUNDS rounds, each with its part of every pattern's uses."""
    parts = [(n * (r + 1) // ROUNDS - n * r // ROUNDS, pattern) for r in range(ROUNDS) for n, pattern in plan]
    return [(n, pattern) for n, pattern in parts if n]


def _in_order(placed: DataFrame) -> DataFrame:
    """placed with its sequences numbered by the mean order of their tokens."""
    spark = placed.sparkSession
    mean = F.floor(F.sum(F.col("order") * F.col("length")) / F.sum("length"))
    means = placed.groupBy("sequence_id").agg(mean.alias("mean"))
    most = means.agg(F.max("mean")).first()[0] or 0
    means = materialise(means.withColumn("bucket", F.floor(F.col("mean") * BUCKETS / F.lit(most + 1))), "means")
    before, rows = 0, []
    for bucket, n in sorted(means.groupBy("bucket").count().collect()):  # BUCKETS rows
        rows.append((bucket, before))
        before += n
    offsets = spark.createDataFrame(rows, "bucket long, before long")
    row = F.row_number().over(Window.partitionBy("bucket").orderBy("mean", "sequence_id")) - 1
    numbers = means.withColumn("row", row).join(F.broadcast(offsets), "bucket").select("sequence_id", (F.col("before") + F.col("row")).alias("number"))
    return placed.join(numbers, "sequence_id").withColumn("sequence_id", F.col("number")).drop("number")


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", order: str | None = None) -> DataFrame:
    """Every piece with its sequence_id and its offset there; `order` names a column of whole numbers from 0 that sequences follow."""
    spark = docs.sparkSession
    cut = materialise(pieces(docs, tokenizer, doc_id, text, order), "pieces")
    if order:
        most = cut.agg(F.max("order")).first()[0] or 0
        cut = cut.withColumn("bucket", F.floor(F.col("order") * BUCKETS / F.lit(most + 1)))
    else:
        cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)))
    cut = cut.withColumn("size", F.ceil(F.col("length") / UNIT))
    counts = materialise(cut.groupBy("size", "bucket").agg(F.count("*").alias("n")), "counts")
    before = F.sum("n").over(Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("size", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    demand = materialise(counts.groupBy("size").agg(F.sum("n").alias("n")), "demand")  # LENGTH / UNIT rows at most
    whole = demand.where(F.col("size") == LENGTH // UNIT).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    plan = solved(demand.where(F.col("size") < LENGTH // UNIT), LENGTH // UNIT)
    discard(demand)

    row = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("order", "doc_id", "start")) - 1
    ranked = cut.withColumn("row", row).join(offsets, ["size", "bucket"]).withColumn("rank", F.col("row") + F.col("before")).drop("row", "before", "bucket")
    large = ranked.where(F.col("size") == LENGTH // UNIT).withColumn("sequence_id", F.col("rank")).withColumn("place", F.lit(0).cast("long"))
    items = _binned(ranked.where(F.col("size") < LENGTH // UNIT), _table(spark, _dealt(plan) if order else plan, whole), "sequence_id", "place")
    placed = large.unionByName(items).drop("rank", "size")
    if order:
        placed = _in_order(materialise(placed, "placed"))
    earlier = Window.partitionBy("sequence_id").orderBy("place", "doc_id", "start").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("sequence_id").cast("long").alias("sequence_id"), offset.alias("offset"))
