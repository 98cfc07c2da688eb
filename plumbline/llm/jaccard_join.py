"""Chosen-path similarity join on word shingles: all pairs of texts with Jaccard similarity of 0.8 or more.

Each run draws, by a hash shared by all sets, tokens at a rate of BRANCH / threshold
per set; sets that drew the same token meet in a bucket named by it. A bucket of up to
SMALL sets is compared outright. A larger one splits again on freshly sampled tokens;
one whose children hardly shrink is dense, as its sets all resemble each other, and is
compared in blocks. Two sets at the threshold share BRANCH children in expectation at
every level. One run misses such a pair with probability exp(-BRANCH) at the first level
and at most MISS through any number of splits, so :func:`runs_for` gives the number of
runs that a target recall needs: 8 for the default of all but four pairs in a million.

Equal sets are joined first, by digest, and one of them stands for all. A pair that meets
in several buckets is compared only in the one with the smallest name, so links can be
summed without listing pairs: each bucket sends one row per set, with the rows its links
stand for and the smallest id it reached. Whole token sets travel only to buckets in
which they have a pair to compare. Comparison is exact.

Memory of a task: a bucket is compared in pairs of blocks of at most BLOCK sets and about
TOKENS tokens (one set at least), and overlaps are summed over ranges of the token hashes, so
a task holds a pair of blocks and the tables of one range. Buckets above HOT members get
their size by a broadcast, so their members are never brought to one task.

Edge cases: words are the lower-case runs without ASCII white space; a text of one to four
words has one shingle, all its words. A null or empty text, or a null id, has no links and
is its own class. Repeated rows link to each other like copies. Ids are unique but for
repeated rows. Columns besides id and text are ignored. Texts are read whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .arrays import U, mix
from .components import components
from .shared import discard, materialise

#: Words a shingle; similarity as a fraction; common children at each level; sets compared outright; levels; sets and tokens of a block.
WORDS, THRESHOLD, BRANCH, SMALL, LEVELS, BLOCK, TOKENS = 5, (4, 5), 2.0, 200, 4, 512, 2 << 20
#: Chance that one run misses a pair at the threshold: the least root of x = exp(-BRANCH * (1 - x)), rounded up; target recall.
MISS, RECALL = 0.21, 1 - 4e-6
#: Members from which a bucket counts as hot; tokens whose overlaps are summed at a time.
HOT, RANGE = 5000, 1 << 19


def runs_for(recall: float) -> int:
    """Runs after which a pair at the threshold is found with probability `recall` or more."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(MISS)))


RUNS = runs_for(RECALL)


def _seed(*parts: int) -> np.uint64:
    return mix(np.array([hash(parts) & (2**64 - 1)], U))[0]


def _rate(n: np.ndarray) -> np.ndarray:
    """Sampling bound on a 64-bit hash for sets of n tokens."""
    share = np.minimum(BRANCH * THRESHOLD[1] / THRESHOLD[0] / np.maximum(n, 1), 1.0)
    return np.minimum(share * 2.0**64, 2.0**64 - 2048).astype(U)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, digest of the token set, its size, and the tokens drawn in each run as bucket names."""
    for whole in batches:
        for batch in arrays.slices(whole, "text"):
            buf, off = arrays.buffers(pc.utf8_lower(batch.column("text")))
            tokens, at = arrays.shingles(buf, off, WORDS)
            n = np.diff(at)
            bound = np.repeat(_rate(n), n)
            owner = np.repeat(np.arange(len(n)), n)
            rows, keys = [], []
            for run in range(RUNS):
                h = mix(tokens ^ _seed(1, run))
                hit = np.flatnonzero(h <= bound)
                rows.append(owner[hit])
                keys.append(mix(h[hit] + _seed(2, run)))
            rows, keys = np.concatenate(rows), np.concatenate(keys)
            order = np.argsort(rows, kind="stable")
            ends = np.searchsorted(rows[order], np.arange(len(n) + 1)).astype(np.int32)
            raw = tokens.view(np.uint8)
            digests = [hashlib.blake2b(raw[a * 8 : b * 8], digest_size=16).digest() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[order].view(np.int64)))],
                names=["doc_id", "digest", "n", "keys"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Appends the token set, eight bytes a token, in place of the text."""
    for whole in batches:
        for batch in arrays.slices(whole, "text"):
            buf, off = arrays.buffers(pc.utf8_lower(batch.column("text")))
            tokens, at = arrays.shingles(buf, off, WORDS)
            raw = tokens.view(np.uint8).tobytes()
            column = pa.array([raw[a * 8 : b * 8] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("n"), batch.column("copies"), column], names=["rep", "n", "copies", "tokens"])


def _children(level: int):
    """Draws again, for each bucket a set is in, from the set's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, parents, sizes, widths, found = [], [], [], [], []
            for rep, buckets, raw in zip(batch.column("rep").to_pylist(), batch.column("buckets").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                tokens = np.frombuffer(raw, U)
                bound = _rate(np.array([len(tokens)]))[0]
                for key, size in ((x["key"], x["size"]) for x in buckets):
                    own = mix(np.array([key], np.int64).view(U) + _seed(3, level))[0]
                    h = mix(tokens ^ own)
                    drawn = mix(h[h <= bound] + own).view(np.int64)
                    found.append(drawn)
                    reps.append(np.full(len(drawn), rep, np.int64))
                    parents.append(np.full(len(drawn), key, np.int64))
                    sizes.append(np.full(len(drawn), size, np.int64))
                    widths.append(np.full(len(drawn), len(tokens), np.int32))
            if reps:
                yield pa.RecordBatch.from_pydict({
                    "rep": np.concatenate(reps), "n": np.concatenate(widths), "parent": np.concatenate(parents), "parent_size": np.concatenate(sizes), "key": np.concatenate(found),
                })

    return run


def _wanted(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Pairs of a bucket (or of two blocks of it) that are to be compared in it, as a matrix; sizes; ids."""
    key = group.column("key")[0].as_py()
    n = group.column("n").to_numpy().astype(np.int64)
    reps = group.column("rep").to_numpy()
    names = [np.asarray(x) for x in group.column("names").to_pylist()]
    block = group.column("block").to_numpy()
    flat = np.concatenate(names)
    lower = flat < key
    owner = np.repeat(np.arange(len(n)), [len(x) for x in names])[lower]
    unique, codes = np.unique(flat[lower], return_inverse=True)
    met = np.zeros((len(n), len(n)), np.float32)
    for lo in range(0, len(unique), 2048):
        part = (codes >= lo) & (codes < lo + 2048)
        has = np.zeros((len(n), min(2048, len(unique) - lo)), np.float32)
        has[owner[part], codes[part] - lo] = 1
        met += has @ has.T
    num, den = THRESHOLD
    close = np.minimum.outer(n, n) * den >= np.maximum.outer(n, n) * num
    pairs = (met == 0) & close & (reps[:, None] < reps[None, :])
    if group.column("i")[0].as_py() != group.column("j")[0].as_py():
        pairs &= block[:, None] != block[None, :]
    return pairs, n, reps, names


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the members of each bucket that have a pair to compare there."""
    for group in arrays.grouped(batches, "gkey"):
        if group.num_rows > 1:
            pairs = _wanted(group)[0]
            keep = pairs.any(0) | pairs.any(1)
            if keep.any():
                yield from group.filter(pa.array(keep)).to_batches()


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each member with a link: the rows its links stand for, and the smallest id it is linked with."""
    num, den = THRESHOLD
    for group in arrays.grouped(batches, "gkey"):
        if group.num_rows < 2:
            continue
        pairs, n, reps, _ = _wanted(group)
        sets = _views(group.column("tokens"))
        a, b = np.nonzero(pairs)
        if len(sets) <= 6 or len(a) < 2 * len(sets):
            common = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b, strict=True)], np.int64)
        else:
            common = _overlaps(sets)[a, b]
        linked = common * (num + den) >= num * (n[a] + n[b])
        a, b = a[linked], b[linked]
        if not len(a):
            continue
        copies = group.column("copies").to_numpy()
        links = np.bincount(a, copies[b], len(n)) + np.bincount(b, copies[a], len(n))
        root = reps.copy()
        while True:
            new = root.copy()
            np.minimum.at(new, a, root[b])
            np.minimum.at(new, b, root[a])
            if (new == root).all():
                break
            root = new
        at = np.flatnonzero(links)
        yield pa.RecordBatch.from_pydict({"rep": reps[at], "links": links[at].astype(np.int64), "root": root[at]})


def _views(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Each row's tokens, without copying them."""
    out = []
    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        at = np.frombuffer(offsets, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].tolist()
        out += [np.frombuffer(data, U, (b - a) // 8, a) for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of ascending sets, summed over ranges of the hashes with about RANGE tokens each."""
    out = np.zeros((len(sets), len(sets)), np.int64)
    ranges = sum(map(len, sets)) // RANGE + 1
    bounds = np.array([k * 2**64 // ranges for k in range(1, ranges)], U)
    cuts = [[0, *np.searchsorted(x, bounds).tolist(), len(x)] for x in sets]
    for k in range(ranges):
        out += _common([x[c[k] : c[k + 1]] for x, c in zip(sets, cuts, strict=True)])
    return out


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from the tokens that two sets or more have."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    unique, codes, counts = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1
    shared = counts[codes] > 1
    owner, codes = owner[shared], number[codes[shared]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(codes, kind="stable")
    owner, codes = owner[order], codes[order]
    width = 2048
    for lo in range(0, int((counts > 1).sum()), width):
        s, e = np.searchsorted(codes, [lo, lo + width])
        has = np.zeros((len(sets), width), np.float32)
        has[owner[s:e], codes[s:e] - lo] = 1
        out += has @ has.T
    return out.astype(np.int64)


def _counted(members: DataFrame, by: str = "key") -> DataFrame:
    """Members of buckets with two sets or more, each with its bucket's size and number of tokens.

    Buckets are measured with partial sums; hot ones (a HOT-th of the members at most) reach their members by a broadcast.
    """
    sizes = materialise(members.groupBy(by).agg(F.count("*").alias("size"), F.sum("n").alias("tokens")).where("size > 1"), "sizes")
    hot = F.broadcast(sizes.where(F.col("size") > HOT))
    others = members.join(hot.select(by), by, "left_anti").join(sizes.where(F.col("size") <= HOT), by)
    return members.join(hot, by).unionByName(others)


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id (smallest id its links lead to, over any number of links) and n_links, for every row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = rows.mapInArrow(_signatures, "doc_id long, digest binary, n int, keys array<long>")
    signed = materialise(signed, "signatures")
    some = signed.where("n > 0 and doc_id is not null")
    reps = some.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    reps = materialise(reps, "representatives")
    members = materialise(_counted(reps.select("rep", "n", F.explode("keys").alias("key"))), "members")
    alive = members.select("rep").distinct()
    kept = reps.select("rep", "copies", "n").join(alive, "rep", "left_semi")
    texts = rows.withColumnRenamed("doc_id", "rep").join(kept, "rep").dropDuplicates(["rep"])
    sets = materialise(texts.select("rep", "n", "copies", "text").mapInArrow(_sets, "rep long, n int, copies long, tokens binary"), "sets")

    leaves = members.where(F.col("size") <= SMALL).select("key", "rep", "size", F.col("tokens").alias("total"))
    large = members.where(F.col("size") > SMALL).select("key", "rep", "size", F.col("tokens").alias("total"))
    for level in range(LEVELS):
        if large.isEmpty():
            break
        if level == LEVELS - 1:
            leaves = leaves.union(large)
            break
        asked = large.groupBy("rep").agg(F.collect_list(F.struct("key", "size")).alias("buckets")).join(sets.select("rep", "n", "tokens"), "rep")
        drawn = materialise(asked.mapInArrow(_children(level), "rep long, n int, parent long, parent_size long, key long"), "drawn")
        counted = materialise(_counted(drawn), "children")
        dense = counted.groupBy(F.col("parent").alias("key")).agg((F.max("size") * 2 >= F.first("parent_size")).alias("dense")).where("dense").select("key")
        stays = large.join(dense, "key", "left_semi")
        split = counted.join(dense.withColumnRenamed("key", "parent"), "parent", "left_anti").select("key", "rep", "size", F.col("tokens").alias("total"))
        leaves = leaves.union(stays).union(split.where(F.col("size") <= SMALL))
        large = materialise(split.where(F.col("size") > SMALL), "large")
        discard(drawn)
    leaves = materialise(leaves, "leaves")

    names = leaves.groupBy("rep").agg(F.collect_list("key").alias("names")).join(sets.select("rep", "n"), "rep")
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("total") / TOKENS)).cast("int")
    placed = leaves.join(names, "rep").withColumn("blocks", F.when((F.col("size") > SMALL) | (F.col("total") > 2 * TOKENS), F.greatest(blocks, F.lit(2))).otherwise(1))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    placed = placed.withColumn("gkey", F.xxhash64("key", "i", "j")).select("gkey", "key", "i", "j", "block", "rep", "n", "names")
    member = "gkey long, key long, i int, j int, block int, rep long, n int, names array<long>"
    needed = placed.repartition("gkey").sortWithinPartitions("gkey", "key").mapInArrow(_needed, member)
    joined = needed.join(sets.select("rep", "copies", "tokens"), "rep")
    compared = joined.select(*[x.split()[0] for x in member.split(", ")], "copies", "tokens").repartition("gkey").sortWithinPartitions("gkey", "key")
    compared = materialise(compared.mapInArrow(_compared, "rep long, links long, root long"), "compared")
    discard(sets, leaves, members)

    links = compared.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(compared.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    named = reps.select("digest", "rep", "copies").join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("digest", F.coalesce("root", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = signed.select("doc_id", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(named, "digest", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def first_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that a similar or equal row with a smaller id, over any number of links, stands for.

    Rows repeated under one id are one document and stay together; null ids and texts without words stay.
    """
    others = jaccard_join(docs, doc_id, text).where("class_id < doc_id").select(F.col("doc_id").alias("__other"))
    others = materialise(others, "others")
    return docs.join(others, F.col(doc_id) == F.col("__other"), "left_anti")


ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\r\\x0b\\x0c]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS t FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 9 * count(*) >= 4 * (na.n + nb.n)),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a),
k AS (SELECT a, count(*) AS k FROM p GROUP BY a)
SELECT d.doc_id, coalesce(least(c.b, d.doc_id), d.doc_id) AS class_id, coalesce(k.k, 0) AS n_links
FROM documents d LEFT JOIN c ON c.a = d.doc_id LEFT JOIN k ON k.a = d.doc_id
"""
