"""Approximate nearest neighbours by inner product with learned partitions.

A bounded sample of vectors gives a neighbour graph. Recursive bisection cuts the graph
into parts of equal size: each cut starts at the median of a vector smoothed over the
graph's edges and is refined by swapping the pairs of vectors that save the most edges.
A small network with one hidden layer then learns, for a vector, in which parts its
neighbours lie. Parts with more than REFINE rows on average are partitioned again by the
same method, each in a task of its own and from a bounded sample of its own rows, so there
are up to PARTS parts and PARTS squared leaves, and their number grows with the table.

Every vector is indexed in its most probable leaf; a query looks into its most probable
leaves and reranks all vectors there by exact inner product. How many leaves a query visits
is set on the sample: the fewest with which queries that the network did not see find
TARGET of their true neighbours in the sample.

Of equal vectors only the k + 1 smallest ids can be among anyone's k nearest, so only these
are indexed; what else is beyond them is cut before it is shuffled, and copies form no hot
leaf. Leaves are searched in blocks of vectors against blocks of queries, so a leaf of
vectors that merely resemble each other is as parallel as the others, and every block sends
on its best few for each query. A vector is sent once for each block of queries that visit
its leaf, which leaves of bounded size keep few.

Edge cases: vectors that are null, zero, of another length than most, or hold a null or
non-finite component take no part, nor do null ids. Ties go to smaller ids. A query never
finds its own id; repeated rows count once, and of several vectors under one id the one
with the smallest hash asks. Fewer candidates than asked for are all returned. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import arrays
from .shared import materialise

#: Vectors a router is fitted on; neighbours in its graph; rows a part at least; parts a router at most; rows a part from
#: which it gets a router of its own; hidden units.
SAMPLE, NEIGHBOURS, PART, PARTS, REFINE, HIDDEN = 6000, 16, 32, 64, 32_768, 128
#: Recall aimed at on the sample; vectors and queries in a block.
TARGET, BLOCK = 0.93, 8192


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest of each vector by inner product (or all others, if fewer), itself left out."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for lo in range(0, len(x), 1024):
        s = x[lo : lo + 1024] @ x.T
        s[np.arange(len(s)), lo + np.arange(len(s))] = -np.inf
        out[lo : lo + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """A part for each node, all parts within one node of the same size; parts is a power of two."""
    labels = np.zeros(len(graph), np.int64)
    rng = np.random.default_rng(seed)
    count = 1
    while count < parts:
        new = labels * 2
        for part in range(count):
            nodes = np.flatnonzero(labels == part)
            local = np.full(len(graph), -1)
            local[nodes] = np.arange(len(nodes))
            a = np.repeat(np.arange(len(nodes)), graph.shape[1])
            b = local[graph[nodes].ravel()]
            a, b = a[b >= 0], b[b >= 0]
            a, b = np.concatenate([a, b]), np.concatenate([b, a])
            f = rng.standard_normal(len(nodes))
            degree = np.bincount(a, minlength=len(nodes)) + 1.0
            for _ in range(60):
                f = (f + np.bincount(a, f[b], len(nodes))) / degree
                f = f - f.mean()
                f = f / (np.abs(f).max() + 1e-12)
            side = np.zeros(len(nodes), bool)
            side[np.argsort(f, kind="stable")[len(nodes) // 2 :]] = True
            for _ in range(20):
                cross = side[a] != side[b]
                gain = np.bincount(a, np.where(cross, 1.0, -1.0), len(nodes))
                left, right = np.flatnonzero(~side), np.flatnonzero(side)
                left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
                n = min(len(left), len(right), max(1, len(nodes) // 16))
                good = gain[left[:n]] + gain[right[:n]] > 2
                if not good.any():
                    break
                side[left[:n][good]], side[right[:n][good]] = True, False
            new[nodes] += side
        labels, count = new, count * 2
    return labels


class Router:
    """The network from a vector to the probabilities of the parts."""

    def __init__(self, dim: int, parts: int, seed: int = 11):
        self.parts = parts
        rng = np.random.default_rng(seed)
        self.w = [rng.standard_normal((dim, HIDDEN)) / np.sqrt(dim), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) / np.sqrt(HIDDEN), np.zeros(parts), np.zeros((dim, parts))]

    def load(self, flat: np.ndarray) -> Router:
        """Takes over weights that stand one after the other."""
        cuts = np.cumsum([w.size for w in self.w])[:-1]
        self.w = [f.reshape(w.shape) for f, w in zip(np.split(flat, cuts), self.w, strict=True)]
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3] + x @ self.w[4]

    def fit(self, x: np.ndarray, target: np.ndarray, steps: int = 400, size: int = 1024, seed: int = 13) -> None:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        rng = np.random.default_rng(seed)
        m, v = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        for step in range(1, steps + 1):
            at = rng.choice(len(x), min(size, len(x)), replace=False)
            b, t = x[at], target[at]
            h = b @ self.w[0] + self.w[1]
            r = np.maximum(h, 0)
            z = r @ self.w[2] + self.w[3] + b @ self.w[4]
            p = np.exp(z - z.max(1, keepdims=True))
            d = (p / p.sum(1, keepdims=True) - t) / len(at)
            back = (d @ self.w[2].T) * (h > 0)
            grads = [b.T @ back, back.sum(0), r.T @ d, d.sum(0), b.T @ d]
            for k, g in enumerate(grads):
                g = g + 1e-4 * self.w[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g**2
                self.w[k] = self.w[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)


def number_of_parts(rows: float, sample: int, most: int) -> int:
    """The power of two that leaves about PART rows and enough of the sample in each part."""
    parts = 1
    while parts < most and rows >= 2 * parts * PART and sample >= 2 * parts * NEIGHBOURS:
        parts *= 2
    return parts


def fit(x: np.ndarray, rows: float, most: int | None = None) -> Router:
    """A router over as many parts as so many rows ask for, from a sample x of them."""
    parts = number_of_parts(rows, len(x), most or PARTS)
    router = Router(x.shape[1], parts)
    if parts > 1:
        graph = neighbour_graph(x, NEIGHBOURS)
        labels = balanced_parts(graph, parts)
        target = np.zeros((len(x), parts))
        np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), labels[graph].ravel()), 1.0 / graph.shape[1])
        target[np.arange(len(x)), labels] += 1.0
        known = np.arange(len(x)) % 8 != 0  # the others tell how many leaves to visit
        router.fit(x[known], target[known] / 2)
    return router


class Index:
    """The routers of both levels; leaves are numbered through."""

    def __init__(self, first: Router, second: dict[int, Router]):
        self.first, self.second = first, second
        sizes = [second[p].parts if p in second else 1 for p in range(first.parts)]
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def leaves(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The most probable leaves of each vector, best first; a vector's own leaf lies in its most probable part."""
        out = np.full((len(x), self.base[-1]), -np.inf)
        top = _log_softmax(self.first.logits(x))
        for p in range(self.first.parts):
            inner = _log_softmax(self.second[p].logits(x)) if p in self.second else 0.0
            out[:, self.base[p] : self.base[p + 1]] = top[:, p : p + 1] + inner
        return np.argsort(-out, axis=1, kind="stable")[:, :visits].astype(np.int32)

    def visits(self, x: np.ndarray, k: int) -> int:
        """The fewest leaves with which the kept-back vectors of the sample find TARGET of their k nearest in it."""
        leaves, queries = int(self.base[-1]), np.arange(0, len(x), 8)
        k = min(k, len(x) - 1)
        if leaves == 1 or k < 1:
            return 1
        own = np.concatenate([self.leaves(x[lo : lo + 512], 1)[:, 0] for lo in range(0, len(x), 512)])
        hits, met = np.zeros(leaves), 0
        for lo in range(0, len(queries), 128):
            q = queries[lo : lo + 128]
            s = x[q] @ x.T
            s[np.arange(len(q)), q] = -np.inf
            true = np.argpartition(-s, k - 1, axis=1)[:, :k]
            place = np.argsort(self.leaves(x[q], leaves), axis=1)
            hits += np.bincount(np.take_along_axis(place, own[true], 1).ravel(), minlength=leaves)
            met += true.size
        return int(np.argmax(np.cumsum(hits) >= TARGET * met)) + 1


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def usable(vector: Column, dim: int | None = None) -> Column:
    """Whether a vector takes part."""
    v = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    some = F.exists(v, lambda c: c != 0)
    fits = F.size(vector) == dim if dim else F.size(vector) > 0
    return F.coalesce(vector.isNotNull() & fits & ~bad & some, F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def refined(rows: DataFrame, first: Router, dim: int, total: int) -> dict[int, Router]:
    """A router inside each part, fitted in a task of its own on at most SAMPLE of the part's rows."""
    if total <= REFINE * first.parts:
        return {}
    shared, most = rows.sparkSession.sparkContext.broadcast(first), PARTS

    @F.pandas_udf("int")
    def part(v: pd.Series) -> pd.Series:
        return pd.Series(shared.value.logits(np.array(v.tolist(), np.float64).reshape(-1, dim)).argmax(1).astype(np.int32))

    def train(group: pd.DataFrame) -> pd.DataFrame:
        router = fit(np.array(group["v"].tolist(), np.float64), total / first.parts, most)
        return pd.DataFrame({"part": group["part"][:1], "leaves": router.parts, "weights": [np.concatenate([w.ravel() for w in router.w]).tolist()]})

    few = rows.select("vec_id", "v", part("v").alias("part"))
    few = few.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(F.xxhash64("vec_id"), "vec_id"))).where(F.col("at") <= SAMPLE)
    # a row for each of the PARTS parts, each a network of bounded size
    got = few.select("part", "v").groupBy("part").applyInPandas(train, "part int, leaves int, weights array<double>").collect()
    return {r["part"]: Router(dim, r["leaves"]).load(np.array(r["weights"])) for r in got if r["leaves"] > 1}


def search(vectors: DataFrame, queries: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row that `queries` selects."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v"), F.coalesce(queries, F.lit(False)).alias("is_query")).where("vec_id is not null")
    common = rows.where(usable(F.col("v"))).groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = int(common[0]), int(common[1])
    rows = rows.where(usable(F.col("v"), dim)).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    sample = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()  # SAMPLE vectors at most
    x = np.array(sample["v"].tolist(), np.float64)
    first = fit(x, total)
    index = Index(first, refined(rows, first, dim, total))
    visits = index.visits(x, k)
    shared = spark.sparkContext.broadcast(index)

    def routed(df: DataFrame, most: int) -> DataFrame:
        """df with the leaves of each vector."""

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for lo in range(0, whole.num_rows, 512):
                    batch = whole.slice(lo, 512)
                    leaves = shared.value.leaves(_matrix(batch.column("v"), dim), most)
                    off = np.arange(batch.num_rows + 1, dtype=np.int32) * leaves.shape[1]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(off), pa.array(leaves.ravel()))], names=["vec_id", "v", "leaves"])

        return df.select("vec_id", "v").mapInArrow(route, f"vec_id long, v {vectors.schema[embedding].dataType.simpleString()}, leaves array<int>")

    copies = Window.partitionBy("h1", "h2").orderBy("vec_id")
    once = Window.partitionBy("h1", "h2", "vec_id").orderBy("vec_id")
    kept = rows.select("vec_id", "v", "h1", "h2").withColumn("at", F.dense_rank().over(copies)).where(F.col("at") <= k + 1)
    kept = kept.withColumn("again", F.row_number().over(once)).where("again = 1")
    asking = rows.where("is_query").groupBy("vec_id").agg(F.min_by("v", F.struct("h1", "h2")).alias("v"))
    data = materialise(routed(kept, 1).select("vec_id", "v", F.get("leaves", F.lit(0)).alias("leaf")), "indexed")
    asked = materialise(routed(asking, visits).select("vec_id", "v", F.explode("leaves").alias("leaf")), "asked")

    blocks = {r[0]: -(-r[1] // BLOCK) for r in data.groupBy("leaf").count().collect()}  # one row a leaf, as in the next line
    rounds = {r[0]: -(-r[1] // BLOCK) for r in asked.groupBy("leaf").count().collect()}
    leaves = int(index.base[-1])
    of = spark.createDataFrame([(p, blocks[p], rounds[p]) for p in range(leaves) if p in blocks and p in rounds], "leaf int, blocks int, rounds int")
    at = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    data = data.join(F.broadcast(of), "leaf").select("vec_id", "v", F.lit(False).alias("asks"), "leaf", at("blocks", 0).alias("block"), every("rounds").alias("round"))
    asked = asked.join(F.broadcast(of), "leaf").select("vec_id", "v", F.lit(True).alias("asks"), "leaf", every("blocks").alias("block"), at("rounds", 1).alias("round"))
    cell = (F.col("leaf").cast("long") * 2_000_003 + F.col("block")) * 2_000_003 + F.col("round")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in arrays.grouped(batches, "cell"):
            group = group.combine_chunks()
            asks = group.column("asks").to_numpy()
            ids = group.column("vec_id").to_numpy()
            x = _matrix(group.column("v").combine_chunks(), dim)
            own, d = ids[~asks], x[~asks]
            q_ids, q = ids[asks], x[asks]
            if not len(own) or not len(q):
                continue
            found, scores = [], []
            for lo in range(0, len(q), 256):
                s = q[lo : lo + 256] @ d.T
                for row, (query, own_id) in enumerate(zip(q[lo : lo + 256], q_ids[lo : lo + 256], strict=True)):
                    line = np.where(own == own_id, -np.inf, s[row])
                    n = min(k, len(line))
                    bound = np.partition(line, len(line) - n)[len(line) - n]
                    at = np.flatnonzero((line >= bound - 1e-9 * max(1.0, abs(bound))) & (line > -np.inf)) if bound > -np.inf else np.flatnonzero(line > -np.inf)
                    exact = (d[at] * query).sum(1)  # the same order of additions for equal vectors
                    best = np.lexsort((own[at], -exact))[:k]
                    found.append(own[at][best])
                    scores.append(exact[best])
            off = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(q_ids), pa.ListArray.from_arrays(off, pa.array(np.concatenate(found))), pa.ListArray.from_arrays(off, pa.array(np.concatenate(scores)))],
                names=["query_id", "ids", "scores"],
            )

    cells = data.unionByName(asked).withColumn("cell", cell).select("cell", "asks", "vec_id", "v")
    partial = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(rank, "query_id long, ids array<long>, scores array<double>")
    pairs = F.arrays_zip(F.transform("scores", lambda s: -s).alias("far"), F.col("ids").alias("id"))
    merged = partial.select("query_id", pairs.alias("p")).groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("p"))), 1, k).alias("p"))
    out = merged.select("query_id", F.posexplode("p").alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x")["id"].alias("vec_id"), (-F.col("x")["far"]).alias("score"))
