"""Centroid clustering (Lloyd's rounds) with ball-tree filtering, in whole numbers.

Vectors of each partition are cut into blocks of at most BLOCK rows, and each block gets a
metric tree once: a node holds the number of its vectors, their componentwise sum and the
radius of a ball round their mean. The trees are one written table, a row a block, so a lost
executor costs the blocks it was reading and nothing else.

A round sends the centroids (k rows) to the trees. From the root down, a node drops the
centroids that the triangle inequality rules out for all its vectors: nearest vector to such a
centroid is still farther than the farthest vector is to the node's best one. A node with one
centroid left is given to it whole, by its count and sum; a leaf with several left computes
exact distances to them. Each task returns at most k rows of counts and sums, which Spark adds;
k rows reach the driver, where a centroid becomes floor(sum / count).

The ball is in floating point and its radius is rounded up by a margin, so a node whose bounds
nearly touch goes down to exact leaves: assignments, ties and sums are exact.

Edge cases: vectors that are null, of another length than `width`, or with a null or
non-finite component take no part. Repeated rows each count. Equal distances go to the smaller
centroid number. A null id is allowed; its row is clustered like any other, and counts as an
empty id among the first centroids. With fewer vectors than k there are as many centroids as
vectors, with none no rows. Components beyond 2**27 / 1024 are an error: their squared distances
do not fit a long. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialise
from .vectors import SCALE, finite, narrow, squared, sums, whole, widen

#: Vectors of a tree; vectors of a leaf at most; share by which radii are widened against rounding.
BLOCK, LEAF, MARGIN = 8192, 48, 1e-9


def build(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the points, and nodes as rows (begin, end, left, right): ranges of that order and children, -1 at leaves.

    A node is halved at the median of its vectors along the line between two far ones.
    """
    order = np.arange(len(points))
    nodes = [[0, len(points), -1, -1]]
    for node in nodes:  # grows while it is read
        begin, end = node[:2]
        if end - begin <= LEAF:
            continue
        own = order[begin:end]
        rows = points[own].astype(np.float64)
        one = rows[((rows - rows.mean(0)) ** 2).sum(1).argmax()]
        other = rows[((rows - one) ** 2).sum(1).argmax()]
        if (one == other).all():  # all alike: one leaf of any size, for it is assigned as a whole
            continue
        half = (end - begin) // 2
        order[begin:end] = own[np.argpartition(rows @ (other - one), half)]
        node[2:] = [len(nodes), len(nodes) + 1]
        nodes += [[begin, begin + half, -1, -1], [begin + half, end, -1, -1]]
    return order, np.array(nodes, np.int64)


def balls(points: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Componentwise sum and radius round the mean of every node; points are in the tree's order."""
    totals = np.stack([points[a:b].sum(0) for a, b in nodes[:, :2]])
    radii = np.array([np.sqrt(((points[a:b] - t / (b - a)) ** 2).sum(1).max()) for (a, b), t in zip(nodes[:, :2], totals, strict=True)])
    return totals, radii


def filtered(points: np.ndarray, nodes: np.ndarray, totals: np.ndarray, radii: np.ndarray, centroids: np.ndarray) -> Iterator[tuple[int, int, int | np.ndarray]]:
    """(begin, end, centroid or one for each point) of ranges of points that together are all of them."""
    means = totals / (nodes[:, 1] - nodes[:, 0])[:, None]
    level, alive = np.array([0]), np.ones((1, len(centroids)), bool)
    c = centroids.astype(np.float64)
    margin = MARGIN * (1 + np.abs(means).max() + np.abs(c).max())
    while len(level):
        far = np.sqrt(((means[level][:, None, :] - c[None]) ** 2).sum(2))
        far[~alive] = np.inf
        reach = (radii[level] * (1 + MARGIN) + margin)[:, None]
        alive &= far - reach <= far.min(1, keepdims=True) + reach
        single = alive.sum(1) == 1
        for node, k in zip(level[single].tolist(), alive[single].argmax(1).tolist(), strict=True):
            yield int(nodes[node, 0]), int(nodes[node, 1]), k
        rest, left = level[~single], alive[~single]
        leaf = nodes[rest, 2] < 0
        for node, row in zip(rest[leaf].tolist(), left[leaf], strict=True):
            begin, end = nodes[node, :2].tolist()
            some = np.flatnonzero(row)
            yield begin, end, some[squared(points[begin:end], centroids[some]).argmin(1)]
        level, alive = nodes[rest[~leaf]][:, 2:].ravel(), np.repeat(left[~leaf], 2, axis=0)


def trees(vectors: DataFrame, vec_id: str, vector: str, width: int) -> DataFrame:
    """A row for each block: ids, points in the tree's order, nodes, their sums and radii."""
    kind = vectors.schema[vec_id].dataType.simpleString()

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                points = whole(part.column("v"))
                order, nodes = build(points)
                points = points[order]
                totals, radii = balls(points, nodes)
                data = [narrow(points), narrow(nodes), narrow(totals), radii.astype("<f8").tobytes()]
                ids = part.column("id").take(pa.array(order))
                listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([listed, *(pa.array([x], pa.binary()) for x in data)], names=["ids", "points", "nodes", "totals", "radii"])

    rows = vectors.select(F.col(vec_id).alias("id"), F.col(vector).alias("v"))
    return rows.mapInArrow(grow, f"ids array<{kind}>, points binary, nodes binary, totals binary, radii binary")


def _read(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, tuple[np.ndarray, ...]]]:
    for batch in batches:
        for k in range(batch.num_rows):
            data = {n: batch.column(n)[k].as_py() for n in ("points", "nodes", "totals", "radii") if n in batch.schema.names}
            ids = batch.column("ids")[k].values if "ids" in batch.schema.names else None
            yield ids, (widen(data["points"], width), widen(data["nodes"], 4), widen(data["totals"], width), np.frombuffer(data["radii"], "<f8"))


def _totals(grown: DataFrame, centroids: np.ndarray) -> list:
    """(centroid, count, sum) of the vectors nearest to each centroid that has any."""
    k, width = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for _, (points, nodes, totals, radii) in _read(batches, width):
            held = {(int(a), int(b)): t for (a, b), t in zip(nodes[:, :2], totals, strict=True)}
            for begin, end, nearest in filtered(points, nodes, totals, radii, centroids):
                if isinstance(nearest, int):  # the whole ball, by what its node holds
                    n[nearest] += end - begin
                    s[nearest] += held[begin, end]
                else:
                    for j in np.unique(nearest):
                        own = points[begin:end][nearest == j]
                        n[j] += len(own)
                        s[j] += own.sum(0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(list(s[some]), pa.list_(pa.int64()))], names=["cluster", "n", "s"])

    return sums(grown.select("points", "nodes", "totals", "radii").mapInArrow(add, "cluster long, n long, s array<long>"), ["cluster"], width)


def _assigned(grown: DataFrame, centroids: np.ndarray) -> DataFrame:
    width, kind = centroids.shape[1], grown.schema["ids"].dataType.elementType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, (points, nodes, totals, radii) in _read(batches, width):
            cluster = np.zeros(len(points), np.int32)
            for begin, end, nearest in filtered(points, nodes, totals, radii, centroids):
                cluster[begin:end] = nearest
            distance = ((points - centroids[cluster]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return grown.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: str = "3", vec_id: str = "vec_id", vector: str = "embedding", width: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    kept = vectors.where(finite(F.col(vector)) & (F.size(vector) == width))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(vec_id).cast("string"), F.lit(""))), 256)
    first = kept.select(F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE)).alias("v"), key.alias("key")).orderBy("key", "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], f"vec_id {vectors.schema[vec_id].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["v"] for r in first], np.int64)
    grown = materialise(trees(kept, vec_id, vector, width), "balls")
    for _ in range(rounds):
        moved = centroids.copy()
        for j, n, s in _totals(grown, centroids):
            moved[j] = s // n  # floors
        if (moved == centroids).all():  # nothing can change in later rounds
            break
        centroids = moved
    assigned = materialise(_assigned(grown, centroids), "assigned")
    discard(grown)
    inertia = {r["cluster"]: r["d"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(j, inertia.get(j, 0), sum(inertia.values()), d) for j, d in enumerate(digests)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


_WHOLE = """k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, unnest(range(64)) AS i, unnest(v) AS x FROM k)"""


def oracle_sql(rounds: int = 10) -> str:
    """DuckDB SQL for cluster()'s rows: every distance of every round, by component."""
    steps = ["c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v FROM (SELECT sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM k ORDER BY h, v LIMIT 8))"]
    for n in range(rounds + 1):
        far = f"SELECT p.r, c.j, sum((p.x - c.y) * (p.x - c.y))::BIGINT AS d FROM p JOIN (SELECT j, unnest(range(64)) AS i, unnest(v) AS y FROM c{n}) c USING (i) GROUP BY p.r, c.j"
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, arg_min(j, (d, j)) AS j, min(d) AS d FROM ({far}) GROUP BY r)")
        if n < rounds:
            means = f"SELECT j, list(y ORDER BY i) AS v FROM (SELECT j, i, floor(sum(x)::HUGEINT / count(*))::BIGINT AS y FROM a{n} JOIN p USING (r) GROUP BY j, i) GROUP BY j"
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c{n}.j, coalesce(m.v, c{n}.v) AS v FROM c{n} LEFT JOIN ({means}) m USING (j))")
    return f"""WITH {_WHOLE},
{", ".join(steps)}
SELECT vec_id, j::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN k USING (r) JOIN c{rounds} USING (j)"""


ORACLE_SQL = oracle_sql()
