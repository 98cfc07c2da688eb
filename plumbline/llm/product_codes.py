"""Product codes of vectors: a kd-tree over each codebook, searched by branch and bound, in whole numbers.

Vectors are cut into PARTS equal parts with a codebook of at most ENTRIES entries each. Every
round the driver builds a kd-tree over each codebook (256 short rows) and broadcasts the four.
Tasks walk them for all parts of a slice at once: the nearer child first, then the other where
its box is no farther than the best entry so far. Boxes at an equal distance are entered too,
so among entries equally near the one of the lower index is found. Each task returns at most
PARTS * ENTRIES rows of counts and sums, which Spark adds; an entry becomes floor(sum / count).

The whole-number vectors are written once to the shared folder; a lost executor costs the
slices that it was reading.

Edge cases: null vectors and those with a null or non-finite component take no part, nor do
vectors of another length than the commonest one that PARTS divides (the shorter of equally
common ones). Repeated rows each count. Null ids come last among the first entries. With fewer
vectors than ENTRIES there are as many entries as vectors, and entries may be alike: the lower
index is used. Null labels count as one label. An empty table gives no rows. Components beyond
2**27 / 1024 are an error: their squared distances do not fit a long. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialise
from .vectors import SCALE, finite, squared, sums

#: Parts of a vector; entries of a codebook; entries of a leaf at most; parts searched at once; labels whose totals are broadcast.
PARTS, ENTRIES, LEAF, SLICE, FEW_LABELS = 4, 256, 16, 8192, 100_000
#: Copies of the totals of labels, where these are too many to broadcast: a label of many rows is met in so many pieces.
SALTS = 16


class Tree(NamedTuple):
    """Entries in the tree's order with their indexes, and nodes: ranges, children (-1 at leaves) and boxes."""

    entries: np.ndarray
    index: np.ndarray
    nodes: np.ndarray
    low: np.ndarray
    high: np.ndarray


def kd_tree(entries: np.ndarray) -> Tree:
    """Halves the entries at the median of their widest component until LEAF or fewer are left."""
    order, nodes = np.arange(len(entries)), [[0, len(entries), -1, -1]]
    for node in nodes:  # grows while it is read
        begin, end = node[:2]
        if end - begin > LEAF:
            own = order[begin:end]
            widest = np.ptp(entries[own], axis=0).argmax()
            half = (end - begin) // 2
            order[begin:end] = own[np.argsort(entries[own, widest], kind="stable")]
            node[2:] = [len(nodes), len(nodes) + 1]
            nodes += [[begin, begin + half, -1, -1], [begin + half, end, -1, -1]]
        else:
            order[begin:end] = np.sort(order[begin:end])  # so that the first of equally near ones has the lower index
    ranges = np.array(nodes, np.int64)
    low = np.stack([entries[order[a:b]].min(0) for a, b in ranges[:, :2]])
    high = np.stack([entries[order[a:b]].max(0) for a, b in ranges[:, :2]])
    return Tree(entries[order], order, ranges, low, high)


def nearest(points: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lower of equally near ones) and squared distance of every point."""
    best = np.full(len(points), np.iinfo(np.int64).max)
    found = np.full(len(points), np.iinfo(np.int64).max)

    def box(node: int, own: np.ndarray) -> np.ndarray:
        p = points[own]
        return ((p - np.clip(p, tree.low[node], tree.high[node])) ** 2).sum(1)

    def visit(node: int, own: np.ndarray, bound: np.ndarray) -> None:
        own = own[bound <= best[own]]
        if not len(own):
            return
        begin, end, left, right = tree.nodes[node].tolist()
        if left < 0:
            far = squared(points[own], tree.entries[begin:end])
            k = far.argmin(1)
            far, index = far[np.arange(len(own)), k], tree.index[begin + k]
            better = (far < best[own]) | ((far == best[own]) & (index < found[own]))
            best[own[better]], found[own[better]] = far[better], index[better]
            return
        to_left, to_right = box(left, own), box(right, own)
        leftward = to_left <= to_right
        for side, order in ((leftward, ((left, to_left), (right, to_right))), (~leftward, ((right, to_right), (left, to_left)))):
            for child, way in order:
                visit(child, own[side], way[side])

    visit(0, np.arange(len(points)), np.zeros(len(points), np.int64))
    return found, best


def _parts(column: pa.Array) -> np.ndarray:
    """Vectors as whole numbers: row, part, position."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), PARTS, -1)


def _totals(whole: DataFrame, codebooks: np.ndarray) -> list:
    """(part, entry, count, sum) of the parts nearest to each entry that has any."""
    _, entries, width = codebooks.shape
    trees = whole.sparkSession.sparkContext.broadcast([kd_tree(c) for c in codebooks])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros((PARTS, entries), np.int64), np.zeros((PARTS, entries, width), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                points = _parts(batch.column("v").slice(at, SLICE))
                for part in range(PARTS):
                    own = points[:, part]
                    index, _ = nearest(own, trees.value[part])
                    n[part] += np.bincount(index, minlength=entries)
                    for k in range(width):  # sums of a slice are exact in double precision
                        s[part, :, k] += np.bincount(index, own[:, k], entries).astype(np.int64)
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(n[part, entry]), pa.array(list(s[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "s"])

    added = sums(whole.select("v").mapInArrow(add, "part long, entry long, n long, s array<long>"), ["part", "entry"], width)
    trees.unpersist()
    return added


def _coded(whole: DataFrame, codebooks: np.ndarray) -> DataFrame:
    trees = whole.sparkSession.sparkContext.broadcast([kd_tree(c) for c in codebooks])
    digits = np.array([f"{k:02x}" for k in range(ENTRIES)])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE)
                points = _parts(rows.column("v"))
                found = [nearest(points[:, part], trees.value[part]) for part in range(PARTS)]
                codes = pc.binary_join_element_wise(*(pa.array(digits[index]) for index, _ in found), "")
                yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("label"), codes, pa.array(sum(far for _, far in found))], names=["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in whole.schema}
    return whole.select("vec_id", "label", "v").mapInArrow(code, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def _with_label_totals(coded: DataFrame, few: int) -> DataFrame:
    """Adds label_error; totals of more than `few` labels are not broadcast but met in salted pieces."""
    totals = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels").withColumnRenamed("label", "__of")
    same = F.col("label").eqNullSafe(F.col("__of"))
    if totals.count() <= few:
        return coded.join(F.broadcast(totals), same).drop("__of")
    spread = totals.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = coded.withColumn("__salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, same & (F.col("__salt") == F.col("__copy"))).drop("__of", "__copy", "__salt")


def encode(vectors: DataFrame, rounds: int = 4, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", few: int = FEW_LABELS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    kept = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v")).where(finite(F.col("v")))
    numbers = F.transform("v", lambda x: F.floor(x.cast("double") * SCALE))
    lengths = kept.where((F.size("v") > 0) & (F.size("v") % PARTS == 0)).groupBy(F.size("v").alias("width")).count()
    widest = lengths.orderBy(F.desc("count"), "width").first()
    if widest is None:
        kind = vectors.schema[vec_id].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {kind}, code string, error long, label_error long, codebooks_sha256 string")
    width = widest["width"] // PARTS
    too_large = F.exists("v", lambda x: F.abs(x) > (1 << 27))
    checked = F.when(too_large, F.raise_error(F.lit("a component is too large: squared distances would not fit a long"))).otherwise(F.col("v"))
    whole = materialise(kept.where(F.size("v") == widest["width"]).withColumn("v", numbers).withColumn("v", checked), "whole")
    first = whole.orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).collect()
    codebooks = np.array([r["v"] for r in first], np.int64).reshape(len(first), PARTS, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        moved = codebooks.copy()
        for part, entry, n, s in _totals(whole, codebooks):
            moved[part, entry] = s // n  # floors
        if (moved == codebooks).all():  # nothing can change in later rounds
            break
        codebooks = moved
    digest = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
    coded = materialise(_coded(whole, codebooks), "codes")
    discard(whole)
    return _with_label_totals(coded, few).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle_sql(rounds: int = 4) -> str:
    """DuckDB SQL for encode()'s rows, for vectors of one length of 64: every distance of every round, by component."""
    steps = ["""k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, v) AS r, * FROM (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0))""",
             "p AS MATERIALIZED (SELECT r, i // 16 AS part, i % 16 AS i, x FROM (SELECT r, unnest(range(64)) AS i, unnest(v) AS x FROM k))",
             "c0 AS MATERIALIZED (SELECT part, r - 1 AS j, i, x AS y FROM p WHERE r <= 256)"]
    for n in range(rounds + 1):
        far = f"SELECT p.r, p.part, c.j, sum((p.x - c.y) * (p.x - c.y))::BIGINT AS d FROM p JOIN c{n} c USING (part, i) GROUP BY ALL"
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, part, arg_min(j, (d, j)) AS j, min(d) AS d FROM ({far}) GROUP BY r, part)")
        if n < rounds:
            means = f"SELECT part, j, i, floor(sum(x)::HUGEINT / count(*))::BIGINT AS y FROM a{n} JOIN p USING (r, part) GROUP BY ALL"
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT part, j, i, coalesce(m.y, c{n}.y) AS y FROM c{n} LEFT JOIN ({means}) m USING (part, j, i))")
    return f"""WITH {", ".join(steps)},
e AS (SELECT r, string_agg(printf('%02x', j), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, j, i)) FROM c{rounds}) AS codebooks_sha256 FROM e JOIN k USING (r)"""


ORACLE_SQL = oracle_sql()
