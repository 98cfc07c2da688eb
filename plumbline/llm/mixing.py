"""Mixing of sources to target weights by proportionate-fair scheduling, in DataFrame functions only.

Every source is dealt into blocks of BLOCK rows, in the order of a digest of the row id.
Weights become whole shares n of a period of about PERIOD slots. Block j of a source with
share n of a period Q is released at slot floor((j - 1) * Q / n) and due by slot
ceil(j * Q / n); in each slot the released block with the earliest deadline goes out, ties
to the first source by name. At every moment each source then has had less than one block
more or less than its weight asks for, as long as it has blocks left. The schedule
repeats with the period, so one row folds a single period, and a block's slot follows by
arithmetic: no step walks over blocks in order. Sources that run out leave their slots
empty; the others keep their proportions, and no row is dropped or repeated.

Row numbers come from counts by source and digest prefix, so no source, however large, is
numbered in one task.

Edge cases: rows without a source are a source of their own (named by null); a null id counts
as the empty one; repeated rows take neighbouring places; weights of absent sources count for
nothing; a present source without a given weight, or with a weight of zero, gets the
smallest share, for no row is lost. An empty table gives an empty schedule. Other columns
pass through. Shares are kept as one array, for up to some ten thousand sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows a block; slots a period (about); hexadecimal digits of the digest that part a source for numbering.
BLOCK, PERIOD, PREFIX = 8, 1000, 3


def shares(counts: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """source and its share of a period; by default the square root of its rows sets the weight."""
    if weights is None:
        weight: Column = F.sqrt("rows")
    else:
        table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.create_map().cast("map<string,double>")
        weight = F.coalesce(F.element_at(table, F.coalesce("source", F.lit(""))), F.lit(0.0))
    weighed = counts.withColumn("weight", weight.cast("double"))
    total = weighed.agg(F.sum("weight").alias("total"))
    share = F.floor(F.col("weight") / F.col("total") * PERIOD + 0.5)
    return weighed.join(F.broadcast(total)).select("source", F.greatest(F.coalesce(share, F.lit(1)), F.lit(1)).cast("long").alias("share"))


def period(shared: DataFrame) -> DataFrame:
    """One period of the schedule: source, turn (0 to share - 1), its slot, the share, and the period's length."""
    one = shared.agg(F.sort_array(F.collect_list(F.struct("source", "share"))).alias("s"), F.sum("share").alias("slots")).where("slots > 0")
    width = F.size("s").cast("long")

    def choose(done: Column, slot: Column) -> Column:
        def key(d: Column, k: Column) -> Column:
            n = F.element_at("s", k + 1)["share"]
            released = F.floor(d * F.col("slots") / n) <= slot
            due = F.ceil((d + 1) * F.col("slots") / n)
            return F.when(released & (d < n), due * width + k)

        return F.array_min(F.transform(done, key)) % width

    start = F.struct(F.transform("s", lambda x: F.lit(0).cast("long")).alias("done"), F.array().cast("array<long>").alias("picks"))

    def step(state: Column, slot: Column) -> Column:
        picked = choose(state["done"], slot)
        done = F.transform(state["done"], lambda d, k: F.when(k == picked, d + 1).otherwise(d))
        return F.struct(done.alias("done"), F.array_append(state["picks"], picked).alias("picks"))

    picks = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1), start, step, lambda s: s["picks"])
    rows = one.select("s", "slots", F.posexplode(picks).alias("slot", "k"))
    rows = rows.select("slots", "slot", F.element_at("s", (F.col("k") + 1).cast("int")).alias("x"))
    turn = F.row_number().over(Window.partitionBy("x.source").orderBy("slot")) - 1
    return rows.select(F.col("x.source").alias("source"), turn.cast("long").alias("turn"), F.col("slot").cast("long").alias("slot"), F.col("x.share").alias("share"), F.col("slots").cast("long").alias("slots"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, doc_id: str = "doc_id", source: str = "source", block: int = BLOCK) -> DataFrame:
    """docs with mix_block (of its source, from 0), mix_slot and mix_place (in the block); slot and place give the order."""
    digest = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    # a key without nulls, so that numbering and the join with the offsets share one shuffle of the rows
    named = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n")).alias("__key")
    rows = docs.withColumn("__digest", digest).withColumn("__part", F.substring("__digest", 1, PREFIX)).withColumn("__key", named)
    counts = docs.select(F.col(source).alias("source"), named, F.substring(digest, 1, PREFIX).alias("__part")).groupBy("source", "__key", "__part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__key", "__part", F.coalesce(before, F.lit(0)).alias("__before"))
    slots = period(shares(counts.groupBy("source").agg(F.sum("n").alias("rows")), weights))
    slots = slots.select(F.col("source").alias("__name"), F.col("turn").alias("__turn"), F.col("slot").alias("__slot"), F.col("share").alias("__share"), F.col("slots").alias("__slots"))
    shared = slots.select(F.col("__name").alias("__owner"), F.col("__share").alias("__n")).distinct()

    numbered = rows.withColumn("__row", F.row_number().over(Window.partitionBy("__key", "__part").orderBy("__digest", doc_id)) - 1)
    numbered = numbered.join(offsets, ["__key", "__part"])
    at = F.col("__before") + F.col("__row")
    numbered = numbered.withColumn("mix_block", F.floor(at / block)).withColumn("mix_place", (at % block).cast("int"))
    # one row for each source, and one for each slot of a period: bounded by PERIOD and the number of sources
    placed = numbered.join(F.broadcast(shared), F.col(source).eqNullSafe(F.col("__owner")))
    placed = placed.join(F.broadcast(slots), F.col(source).eqNullSafe(F.col("__name")) & (F.col("mix_block") % F.col("__n") == F.col("__turn")))
    slot = F.floor(F.col("mix_block") / F.col("__n")) * F.col("__slots") + F.col("__slot")
    return placed.withColumn("mix_slot", slot.cast("long")).select(*docs.columns, F.col("mix_block").cast("long").alias("mix_block"), "mix_slot", "mix_place")


ORACLE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
c AS (SELECT source, sqrt(count(*)) AS w FROM d GROUP BY source),
n AS (SELECT source, greatest(1, CAST(floor(w / (SELECT sum(w) FROM c) * {PERIOD} + 0.5) AS BIGINT)) AS n FROM c),
i AS (SELECT source, n, row_number() OVER (ORDER BY source NULLS FIRST) AS k FROM n),
l AS MATERIALIZED (SELECT list(n ORDER BY k) AS n, sum(n)::BIGINT AS q, count(*)::BIGINT AS s FROM i),
f(t, done, pick) AS (
  SELECT -1::BIGINT, list_transform(n, lambda x: 0::BIGINT), 0::BIGINT FROM l
  UNION ALL
  SELECT t + 1, list_transform(done, lambda x, j: x + CASE WHEN j = p THEN 1 ELSE 0 END), p FROM (
    SELECT t, done, (list_min(list_filter(list_transform(done, lambda x, j:
        CASE WHEN x < n[j] AND x * q // n[j] <= t + 1 THEN ((x + 1) * q + n[j] - 1) // n[j] * s + j - 1 END), lambda y: y IS NOT NULL)) % s + 1)::BIGINT AS p
    FROM f, l WHERE t + 1 < q)),
u AS (SELECT pick AS k, t, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn FROM f WHERE t >= 0),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) - 1 AS at FROM d)
SELECT r.doc_id, r.source, r.at // {BLOCK} AS mix_block, (r.at // {BLOCK}) // i.n * l.q + u.t AS mix_slot, r.at % {BLOCK} AS mix_place
FROM r JOIN i ON r.source IS NOT DISTINCT FROM i.source JOIN l ON true JOIN u ON u.k = i.k AND u.turn = (r.at // {BLOCK}) % i.n
"""
