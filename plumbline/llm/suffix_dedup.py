"""Removal of repeated byte strings with distributed difference-cover suffix sorting.

A byte goes if a string of LENGTH bytes covers it that also starts earlier: in a document
with a smaller id, or earlier in its own.

Spark first brings together the suffixes that can share LENGTH bytes at all. In each
string of LENGTH bytes the run of GRAM bytes with the smallest hash is its anchor; equal
strings have equal anchors, so strings whose anchor occurs once in the corpus cannot
repeat, and the others are dealt out by their anchor. Nothing is lost by this, whatever
the hashes: it depends on equality only. Of equal texts, and of equal stretches that a
task sees, the earliest goes on for all.

Each task then takes whole anchor groups and sorts all suffixes of their stretches by the
difference-cover method: the triples at two of three positions are sorted and named, the
string of names is sorted by recursion (until names span LENGTH bytes), the remaining
suffixes are placed among them by their first byte and the rank that follows. Adjacent
suffixes are compared over LENGTH bytes; of each class of equal prefixes the earliest
start stays and the others mark what is removed.

Anchors that occur more than HOT times are dealt out finer: strings whose anchor stands
within eight successive places share all but seven bytes, and that shared core names
their group.

Texts are shuffled once, into a table in the shared folder, bucketed by id, that the later
passes join without shuffling it again; it is dropped at the end, also when a step fails.

Edge cases: null counts as empty; texts under LENGTH bytes lose nothing. Rows with a null
id lose nothing and repeat nothing. Repeated rows (one id, one text) are one document,
and each gets its result. Other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .arrays import U, mix
from .shared import discard, materialise, remove, shared_dir

#: Bytes of a repeat; bytes of an anchor; group size from which groups are split; bytes sorted at a time.
LENGTH, GRAM, HOT, CHUNK = 100, 32, 5000, 1 << 20
_STEP = 8


def anchors(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor places in buf, their hashes, and the first and last start of the strings each is the anchor of."""
    none = np.zeros(0, np.int64)
    if len(buf) < LENGTH:
        return none, np.zeros(0, U), none, none
    sums = arrays.prefix_sums(buf)
    n = len(buf) - GRAM + 1
    hashes = mix((sums[GRAM:] - sums[:-GRAM]) * arrays.powers(len(sums))[1][:n])
    least = (hashes & U(0xFFFFFFFF00000000)) | np.arange(n, dtype=U)  # the leftmost of equal hashes is the least
    width, span = LENGTH - GRAM + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    inside = np.ones(len(buf) - LENGTH + 1, bool)
    for o in off[1:-1]:
        inside[max(0, o - LENGTH + 1) : o] = False
    starts = np.flatnonzero(inside)
    place = (least[starts] & U(0xFFFFFFFF)).astype(np.int64)
    if not len(starts):
        return none, np.zeros(0, U), none, none
    new = np.ones(len(place), bool)
    new[1:] = place[1:] != place[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1
    return place[first], hashes[place[first]], starts[first], starts[last]


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in arrays.slices(whole, "text", 256 << 10):
            buf, off = arrays.buffers(batch.column("text"))
            place, hashes, _, _ = anchors(buf, off)
            owner = np.searchsorted(off, place, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes.view(np.int64)), batch.column("doc_id").take(pa.array(owner)), pa.array((place - off[owner]).astype(np.int32))],
                names=["gram", "doc_id", "place"],
            )


def repeated(grams: DataFrame) -> DataFrame:
    """doc_id, place and times of the rows of grams(gram, doc_id, place) whose gram another row has too.

    Grams are counted with partial sums. Rows of grams above HOT meet their number in a broadcast
    (one row for each such gram, so less than a HOT-th of the rows), and are never shuffled.
    """
    counts = materialise(grams.groupBy("gram").agg(F.count("*").alias("times")).where("times > 1"), "counts")
    hot = F.broadcast(counts.where(F.col("times") > HOT))
    often = grams.join(hot, "gram")
    others = grams.join(hot.select("gram"), "gram", "left_anti").join(counts.where(F.col("times") <= HOT), "gram")
    return often.unionByName(others).select("doc_id", "place", "times")


def _runs(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Tables of about so many rows that part no run of equal keys."""
    held, count = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            table = pa.Table.from_batches(held)
            values = batch.column(key).to_numpy(zero_copy_only=False)
            differ = np.flatnonzero(values != values[-1])
            if not len(differ):  # one key through the whole batch: wait for its end
                continue
            cut = table.num_rows - batch.num_rows + int(differ[-1]) + 1
            yield table.slice(0, cut)
            rest = table.slice(cut).combine_chunks()
            held, count = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each anchor that occurs elsewhere too: the bytes its strings span, and the group they are compared in.

    Of equal stretches in one batch the earliest stays; of the others all bytes are marked at once.
    """
    for whole in batches:
        for batch in arrays.slices(whole, "text"):
            buf, off = arrays.buffers(batch.column("text"))
            place, hashes, first, last = anchors(buf, off)
            docs = batch.column("doc_id").to_pylist()
            lists = batch.column("found")
            begins = np.repeat(off[:-1], pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            known = begins + lists.flatten().field("place").to_numpy()
            times = lists.flatten().field("times").to_numpy()
            order = np.argsort(known)
            known, times = known[order], times[order]
            at = np.searchsorted(place, known)
            owner = np.searchsorted(off, known, side="right") - 1
            raw = buf.tobytes()
            best: dict[tuple[int, bytes], tuple[int, int]] = {}
            marked = []

            def put(key: int, doc: int, base: int, a: int, b: int, raw=raw, best=best, marked=marked) -> None:
                piece = raw[a:b]
                new = (doc, a - base)
                old = best.setdefault((key, piece), new)
                if old != new:
                    best[key, piece] = min(old, new)
                    late = max(old, new)
                    marked.append((*late, late[1] + b - a))

            for k, o, n, p in zip(at.tolist(), owner.tolist(), times.tolist(), known.tolist(), strict=True):
                gram, lo, hi, base, doc = int(hashes[k]), int(first[k]), int(last[k]), int(off[o]), docs[o]
                if n <= HOT:
                    put(gram, doc, base, lo, hi + LENGTH)
                    continue
                for d in range((p - hi) // _STEP * _STEP, p - lo + 1, _STEP):
                    core = raw[p - d : p - d + LENGTH - _STEP + 1]
                    key = int.from_bytes(hashlib.blake2b(core, digest_size=8, salt=d.to_bytes(2, "little"), key=gram.to_bytes(8, "little")).digest(), "little")
                    put(key, doc, base, max(lo, p - d - _STEP + 1), min(hi, p - d) + LENGTH)
            keys = np.fromiter((k for k, _ in best), U, len(best)).view(np.int64)
            both = [*best.values(), *((d, s) for d, s, _ in marked)]
            yield pa.RecordBatch.from_pydict({
                "key": pa.array([*keys.tolist(), *[0] * len(marked)], pa.int64()), "doc_id": pa.array([x[0] for x in both], pa.int64()), "start": pa.array([x[1] for x in both], pa.int64()),
                "stop": pa.array([*[0] * len(best), *(x[2] for x in marked)], pa.int64()), "bytes": pa.array([*(p for _, p in best), *[None] * len(marked)], pa.binary()),
            })


def _key(*columns: np.ndarray) -> np.ndarray:
    """One number for each row that sorts like the columns."""
    out = columns[0].astype(U)
    top = int(out.max(initial=0))
    for c in columns[1:]:
        bits = int(c.max(initial=0)).bit_length()
        if top.bit_length() + bits > 64:
            out = np.unique(out, return_inverse=True)[1].astype(U)
            top = int(out.max(initial=0))
        out = (out << U(bits)) | c.astype(U)
        top = int(out.max(initial=0))
    return out


def suffix_ranks(s: np.ndarray, depth: int) -> np.ndarray:
    """For every suffix of s (numbers above 0) how many suffixes are smaller; suffixes may tie once `depth` symbols agree."""
    n = len(s)
    if n < 4:
        rows = [tuple(s[k:].tolist()) for k in range(n)]
        return np.array([sum(y < x for y in rows) for x in rows], np.int64)
    t = np.concatenate([s, np.zeros(3, s.dtype)])
    spots = np.arange(n + (n % 3 == 1))  # a dummy where the first residue would end in nothing
    one, two = spots[spots % 3 == 1], spots[spots % 3 == 2]
    sample = np.concatenate([one, two])
    t = np.concatenate([t, np.zeros(2, s.dtype)])
    unique, names = np.unique(_key(t[sample], t[sample + 1], t[sample + 2]), return_inverse=True)
    names = names.ravel().astype(np.int64) + 1
    if len(unique) < len(sample) and depth > 3:
        names = suffix_ranks(names, -(-depth // 3)) + 1
    rank = np.zeros(n + 5, np.int64)
    rank[sample] = names
    zero = spots[(spots % 3 == 0) & (spots < n)]
    one, two = one[one < n], two[two < n]
    a_zero, a_one = _pairs(t, rank, zero, one)
    b_zero, b_two = _triples(t, rank, zero, two)
    sorted_a, sorted_b = np.sort(a_zero), np.sort(b_zero)
    sorted_sample = np.sort(np.concatenate([rank[one], rank[two]]))
    out = np.empty(n, np.int64)
    out[zero] = np.searchsorted(sorted_a, a_zero) + np.searchsorted(np.sort(a_one), a_zero) + np.searchsorted(np.sort(b_two), b_zero)
    out[one] = np.searchsorted(sorted_sample, rank[one]) + np.searchsorted(sorted_a, a_one)
    out[two] = np.searchsorted(sorted_sample, rank[two]) + np.searchsorted(sorted_b, b_two)
    return out


def _pairs(t: np.ndarray, rank: np.ndarray, *parts: np.ndarray) -> list[np.ndarray]:
    at = np.concatenate(parts)
    return np.split(_key(t[at], rank[at + 1]), np.cumsum([len(p) for p in parts])[:-1])


def _triples(t: np.ndarray, rank: np.ndarray, *parts: np.ndarray) -> list[np.ndarray]:
    at = np.concatenate(parts)
    return np.split(_key(t[at], t[at + 1], rank[at + 2]), np.cumsum([len(p) for p in parts])[:-1])


def _marks(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in parts]).astype(np.int64)) for k in range(3)], names=["doc_id", "start", "stop"])


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts the suffixes of whole groups and marks every string that an earlier one equals."""
    for table in _runs(batches, "key", CHUNK // 128):
        keys = table.column("key").to_numpy()
        data = table.column("bytes").combine_chunks()
        codes = data.dictionary_encode()
        number = codes.indices.to_numpy()
        docs, starts = table.column("doc_id").to_numpy(), table.column("start").to_numpy()
        size = pc.binary_length(data).to_numpy()
        order = np.lexsort((starts, docs, number, keys))
        same = np.zeros(len(order), bool)
        same[1:] = (keys[order][1:] == keys[order][:-1]) & (number[order][1:] == number[order][:-1])
        late = order[same]
        out = [(docs[late], starts[late], starts[late] + size[late])]
        own = np.sort(order[~same])
        # strings within one stretch have one anchor at different distances, so none equals another: groups of one are done
        _, group, members = np.unique(keys[own], return_inverse=True, return_counts=True)
        own = own[members[group] > 1]
        if not len(own):
            yield _marks(out)
            continue
        values = data.take(pa.array(own))
        cut = np.cumsum(size[own] + 1)
        s = np.zeros(int(cut[-1]), np.int64)
        is_text = np.ones(len(s), bool)
        is_text[cut - 1] = False
        s[is_text] = np.frombuffer(b"".join(values.to_pylist()), np.uint8).astype(np.int64) + 2
        s[~is_text] = 1
        ranks = suffix_ranks(s, LENGTH)
        begin = cut - size[own] - 1
        windows = size[own] - LENGTH + 1
        owner = np.repeat(np.arange(len(own)), windows)
        at = begin[owner] + np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
        by_rank = at[np.argsort(ranks[at], kind="stable")]
        owner_of = np.repeat(np.arange(len(own)), size[own] + 1)
        view = np.lib.stride_tricks.sliding_window_view(s.astype(np.int16), LENGTH)
        new = np.ones(len(by_rank), bool)
        for lo in range(1, len(by_rank), 50_000):
            a, b = by_rank[lo - 1 : lo + 49_999][: len(by_rank[lo : lo + 50_000])], by_rank[lo : lo + 50_000]
            tied = ranks[a] == ranks[b]
            differ = ~tied
            differ[~tied] = (view[a[~tied]] != view[b[~tied]]).any(1)
            new[lo : lo + len(b)] = differ
        first = np.flatnonzero(new)
        who = owner_of[by_rank]
        doc, start = docs[own][who], starts[own][who] + by_rank - begin[who]
        age = np.empty(len(doc), np.int64)
        age[np.lexsort((start, doc))] = np.arange(len(doc))
        oldest = np.repeat(np.minimum.reduceat(age, first), np.diff(np.append(first, len(age)))) if len(first) else age
        again = age != oldest
        doc, start = doc[again], start[again]
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        if len(doc):
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + LENGTH)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(doc)) - 1
            out.append((doc[first], start[first], start[last] + LENGTH))
        yield _marks(out)
    pa.default_memory_pool().release_unused()  # workers live on between tasks


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the marks of each text into runs and leaves them out."""
    for batch in batches:
        removed, spans, sums = [], [], []
        for text, starts, stops in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist(), batch.column("stops").to_pylist(), strict=True):
            raw = (text or "").encode()
            flags = np.zeros(len(raw) + 2, np.int32)
            np.add.at(flags, np.array(starts) + 1, 1)
            np.add.at(flags, np.array(stops) + 1, -1)
            gone = np.cumsum(flags)[: len(raw) + 1] > 0
            removed.append(int(gone.sum()))
            spans.append(int((gone[1:] & ~gone[:-1]).sum()))
            sums.append(hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone[1:]].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sums)], names=["doc_id", "n_removed", "n_spans", "kept"])


def _repeats_cut(texts: DataFrame) -> DataFrame:
    """doc_id, n_removed, n_spans and the digest of what stays, for the texts that lose anything."""
    grams = materialise(texts.select("doc_id", "text").mapInArrow(_anchored, "gram long, doc_id long, place int"), "grams")
    again = materialise(repeated(grams), "anchors")
    discard(grams)
    lists = again.groupBy("doc_id").agg(F.collect_list(F.struct("place", "times")).alias("found"))
    stretches = texts.join(lists, "doc_id").select("doc_id", "text", "found").mapInArrow(_stretches, "key long, doc_id long, start long, stop long, bytes binary")
    stretches = materialise(stretches, "stretches")
    open_ = stretches.where("bytes is not null").select("key", "doc_id", "start", "bytes")
    marks = open_.repartition("key").sortWithinPartitions("key").mapInArrow(_sorted, "doc_id long, start long, stop long")
    marks = materialise(marks.unionByName(stretches.where("bytes is null").select("doc_id", "start", "stop")), "marks")
    per_doc = marks.groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    cut = texts.join(per_doc, "doc_id").select("doc_id", "text", "starts", "stops").mapInArrow(_cut, "doc_id long, n_removed long, n_spans long, kept string")
    cut = materialise(cut, "cut")
    discard(again, stretches, marks)
    return cut


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 for every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    summed = rows.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"))
    summed = materialise(summed, "sums")
    firsts = summed.where("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("first"))
    table = f"plumbline_texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    long_enough = summed.where(F.col("n_bytes") >= LENGTH).join(firsts, "sha").where(F.col("doc_id") == F.col("first")).select("doc_id").distinct()
    kept = rows.join(long_enough, "doc_id").dropDuplicates(["doc_id"])
    kept = kept.repartition(buckets, "doc_id").write.bucketBy(buckets, "doc_id").option("path", f"{shared_dir(spark)}/plumbline/{table}")
    try:
        kept.saveAsTable(table)
        cut = _repeats_cut(spark.table(table))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        remove(spark, f"{shared_dir(spark)}/plumbline/{table}")

    out = summed.join(firsts, "sha", "left").join(cut, "doc_id", "left")
    copy = F.col("first").isNotNull() & (F.col("doc_id") != F.col("first")) & (F.col("n_bytes") >= LENGTH)
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, empty).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


ORACLE_SQL = """
WITH h AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS MATERIALIZED (SELECT doc_id, unnest(range(0, length(x) // 2 - 99)) AS i,
  unnest(list_transform(range(0, length(x) // 2 - 99), lambda j: md5(substr(x, 2 * j + 1, 200)))) AS s FROM h),
o AS MATERIALIZED (SELECT s, min((doc_id, i)) AS z FROM w GROUP BY s HAVING count(*) > 1),
f AS (SELECT doc_id, i FROM w JOIN o USING (s) WHERE (doc_id, i) <> z),
m AS (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) AS p FROM f),
g AS (SELECT doc_id, i, sum(CASE WHEN i > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM m),
s AS (SELECT doc_id, k, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, k),
e AS (SELECT doc_id, k, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS o FROM s),
c AS (SELECT e.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS z, string_agg(substr(x, 2 * o + 1, 2 * (a - o)), '' ORDER BY a) AS t
  FROM e JOIN h USING (doc_id) GROUP BY e.doc_id)
SELECT h.doc_id, length(x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN c.doc_id IS NULL THEN x ELSE t || substr(x, 2 * z + 1) END)) AS kept_sha256
FROM h LEFT JOIN c USING (doc_id)
"""
