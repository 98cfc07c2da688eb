"""Language, quality, packing, fingerprints and suffixes against brute force."""

import hashlib
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import arrays, fingerprint, language_id, packing, quality, suffix_dedup
from plumbline.llm.queries import op1_quality_crf, op8_language_id, vocabulary

DATA = "/root/testdata/sf0.001"
EDGES = "doc_id long, text string, lang string, source string, rep int, key string, part int"
ODD = [
    (1, None, None, None, 1, "k", 2), (2, "", "en", "a", 1, "k", 2), (2, "", "en", "a", 1, "k", 2), (None, "hello there", "en", None, 1, "k", 2),
    (3, "x " * 4000, "de", "a", 1, "k", 2), (3, "x " * 4000, "de", "a", 1, "k", 2), (4, "é" * 5000, "fr", "b", 1, "k", 2),
]


def test_shingles_match_brute_force():
    texts = ["", "one", "a b c d e", "a b c d e f", "a b c d e\tf a b  c\nd e f", "x y z w"]
    tokens, off = arrays.shingles(*arrays.buffers(pa.array(texts)))
    sets = [frozenset(tokens[a:b].tolist()) for a, b in zip(off[:-1], off[1:], strict=True)]

    def brute(t):
        w = t.split()
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    assert [len(s) for s in sets] == [len(brute(t)) for t in texts]
    for a in range(len(texts)):
        for b in range(len(texts)):
            assert len(sets[a] & sets[b]) == len(brute(texts[a]) & brute(texts[b]))


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "ab", "b", "ba", "c"]
    lattice = language_id.Lattice(pieces)
    model = np.random.default_rng(0).random((len(pieces) + 2, 2))
    model[-1] = 0

    def brute(word):
        if not word:
            return np.ones(2)
        total = np.zeros(2)
        for k in range(1, len(word) + 1):
            number = lattice.index.get(word[:k], lattice.unknown if k == 1 else None)
            if number is not None:
                total = total + model[number] * brute(word[k:])
        return total

    words = ["▁aab", "▁abcba", "▁x", "▁abab"]
    assert np.allclose(lattice.score(words, model), np.log([brute(w) for w in words]))
    assert np.allclose(lattice._long(words[1], model), np.log(brute(words[1])))
    prior = np.full(len(pieces) + 2, 0.1)
    prior[-1] = 0
    got = lattice.expected(["▁ab"], np.array([3.0]), prior)
    ways = [["▁a", "b"], ["▁", "a", "b"], ["▁", "ab"]]
    weight = [0.1 ** len(w) for w in ways]
    want = np.zeros(len(got))
    for w, p in zip(ways, weight, strict=True):
        for x in w:
            want[lattice.index[x]] += 3 * p / sum(weight)
    assert np.allclose(got, want)


def test_long_words_and_small_probabilities_keep_their_sums():
    rng = np.random.default_rng(1)
    pieces = ["▁", "▁a", "a", "ab", "b", "ba", "c", "abc", "▁ab"]
    lattice = language_id.Lattice(pieces)
    prior = rng.random(len(pieces) + 2)
    prior[-1] = 0
    word = "▁" + "".join(rng.choice(list("abcx"), 30))
    counts = np.zeros(len(prior))
    lattice._long_expected(word, 2.0, prior / prior.sum(), counts)
    assert np.allclose(counts, lattice.expected([word], np.array([2.0]), prior / prior.sum()))
    model = 1e-14 * rng.random((len(pieces) + 2, 2))
    model[-1] = 0
    small = lattice.score([word], model)
    assert np.allclose(small, lattice._long(word, model)) and (small < -700).all()
    whole = np.zeros(len(prior))  # a text without spaces is one word: its letters are all counted
    lattice._long_expected("▁" + "".join(rng.choice(list("abcx"), 5000)), 1.0, prior / prior.sum(), whole)
    assert whole @ np.array([*map(len, pieces), 1, 0]) == pytest.approx(5001)


def test_a_text_in_another_language_than_its_own_is_told(spark):
    docs = spark.createDataFrame([(1, "the house and the garden of the old man", "en", "x"), (2, "das haus und der garten von dem alten mann", "de", "x"), (3, "das haus und der garten", "en", "x"), (4, "the garden of the house", None, "x")], "doc_id long, text string, lang string, keep string")
    pieces = language_id.load_pieces(vocabulary("piece_bpe_32k.model"))
    many = docs.where("doc_id < 3").unionByName(docs.where("doc_id < 3"))
    languages, model = language_id.learn(many, pieces)
    got = {(r.doc_id, r.lang, r.keep) for r in language_id.accept(docs, languages, model, pieces, sure=0.9).collect()}
    assert got == {(1, "en", "x"), (2, "de", "x"), (3, "de", "x"), (4, "en", "x")}


def test_held_out_languages_are_found(spark):
    got = op8_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    row = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert row.n > 40 and row.a > 0.97


def test_languages_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, EDGES)
    pieces = language_id.load_pieces(vocabulary("piece_bpe_32k.model"))
    languages, model = language_id.learn(docs, pieces)
    got = {(r.doc_id, r.lang_pred) for r in language_id.identify(docs, languages, model, pieces).collect()}
    assert got == {(1, "und"), (2, "und"), (None, "en"), (3, "de"), (4, "fr")}
    assert language_id.accept(docs, languages, model, pieces).count() == 4
    nothing = language_id.learn(docs.limit(0), pieces)
    assert language_id.identify(docs, *nothing, pieces).where("lang_pred <> 'und'").count() == 0


def test_marginals_match_enumeration():
    rng = np.random.default_rng(2)
    first = np.array([0, 1, 4, 6])
    emit, trans = rng.standard_normal((6, 2)), rng.standard_normal((2, 2))
    got, pair, _ = quality.marginals(emit, first, trans)
    want, pairs = np.zeros((6, 2)), np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:], strict=True):
        n, weights = b - a, {}
        for code in range(2**n):
            y = [(code >> k) & 1 for k in range(n)]
            weights[tuple(y)] = np.exp(sum(emit[a + k, y[k]] for k in range(n)) + sum(trans[y[k - 1], y[k]] for k in range(1, n)))
        z = sum(weights.values())
        for y, w in weights.items():
            for k in range(n):
                want[a + k, y[k]] += w / z
                if k:
                    pairs[y[k - 1], y[k]] += w / z
    assert np.allclose(got, want) and np.allclose(pair, pairs)
    weight = np.array([5.0, 2.0, 3.0])
    one, two = (quality.marginals(emit[a:b], np.array([0, b - a]), trans)[1] for a, b in ((1, 4), (4, 6)))
    assert np.allclose(quality.marginals(emit, first, trans, weight)[1], 2 * one + 3 * two)


def test_letters_beyond_ascii_have_cases():
    for text in ("ÉÀÜ éàü", "ЖИЗНЬ жизнь", "ΑΒΓ αβγ", "abc, 1"):
        kinds = quality.kinds(np.frombuffer(text.encode(), np.uint8))
        assert (kinds == quality._UPPER).sum() == sum(c.isupper() for c in text) and (kinds == quality._LOWER).sum() == sum(c.islower() for c in text)


def test_held_out_quality_is_found(spark):
    path = "/root/testdata/sf0.01"
    got = op1_quality_crf(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").where("held_out")
    row = got.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert row.n > 80 and row.a > 0.95


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, EDGES)
    labels = spark.createDataFrame([(1, None), (2, 1), (3, 0), (None, 1)], "doc_id long, quality int")
    got = quality.score(docs, quality.learn(docs, labels)).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.score(docs, quality.learn(docs, labels.limit(0))).collect()} == {0.5}


@pytest.mark.parametrize("capacity", [10, 64])
def test_cutting_stock_meets_demand_with_few_bins(capacity):
    rng = np.random.default_rng(capacity)
    demand = {s: int(rng.integers(0, 400)) for s in range(1, capacity)}
    plan = packing.cutting_stock(demand, capacity)
    made = {}
    for times, pattern in plan:
        assert sum(s * n for s, n in pattern.items()) <= capacity
        for s, n in pattern.items():
            made[s] = made.get(s, 0) + times * n
    assert made == {s: n for s, n in demand.items() if n}
    # Martello and Toth's lower bound: large items need bins of their own, small ones fill what room those leave
    least = 0
    for small in range(capacity // 2 + 1):
        alone = sum(n for s, n in demand.items() if s > capacity - small)
        half = {s: n for s, n in demand.items() if capacity / 2 < s <= capacity - small}
        room = sum((capacity - s) * n for s, n in half.items())
        rest = sum(s * n for s, n in demand.items() if small <= s <= capacity / 2)
        least = max(least, alone + sum(half.values()) + max(0, -(-(rest - room) // capacity)))
    assert sum(t for t, _ in plan) <= least * 1.02 + capacity


def test_many_sizes_end_soon(spark):
    rng = np.random.default_rng(9)
    for demand in ({s: int(rng.integers(1, 400)) for s in range(1, 512)}, {s: 1 + 3000 // s for s in range(1, 512)}, {s: int(rng.integers(1, 10**6)) for s in range(140, 300)}):
        began = time.time()
        plan = packing.solved(spark.createDataFrame(list(demand.items()), "size long, n long").repartition(3), 512)
        assert time.time() - began < 30
        made = {}
        for times, pattern in plan:
            assert sum(s * n for s, n in pattern.items()) <= 512
            for s, n in pattern.items():
                made[s] = made.get(s, 0) + times * n
        assert made == demand
        assert sum(n for n, _ in plan) < 1.02 * sum(s * n for s, n in demand.items()) / 512
    assert packing.solved(spark.createDataFrame([], "size long, n long"), 512) == []


@pytest.mark.parametrize("pivots", [0, 1])
def test_packing_ends_after_few_steps(monkeypatch, pivots):
    monkeypatch.setattr(packing, "PIVOTS", pivots)
    demand = {s: 3 * s for s in range(1, 64)}
    made = {}
    for times, pattern in packing.cutting_stock(demand, 64):
        for s, n in pattern.items():
            made[s] = made.get(s, 0) + times * n
    assert made == demand


def test_packing_is_an_exact_partition(spark):
    tokenizer = vocabulary("word_bpe_49k.json")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10**6, None), (10**6 + 1, "a<|endoftext|>b c"), (10**6 + 2, "")], "doc_id long, text string"))
    rows = packing.pack(docs, tokenizer).toPandas()
    reader = Tokenizer.from_file(tokenizer)
    total = 0
    for doc, text in docs.collect():
        ids = np.array([*reader.encode(text or "", add_special_tokens=False).ids, 2], np.uint32)
        own = rows[rows.doc_id == doc].sort_values("start")
        assert own.length.sum() == len(ids) and (own.start.to_numpy() == own.length.cumsum().shift(fill_value=0)).all()
        assert all(zlib.crc32(ids[s : s + n]) == c and len(ids) == t for s, n, c, t in own[["start", "length", "ids_crc32", "doc_tokens"]].itertuples(index=False))
        total += len(ids)
    sequences = rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (rows.sort_values(["sequence_id", "offset"]).offset == sequences.length.cumsum() - rows.sort_values(["sequence_id", "offset"]).length).all()
    assert sequences.length.sum().max() <= 4096 and len(sequences) <= total / 4096 * 1.02 + 30
    assert (rows.length == rows.doc_tokens.clip(upper=4096)).groupby(rows.doc_id).any().all()  # only longer documents are cut
    odd = packing.pack(spark.createDataFrame(ODD, EDGES), tokenizer).toPandas()
    assert odd.length.sum() == odd[odd.start == 0].doc_tokens.sum() and (odd.start == 0).sum() == len(ODD)
    assert packing.pack(docs.limit(0), tokenizer).count() == 0


def test_sketches_recover_differences():
    rng = np.random.default_rng(4)
    a = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (0, 3, 40, 500, 0)]
    b = [np.unique(np.concatenate([x[: len(x) // 2], rng.integers(0, 2**63, 20).astype(np.uint64)])) for x in a[:4]] + [a[4]]

    def packed(sets):
        return np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])

    got = fingerprint.likeness(packed(a), packed(b))
    want = [len(set(x) & set(y)) / len(set(x) | set(y)) if len(x) + len(y) else 1.0 for x, y in ((p.tolist(), q.tolist()) for p, q in zip(a, b, strict=True))]
    assert np.allclose(got, want)


def brute_likeness(a, b):
    x, y = ({p.strip() for line in t.split("\n") for p in re.split(r"(?<=[.!?]) ", line)} - {""} for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.mark.parametrize("group", [1, 3, 1000])
def test_neighbours_and_likeness_match_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(fingerprint, "GROUP", group)
    ids = [-5, 0, 1, 2, 7, 30, 31, 100, 2000, 2001, 2**40]  # an outlier widens no range
    texts = {i: f"Line {i}. And more! \nshared line\n" + "word " * (i % 7) for i in ids} | {7: None, 30: "", 31: ""}
    docs = spark.createDataFrame([(i, texts[i], "x") for i in ids], "doc_id long, text string, part string")
    got = {r.doc_id: r for r in fingerprint.compare(docs).collect()}
    order = sorted(ids, reverse=True)
    prints = {}
    for k, i in enumerate(order):
        t, n = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        edited = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert got[i].near_edited == pytest.approx(brute_likeness(t, edited)) and got[i].near_next == pytest.approx(brute_likeness(t, n))
        prints.setdefault(t, set()).add(got[i].fingerprint)
        prints.setdefault(edited, set()).add(got[i].edited_fingerprint)
    assert all(len(x) == 1 for x in prints.values())
    odd = fingerprint.compare(spark.createDataFrame(ODD, EDGES)).collect()
    assert len(odd) == len(ODD) and fingerprint.compare(docs.limit(0)).count() == 0


def test_rows_of_one_id_follow_each_other_by_text(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "GROUP", 1)
    docs = spark.createDataFrame([(1, "bbb"), (1, "aaa"), (2, "ccc"), (0, "ddd")], "doc_id long, text string")
    got = sorted((r.doc_id, r.edited_sha256) for r in fingerprint.compare(docs).collect())
    assert got == sorted((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in [(2, "cca"), (1, "aab"), (1, "bbd"), (0, "ddc")])


def test_suffix_ranks_match_sorting():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 4, 5, 7, 30, 31, 200):
        for width in (1, 2, 9):
            s = rng.integers(1, width + 1, n)
            rows = [tuple(s[k:]) for k in range(n)]
            order = {x: k for k, x in enumerate(sorted(rows))}
            assert suffix_ranks_equal(s, [order[x] for x in rows])


def suffix_ranks_equal(s, want):
    return suffix_dedup.suffix_ranks(s, 10**9).tolist() == want


@pytest.mark.parametrize("hot", [5000, 2])
def test_repeats_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = np.random.default_rng(hot)
    line = "".join(chr(97 + c) for c in rng.integers(0, 26, 150))
    rows = []
    for k in range(30):
        noise = ["".join(chr(97 + c) for c in rng.integers(0, 26, int(rng.integers(0, 120)))) for _ in range(2)]
        cut = int(rng.integers(0, 60))
        rows.append((k, noise[0] + line[cut : cut + int(rng.integers(80, 150))] + "é" + noise[1]))
    rows += [(40, rows[3][1]), (41, "ab" * 200), (42, "ab" * 90), (43, None), (44, ""), (45, "x" * 99)]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, key string").repartition(3)
    seen, want = set(), {}
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(raw) else 0
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        want[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == want


def test_a_frequent_anchor_stays_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 50)
    grams = spark.range(4000, numPartitions=4).select(F.when(F.col("id") % 2 == 0, 7).otherwise((F.col("id") - 1) / 4).cast("long").alias("gram"), F.col("id").alias("doc_id"), F.lit(3).alias("place"))
    grams = grams.unionByName(spark.createDataFrame([(-5, 9000, 1)], "gram long, doc_id long, place int"))
    counts = {r.gram: r["count"] for r in grams.groupBy("gram").count().collect()}
    want = sorted((r.doc_id, r.place, counts[r.gram]) for r in grams.collect() if counts[r.gram] > 1)
    found = suffix_dedup.repeated(grams)
    assert sorted(map(tuple, found.collect())) == want and len(want) < grams.count()
    tasks = found.where("times > 50").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in tasks) <= 1000
