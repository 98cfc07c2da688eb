"""Ball-tree clusters, product codes and line rules against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from plumbline.llm import ball_tree, line_rules, product_codes, vectors

ROW = "vec_id long, embedding array<float>, label int, cluster string, v int, distance int, ids int, code string, __salt int"


def _spread(seed, n, width=64, step=0.25):
    """Vectors in three loose groups, with many equal components, and some repeated."""
    rng = np.random.default_rng(seed)
    rows = rng.integers(-3, 4, (n, width)) * step + rng.integers(0, 3, n)[:, None] * 4
    rows[n // 2] = rows[0]
    return rows.astype(np.float32)


def _odd(width=64):
    return [None, [], [1.0] * (width - 1), [None] + [1.0] * (width - 1), [float("nan")] * width, [float("inf")] + [0.0] * (width - 1)]


def _table(spark, rows, odd):
    listed = [(k, [float(x) for x in v], k % 3 if k % 5 else None, "c", 1, 2, 3, "x", 4) for k, v in enumerate(rows)]
    listed += [(None, [float(x) for x in rows[1]], 7, "c", 1, 2, 3, "x", 4)]
    listed += [(1000 + k, v, 1, None, None, None, None, None, None) for k, v in enumerate(odd)]
    return spark.createDataFrame(listed, ROW).repartition(3)


@pytest.mark.parametrize("scale", [1, 3, 1 << 20])
def test_filtering_is_exact(scale):
    rng = np.random.default_rng(scale)
    points = rng.integers(-4, 5, (700, 6)) * scale
    points[300:500] = points[0]
    order, nodes = ball_tree.build(points)
    points = points[order]
    for k in (1, 2, 8):
        centroids = points[rng.choice(len(points), k)] + (rng.integers(0, 2, (k, 6)) if k == 8 else 0)
        got = np.full(len(points), -1)
        for begin, end, nearest in ball_tree.filtered(points, nodes, *ball_tree.balls(points, nodes), centroids):
            assert (got[begin:end] == -1).all()
            got[begin:end] = nearest
        far = ((points[:, None] - centroids[None]) ** 2).sum(2)
        assert (got == far.argmin(1)).all()


def test_whole_balls_are_assigned_without_their_leaves(monkeypatch):
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.integers(0, 20, (2000, 8)), rng.integers(1000, 1020, (2000, 8))])
    order, nodes = ball_tree.build(points)
    points = points[order]
    monkeypatch.setattr(ball_tree, "squared", None)  # a leaf would call it
    parts = list(ball_tree.filtered(points, nodes, *ball_tree.balls(points, nodes), np.array([[10] * 8, [1010] * 8])))
    assert sum(b - a for a, b, _ in parts) == 4000 and len(parts) < 20


def _lloyd(rows, k, rounds):
    """ids and vectors in, (id, cluster, distance) and centroids out."""
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    first = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in whole)[:k]
    centroids = [v for _, v in first]
    for step in range(rounds + 1):
        far = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids] for _, v in whole]
        near = [d.index(min(d)) for d in far]
        if step < rounds:
            for j in range(len(centroids)):
                own = [v for (_, v), n in zip(whole, near) if n == j]
                if own:
                    centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    return [(i, n, d[n]) for (i, _), n, d in zip(whole, near, far)], centroids


@pytest.mark.parametrize("n", [5, 150])
def test_clusters_match_brute_force(spark, monkeypatch, n):
    monkeypatch.setattr(ball_tree, "BLOCK", 40)
    monkeypatch.setattr(ball_tree, "LEAF", 4)
    rows = _spread(1, n)
    got = sorted(map(tuple, ball_tree.cluster(_table(spark, rows, _odd())).collect()), key=str)
    want, centroids = _lloyd([*enumerate(rows.tolist()), (None, rows[1].tolist())], 8, 10)
    total = [sum(d for _, c, d in want if c == j) for j in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    assert got == sorted(((i, c, d, total[c], sum(total), digest[c]) for i, c, d in want), key=str)


def test_no_vectors_no_clusters(spark):
    table = _table(spark, _spread(1, 5), _odd())
    for nothing in (table.limit(0), table.where("vec_id >= 1000")):
        assert ball_tree.cluster(nothing).count() == 0
        assert ball_tree.cluster(nothing).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert product_codes.encode(nothing.where("embedding is null or size(embedding) < 4")).count() == 0


def test_components_that_fit_no_long_are_an_error(spark):
    wild = spark.createDataFrame([(1, [1e30] + [0.0] * 63, 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(Exception, match="would not fit a long"):
        ball_tree.cluster(wild).collect()
    with pytest.raises(Exception, match="would not fit a long"):
        product_codes.encode(wild).collect()


def test_distances_of_large_numbers_are_exact():
    points, entries = np.array([[1 << 27, -(1 << 27)], [5, 7]]), np.array([[-(1 << 27), (1 << 27) - 1]])
    assert vectors.squared(points, entries)[:, 0].tolist() == [sum((int(a) - int(b)) ** 2 for a, b in zip(p, entries[0])) for p in points]
    for most in (3, 1 << 20, 1 << 40):
        rows = np.array([[most, -most, 0]])
        assert (vectors.widen(vectors.narrow(rows), 3) == rows).all()


@pytest.mark.parametrize("n, width, high", [(1, 4, 3), (17, 2, 2), (256, 16, 3), (256, 3, 40), (200, 4, 1)])
def test_lower_index_wins_among_nearest_entries(n, width, high):
    rng = np.random.default_rng(n + width)
    entries, points = rng.integers(-high, high + 1, (n, width)), rng.integers(-high - 1, high + 2, (500, width))
    index, far = product_codes.nearest(points, product_codes.kd_tree(entries))
    every = ((points[:, None] - entries[None]) ** 2).sum(2)
    assert (index == every.argmin(1)).all() and (far == every.min(1)).all()


@pytest.mark.parametrize("few, n", [(0, 40), (100, 300)])
def test_codes_match_brute_force(spark, few, n):
    rows = _spread(2, n, width=8)
    found = product_codes.encode(_table(spark, rows, _odd(8)), few=few).collect()
    whole = [(k, [math.floor(1024 * x) for x in v], k % 3 if k % 5 else None) for k, v in enumerate(rows.tolist())]
    whole += [(None, whole[1][1], 7)]
    books = [[v[2 * p : 2 * p + 2] for _, v, _ in whole[:256]] for p in range(4)]
    for step in range(5):
        far = [[[sum((a - b) ** 2 for a, b in zip(v[2 * p : 2 * p + 2], e)) for e in books[p]] for p in range(4)] for _, v, _ in whole]
        near = [[d.index(min(d)) for d in row] for row in far]
        if step < 4:
            for p in range(4):
                for j in range(len(books[p])):
                    own = [v[2 * p : 2 * p + 2] for (_, v, _), row in zip(whole, near) if row[p] == j]
                    if own:
                        books[p][j] = [sum(x) // len(own) for x in zip(*own)]
    error = [sum(min(d) for d in row) for row in far]
    total = {label: sum(e for e, (_, _, lb) in zip(error, whole) if lb == label) for _, _, label in whole}
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    want = [(i, "".join(f"{x:02x}" for x in row), e, total[label], digest) for (i, _, label), row, e in zip(whole, near, error)]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def _base(text):
    space = "[^\\x20\\x09-\\x0D]+"
    words = re.findall(space, text)
    lines = [x for x in text.split("\n") if re.search(space, x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_base_counts_match_brute_force(spark):
    rng = random.Random(4)
    texts = ["", None, "\n", "\n\n a", "a\n", "a\na\na", "é ü   x", "x " * 20, "a b c d e\n\x0ba b c\td e f", "word " * 3000, "# ** $% &|<>"]
    for _ in range(150):
        texts.append("".join(rng.choice(["a", "b", "ab", "é", "#", "|"]) + rng.choice([" ", " ", "\n", "\n", "  ", "\r\n", "\t", "\x0b", " "]) for _ in range(rng.randrange(60))))
    docs = spark.createDataFrame([(k, t, "x", True) for k, t in enumerate(texts)], "doc_id long, text string, n_words string, kept boolean").repartition(3)
    got = {r["doc_id"]: r for r in line_rules.clean(docs).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        r, want = got[k], _base(text or "")
        assert tuple(r)[1:6] == want, text
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["kept"] and r["base_failed"])
        assert r["lost_chars"] == want[1] - _base(r["clean_text"])[1]


@pytest.mark.parametrize(
    "line, rule",
    [
        ("The tenant pays the rent each month.", None),
        ("« Oui », dit-elle !", None),
        ("Is it so? Perhaps nobody knows it yet", "punctuation"),
        ("One sentence ends. Another ends too. The last one was cut", None),
        ("Chapter one without an end", "punctuation"),
        ("BUY!! NOW!! CHEAP!! STUFF!!", "punctuation"),
        ("of*** the$$$ and%%% or### to.", "punctuation"),
        ("Profits rose by 5% to $3 in the last quarter of the year.", None),
        ("Home | News | Sport | Weather", "navigation"),
        ("Read more »", "navigation"),
        ("Skip to main content", "navigation"),
        ("We went home to read more news.", None),
        ("Licensed under the Apache License, Version 2.0.", "boilerplate"),
        ("All rights reserved.", "boilerplate"),
        ("Alle Rechte vorbehalten.", "boilerplate"),
        ("In this long story, which nobody had told before that evening, the clerk reads aloud from a letter of many pages that all rights reserved to the crown had been sold, one by one, to the merchants of the town on the hill.", None),
    ],
)
def test_lines_are_judged(line, rule):
    assert line_rules.failed(line) == rule


def test_documents_that_lose_too_much_are_rejected(spark):
    good = "The river rose slowly and the people left their houses before night came."
    rows = [(1, f"{good}\nHome | News | Sport\n{good[::-1]}."), (2, good + "\n" + "buy!! it!! now!! " * 12), (3, "Too short."), (None, f"{good}\nAll rights reserved.")]
    got = {r["doc_id"]: r for r in line_rules.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k]["kept"] for k in (1, 2, 3, None)] == [True, False, False, True]
    assert got[None]["clean_text"] == good and got[1]["by_navigation"] == 1 and got[None]["by_boilerplate"] == 1
