import hashlib
import math
import random
from collections import defaultdict

import numpy as np

from citegraph.llm import vectorcode

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """Every part against every entry, in plain Python numbers."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(parts, max((-(-len(v) // parts) * parts for _, v, _ in kept), default=0))
    kept = [(i, v + [0] * (width - len(v)), label) for i, v, label in kept]
    size = width // parts
    cut = [[v[p * size:(p + 1) * size] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[list(cut[k][p]) for k in first] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for own in cut:
                groups[nearest(own[p], books[p])[1]].append(own[p])
            for e, members in groups.items():
                books[p][e] = [sum(x) // len(members) for x in zip(*members)]
    found, sums = [], defaultdict(int)
    for (i, _, label), own in zip(kept, cut):
        near = [nearest(own[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in near)
        sums[label] += error
        found.append((i, "".join(f"{e:02x}" for _, e in near), error, label))
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    digest = hashlib.sha256(text.encode()).hexdigest()
    return sorted(((i, c, e, sums[label], digest) for i, c, e, label in found), key=str)


def codes(spark, rows, parts=3):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in vectorcode.compressed(docs).collect()), key=str)


def single(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label)
            for i, v, label in rows]


def test_codes_match_plain_code(spark):
    rng = random.Random(5)
    hot = [rng.gauss(0, 0.2) for _ in range(32)]
    rows = [(k, hot if k % 3 == 0 else [round(rng.gauss(0, 0.2), rng.choice((1, 4))) for _ in range(32)],
             rng.choice((0, 1, 2, None))) for k in range(300)]
    rows += [(300, None, 1), (301, [float("nan")] * 32, 1), (302, [float("-inf")] + [0.0] * 31, 1),
             (303, [None] + [0.1] * 31, 2)]
    rows = single(rows)
    assert codes(spark, rows) == plain_codes(rows)


def test_odd_vectors(spark):
    rows = single([(1, [0.5, -0.25], None), (1, [0.5, -0.25], None), (2, [0.1] * 11, 1), (None, [], 1),
                   (4, [-1.0] * 16, None), (5, [], 2)])
    assert codes(spark, rows) == plain_codes(rows)
    assert codes(spark, []) == []
    assert codes(spark, [(1, None, 1), (2, [None], 2)]) == []
    wide = spark.createDataFrame([(1, [1.0] * 8, 1, "x", 2.0)],
                                 "vec_id long, embedding array<double>, label int, code string, pos double")
    assert vectorcode.compressed(wide).columns == [
        "vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert vectorcode.compressed(wide).count() == 1


def test_trie_distances_are_those_of_every_leaf():
    rng = np.random.default_rng(3)
    leaves = np.unique(rng.integers(-3, 4, size=(9000, 6)), axis=0)
    book = rng.integers(-3, 4, size=(16, 6))
    entry, distance = vectorcode.nearest_entries(leaves, book)
    apart = ((leaves[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (entry == apart.argmin(axis=1)).all() and (distance == apart.min(axis=1)).all()


def test_leaves_are_dealt_once(spark):
    kept = vectorcode.whole_vectors(spark.createDataFrame([(1, [0.0] * 8, 1)], SCHEMA))
    plan = vectorcode.distinct_parts(kept, 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
