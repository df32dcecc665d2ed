import random
import re

import numpy as np
import pytest

from citegraph.llm import jaccard as J
from citegraph.scratch import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def brute_force(rows):
    """Component by comparing every two rows; rows are (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for k, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(doc_id)
    return sorted((d, len(sets[k]), min(groups[find(k)])) for k, (d, _) in enumerate(rows))


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    found, number = [], 0
    for group in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([6, 9, 30, 120, 400]))]
        for copy in range(rng.choice([1, 3, 8, 40])):
            found.append((number, edited(rng, base, rng.choice([0, 1, 2, len(base) // 60]))))
            number += 1
    common = " ".join(f"c{k}" for k in range(40))
    for _ in range(15):
        found.append((number, common + " " + edited(rng, ["x"] * 60, 200)))
        number += 1
    found += [(number, None), (number + 1, ""), (number + 2, " \n"), (number + 3, "One two"),
              (number + 4, "one TWO"), (number + 5, "one\ttwo three")]
    return found


@pytest.mark.parametrize("meetings, block", [(3, 64), (1, 5), (10**9, 5)])
def test_components_match_brute_force(spark, rows, meetings, block, monkeypatch):
    monkeypatch.setattr(J, "MEETINGS", meetings)
    monkeypatch.setattr(J, "LEADERS", 1)
    monkeypatch.setattr(J, "LEFT_BLOCK", block)
    monkeypatch.setattr(J, "RIGHT_BLOCK", block)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = J.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found)) == brute_force(rows)


def test_links_apart_from_the_first_member(spark):
    """Crops of one text: a bucket's members link with each other, but not all with its first."""
    rng = random.Random(8)
    found = []
    for text in range(60):
        words = [f"t{text}w{k}" for k in range(60)]
        for offset in range(len(words) - 12):
            if rng.random() < 0.9:
                found.append((len(found), " ".join(words[offset:offset + 13])))
    rng.shuffle(found)
    docs = spark.createDataFrame(found, "doc_id long, text string").repartition(3)
    got = J.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute_force(found)


def test_prefixes_of_linked_sets_meet():
    """In the worst order all that one set has alone comes before what is common."""
    tightest = None
    for common in range(1, 400):
        for more in range(common // 4 + 1):
            for less in range(common // 4 - more + 1):
                sizes = common + more, common + less
                sent = [J.tried_of(s, 0.3) for s in sizes]
                # Alone shingles of either side at the start or at the end of its order.
                worst = min(min(max(0, sent[0] - x), max(0, sent[1] - y), common)
                            for x in range(more + 1) for y in range(less + 1)) \
                    if common < 40 else min(max(0, sent[0] - more), max(0, sent[1] - less), common)
                room = worst - max(J.least_shared(s, 0.3) for s in sizes)
                tightest = room if tightest is None else min(tightest, room)
    assert tightest == 0


def test_short_text_inside_a_longer_one(spark):
    """Sets of 4 inside sets of 5; two of five orders put the odd shingle into the prefix."""
    found = []
    for k in range(40):
        words = [f"s{k}w{j}" for j in range(9)]
        found += [(2 * k, " ".join(words[:8])), (2 * k + 1, " ".join(words))]
    docs = spark.createDataFrame(found, "doc_id long, text string")
    got = J.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute_force(found)


def test_keys_of_linked_sets_meet():
    import numpy as np
    rng = np.random.default_rng(1)
    starts = J.band_starts(4000)
    for size in (5, 9, 40, 41, 200, 1000):
        for _ in range(20):
            shared = rng.integers(0, 2**48, size, dtype=np.uint64)
            change = int(size * 2 / 9 / 2)
            other = np.concatenate([shared[change:], rng.integers(0, 2**48, change, dtype=np.uint64)])
            bigger = np.concatenate([shared, rng.integers(0, 2**48, size // 4, dtype=np.uint64)])
            for second in (other, bigger):
                both = len(np.intersect1d(shared, second))
                if 100 * both >= 80 * (size + len(second) - both):
                    assert np.intersect1d(J.signature_keys(shared, size, starts),
                                          J.signature_keys(second, len(second), starts)).size


def test_sketch_distance_bounds_difference():
    import numpy as np
    rng = np.random.default_rng(2)
    for _ in range(50):
        a = np.unique(rng.integers(0, 500, 200, dtype=np.uint64))
        b = np.unique(rng.integers(0, 500, 180, dtype=np.uint64))
        apart = J.sketch_words(a, 8) ^ J.sketch_words(b, 8)
        bits = int(np.unpackbits(apart.view(np.uint8)).sum())
        assert bits <= len(np.setxor1d(a, b))


def test_edge_rows(spark):
    text = "a b c d e f g h"
    docs = spark.createDataFrame(
        [(1, text, "x"), (1, text, "x"), (None, text, None), (2, text, "y"), (None, None, "z"),
         (3, "long " * 30000, None)], "doc_id long, text string, key string")
    found = J.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found), key=str) == sorted(
        [(1, 4, 1), (1, 4, 1), (None, 4, 1), (2, 4, 1), (None, 0, None), (3, 1, 3)], key=str)
    empty = docs.where("doc_id > 99")
    assert J.jaccard_components(empty).count() == 0


def test_copies_in_other_tasks_send_nothing(spark):
    rows = [(k, "a b c d e f g") for k in range(40)] + [(50, "u v w x y z"), (51, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    first = J.first_rows(J.shingle_classes(docs), Scratch(spark, "first"))
    keys = J.shingle_classes(docs).select("doc_id", J.row_key().alias("k")).toPandas()
    sent = keys[J.passes(first, keys["k"].to_numpy().view("uint64"))]["doc_id"].tolist()
    assert 50 in sent and 2 <= len(sent) < 10


def test_sketches_tell_large_sets_apart():
    rng = np.random.default_rng(3)
    large, other = (rng.integers(1, 1 << 47, 4000).astype(np.uint64) for _ in range(2))
    close, small = np.concatenate([large[:3700], other[:300]]), large[:3300]

    def row(comp, s):
        return comp, len(s), 0, J.sketch_words(s, J.sketch_size(len(s))).tobytes()

    rows = [row(1, large), row(2, other)]
    left, right = J.near_rows(rows, [row(3, close), row(4, small[:900])])
    assert left.tolist() == [True, False] and right.tolist() == [True, False]
    for words in (16, 32):
        assert (J.folded([rows[0][3]], words)[0] == J.sketch_words(large, words)).all()
