import random

import numpy as np

from citegraph.llm import decontaminate as D
from citegraph.llm.alignment import banded_alignment


def nearest(item, text):
    """Fewest edits between the item and any region of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def mutated(rng, text, edits):
    text = list(text)
    for _ in range(edits):
        at = rng.randrange(len(text))
        kind = rng.randrange(3)
        if kind == 0:
            text[at] = rng.choice("xyzé中")
        elif kind == 1:
            text.insert(at, rng.choice("xyz"))
        elif len(text) > 1:
            del text[at]
    return "".join(text)


def test_finds_exactly_the_regions_within_the_budget():
    rng = random.Random(3)
    words = ["the", "one", "tion", "ness", "ment", "été", "in", "of"]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))
    items = [(k, prose(rng.choice([3, 8, 15, 30]))) for k in range(12)]
    index = D.ItemIndex(items)
    hits = 0
    for _ in range(60):
        which = rng.randrange(len(items))
        spoilt = mutated(rng, items[which][1], rng.choice([0, 1, 3, 6, 12, 40]))
        text = prose(20) + " " + spoilt + " " + prose(10)
        found = {i: edits for i, _, _, edits, _ in index.leaks(text)}
        for number, item in items:
            fewest = nearest(D.normal(item), D.normal(text))
            if fewest <= D.edit_budget(len(D.normal(item))):
                assert found[number] == fewest
                hits += 1
            else:
                assert number not in found
    assert hits > 30


def test_alignment_reports_the_region():
    own = np.frombuffer(b"abcdefghij", np.uint8)
    other = np.frombuffer(b"zzzzabcdXefghijzz", np.uint8)
    assert banded_alignment(own, other, 0, 8, 2) == (1, 4, 15)
    assert banded_alignment(own, other, 0, 8, 0) is None
    assert banded_alignment(own, other[:0], 0, 8, 3) is None


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    bench = spark.createDataFrame(
        [(k, f"item number {k} has some words of its own, {k * 7919} of them") for k in range(20)],
        "item_id long, text string")
    docs = spark.createDataFrame(
        [(k, f"before. ITEM number {k}  has some\nwords of its own, {k * 7919} of them. after")
         for k in range(0, 20, 3)], "doc_id long, text string")
    once = sorted(map(tuple, D.leaks(docs, bench).collect()))
    assert {r[0] for r in once} == set(range(0, 20, 3)) and {r[0] for r in once if r[0] == r[1]}
    monkeypatch.setattr(D, "BLOCK_CHARS", 200)
    assert sorted(map(tuple, D.leaks(docs, bench).collect())) == once
    assert D.without_leaks(docs, bench).count() == 0


def test_items_without_id_are_removed(spark):
    item = "an item that has no number of its own but leaks"
    bench = spark.createDataFrame([(None, item), (2, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, "clean"), (3, None)],
                                 "doc_id long, text string")
    assert sorted(r["doc_id"] for r in D.without_leaks(docs, bench).collect()) == [2, 3]
    assert D.leaks(docs, bench).count() == 0
