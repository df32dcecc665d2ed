import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from citegraph.llm import bitslice
from citegraph.llm import textual as T

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])], len(words)


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def plain_draw(docs, target):
    raw, good = Counter(), Counter()
    for _, text in docs:
        raw.update(map(bucket, features(text)[0]))
    for text in target:
        good.update(map(bucket, features(text)[0]))
    s_all, t_all = sum(raw.values()), sum(good.values())
    gain = [math.floor(1000 * math.log(float(good[b] + 1) * float(s_all + 10000)
                                       / (float(raw[b] + 1) * float(t_all + 10000)))) for b in range(10000)]
    rows = []
    for doc_id, text in docs:
        found, words = features(text)
        weight = sum(gain[bucket(f)] for f in found) // max(len(found), 1)
        name = "" if doc_id is None else doc_id
        h = int(hashlib.sha256(f"7:{name}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(found), weight, score, None, words])
    enough = sorted((r for r in rows if r[5] >= 20),
                    key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(enough[:len(enough) * 25 // 100]):
        row[4] = rank + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def drawn(spark, docs, target):
    table = spark.createDataFrame([(*d, "a", 1, 2.0) for d in docs],
                                  "doc_id long, text string, score string, row int, rank double")
    items = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    return sorted((tuple(r) for r in bitslice.drawn(table.repartition(3), items).collect()), key=str)


def test_draw_matches_plain_code(spark):
    rng = random.Random(2)
    pool = ["alpha", "Beta", "naïve", "x9", "中文", "zürich", "THE", "of", "q" * 60, "a" * 200]
    docs = [(k, " ".join(rng.choice(pool) + rng.choice(("", ",", "-", "\n")) for _ in range(rng.randrange(80))))
            for k in range(200)]
    docs += [(200, None), (201, ""), (202, " \x00-\x7f "), (None, "lost words " * 30), (None, "lost words " * 30),
             (203, "long " * 70000), (5, docs[5][1]), (6, "other " * 25)]
    target = [" ".join(rng.choice(pool[:4]) for _ in range(40)) for _ in range(20)] + [None, ""]
    assert drawn(spark, docs, target) == plain_draw(docs, target)


@pytest.mark.parametrize("docs, target", [([], ["a b"]), ([(1, "a b c " * 9)], []), ([], [])])
def test_empty_tables(spark, docs, target):
    assert drawn(spark, docs, target) == plain_draw(docs, target)


def test_pairs_cross_the_pieces_of_a_slice(monkeypatch):
    texts = ["one two three four five six seven", "", "eight", "nine ten " + "w" * 99 + " end"]
    slices = list(T.byte_slices(pa.array(texts)))
    whole = [bitslice.slice_features(d, o) for _, d, o in slices]
    monkeypatch.setattr(bitslice, "WORDS_AT_ONCE", 2)
    for (_, data, offsets), (row, found, words) in zip(slices, whole):
        again = bitslice.slice_features(data, offsets)
        assert sorted(zip(again[0], again[1])) == sorted(zip(row, found))
        assert (again[2] == words).all()
        assert Counter(found.tolist()) == Counter(bucket(f) for t in texts for f in features(t)[0])


def test_bit_planes_give_plain_sums():
    rng = np.random.default_rng(1)
    gains = rng.integers(-9000, 5000, 10000)
    row = np.sort(rng.integers(0, 1300, 40000))
    found = rng.integers(0, 10000, 40000) % rng.choice((7, 10000), 40000)
    sums = bitslice.gain_sums(row, found, 1300, bitslice.gain_planes(gains))
    assert (sums == np.bincount(row, weights=gains[found], minlength=1300)).all()
