import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citegraph.llm import importance as I
from citegraph.llm import langid as L

SYLLABLES = {"aa": ["the", "ing", "and", "ou"], "bb": ["über", "sch", "ich", "ß"],
             "cc": ["ção", "que", "os", "ar"]}


def sentence(rng, language, words):
    return " ".join("".join(rng.choice(SYLLABLES[language]) for _ in range(rng.randrange(1, 4)))
                    for _ in range(words))


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    network = L.Network.fresh(["a", "b", "c"], hidden=4)
    for p in network.parameters():
        p[:] = rng.normal(0, 0.5, p.shape)
    for d in (network.ahead, network.behind):
        d.inputs, d.recurrent = d.inputs.astype(float), d.recurrent.astype(float)
    network.out, network.bias = network.out.astype(float), network.bias.astype(float)
    steps, labels = rng.integers(97, 101, (5, 6)), rng.integers(0, 3, 6)
    _, gradients = network.gradients(steps, labels)
    for values, gradient in zip(network.parameters(), gradients, strict=True):
        for _ in range(6):
            spot = tuple(rng.integers(0, s) for s in values.shape)
            if values is network.ahead.inputs or values is network.behind.inputs:
                spot = (int(rng.integers(97, 101)), spot[1])
            held, losses = values[spot], []
            for shift in (1e-3, -1e-3):
                values[spot] = held + shift
                losses.append(network.gradients(steps, labels)[0])
            values[spot] = held
            assert gradient[spot] == pytest.approx((losses[0] - losses[1]) / 2e-3, abs=2e-3)


def test_pooling_equals_reading_every_word():
    network = L.Network.fresh(["a", "b"])
    texts = ["one two one", None, "", "x" * 100 + " one", "é 中"]
    found = list(L.Pooler(network).pooled(pa.array(texts)))
    for text, row in zip(texts, found, strict=True):
        total = np.zeros(2)
        for unit in L.units_of(text or ""):
            total += network.positions(np.frombuffer(unit, np.uint8)[:, None])[:, 0].sum(axis=0)
        assert row == pytest.approx(total / max(total.sum(), 1e-9), abs=1e-5)


def test_languages_of_held_out_texts(spark):
    rng = random.Random(4)
    rows = [(k, sentence(rng, lang, 40), lang) for k in range(300)
            for lang in [rng.choice(sorted(SYLLABLES))]]
    rows += [(1000, None, "aa"), (1001, "123 !!", "aa"), (1002, sentence(rng, "bb", 5000), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in L.languages(docs, steps=300).collect()}
    held = [k for k, _, _ in rows[:300] if found[k]["held_out"]]
    assert 30 < len(held) < 90
    assert sum(found[k]["lang_pred"] == rows[k][2] for k in held) >= 0.97 * len(held)
    assert found[1000]["lang_pred"] == found[1001]["lang_pred"] == "und"
    assert found[1002]["lang_pred"] == "bb"
    # A label is never an input: without the labels of held-out texts all stays the same.
    hidden = docs.withColumn("lang", F.when(~L.held_out(F.col("doc_id")), F.col("lang")))
    again = {r["doc_id"]: r for r in L.languages(hidden, steps=300).collect()}
    assert all(again[k]["lang_pred"] == found[k]["lang_pred"] for k in found)


def test_counts_cover_all_texts(spark):
    texts = ["abc abd", None, "", "abc", "é" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids, flags = np.array([0], np.int64), np.array([1], np.int8)
    ratios = I.log_ratios(docs, ids, flags)
    raw, target = np.zeros(2 * I.BUCKETS), np.zeros(2 * I.BUCKETS)
    for k, buckets in enumerate(I.text_buckets(pa.array(texts))):
        own = np.bincount(buckets, minlength=2 * I.BUCKETS)
        raw += own
        if k == 0:
            target += own
    for kind in (slice(0, I.BUCKETS), slice(I.BUCKETS, None)):
        share = raw[kind] / raw[kind].sum() * target[kind].sum()
        assert ratios[kind] == pytest.approx(np.log((target[kind] + I.PRIOR) / (share + I.PRIOR)))


def test_top_k_is_the_k_largest_keys_and_parts_good_from_bad(spark):
    rng = random.Random(6)
    rows = [(k, sentence(rng, "aa", 60), k % 10 != 0) for k in range(600)]
    rows = [(k, t if good else t.upper().replace(" ", "!! "), good) for k, t, good in rows]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, int(g), 0) for k, _, g in rows if k % 3],
                                   "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in I.resampled(docs, labels).collect()}
    model = I.Resampling(docs, labels)
    batch = pa.record_batch([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])],
                            names=["doc_id", "text"])
    weights, keys = I._scores(batch, model.ratios)
    assert len(kept) == model.count == int((weights >= model.cut).sum())
    assert kept == set(np.argsort(-keys)[:model.count].tolist())
    good = {k for k, _, g in rows if g}
    assert len(kept & good) >= 0.98 * len(good) and len(kept - good) <= 2
    assert {r["doc_id"] for r in I.kept_rows(docs, labels).collect()} == kept


def test_noise_is_gumbel():
    noise = I.gumbel(np.arange(200_000))
    assert noise.mean() == pytest.approx(0.5772, abs=0.02)
    assert noise.var() == pytest.approx(np.pi**2 / 6, abs=0.03)
