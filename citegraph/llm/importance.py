"""Quality classifier by importance resampling.

Two hashed n-gram models, of the target (texts labelled good) and of the raw texts (all of
them), give every text the mean log ratio of its n-grams.  A share of the texts is drawn by
Gumbel top-k: the log weight plus Gumbel noise is the key, and the k largest keys are kept,
which samples k texts without replacement in proportion to their weights.

The n-grams are byte 3-grams and words, each hashed into ``BUCKETS``; counts cover all bytes
of all texts.  The target's rate of a bucket is shrunk towards the raw one by ``PRIOR``
expected occurrences.  A text's log weight is its mean log ratio times ``EVIDENCE``, so that
length alone decides nothing.  k is the number of texts above the cut that separates the
labelled good from the bad best while it loses at most ``MAX_LOSS`` of the good; labels that
set the cut are not those of the model.  Both come from a bounded sample of the labels.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.llm import textual as T
from citegraph.scratch import Scratch, number_rows

BUCKETS = 1 << 16
PRIOR = 20.0
EVIDENCE = 200.0
#: Labels used, those with the smallest hash of their id; they go to every task.
MAX_LABELS = 20_000
MAX_LOSS = 0.005
#: N-grams that a task counts together.
COUNT_AT_ONCE = 1 << 18
SEED = 11


def text_buckets(column: pa.Array):
    """The bucket of every n-gram of each row's whole text: 3-grams below, words above ``BUCKETS``."""
    for data, words, _, _ in T.row_word_spans(column, fold=False):
        wide = data.astype(np.uint32)
        grams = wide[:-2] | (wide[1:-1] << 8) | (wide[2:] << 16) if len(data) > 2 else wide[:0]
        hashed = (grams * np.uint32(2654435761)) >> np.uint32(16)
        yield np.concatenate([hashed.astype(np.int64),
                              (words >> np.uint64(48)).astype(np.int64) + BUCKETS])


def label_sample(labels: DataFrame, limit: int = MAX_LABELS) -> DataFrame:
    """``(doc_id, good, part)``: at most ``limit`` labelled ids; part 0 is for the model, 1 for
    the cut.  Of several labels of an id the worst counts; null ids and labels are left."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") > 0).alias("good"))
    spot = F.xxhash64("doc_id", F.lit(SEED))
    return known.orderBy(spot, "doc_id").limit(limit).select(
        "doc_id", "good", F.pmod(F.shiftright(spot, 8), F.lit(2)).cast("int").alias("part"))


def _flags(sample: list) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ids and, for each, 1 for the target, 2 and 3 for good and bad of the cut."""
    rows = sorted((r["doc_id"], (1 if r["good"] else 0) if r["part"] == 0 else
                   (2 if r["good"] else 3)) for r in sample)
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int8)


def _flag_of(doc_ids: pa.Array, ids: np.ndarray, flags: np.ndarray) -> np.ndarray:
    wanted = doc_ids.fill_null(0).to_numpy(zero_copy_only=False)
    if not len(ids):
        return np.zeros(len(wanted), np.int8)
    at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
    found = np.where(ids[at] == wanted, flags[at], 0)
    return np.where(doc_ids.is_null().to_numpy(zero_copy_only=False), 0, found)


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))


def log_ratios(docs: DataFrame, ids: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Log of target over raw rate of every bucket, from counts over all texts."""
    def count(batches):
        raw, target = np.zeros(2 * BUCKETS, np.int64), np.zeros(2 * BUCKETS, np.int64)
        for batch in batches:
            chosen = _flag_of(batch.column(0), ids, flags) == 1
            held = {False: [], True: []}
            for own, buckets in zip(chosen.tolist(), text_buckets(batch.column(1)), strict=True):
                held[own].append(buckets)
                if len(held[own]) >= 100 or len(buckets) >= COUNT_AT_ONCE:
                    _add(held[own], raw, target if own else None)
            _add(held[False], raw, None)
            _add(held[True], raw, target)
        seen = np.flatnonzero(raw)
        yield pa.record_batch([pa.array(seen), pa.array(raw[seen]), pa.array(target[seen])],
                              names=["bucket", "raw", "target"])

    # At most 2 x BUCKETS rows reach the driver.
    rows = _columns(docs).mapInArrow(count, "bucket long, raw long, target long").groupBy(
        "bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(2 * BUCKETS), np.zeros(2 * BUCKETS)
    for row in rows:
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    expected = np.zeros(2 * BUCKETS)
    for kind in (slice(0, BUCKETS), slice(BUCKETS, 2 * BUCKETS)):
        expected[kind] = raw[kind] / max(1.0, raw[kind].sum()) * target[kind].sum()
    return np.log((target + PRIOR) / (expected + PRIOR))


def _add(held: list[np.ndarray], *totals: np.ndarray | None) -> None:
    if held:
        found = np.bincount(np.concatenate(held), minlength=2 * BUCKETS)
        for total in totals:
            if total is not None:
                total += found
        held.clear()


def gumbel(doc_ids: np.ndarray) -> np.ndarray:
    """Noise that depends on the id only, so that a task that runs again draws the same."""
    spots = T.mix(doc_ids.astype(np.int64).view(np.uint64) + T.ROLES[SEED])
    even = ((spots >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
    return -np.log(-np.log(even))


def _scores(batch, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log weight and key of each row; a text without n-gram weighs as the mean text, 0."""
    weights = np.array([EVIDENCE * ratios[b].mean() if len(b) else 0.0
                        for b in text_buckets(batch.column(1))], float)
    ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
    return weights, weights + gumbel(ids)


def best_cut(good: np.ndarray, bad: np.ndarray, max_loss: float = MAX_LOSS) -> float:
    """The weight that separates best and loses at most ``max_loss`` of the good; the lowest
    such weight; minus infinity if a side has no label."""
    if not len(good) or not len(bad):
        return -math.inf
    cuts = np.unique(np.concatenate([good, bad]))
    lost = np.searchsorted(np.sort(good), cuts) / len(good)
    caught = np.searchsorted(np.sort(bad), cuts) / len(bad)
    merit = np.where(lost <= max_loss, caught - lost, -1)
    best = int(np.argmax(merit))
    # Half way into the gap below the lowest text that is kept.
    return float((cuts[best] + cuts[best - 1]) / 2) if best else -math.inf


class Resampling:
    """The fitted models, the number of texts to draw and the key of the last one drawn."""

    def __init__(self, docs: DataFrame, labels: DataFrame):
        scratch = Scratch(docs.sparkSession, "importance")
        ids, flags = _flags(label_sample(labels).collect())
        self.ratios = ratios = log_ratios(docs, ids, flags)

        def score(batches):
            for batch in batches:
                weights, keys = _scores(batch, ratios)
                yield pa.record_batch(
                    [batch.column(0), pa.array(weights), pa.array(keys),
                     pa.array(_flag_of(batch.column(0), ids, flags), pa.int8())],
                    names=["doc_id", "log_weight", "key", "flag"])

        scores = scratch.save(_columns(docs).mapInArrow(
            score, "doc_id long, log_weight double, key double, flag byte"))
        # At most MAX_LABELS ids are flagged; a hot id's repeats count once.
        held = scores.where("flag in (2, 3)").groupBy("doc_id", "flag").agg(
            F.min("log_weight").alias("log_weight")).collect()
        self.cut = best_cut(np.array([r["log_weight"] for r in held if r["flag"] == 2]),
                            np.array([r["log_weight"] for r in held if r["flag"] == 3]))
        self.count = scores.where(F.col("log_weight") >= self.cut).count()
        self.last = self._last(scores)

    def _last(self, scores: DataFrame) -> tuple[float, int]:
        """Key and id of the last text drawn; equal keys go by id, null ids last."""
        if not self.count:
            return math.inf, 0
        ranked = number_rows(
            scores.select("key", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id")),
            [F.desc("key"), F.col("doc_id")], "n")
        row = ranked.where(F.col("n") == self.count).first()
        return row["key"], row["doc_id"]

    def drawn(self, batch, doc_ids: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log weights, keys and whether each row of ``(doc_id, text)`` is drawn."""
        weights, keys = _scores(batch, self.ratios)
        ids = doc_ids.fill_null((1 << 63) - 1).to_numpy(zero_copy_only=False)
        key, last = self.last
        return weights, keys, (keys > key) | ((keys == key) & (ids <= last))


def resampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, log_weight, key, kept)`` of the texts that are drawn; ``kept`` is true.

    Null and empty texts weigh as the mean text.  Rows that repeat a ``doc_id`` have the same
    noise and are drawn each by its text; where repeats tie with the last key all are drawn.
    Without labels of both kinds all texts are drawn.  Other columns are ignored.
    """
    model = Resampling(docs, labels)

    def draw(batches):
        for batch in batches:
            weights, keys, kept = model.drawn(batch, batch.column(0))
            out = pa.record_batch([batch.column(0), pa.array(weights), pa.array(keys), pa.array(kept)],
                                  names=["doc_id", "log_weight", "key", "kept"])
            yield out.filter(pa.array(kept))

    return _columns(docs).mapInArrow(
        draw, "doc_id long, log_weight double, key double, kept boolean")


def kept_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are drawn, all columns."""
    model = Resampling(docs, labels)
    id_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")

    def draw(batches):
        for batch in batches:
            ids = batch.column(id_at).cast(pa.int64())
            plain = pa.record_batch([ids, batch.column(text_at).cast(pa.string())],
                                    names=["doc_id", "text"])
            yield batch.filter(pa.array(model.drawn(plain, ids)[2]))

    return docs.mapInArrow(draw, docs.schema)
