"""Importance resampling towards a target distribution with bit-sliced weights.

Features are words and pairs of neighbouring words, hashed into buckets.  All documents and all
target texts are counted; a bucket's gain is the scaled log ratio of its two smoothed rates,
as an integer.  A document's weight is the mean gain of its features, and a share of the
documents is drawn without replacement by Gumbel top-k.

Weights are summed bit-sliced.  A document's bucket counts become planes of one bit per bucket:
plane i holds bit i of every count.  The gains become planes as well, in two's complement with a
sign plane.  A count plane and a gain plane contribute the number of buckets set in both times a
power of two, so the sum of gains is exact in whole numbers.

A word is a run of ASCII letters and digits and of characters beyond ASCII; A-Z count as a-z.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.llm import textual as T
from citegraph.scratch import Scratch, number_rows

BUCKETS = 10_000
SCALE = 1000
MIN_WORDS = 20
#: Hundredths of the documents with ``MIN_WORDS`` words that are drawn.
PERCENT = 25
SEED = 7
#: Words of a slice hashed together, and rows whose planes are in memory together.
WORDS_AT_ONCE, ROWS_AT_ONCE = 1 << 18, 512
#: Longer words are hashed one by one.
LONG_WORD = 48
PLANE_BYTES = -(-BUCKETS // 64) * 8

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _crc_table() -> np.ndarray:
    """What one byte does to a CRC-32, reflected, polynomial 0x04C11DB7."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> np.uint32(1)),
                         table >> np.uint32(1))
    return table


_CRC = _crc_table()
_ONES = np.uint32(0xFFFFFFFF)


def _after(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The inverted CRC-32 ``state`` of every span after its bytes, byte column by byte column."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    state = state[order]
    long = int(np.searchsorted(-lengths, -LONG_WORD))
    for k in range(long):
        word = data[starts[k]:starts[k] + lengths[k]]
        state[k] = zlib.crc32(word, int(state[k] ^ _ONES)) ^ 0xFFFFFFFF
    starts, lengths, short = starts[long:], lengths[long:], state[long:]
    for j in range(int(lengths[0]) if len(lengths) else 0):
        active = int(np.searchsorted(-lengths, -j))
        now = short[:active]
        short[:active] = _CRC[(now ^ data[starts[:active] + j]) & np.uint32(255)] ^ (now >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = state
    return out


def slice_features(data: np.ndarray, offsets: np.ndarray):
    """``(row, bucket)`` of all features and the number of words of every row of a slice."""
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(rows, np.int64)
    starts, ends = T._spans(T.ALPHANUMERIC[data], offsets)
    folded = _FOLD[data]
    cuts = np.searchsorted(starts, offsets)
    words = np.diff(cuts)
    row_of = np.repeat(np.arange(rows), words)
    found_rows, found = [], []
    for lo in range(0, len(starts), WORDS_AT_ONCE):
        # One word of the piece before comes along for the pair over the border.
        lo, hi = max(lo - 1, 0), min(lo + WORDS_AT_ONCE, len(starts))
        row, first = row_of[lo:hi], starts[lo:hi]
        single = _after(np.full(hi - lo, _ONES), folded, first, ends[lo:hi])
        pair = np.flatnonzero(row[1:] == row[:-1])
        spaced = single[pair]
        spaced = _CRC[(spaced ^ np.uint32(32)) & np.uint32(255)] ^ (spaced >> np.uint32(8))
        double = _after(spaced, folded, first[pair + 1], ends[lo:hi][pair + 1])
        own = slice(1, None) if lo else slice(None)
        found_rows += [row[own], row[pair]]
        found += [single[own], double]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), words
    buckets = (np.concatenate(found) ^ _ONES) % np.uint32(BUCKETS)
    return np.concatenate(found_rows), buckets.astype(np.int64), words


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How often every bucket occurs in all of ``texts``; at most ``BUCKETS`` numbers are read."""
    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, data, offsets in T.byte_slices(batch.column(0)):
                total += np.bincount(slice_features(data, offsets)[1], minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held.astype(np.int32)), pa.array(total[held])],
                              names=["bucket", "many"])

    rows = texts.select(F.col("text").cast("string")).mapInArrow(count, "bucket int, many long")
    found = np.zeros(BUCKETS, np.int64)
    for row in rows.groupBy("bucket").agg(F.sum("many").alias("many")).collect():
        found[row["bucket"]] = row["many"]
    return found


def gains_of(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Scaled log ratio of a bucket's smoothed rates in the target and in all documents."""
    all_raw, all_target = int(raw.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    return np.array([
        math.floor(SCALE * math.log((float(t + 1) * float(all_raw)) / (float(s + 1) * float(all_target))))
        for s, t in zip(raw.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def _planes(values: np.ndarray) -> np.ndarray:
    """Bits of every row, packed into 64-bit words."""
    wide = np.zeros((len(values), PLANE_BYTES * 8), np.uint8)
    wide[:, :values.shape[1]] = values
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def gain_planes(gains: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """``(factor, plane)``: two's complement, the sign plane counting negatively."""
    bits = max((int(g) if g >= 0 else ~int(g)).bit_length() for g in gains)
    factors = [1 << b for b in range(bits)] + [-(1 << bits)]
    values = np.array([(gains >> b) & 1 for b in range(bits)] + [gains < 0], dtype=np.uint8)
    return list(zip(factors, _planes(values), strict=True))


def gain_sums(row: np.ndarray, bucket: np.ndarray, rows: int,
              gains: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Sum of the gains of each row's features."""
    total = np.zeros(rows, np.int64)
    wide = PLANE_BYTES * 8
    cells, counts = np.unique(row * wide + bucket, return_counts=True)
    for lo in range(0, rows, ROWS_AT_ONCE):
        hi = min(lo + ROWS_AT_ONCE, rows)
        here = slice(*np.searchsorted(cells, [lo * wide, hi * wide]))
        cell, count = cells[here] - lo * wide, counts[here]
        place = 0
        while len(cell):
            bit = cell[(count & 1).astype(bool)]
            held, at = np.unique(bit // wide, return_inverse=True)
            flat = np.zeros(len(held) * wide, np.uint8)
            flat[at * wide + bit % wide] = 1
            plane = np.packbits(flat.reshape(len(held), wide), axis=1, bitorder="little").view(np.uint64)
            for factor, gain in gains:
                both = np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64)
                total[lo + held] += both * (factor << place)
            more = count > 1
            cell, count, place = cell[more], count[more] >> 1, place + 1
    return total


def noise_of(doc_id: int | None, seed: int = SEED) -> int:
    """Scaled Gumbel noise, by hash."""
    name = "" if doc_id is None else doc_id
    drawn = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((drawn + 0.5) / 4294967296)))


_SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def scored(docs: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    """Every row's words, features, weight and noisy score."""
    planes = gain_planes(gains)

    def score(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, data, offsets in T.byte_slices(batch.column(1)):
                row, bucket, words = slice_features(data, offsets)
                rows = len(words)
                features = np.bincount(row, minlength=rows)
                weight = gain_sums(row, bucket, rows, planes) // np.maximum(features, 1)
                noise = np.array([noise_of(i, seed) for i in ids[first:first + rows]], np.int64)
                yield pa.record_batch(
                    [batch.column(0).slice(first, rows), pa.array(words), pa.array(features),
                     pa.array(weight), pa.array(weight + noise)],
                    names=["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        score, _SCORED)


def drawn(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS,
          seed: int = SEED) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)``, one row per row of ``docs``.

    ``rank`` counts the drawn rows from 1 by falling score, ties by ``doc_id``; it is null for
    the others.  Rows that repeat a ``doc_id`` are drawn on their own, with the same noise; rows
    without one share the noise of an empty id and lose ties.  Null and empty texts have no
    feature and weight 0; without any target text all gains follow the smoothing alone.  Other
    columns are ignored.
    """
    gains = gains_of(bucket_counts(docs), bucket_counts(target))
    enough = F.col("n_words") >= min_words
    table, seen = Scratch(docs.sparkSession, "bitslice").save_observed(
        scored(docs, gains, seed), enough=F.coalesce(F.sum(enough.cast("long")), F.lit(0)))
    many = int(seen["enough"]) * percent // 100
    rows = table.withColumn("row", F.monotonically_increasing_id())
    order = [~enough, -F.col("score"), F.col("doc_id").asc_nulls_last(), F.col("row")]
    return number_rows(rows, order, "number").select(
        "doc_id", "n_features", "weight", "score",
        F.when(enough & (F.col("number") <= many), F.col("number")).alias("rank"))
