"""Best-fit decreasing packing of token sequences.

Texts are tokenized once.  A document longer than a sequence is cut from its end into whole
sequences, so only its first piece needs packing.  Best-fit decreasing needs of the pieces
only how many there are of each length, at most one number per length whatever the input.
So the driver packs counts: pieces of one length, longest first, go to the tightest open bins
as whole runs of bins, found with a segment tree over the remaining capacities in logarithmic
time.  The runs say which sequence and offset the r-th piece of a length gets; numbering the
pieces of each length and looking their run up is distributed.
"""

from __future__ import annotations

import base64
import json
import re
import sys
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from citegraph.scratch import Scratch

CAPACITY = 2048
#: Parts into which every length is split for numbering; one length may hold a third of all rows.
SALTS = 128
#: Runs of white space that the rank encoder's pattern is not given: it backtracks over them and
#: panics at a million.
LONG_SPACE = 100_000
_LONG_SPACE = re.compile(r"\s{%d}" % LONG_SPACE)


class TextTokenizer:
    """The ids of a byte-level tokenizer.

    ``ranks`` is the vocabulary of the tokenizer in ``path`` as ranks, whose encoder gives the
    same ids in a fifth of the time.  Texts with a special token's string, with the separators
    on which the two need not agree, or with very long runs of white space go to the tokenizer
    itself.
    """

    def __init__(self, path: str, ranks: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            special = [t["content"] for t in json.load(file).get("added_tokens", [])]
        self.odd = (*special, "\x1c", "\x1d", "\x1e", "\x1f")
        with open(ranks, "rb") as file:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN,
                                          mergeable_ranks=merges, special_tokens={})

    def ids(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        if any(o in text for o in self.odd) or (
                len(text) >= LONG_SPACE and _LONG_SPACE.search(text)):
            found = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            found = self.encoding.encode_ordinary(text)
        packed = array("I", found)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()


_TOKENIZERS: dict[tuple, TextTokenizer] = {}


def tokenizer_at(*paths: str) -> TextTokenizer:
    """One per Python worker, as building one takes a second."""
    if paths not in _TOKENIZERS:
        _TOKENIZERS[paths] = TextTokenizer(*paths)
    return _TOKENIZERS[paths]


def piece_starts(count: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)``: whole sequences from the end; the first piece may be shorter."""
    first = count % capacity
    found = [(0, first)] if first else []
    found += [(s, capacity) for s in range(first, count, capacity)]
    return found


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, ranks: str, end_id: int = 0,
           capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every text with its end token, by its tokenizer's ids."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        tokens = tokenizer_at(path, ranks)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                    strict=True):
                ids = memoryview(tokens.ids(text or "") + end)
                rows += [(doc_id, k, start, length, zlib.crc32(ids[4 * start:4 * (start + length)]))
                         for k, (start, length) in enumerate(piece_starts(len(ids) // 4, capacity))]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(),
                                                          pa.int64(), pa.int64()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        cut, _PIECES)


class CapacityTree:
    """Which remaining capacities have open bins; finds the tightest that fits."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.open = [0] * (2 * self.leaves)

    def set(self, room: int, is_open: bool) -> None:
        at = room + self.leaves
        self.open[at] = int(is_open)
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] | self.open[2 * at + 1]

    def tightest(self, size: int) -> int | None:
        """The smallest open room of at least ``size``."""
        at = size + self.leaves
        if self.open[at]:
            return size
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit_runs(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """``(length, first rank, how many, first sequence, offset)``: piece ``first rank + i`` of a
    length goes to sequence ``first sequence + i``."""
    tree = CapacityTree(capacity)
    rooms: dict[int, list[tuple[int, int]]] = {}
    runs, sequences = [], 0

    def keep(room: int, first: int, many: int) -> None:
        if room:
            if not rooms.get(room):
                tree.set(room, True)
            rooms.setdefault(room, []).append((first, many))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, many = capacity, sequences, left
            else:
                first, many = rooms[room].pop()
                if not rooms[room]:
                    tree.set(room, False)
            # Once a bin has a piece it is the tightest for the next one of this length.
            each = room // length
            filled = min(many, left // each)
            rest = left - filled * each if filled < many else 0
            for slot in range(each):
                for begin, bins in ((first, filled), (first + filled, int(slot < rest))):
                    if bins:
                        runs.append((length, rank, bins, begin, capacity - room + slot * length))
                        rank += bins
            used = filled + int(rest > 0)
            if filled:
                keep(room - each * length, first, filled)
            if rest:
                keep(room - rest * length, first + filled, 1)
            if first == sequences:
                sequences += used
            elif many > used:
                keep(room, first + used, many - used)
            left -= filled * each + rest
    return runs


_PACKED = _PIECES + ", sequence_id long, offset long"


def packed(docs: DataFrame, path: str, ranks: str, end_id: int = 0,
           capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, one row per piece.

    A null text counts as empty and is its end token.  Rows that repeat a ``doc_id`` or lack
    one are documents of their own.  No row gives no piece; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cut = pieces(docs, path, ranks, end_id, capacity).withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    rows = scratch.save(cut)
    # At most capacity x salts rows, whatever the input; a number per length reaches the driver.
    parts = scratch.save(rows.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("many")))
    counts = {r["length"]: r["many"] for r in
              parts.groupBy("length").agg(F.sum("many").alias("many")).collect()}
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = parts.select("length", "salt", F.coalesce(
        F.sum("many").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("place", F.row_number().over(within)).join(
        scratch.save(offsets), ["length", "salt"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("before") + F.col("place") - 1).alias("rank"))
    runs = np.array(best_fit_runs(counts, capacity), dtype=np.int64).reshape(-1, 5)
    span = np.int64(max(counts.values(), default=0) + 1)
    # Runs of a length ascend by rank; one number orders them by (length, rank).
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    runs = runs[order]
    starts = runs[:, 0] * span + runs[:, 1]

    def place(batches):
        for batch in batches:
            length = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(5).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(starts, length * span + rank, side="right") - 1
            yield pa.record_batch(
                [*batch.columns[:5], pa.array(runs[at, 3] + rank - runs[at, 1]),
                 pa.array(runs[at, 4])],
                names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, _PACKED)
