"""Benchmark decontamination by the q-gram lemma and banded alignment.

An item of m characters leaks into a text if some region of the text is within k edits of
it, k being ``EDIT_RATE`` of m.  Such a region keeps at least ``m - q + 1 - k * q`` of the
item's q-grams, on diagonals (place in text - place in item) that differ by at most k.  So
q-grams that a text shares with an item are counted in diagonal bands of width 2 * (k + 1),
each overlapping the next by half; a band with fewer than the bound is left, the others are
verified by alignment inside the band.

Characters are compared after lower-casing and joining white space to one blank.  For the
count they are folded to one byte each, so that eight of them are one 64-bit number; folding
can only raise the count.  The alignment compares the characters themselves.  k is lowered
where the bound would fall below 1; items of fewer than q characters are never found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.llm.alignment import banded_alignment

Q = 8
EDIT_RATE = 0.1
#: Characters of items that one pass over the texts holds in every task.
BLOCK_CHARS = 4 << 20
_SLOT_BITS = 22
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def folded(text: str) -> np.ndarray:
    """One byte per character; characters beyond Latin-1 share the upper half."""
    try:
        return np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        codes = characters(text)
        return np.where(codes < 256, codes, 128 + codes % 128).astype(np.uint8)


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(data: np.ndarray) -> np.ndarray:
    """All q-grams of a folded text as 64-bit numbers, without a copy."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    data = np.ascontiguousarray(data)
    return np.ndarray(len(data) - Q + 1, np.uint64, data, strides=(1,)).copy()


def edit_budget(length: int, rate: float = EDIT_RATE) -> int:
    return max(0, min(int(rate * length), (length - Q) // Q))


class ItemIndex:
    """The q-grams of one block of items."""

    def __init__(self, items: list[tuple[int, str]], rate: float = EDIT_RATE):
        kept = [(i, normal(t)) for i, t in items]
        kept = [(i, t) for i, t in kept if len(t) >= Q]
        self.ids = [i for i, _ in kept]
        self.texts = [t for _, t in kept]
        self.lengths = np.array([len(t) for _, t in kept], np.int64)
        self.budgets = np.array([edit_budget(len(t), rate) for _, t in kept], np.int64)
        self.bounds = self.lengths - Q + 1 - self.budgets * Q
        found = [grams(folded(t)) for _, t in kept]
        values = np.concatenate(found) if found else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(kept)), [len(f) for f in found])
        place = np.concatenate([np.arange(len(f)) for f in found]) if found else item
        order = np.argsort(values, kind="stable")
        self.values, self.first, self.counts = np.unique(
            values[order], return_index=True, return_counts=True)
        self.item, self.place = item[order], place[order]
        self.slots = np.zeros(1 << _SLOT_BITS, bool)
        self.slots[self._slot(self.values)] = True

    @staticmethod
    def _slot(values: np.ndarray) -> np.ndarray:
        return (values * _SPREAD) >> np.uint64(64 - _SLOT_BITS)

    def shared(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(item, place in item, place in text)`` of every shared q-gram."""
        own = grams(data)
        spots = np.flatnonzero(self.slots[self._slot(own)])
        values = own[spots]
        at = np.minimum(np.searchsorted(self.values, values), len(self.values) - 1)
        real = self.values[at] == values
        at, spots = at[real], spots[real]
        counts = self.counts[at]
        rows = np.repeat(self.first[at] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        return self.item[rows], self.place[rows], np.repeat(spots, counts)

    def leaks(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """``(item id, start, end, edits, shared q-grams)``: the best region of each item."""
        plain = normal(text)
        if not self.ids or len(plain) < Q:
            return []
        item, place, spot = self.shared(folded(plain))
        if not len(item):
            return []
        enough = np.bincount(item, minlength=len(self.ids)) >= self.bounds
        kept = enough[item]
        item, place, spot = item[kept], place[kept], spot[kept]
        if not len(item):
            return []
        step = self.budgets[item] + 1
        band = (spot - place + self.lengths[item]) // step
        # Each diagonal lies in the band that starts at its own step and in the one before.
        item, place, band = np.tile(item, 2), np.tile(place, 2), np.concatenate([band, band - 1])
        keys = np.unique(np.stack([item, band, place]), axis=1)
        cuts = np.flatnonzero(np.any(np.diff(keys[:2], axis=1, prepend=-1) != 0, axis=0))
        shared = np.diff(cuts, append=keys.shape[1])
        best: dict[int, tuple] = {}
        for at, count in zip(cuts, shared, strict=True):
            which, number = int(keys[0, at]), int(keys[1, at])
            if count < self.bounds[which] or best.get(which, (1,))[0] == 0:
                continue
            width = int(self.budgets[which]) + 1
            low = number * width - int(self.lengths[which])
            found = self._aligned(which, plain, low, low + 2 * width - 1)
            if found and (which not in best or (found[0], found[1]) < best[which][:2]):
                best[which] = (*found, int(count))
        return [(self.ids[w], start, end, edits, count)
                for w, (edits, start, end, count) in sorted(best.items())]

    def _aligned(self, which: int, plain: str, low: int, high: int):
        item, budget = self.texts[which], int(self.budgets[which])
        at = plain.find(item, max(0, low), max(0, high) + len(item))
        if at >= 0:
            return 0, at, at + len(item)
        return banded_alignment(characters(item), characters(plain), low - budget, high + budget,
                                budget)


def _blocks(benchmark: DataFrame, rate: float, named: bool = True):
    """Item indexes, each over about ``BLOCK_CHARS`` characters; rows without text are left, and
    those without id if items are ``named``."""
    items = benchmark.where("text is not null").select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    if named:
        items = items.where("item_id is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    count = max(1, -(-total // BLOCK_CHARS))
    for block in range(count):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block)
        rows = [(r["item_id"], r["text"]) for r in own.collect()]
        yield ItemIndex(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])), rate)


_LEAKS = "doc_id long, item_id long, start long, end long, edits long, shared_grams long"


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """``(doc_id, item_id, start, end, edits, shared_grams)``: every item that a text holds.

    One row per row of ``docs`` and item; places count characters of the normal form.  Null
    and empty texts hold nothing; a null ``doc_id`` is reported as null; rows that repeat a
    ``doc_id`` are searched each.  Equal items are all reported.  The benchmark is the query
    set: it is searched in blocks, each against all texts.
    """
    def searched(index: ItemIndex):
        def search(batches):
            for batch in batches:
                rows = [(doc_id, *hit) for doc_id, text in
                        zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                        for hit in index.leaks(text)]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 6
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns],
                                      names=["doc_id", "item_id", "start", "end", "edits",
                                             "shared_grams"])

        return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
            search, _LEAKS)

    found = None
    for index in _blocks(benchmark, rate):
        part = searched(index)
        found = part if found is None else found.unionAll(part)
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item, with or without id; null
    texts stay."""
    place = docs.columns.index("text")

    def filtered(index: ItemIndex):
        def keep(batches):
            for batch in batches:
                clean = [not index.leaks(t) for t in batch.column(place).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return keep

    for index in _blocks(benchmark, rate, named=False):
        docs = docs.mapInArrow(filtered(index), docs.schema)
    return docs
