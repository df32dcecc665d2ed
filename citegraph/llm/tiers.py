"""Hierarchical packing of token sequences into windows of several lengths.

Texts are tokenized once.  A document beyond the longest window is cut from its end into whole
windows, so only its first piece is shorter.  The pieces go tier by tier, longest first:

1. A piece is routed to the tier of the shortest window that holds it.
2. Each piece of a tier opens a window of its own, as long as the pieces shorter than it can
   fill the gaps; in the shortest tier, and where little else is left, only the longest do.
3. The gaps are filled in order with the tokens of the other pieces, shortest first, so gaps of
   long windows take from the shorter tiers, and a gap cuts one piece at most.  Pieces that
   would leave a gap of a few tokens open no window: they are the first to fill gaps, and what
   these do not need of them fills whole windows of their tier.
4. Less than a window is left at the end; its tokens are laid over windows of their count's
   binary digits.  So every sequence is full and none needs padding.
5. Step groups: the windows are dealt to steps, longest first, each to the step with the fewest
   tokens; the token counts of two steps differ by at most one long window.

All this is arithmetic on the number of pieces of each length, at most one number per length
whatever the input.  With the pieces numbered in the order of their lengths, a number tells the
window that a piece opens or the tokens it has in the stream of fillings; every task computes
the places of its own pieces from tables of at most one row per length.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.llm.wordunits import WordTokenizer
from citegraph.scratch import Scratch, number_rows

#: Window lengths; powers of two, ascending.
WINDOWS = (512, 1024, 2048, 4096)
#: Tokens of a training step; the number of steps follows from it.
STEP_TOKENS = 64 * 4096
#: A piece whose window would have a smaller gap fills other gaps instead.
LEAST_GAP = 16

_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer_at(path: str) -> WordTokenizer:
    """One per Python worker, as building one takes a second."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


_UNITS = "doc_id long, start long, length int, doc_tokens long, ids binary, ids_crc32 long"
_UNIT_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64())
#: Texts that are tokenized together.
TEXTS_AT_ONCE = 1024


def units(docs: DataFrame, path: str, end_id: int, longest: int) -> DataFrame:
    """Texts with their end token as units of at most ``longest`` tokens, the first one shorter."""
    def cut(batches):
        tokens = tokenizer_at(path)
        end = np.array([end_id], tokens.wide).tobytes()
        size = tokens.wide.itemsize
        for batch in batches:
            for first in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(first, TEXTS_AT_ONCE)
                rows, held = [], 0
                texts = [text or "" for text in some.column(1).to_pylist()]
                for doc_id, ids in zip(some.column(0).to_pylist(), tokens.encoded(texts), strict=True):
                    ids += end
                    count = len(ids) // size
                    edges = [0, *range(count % longest or longest, count + 1, longest)]
                    for lo, hi in zip(edges, edges[1:]):
                        own = ids[size * lo:size * hi]
                        crc = zlib.crc32(np.frombuffer(own, tokens.wide).astype("<u4"))
                        rows.append((doc_id, lo, hi - lo, count, own, crc))
                    held += len(ids)
                    if held > 1 << 24:
                        yield _batch(rows, _UNITS, _UNIT_TYPES)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, _UNITS, _UNIT_TYPES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        cut, _UNITS)


def _batch(rows, schema, types):
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    names = [column.split()[0] for column in schema.split(", ")]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


class Plan:
    """Where every piece goes, from the number of pieces of each length.

    Pieces are numbered from 0 in the order of ``order_of`` their lengths.
    """

    def __init__(self, counts: dict[int, int], windows: tuple[int, ...] = WINDOWS,
                 least_gap: int = LEAST_GAP):
        self.windows = windows
        lengths = sorted((length for length, many in counts.items() if many),
                         key=lambda length: order_of(length, windows, least_gap))
        many = [counts[length] for length in lengths]
        #: Per length in order: the length, its first piece, the tokens of all pieces before.
        self.lengths = np.array(lengths, np.int64)
        self.first = np.cumsum([0, *many], dtype=np.int64)
        self.tokens = np.cumsum([0, *(n * m for n, m in zip(lengths, many, strict=True))], dtype=np.int64)
        #: ``(window, how many)``, sequences being numbered from 0 in this order.
        self.sequences: list[tuple[int, int]] = []
        opened, slots, taken, number = [], [], 0, 0
        for below, window in zip((*reversed(windows[:-1]), 0), reversed(windows), strict=True):
            orders = [order_of(n, windows, least_gap) for n in lengths]
            # Pieces of this tier that may open a window, by number.
            lo = int(self.first[sum(order <= below for order in orders)])
            hi = int(self.first[sum(order <= window for order in orders)])
            # A window takes ``window`` tokens, its opener's and the fillings', of those left.
            many = min(hi - lo, (self._before(hi) - taken) // window)
            first = hi - many
            if many:
                opened.append((first, hi, number))
                for k in range(int(np.searchsorted(self.first, first, side="right")) - 1, len(lengths)):
                    begin, end = max(first, int(self.first[k])), min(hi, int(self.first[k + 1]))
                    if begin >= end:
                        break
                    gap = window - lengths[k]
                    if gap:
                        slots.append((taken, gap, number + begin - first, lengths[k]))
                        taken += gap * (end - begin)
            # Fillings of this tier's length beyond its gaps have whole windows of it.
            aside = self._before(int(self.first[sum(order < -below for order in orders)])) - taken
            rest = self._before(first) - taken if many < hi - lo or not below else max(aside, 0)
            fillings = rest // window
            if fillings:
                slots.append((taken, window, number + many, 0))
                taken += fillings * window
            if many + fillings:
                self.sequences.append((window, many + fillings))
                number += many + fillings
            if many < hi - lo or not below:
                left = self._before(first) - taken
                for size in [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]:
                    slots.append((taken, size, number, 0))
                    self.sequences.append((size, 1))
                    taken += size
                    number += 1
                break
        #: Ascending: first piece, one behind the last, sequence of the first.
        self.opened = np.array(sorted(opened), np.int64).reshape(-1, 3)
        #: Ascending: first token, tokens of a slot, sequence of the first slot, offset there.
        self.slots = np.array(slots, np.int64).reshape(-1, 4)

    def _before(self, piece: int) -> int:
        """Tokens of all pieces with a smaller number."""
        if piece >= self.first[-1]:
            return int(self.tokens[-1])
        k = int(np.searchsorted(self.first, piece, side="right")) - 1
        return int(self.tokens[k] + (piece - self.first[k]) * self.lengths[k])

    def whole(self) -> list[tuple[int, int]]:
        """Ranges ``(least, most)`` of lengths of which no piece is cut, but for those set aside."""
        found = []
        for first, behind, _ in self.opened.tolist():
            inside = self.lengths[(self.first[:-1] >= first) & (self.first[1:] <= behind)]
            if len(inside):
                found.append((int(inside.min()), int(inside.max())))
        return found

    def places(self, pieces: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Columns ``(row, start, length, sequence, offset)``; a piece may be cut into several."""
        rows = np.arange(len(pieces))
        at = np.searchsorted(self.opened[:, 0], pieces, side="right") - 1
        opens = np.zeros(len(pieces), bool)
        if len(self.opened):
            opens = (at >= 0) & (pieces < self.opened[at, 1])
        own = at[opens]
        zero = np.zeros(len(own), np.int64)
        found = [np.stack([rows[opens], zero, lengths[opens],
                           self.opened[own, 2] + pieces[opens] - self.opened[own, 0], zero])]
        row = rows[~opens]
        k = np.searchsorted(self.first, pieces[row], side="right") - 1
        base = self.tokens[k] + (pieces[row] - self.first[k]) * self.lengths[k]
        done = np.zeros(len(row), np.int64)
        while len(row):
            token = base + done
            slot = self.slots[np.searchsorted(self.slots[:, 0], token, side="right") - 1]
            nth, inside = np.divmod(token - slot[:, 0], slot[:, 1])
            taken = np.minimum(slot[:, 1] - inside, lengths[row] - done)
            found.append(np.stack([row, done, taken, slot[:, 2] + nth, slot[:, 3] + inside]))
            done = done + taken
            more = done < lengths[row]
            row, base, done = row[more], base[more], done[more]
        return np.concatenate(found, axis=1)


def order_of(length: int, windows: tuple[int, ...] = WINDOWS, least_gap: int = LEAST_GAP) -> int:
    """Pieces are numbered by this; it is negative for those that open no window."""
    window = windows[bisect.bisect_left(windows, length)]
    return -length if 0 < window - length < least_gap < window else length


def step_runs(sequences: list[tuple[int, int]], steps: int) -> list[tuple[int, int, int]]:
    """``(first sequence, first step, width)``: sequence ``first + i`` goes to step
    ``first step + i % width``.  Windows must not ascend, and each divides the ones before."""
    # Steps from ``first`` on have the tokens ``load``; loads descend, so the last are the least.
    loads, runs, number = [(0, 0)], [], 0
    for window, many in sequences:
        while many:
            first, load = loads[-1]
            width = steps - first
            full, extra = divmod(many, width)
            behind = (loads[-2][1] - load) // window if len(loads) > 1 else None
            runs.append((number, first, width))
            if behind is not None and full >= behind:
                loads.pop()
                number += behind * width
                many -= behind * width
                continue
            loads.pop()
            if extra and full + 1 != behind:
                loads.append((first, load + (full + 1) * window))
            loads.append((first + extra, load + full * window))
            number += many
            many = 0
    return runs


_PACKED = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
           "sequence_id long, offset long, window int, step long")
_PACKED_TYPES = (*[pa.int64()] * 7, pa.int32(), pa.int64())


def tiered(docs: DataFrame, path: str, end_id: int = 2, windows: tuple[int, ...] = WINDOWS,
           step_tokens: int = STEP_TOKENS) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, step)``, one
    row per piece; every sequence is exactly as long as its ``window``.

    A null text counts as empty and is its end token.  Rows that repeat a ``doc_id`` or lack one
    are documents of their own.  No row gives no piece; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "tiers")
    held = scratch.save(units(docs, path, end_id, windows[-1])).withColumn(
        "row", F.monotonically_increasing_id())
    # One number per length, whatever the input.
    counts = {r["length"]: r["many"] for r in
              held.groupBy("length").agg(F.count(F.lit(1)).alias("many")).collect()}
    plan = Plan(counts, windows)
    order = length = F.col("length")
    aside = [length for length in counts if order_of(length, windows) < 0]
    if aside:
        order = F.when(length.isin(aside), -length).otherwise(length)
    # Only pieces that may be cut carry their ids on.
    kept = F.lit(False)
    for least, most in plan.whole():
        kept |= order.between(least, most)
    rows = held.withColumn("ids", F.when(~kept, F.col("ids")))
    numbered = number_rows(rows, [order, F.col("doc_id"), F.col("start"), F.col("row")], "number")
    total = int(plan.tokens[-1])
    dealt = np.array(step_runs(plan.sequences, max(1, -(-total // step_tokens))),
                     np.int64).reshape(-1, 3)
    opened = np.cumsum([0, *(many for _, many in plan.sequences)])
    window_of = np.array([window for window, _ in plan.sequences], np.int32)

    def place(batches):
        wide = tokenizer_at(path).wide
        for batch in batches:
            doc_ids, base, sizes, doc_tokens, ids, whole_crc, number = batch.columns
            if not len(number):
                continue
            sizes = sizes.to_numpy(zero_copy_only=False).astype(np.int64)
            row, start, length, sequence, offset = plan.places(
                number.to_numpy(zero_copy_only=False).astype(np.int64) - 1, sizes)
            crc = whole_crc.to_numpy(zero_copy_only=False)[row]
            for k in np.flatnonzero(length < sizes[row]).tolist():
                own = np.frombuffer(ids[int(row[k])].as_py(), wide, length[k], start[k] * wide.itemsize)
                crc[k] = zlib.crc32(own.astype("<u4"))
            dealer = np.searchsorted(dealt[:, 0], sequence, side="right") - 1
            step = dealt[dealer, 1] + (sequence - dealt[dealer, 0]) % dealt[dealer, 2]
            window = window_of[np.searchsorted(opened, sequence, side="right") - 1]
            pick = pa.array(row)
            first = base.to_numpy(zero_copy_only=False).astype(np.int64)[row]
            columns = [doc_ids.take(pick), first + start, length, crc, doc_tokens.take(pick),
                       sequence, offset, window, step]
            yield pa.record_batch(
                [c if isinstance(c, pa.Array) else pa.array(c, t)
                 for c, t in zip(columns, _PACKED_TYPES, strict=True)],
                names=[column.split()[0] for column in _PACKED.split(", ")])

    return numbered.select("doc_id", "start", "length", "doc_tokens", "ids", "ids_crc32", "number").mapInArrow(
        place, _PACKED)
