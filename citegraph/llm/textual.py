"""Words, lines and shingles of text columns as 64-bit hashes, in numpy.

Used inside Arrow tasks.  A word is a maximal run of bytes other than space and
\\t \\n \\v \\f \\r; A-Z count as a-z.  Hashes are 64 bits wide: two different words
share one with probability 2**-64, which the callers state as their equality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are hashed in slices of about this many bytes, so that the arrays of a
#: task stay small; a longer text is a slice of its own and is never cut.
SLICE_BYTES = 1 << 20

SPACES = np.frombuffer(b" \t\n\v\f\r", dtype=np.uint8)
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[SPACES] = False
#: ASCII letters and digits, and all bytes beyond ASCII.
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_NUMBERS = np.random.default_rng(20240501).integers(1, 2**63, size=512, dtype=np.uint64)
_CODES = _NUMBERS[:256] * np.uint64(2) + np.uint64(1)
_FOLDED = _CODES.copy()
_FOLDED[65:91] = _FOLDED[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
ROLES = _NUMBERS[256:] * np.uint64(2) + np.uint64(1)


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    out[0] = 1
    np.multiply.accumulate(out, out=out)
    return out


class _Tables:
    up = _powers(_BASE, 1 << 12)
    down = _powers(pow(_BASE, -1, 2**64), 1 << 12)

    @classmethod
    def reach(cls, count: int) -> None:
        if len(cls.up) < count:
            cls.up = _powers(_BASE, count)
            cls.down = _powers(pow(_BASE, -1, 2**64), count)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    v = values ^ (values >> np.uint64(30))
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v *= np.uint64(0x94D049BB133111EB)
    v ^= v >> np.uint64(31)
    return v


def mix_one(value: int) -> np.uint64:
    return mix(np.array([value & (2**64 - 1)], dtype=np.uint64))[0]


def byte_slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` of consecutive slices; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    rows = len(column)
    if not rows:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + rows + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, np.uint8)
    first = 0
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def _spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, also cut at every row's start."""
    size = len(inside)
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < size)]
    starts[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def _prefix(data: np.ndarray, codes: np.ndarray = _CODES) -> np.ndarray:
    """Sums of the bytes' codes times a power of their place, before each byte and after all."""
    _Tables.reach(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.multiply(codes[data], _Tables.up[:len(data)], out=total[1:])
    np.cumsum(total, out=total)
    return total


def _from_prefix(total: np.ndarray, starts, ends) -> np.ndarray:
    found = total[ends] - total[starts]
    found *= _Tables.down[starts]
    found += (ends - starts).astype(np.uint64)
    return mix(found)


def _hash_spans(data: np.ndarray, starts, ends, codes: np.ndarray) -> np.ndarray:
    return _from_prefix(_prefix(data, codes), starts, ends)


def row_words(column: pa.Array, fold: bool = True) -> Iterator[np.ndarray]:
    """The word hashes of each row's whole text."""
    for _, data, offsets in byte_slices(column):
        yield from _slice_words(data, offsets, fold)


def _slice_words(data, offsets, fold) -> Iterator[np.ndarray]:
    if not len(data):
        for _ in range(len(offsets) - 1):
            yield np.zeros(0, np.uint64)
        return
    starts, ends = _spans(_IN_WORD[data], offsets)
    if not len(starts):
        hashes = np.zeros(0, np.uint64)
    else:
        hashes = _hash_spans(data, starts, ends, _FOLDED if fold else _CODES)
    cuts = np.searchsorted(starts, offsets)
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        yield hashes[lo:hi]


def row_word_spans(column: pa.Array, fold: bool = True, inside: np.ndarray = _IN_WORD
                   ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(bytes, hashes, starts, ends)`` of each row; places count from its first byte.

    ``inside`` says which bytes belong to words.
    """
    codes = _FOLDED if fold else _CODES
    for _, data, offsets in byte_slices(column):
        starts, ends = _spans(inside[data], offsets) if len(data) else (np.zeros(0, np.int64),) * 2
        hashes = (_hash_spans(data, starts, ends, codes) if len(starts)
                  else np.zeros(0, np.uint64))
        cuts = np.searchsorted(starts, offsets)
        for k in range(len(offsets) - 1):
            lo, hi, base = cuts[k], cuts[k + 1], offsets[k]
            yield (data[base:offsets[k + 1]], hashes[lo:hi], starts[lo:hi] - base, ends[lo:hi] - base)


def shingle_set(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle, no word is none."""
    count = len(words)
    if not count:
        return np.zeros(0, np.uint64)
    if count < width:
        whole = np.uint64(count)
        with np.errstate(over="ignore"):
            for j in range(count):
                whole = whole + words[j] * ROLES[j]
        return mix(np.array([whole], dtype=np.uint64))
    left = count - width + 1
    total = words[:left] * ROLES[0]
    for j in range(1, width):
        total += words[j:j + left] * ROLES[j]
    total += np.uint64(width)
    return np.unique(mix(total))


def signed(values: np.ndarray) -> np.ndarray:
    """The same bits as Spark's signed long."""
    return np.ascontiguousarray(values).view(np.int64)


def row_lines(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(hashes, words)`` of each row's \n-split lines; an empty text has no line.

    Lines are equal if their bytes are; ``words`` counts their words.
    """
    for _, data, offsets in byte_slices(column):
        if len(data):
            word_starts, _ = _spans(_IN_WORD[data], offsets)
            breaks = np.flatnonzero(data == 10)
            hashed = _prefix(data)
        for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
            if lo == hi:
                yield np.zeros(0, np.uint64), np.zeros(0, np.int64)
                continue
            own = breaks[np.searchsorted(breaks, lo):np.searchsorted(breaks, hi)]
            starts = np.concatenate([[lo], own + 1])
            ends = np.concatenate([own, [hi]])
            words = np.searchsorted(word_starts, ends) - np.searchsorted(word_starts, starts)
            yield _from_prefix(hashed, starts, ends), words
