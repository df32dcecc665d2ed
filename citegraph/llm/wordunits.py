"""The ids of a tokenizer of lower-case units with word ends, each distinct unit encoded once.

Such a tokenizer drops white space and joins nothing across its units, so a text's ids are those
of its units in order.  Slices of texts are cut into units by numpy, after the tokenizer's own
pattern; units are known by 64-bit hashes, the tokenizer itself encodes those that are new, and
the ids are gathered for a whole slice.  Texts for which this need not hold go another way:

* words with characters that are not plain (below) go to the tokenizer as words;
* texts with a special token's opening, or with the separators \\x1c-\\x1f, on which Python and the
  tokenizer differ about white space, and texts of all other tokenizers go to it whole.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
from tokenizers import Tokenizer

from citegraph.llm import textual as T

# The pattern whose units are cut here, and the normal form it is applied to.
UNIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL_FORM = ["NFC", "Replace", "Lowercase"]

#: Characters of texts that are cut together; longer texts are cut at white space.
SLICE_CHARS = 1 << 20
#: Units, and words with other than plain characters, whose ids are kept.
CACHED_UNITS, CACHED_WORDS = 1 << 20, 1 << 16
#: Units that the tokenizer gets in one call.
UNITS_AT_ONCE = 1 << 13

_SPACE = re.compile(r"\s")
#: Plain characters: no normal form changes them beside others, and their lower case depends on
#: none; besides ASCII, Latin, Greek, Cyrillic, punctuation, kana, CJK and Hangul syllables.
_RANGES = ("¡-įĲ-ɏΑ-ΡΤ-Ϋέ-ία-ώ"
           "Ѐ-ҁҊ-ӿ‐-‧‰-⁞₠-₿ぁ-ゖ"
           "ァ-ヺ一-龥가-힣！-～")
_PLAIN = re.compile(f"[\t-\r -~{_RANGES}]*")
_GAP, _LETTER, _NUMBER, _OTHER = range(4)


def _classes() -> np.ndarray:
    found = np.full(1 << 16, _OTHER, np.uint8)
    for k in range(1 << 16):
        kind = unicodedata.category(chr(k))[0]
        if kind in "LN":
            found[k] = _LETTER if kind == "L" else _NUMBER
    found[[*range(9, 14), 32]] = _GAP
    return found


_CLASS = _classes()


def unit_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the units of lower-case plain UTF-8 bytes."""
    size = len(data)
    kind = _CLASS[data]
    inner = np.zeros(size, bool)
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        three = data[lead] >= 0xE0
        for at, width in ((lead[~three], 2), (lead[three], 3)):
            code = data[at].astype(np.int64) & (0x1F if width == 2 else 0x0F)
            for j in range(1, width):
                code = code << 6 | data[at + j] & 0x3F
            for j in range(width):
                kind[at + j] = _CLASS[code]
                inner[at + j] = j > 0
    changes = np.ones(size, bool)
    changes[1:] = kind[1:] != kind[:-1]
    starts = (kind != _GAP) & (changes | (kind == _NUMBER) & ~inner)
    # An apostrophe alone takes a following s, t, m, d, re, ve or ll.
    short = np.flatnonzero(starts[:-1] & (data[:-1] == 39) & (kind[1:] == _LETTER))
    if len(short):
        first = data[short + 1]
        second = data[np.minimum(short + 2, size - 1)] * (short + 2 < size)
        one = np.isin(first, np.frombuffer(b"stmd", np.uint8))
        two = ((second == ord("e")) & np.isin(first, np.frombuffer(b"rv", np.uint8))
               | (second == ord("l")) & (first == ord("l")))
        for at, letters in ((short[one], 1), (short[two], 2)):
            starts[at + 1] = False
            behind = at + 1 + letters
            behind = behind[behind < size]
            starts[behind[kind[behind] == _LETTER]] = True
    edges = np.flatnonzero(starts | changes & (kind == _GAP))
    opens = starts[edges]
    ends = np.append(edges[1:], size)
    return edges[opens], ends[opens]


class UnitStore:
    """The ids of known units by hash: sorted layers, each at most half as long as the one before."""

    def __init__(self, wide: np.dtype):
        self.layers: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pool, self.used = np.zeros(1 << 16, wide), 0

    def __len__(self) -> int:
        return sum(len(keys) for keys, _, _ in self.layers)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of every key; place -1 if it is not known."""
        place, many = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        for known, places, lengths in self.layers:
            left = np.flatnonzero(place < 0)
            at = np.minimum(np.searchsorted(known, keys[left]), len(known) - 1)
            hit = known[at] == keys[left]
            place[left[hit]], many[left[hit]] = places[at[hit]], lengths[at[hit]]
        return place, many

    def add(self, keys: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Ascending new ``keys`` with their ids one after the other."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used:self.used + len(ids)] = ids
        layer = (keys, self.used + np.cumsum(lengths) - lengths, lengths)
        self.used += len(ids)
        while self.layers and 2 * len(layer[0]) > len(self.layers[-1][0]):
            both = [np.concatenate(c) for c in zip(self.layers.pop(), layer, strict=True)]
            order = np.argsort(both[0], kind="stable")
            layer = tuple(c[order] for c in both)
        self.layers.append(layer)


class WordTokenizer:
    """The ids of the tokenizer in the file at ``path``."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.wide = np.dtype("<u2") if max(vocabulary.values()) < 1 << 16 else np.dtype("<u4")
        self.odd = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
        with open(path, encoding="utf-8") as file:
            suffix = self._word_end(json.load(file))
        self.cut = suffix is not None
        if self.cut:
            self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
            self.bytes_of = np.zeros(len(self.closes), np.int64)
            for token, number in vocabulary.items():
                self.closes[number] = token.endswith(suffix)
                self.bytes_of[number] = len(token.removesuffix(suffix))
        self.units = UnitStore(self.wide)
        self.words: dict[str, bytes] = {}

    @staticmethod
    def _word_end(described: dict) -> str | None:
        """The mark of a word's end, if texts may be cut into units."""
        steps = (described.get("normalizer") or {}).get("normalizers", [])
        splits = (described.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if [s["type"] for s in steps] != NORMAL_FORM:
            return None
        if [s["type"] for s in splits] != ["Split", "ByteLevel"]:
            return None
        if splits[0]["pattern"].get("Regex") != UNIT_PATTERN or splits[0]["behavior"] != "Removed":
            return None
        return described["model"].get("end_of_word_suffix") or None

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype=self.wide).tobytes()

    def encoded(self, texts: list[str]) -> list[bytes]:
        """The ids of every text, packed as ``wide`` numbers."""
        found: list[list[bytes]] = [[] for _ in texts]
        waiting, held = [], 0
        for k, text in enumerate(texts):
            if not self.cut or any(o in text for o in self.odd):
                found[k].append(self._whole(text))
                continue
            for part in _slices(text):
                if not (part.isascii() or _PLAIN.fullmatch(part)):
                    found[k].append(self._by_words(part))
                    continue
                # A part of a long text waits for none after it, so parts stay in order.
                place = len(found[k])
                found[k].append(b"")
                waiting.append((k, place, part.lower().encode()))
                held += len(part)
                if held >= SLICE_CHARS:
                    self._by_units(waiting, found)
                    waiting, held = [], 0
        if waiting:
            self._by_units(waiting, found)
        return [b"".join(parts) for parts in found]

    def _by_words(self, text: str) -> bytes:
        ids = []
        for word in text.split():
            own = self.words.get(word)
            if own is None:
                own = self._whole(word)
                if len(self.words) >= CACHED_WORDS:
                    self.words.clear()
                self.words[word] = own
            ids.append(own)
        return b"".join(ids)

    def _by_units(self, waiting: list[tuple[int, int, bytes]], found: list[list[bytes]]) -> None:
        data = np.frombuffer(b"\n".join(part for _, _, part in waiting), np.uint8)
        edges = np.cumsum([0, *(len(part) + 1 for _, _, part in waiting)])
        if not len(data):
            return
        starts, ends = unit_spans(data)
        if not len(starts):
            return
        keys, first, unit = np.unique(
            T._hash_spans(data, starts, ends, T._CODES), return_index=True, return_inverse=True)
        if len(self.units) > CACHED_UNITS:
            self.units = UnitStore(self.wide)
        place, many = self.units.find(keys)
        new = np.flatnonzero(place < 0)
        if len(new):
            raw = data.tobytes()
            spans = zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)
            self._learn(keys[new], [raw[a:b] for a, b in spans])
            place, many = self.units.find(keys)
        lengths = many[unit]
        behind = np.cumsum(lengths)
        at = np.repeat(place[unit] - behind + lengths, lengths) + np.arange(behind[-1])
        ids = self.units.pool[at].tobytes()
        cuts = np.concatenate([[0], behind])[np.searchsorted(starts, edges)] * self.wide.itemsize
        for (k, part, _), lo, hi in zip(waiting, cuts.tolist(), cuts[1:].tolist()):
            found[k][part] = ids[lo:hi]

    def _learn(self, keys: np.ndarray, units: list[bytes]) -> None:
        for lo in range(0, len(units), UNITS_AT_ONCE):
            some = units[lo:lo + UNITS_AT_ONCE]
            joined = b" ".join(some).decode()
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.closes[ids]) + 1
            starts = np.concatenate([[0], ends[:-1]])
            # What comes back is taken apart at word ends and must have the units' lengths.
            if (len(ends) == len(some) and ends[-1] == len(ids)
                    and (np.add.reduceat(self.bytes_of[ids], starts) == [len(u) for u in some]).all()):
                self.units.add(keys[lo:lo + UNITS_AT_ONCE], ends - starts, ids.astype(self.wide))
            else:
                each = [np.frombuffer(self._whole(u.decode()), self.wide) for u in some]
                self.units.add(keys[lo:lo + UNITS_AT_ONCE], np.array([len(e) for e in each]),
                               np.concatenate(each))


def _slices(text: str):
    """Parts of about ``SLICE_CHARS``, cut at white space."""
    at = 0
    while len(text) - at > SLICE_CHARS:
        space = _SPACE.search(text, at + SLICE_CHARS)
        if space is None:
            break
        yield text[at:space.start()]
        at = space.end()
    yield text[at:] if at else text
