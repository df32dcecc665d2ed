"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of one word at a time, from both ends, and gives every position
a distribution over the languages; a text's probabilities are the mean over all its positions.
As its state starts anew with every word, a word has the same output wherever it stands: the
distinct words of a batch are computed once and pooled by how often each text has them.  Words
longer than ``UNIT_BYTES`` are read in units of that size.

Training is by backpropagation through time in numpy on the driver, on a bounded sample of
the labelled texts: about ``TRAIN_TEXTS`` per language, drawn by a hash of their id.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegraph.llm import textual as T

UNIT_BYTES = 32
HIDDEN = 12
#: Bounds of the training sample: texts per language, bytes per text, words per language.
TRAIN_TEXTS = 400
TRAIN_BYTES = 20_000
TRAIN_WORDS = 20_000
MAX_LANGUAGES = 256
STEPS = 1_500
BATCH = 160
RATE = 0.01
#: Words that are run through the network at once.
CHUNK = 8_192
POOL_BYTES = 8 << 20


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


@dataclass
class Direction:
    """One gated recurrent layer; gates z (keep), r (reset) and the candidate n, side by side."""

    inputs: np.ndarray    # 256 x 3H: what each byte adds to the gates
    recurrent: np.ndarray  # H x 3H

    @classmethod
    def fresh(cls, rng, hidden: int) -> Direction:
        return cls(rng.normal(0, 0.2, (256, 3 * hidden)).astype(np.float32),
                   rng.normal(0, 0.3, (hidden, 3 * hidden)).astype(np.float32))

    def run(self, steps: np.ndarray, keep: bool = False):
        """States after each byte, ``(time, words, H)``; ``steps`` is ``(time, words)``."""
        hidden = len(self.recurrent)
        state = np.zeros((steps.shape[1], hidden), np.float32)
        states, trace = np.empty((*steps.shape, hidden), np.float32), []
        for t, codes in enumerate(steps):
            given, fed = self.inputs[codes], state @ self.recurrent
            gates = _sigmoid(given[:, :2 * hidden] + fed[:, :2 * hidden])
            z, r = gates[:, :hidden], gates[:, hidden:]
            n = np.tanh(given[:, 2 * hidden:] + r * fed[:, 2 * hidden:])
            if keep:
                trace.append((state, z, r, n, fed[:, 2 * hidden:]))
            state = n + z * (state - n)
            states[t] = state
        return states, trace

    def back(self, steps, trace, outer):
        """Gradients of both weight tables from those of the states, back through time."""
        hidden = len(self.recurrent)
        d_inputs, d_recurrent = np.zeros_like(self.inputs), np.zeros_like(self.recurrent)
        carried = np.zeros_like(outer[0])
        for t in range(len(steps) - 1, -1, -1):
            before, z, r, n, fed = trace[t]
            d = outer[t] + carried
            d_n = d * (1 - z) * (1 - n * n)
            d_z = d * (before - n) * z * (1 - z)
            d_r = d_n * fed * r * (1 - r)
            local = np.concatenate([d_z, d_r, d_n], axis=1)
            np.add.at(d_inputs, steps[t], local)
            through = np.concatenate([d_z, d_r, d_n * r], axis=1)
            d_recurrent += before.T @ through
            carried = d * z + through @ self.recurrent.T
        return d_inputs, d_recurrent


@dataclass
class Network:
    languages: list[str]
    ahead: Direction
    behind: Direction
    out: np.ndarray       # 2H x languages
    bias: np.ndarray
    moments: dict = field(default_factory=dict)

    @classmethod
    def fresh(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        return cls(languages, Direction.fresh(rng, hidden), Direction.fresh(rng, hidden),
                   rng.normal(0, 0.2, (2 * hidden, len(languages))).astype(np.float32),
                   np.zeros(len(languages), np.float32))

    def positions(self, steps: np.ndarray, keep: bool = False):
        """Probabilities ``(time, words, languages)`` of every position."""
        ahead, trace_a = self.ahead.run(steps, keep)
        behind, trace_b = self.behind.run(steps[::-1], keep)
        both = np.concatenate([ahead, behind[::-1]], axis=2)
        logits = both @ self.out + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return (logits, both, trace_a, trace_b) if keep else logits

    def parameters(self) -> list[np.ndarray]:
        return [self.ahead.inputs, self.ahead.recurrent, self.behind.inputs,
                self.behind.recurrent, self.out, self.bias]

    def gradients(self, steps: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions, and its gradients."""
        found, both, trace_a, trace_b = self.positions(steps, keep=True)
        words = np.arange(len(labels))
        loss = -np.log(found[:, words, labels] + 1e-9).mean()
        d = found.copy()
        d[:, words, labels] -= 1
        d /= steps.size
        d_out = np.tensordot(both, d, axes=((0, 1), (0, 1)))
        d_both = d @ self.out.T
        hidden = len(self.ahead.recurrent)
        a = self.ahead.back(steps, trace_a, d_both[:, :, :hidden])
        b = self.behind.back(steps[::-1], trace_b, d_both[::-1, :, hidden:])
        return float(loss), [*a, *b, d_out, d.sum(axis=(0, 1))]

    def learn(self, steps: np.ndarray, labels: np.ndarray, turn: int, rate: float) -> float:
        """One Adam step."""
        loss, gradients = self.gradients(steps, labels)
        for k, (values, gradient) in enumerate(zip(self.parameters(), gradients, strict=True)):
            mean, square = self.moments.get(k, (0.0, 0.0))
            mean = 0.9 * mean + 0.1 * gradient
            square = 0.99 * square + 0.01 * gradient * gradient
            self.moments[k] = mean, square
            step = mean / (1 - 0.9 ** turn) / (np.sqrt(square / (1 - 0.99 ** turn)) + 1e-8)
            values -= (rate * step).astype(np.float32)
        return loss


def units_of(text: str) -> list[bytes]:
    found = []
    for word in text.encode().split():
        found += [word[k:k + UNIT_BYTES] for k in range(0, len(word), UNIT_BYTES)]
    return found


def trained(samples: dict[str, list[bytes]], steps: int = STEPS, seed: int = 7) -> Network:
    """A network from the units of each language; batches hold equal lengths, drawn evenly by
    language, so that no position is padding."""
    languages = sorted(samples)
    network = Network.fresh(languages, seed=seed)
    rng = np.random.default_rng(seed)
    by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
    weight: dict[int, int] = {}
    for number, language in enumerate(languages):
        lengths = np.array([len(u) for u in samples[language]])
        for length in np.unique(lengths):
            own = [u for u in samples[language] if len(u) == length]
            by_length.setdefault(int(length), []).append(
                (number, np.frombuffer(b"".join(own), np.uint8).reshape(len(own), length)))
            weight[int(length)] = weight.get(int(length), 0) + len(own)
    if not weight:
        return network
    choices = sorted(weight)
    chances = np.array([weight[c] * c for c in choices], float)
    chances /= chances.sum()
    for turn in range(1, steps + 1):
        groups = by_length[int(rng.choice(choices, p=chances))]
        each = max(1, BATCH // len(groups))
        drawn = [(n, units[rng.integers(0, len(units), each)]) for n, units in groups]
        batch = np.concatenate([u for _, u in drawn])
        labels = np.repeat([n for n, _ in drawn], each)
        network.learn(np.ascontiguousarray(batch.T), labels, turn,
                      RATE * (1 - 0.9 * turn / steps))
    network.moments = {}
    return network


def held_out(doc_id: Column) -> Column:
    """Texts that are never learnt from; a row without id is one of them."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_units(docs: DataFrame, texts: int = TRAIN_TEXTS) -> dict[str, list[bytes]]:
    """A bounded sample of words per language from the texts that may be learnt from."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()
                        & ~held_out(F.col("doc_id")))
    counts = usable.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return {}
    share = F.lit(0.0)
    for row in counts:
        share = F.when(F.col("lang") == row["lang"], min(1.0, texts / row["count"])).otherwise(share)
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30) < share
    # About ``texts`` rows per language; the text is cut for training only.
    rows = usable.where(drawn).select(
        "doc_id", "lang", F.substring("text", 1, TRAIN_BYTES).alias("text")).collect()
    rng = np.random.default_rng(3)
    found: dict[str, list[bytes]] = {}
    for row in sorted(rows, key=lambda r: (r["doc_id"], r["text"])):
        found.setdefault(row["lang"], []).extend(units_of(row["text"]))
    return {language: [units[k] for k in rng.permutation(len(units))[:TRAIN_WORDS]]
            for language, units in sorted(found.items()) if units}


class Pooler:
    """Document probabilities of whole texts."""

    def __init__(self, network: Network):
        self.network = network

    def unit_sums(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Sum of the probabilities over the positions of each unit."""
        lengths = ends - starts
        found = np.empty((len(starts), len(self.network.languages)), np.float32)
        for length in np.unique(lengths):
            own = np.flatnonzero(lengths == length)
            for k in range(0, len(own), CHUNK):
                part = own[k:k + CHUNK]
                steps = data[starts[part] + np.arange(length)[:, None]]
                found[part] = self.network.positions(steps).sum(axis=0)
        return found

    def pooled(self, column: pa.Array):
        """Mean probabilities over all positions of each row's text."""
        for group in self._groups(column):
            datas, starts, ends, hashes, rows, base = [], [], [], [], [], 0
            for data, own_hashes, own_starts, own_ends in group:
                datas.append(data)
                starts.append(own_starts + base)
                ends.append(own_ends + base)
                hashes.append(own_hashes)
                rows.append(len(own_hashes))
                base += len(data)
            data = np.concatenate(datas)
            start, end, hashed = (np.concatenate(x) for x in (starts, ends, hashes))
            total = np.zeros((len(rows), len(self.network.languages)))
            if len(hashed):
                _, first, inverse = np.unique(hashed, return_index=True, return_inverse=True)
                sums = self._word_sums(data, start[first], end[first])
                owner = np.repeat(np.arange(len(rows)), rows)
                for k in range(total.shape[1]):
                    total[:, k] = np.bincount(owner, sums[inverse, k], minlength=len(rows))
            yield from total / np.maximum(total.sum(axis=1, keepdims=True), 1e-9)

    def _word_sums(self, data, start, end) -> np.ndarray:
        """Words over ``UNIT_BYTES`` are the sum of their units."""
        units = -(-(end - start) // UNIT_BYTES)
        owner = np.repeat(np.arange(len(start)), units)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(units) - units, units)
        unit_start = start[owner] + nth * UNIT_BYTES
        sums = self.unit_sums(data, unit_start, np.minimum(unit_start + UNIT_BYTES, end[owner]))
        return np.add.reduceat(sums, np.cumsum(units) - units, axis=0)

    @staticmethod
    def _groups(column):
        group, held = [], 0
        for row in T.row_word_spans(column, fold=False):
            group.append(row)
            held += len(row[0])
            if held >= POOL_BYTES:
                yield group
                group, held = [], 0
        if group:
            yield group


def languages(docs: DataFrame, texts: int = TRAIN_TEXTS, steps: int = STEPS) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``, one row per row of ``docs``.

    ``und`` with score 0 if the text is null or has no letter, or if nothing could be learnt.
    The score is the pooled probability of the prediction.  Equal probabilities go to the
    language first in alphabetical order.  Rows that repeat a ``doc_id`` are predicted each.
    Other columns are ignored.
    """
    samples = training_units(docs, texts)
    network = trained(samples, steps)

    def predict(batches):
        pooler = Pooler(network)
        for batch in batches:
            names, scores = [], []
            letters = batch.column(2).to_pylist()
            for row, letter in zip(pooler.pooled(batch.column(3)), letters, strict=True):
                best = int(np.argmax(row)) if letter else -1
                names.append(network.languages[best] if letter else "und")
                scores.append(float(min(1.0, row[best])) if letter else 0.0)
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()),
                 pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    readable = text.rlike(r"\p{L}") if samples else F.lit(False)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                         held_out(F.col("doc_id")).alias("held_out"),
                         readable.alias("letter"), text.alias("text"))
    if not samples:
        return chosen.select("doc_id", "held_out", F.lit("und").alias("lang_pred"),
                             F.lit(0.0).alias("score"))
    return chosen.mapInArrow(
        predict, "doc_id long, held_out boolean, lang_pred string, score double")
