import random
import sys
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from citegraph.llm import tiers, wordunits

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def check_plan(counts, windows=tiers.WINDOWS, least_gap=tiers.LEAST_GAP):
    plan = tiers.Plan(counts, windows, least_gap)
    lengths = [n for n in sorted(counts, key=lambda n: tiers.order_of(n, windows, least_gap))
               for _ in range(counts[n])]
    row, start, length, sequence, offset = plan.places(
        np.arange(len(lengths)), np.array(lengths, np.int64))
    window = [w for w, many in plan.sequences for _ in range(many)]
    inside, own = defaultdict(list), defaultdict(list)
    for r, s, n, q, o in zip(*(c.tolist() for c in (row, start, length, sequence, offset))):
        own[r].append((s, n))
        inside[q].append((o, n))
    for held, sizes in ((own, lengths), (inside, window)):
        assert sorted(held) == list(range(len(sizes)))
        for k, spans in held.items():
            at = 0
            for s, n in sorted(spans):
                assert s == at and n > 0
                at += n
            assert at == sizes[k]
    assert window == sorted(window, reverse=True)
    assert all(w & (w - 1) == 0 for w in window)
    return window


def test_all_windows_are_full():
    rng = random.Random(4)
    for _ in range(150):
        counts = {rng.randrange(1, 4097): rng.randrange(1, 50) for _ in range(rng.randrange(1, 40))}
        check_plan(counts)
        check_plan({n % 64 + 1: many for n, many in counts.items()}, (8, 16, 64), rng.choice((1, 2, 5)))
    assert check_plan({}) == [] and check_plan({1: 1}) == [1] and check_plan({4095: 1})[0] == 2048
    assert check_plan({4095: 4096}) == [4096] * 4095


def test_plan_does_not_grow_with_the_input():
    for many in (10**3, 10**12):
        plan = tiers.Plan({n: many // n + 1 for n in range(1, 4097)})
        assert len(plan.slots) <= 4096 + 12 and len(plan.sequences) <= 16
        assert sum(w * n for w, n in plan.sequences) == plan.tokens[-1]


def test_long_windows_are_filled_from_shorter_tiers():
    # Each 3000 needs 1096 more tokens, which the 100s have; what is left of these fills short windows.
    window = check_plan({3000: 10, 1500: 4, 100: 400})
    assert window.count(4096) == 10 and window.count(2048) == 4 and window.count(512) > 0


def test_steps_get_equal_tokens():
    rng = random.Random(9)
    for _ in range(200):
        sequences = [(w, rng.randrange(0, 200)) for w in (4096, 2048, 1024, 512, 8, 1)]
        sequences = [s for s in sequences if s[1]]
        steps = rng.randrange(1, 40)
        runs, load, number = tiers.step_runs(sequences, steps), [0] * steps, 0
        for window, many in sequences:
            for q in range(number, number + many):
                first, step, width = [r for r in runs if r[0] <= q][-1]
                load[step + (q - first) % width] += window
            number += many
        assert max(load) - min(load) <= 4096


def test_ids_are_the_tokenizers(plain):
    own = wordunits.WordTokenizer(PATH)
    letters = [chr(c) for c in range(sys.maxunicode + 1)
               if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    rng = random.Random(1)
    rng.shuffle(letters)
    texts = ["".join(a + rng.choice(("", " ", "a", "́", "'s ", "\n")) for a in letters[k:k + 60])
             for k in range(0, len(letters), 60)]
    texts += ["", " ", "<|endoftext|> a <|ENDOFTEXT|>", "a\x1cb \x1f", "x" * 300_000, " \n\t" * 700_000,
              "I'LL we've It's 123 ΑΣ é", "́ " * 3]
    for text, ids in zip(texts, own.encoded(texts)):
        assert np.frombuffer(ids, own.wide).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_texts_are_sliced_at_white_space(monkeypatch):
    own = wordunits.WordTokenizer(PATH)
    text = " some  words\nand " + "l" * 50 + " others, of which\tmany "
    whole = own.encoded([text])
    for size in (1, 7, 20):
        monkeypatch.setattr(wordunits, "SLICE_CHARS", size)
        monkeypatch.setattr(wordunits, "CACHED_UNITS", size)
        assert own.encoded([text, "", text]) == [*whole, b"", *whole]


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = wordunits.WordTokenizer(path)
    text = "Some  text\nof two lines"
    assert np.frombuffer(own.encoded([text])[0], own.wide).tolist() == Tokenizer.from_file(path).encode(text).ids


def test_pieces_hold_every_token_once(spark, plain):
    rng = random.Random(6)
    words = "the quick brown fox jumps over a lazy dog's résumé 2024 !".split()
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.choice((0, 3, 60, 400, 900, 6000)))))
            for k in range(120)]
    rows += [(120, None), (121, ""), (None, "no id"), (None, None), (5, rows[5][1]), (122, "hot text " * 30)]
    rows += [(k, "hot text " * 30) for k in range(200, 300)]
    docs = spark.createDataFrame([(*r, 1, "b", 2.0) for r in rows],
                                 "doc_id long, text string, length int, row string, number double")
    found = tiers.tiered(docs.repartition(3), PATH, step_tokens=16 * 4096).collect()
    inside, load = defaultdict(list), defaultdict(int)
    for r in found:
        inside[r["sequence_id"], r["window"], r["step"]].append((r["offset"], r["length"]))
    assert len({s for s, _, _ in inside}) == len(inside)
    for (_, window, step), spans in inside.items():
        load[step] += window
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == window and window & (window - 1) == 0 and window <= 4096
    assert max(load.values()) - min(load.values()) <= 4096
    ids = {r: [*plain.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows}
    assert sum(r["length"] for r in found) == sum(len(ids[r]) for r in rows)
    unique = {d: ids[d, t] for d, t in rows if d is not None and d != 5}
    for doc_id, own in unique.items():
        at = 0
        for r in sorted((r for r in found if r["doc_id"] == doc_id), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(own)
            piece = np.array(own[at:at + r["length"]], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(piece)
            at += r["length"]
        assert at == len(own)
    assert sum(r["length"] for r in found if r["doc_id"] is None) == sum(
        len(ids[r]) for r in rows if r[0] is None)
    assert tiers.tiered(docs.where("doc_id > 1000"), PATH).collect() == []
