import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from citegraph.llm import licenses, linededup, packing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def plain_dedup(rows, min_words):
    """Every run of lines of at least ``min_words`` words against every earlier one."""
    lines = {d: [x for x in t.split("\n") if WORD.search(x)] for d, t in rows}
    runs = defaultdict(list)
    for doc, own in sorted(lines.items()):
        for start in range(len(own)):
            total = 0
            for end in range(start, len(own)):
                total += len(WORD.findall(own[end]))
                if total >= min_words:
                    runs[tuple(own[start:end + 1])].append((doc, start))
    gone = defaultdict(set)
    for run, places in runs.items():
        for doc, start in places[1:]:
            gone[doc] |= set(range(start, start + len(run)))
    found = {}
    for doc, text in rows:
        kept, number = [], -1
        for line in text.split("\n"):
            number += bool(WORD.search(line))
            if number not in gone[doc]:
                kept.append(line)
        found[doc] = "\n".join(kept)
    return found


def test_line_dedup_matches_plain_code(spark):
    rng = random.Random(8)
    pool = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(0, 9)))
            for _ in range(25)]
    blocks = [[rng.choice(pool) for _ in range(rng.randrange(2, 14))] for _ in range(6)]
    rows = []
    for doc in range(60):
        own = []
        for _ in range(rng.randrange(1, 5)):
            own += rng.choice(blocks) if rng.random() < 0.6 else [f"only {doc} {rng.random()}"] * 2
        rows.append((doc, "\n".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for min_words in (1, 12, 50):
        found = {r["doc_id"]: r["text"] for r in linededup.without_repeats(docs, min_words).collect()}
        assert found == plain_dedup(rows, min_words)


def test_shard_capacity_is_the_smallest():
    rng = random.Random(9)

    def best(sizes, shards):
        reach = {0: 0}
        for _ in range(shards):
            new = {}
            for start, worst in reach.items():
                total = 0
                for end in range(start, len(sizes) + 1):
                    top = max(worst, total)
                    new[end] = min(new.get(end, top), top)
                    if end < len(sizes):
                        total += sizes[end]
            reach = new
        return reach[len(sizes)]

    for _ in range(150):
        sizes = [rng.choice([1, 2, 5, 30]) for _ in range(rng.randrange(1, 14))]
        shards = rng.randrange(1, 6)
        cuts = [0, *sharding.minimax_cuts(sizes, shards), len(sizes)]
        assert len(cuts) == shards + 1 and cuts == sorted(cuts)
        assert max(sum(sizes[a:b]) for a, b in zip(cuts, cuts[1:])) == best(sizes, shards)


def test_shards_hold_equal_texts_together_and_number_them(spark):
    rng = random.Random(10)
    rows = [(k, "hot text" if k % 3 == 0 else None if k % 50 == 1 else "é" * rng.randrange(200))
            for k in range(900)]
    found = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text = dict(rows)
    where, slots = defaultdict(set), defaultdict(list)
    for r in found:
        own = (text[r["doc_id"]] or "").encode()
        assert r["size"] == len(own) + 1 and r["text_crc32"] == zlib.crc32(own)
        where[own].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert len(found) == 900 and all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(slots) <= 15
    sizes = Counter()
    for r in found:
        sizes[r["shard"]] += r["size"]
    mean = sum(sizes.values()) / 16
    assert max(sizes.values()) <= 1.3 * mean and min(sizes.values()) >= 0.7 * mean


def plain_best_fit(lengths, capacity):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [(room, k) for k, room in enumerate(rooms) if room >= length]
        if fits:
            rooms[min(fits)[1]] -= length
        else:
            rooms.append(capacity - length)
    return sorted(rooms)


def test_best_fit_runs_equal_one_by_one_packing():
    rng = random.Random(11)
    for _ in range(200):
        capacity = rng.choice([1, 10, 20, 37])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randrange(120))]
        bins, placed = defaultdict(list), Counter()
        for length, rank, many, first, offset in packing.best_fit_runs(Counter(lengths), capacity):
            assert rank == placed[length]
            placed[length] += many
            for k in range(many):
                bins[first + k].append((offset, length))
        assert placed == Counter(lengths)
        rooms = []
        for own in bins.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            rooms.append(capacity - at)
        assert sorted(rooms) == plain_best_fit(lengths, capacity)


def test_pieces_hold_the_tokenizer_ids(spark):
    rng = random.Random(12)
    words = ["the", "don't", "  two", "\n\n", "été", "中文", "\U0001f600", "a1b22", "###", "<|endoftext|>",
             "\t x", " ", "\x1c", "\xa0", "\u2003x", "'s", "\r\n", "I'll"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 80, 3000]))))
            for k in range(40)] + [(90, None)]
    found = packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), PATH, RANKS).collect()
    tokenizer = Tokenizer.from_file(PATH)
    own, bins = defaultdict(list), defaultdict(list)
    for r in found:
        own[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        at = 0
        for number, r in enumerate(sorted(own[doc_id], key=lambda r: r["piece"])):
            part = ids[at:at + r["length"]]
            assert (r["piece"], r["start"]) == (number, at)
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            assert r["length"] == 2048 or number == 0
            at += r["length"]
        assert at == len(ids)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_license_spans(spark):
    mit = dict(licenses.TEMPLATES)["MIT"]
    rows = [(1, f"some prose before.\n{mit}. And after. {mit.upper()}"), (2, "nothing of the kind"),
            (3, "Licensed under CC BY-NC 4.0."), (4, "Released by us under the MIT License"),
            (5, "released early, released often, under the tree"),
            (6, "THIS work is licensed under the  GNU General\nPublic Licence, version 3")]
    found = defaultdict(list)
    texts = dict(rows)
    for r in licenses.license_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        part = texts[r["doc_id"]].encode()[r["byte_start"]:r["byte_end"]].decode()
        found[r["doc_id"]].append((r["license"], part, r["coverage"]))
    assert found[1] == [("MIT", mit, 1.0), ("MIT", mit.upper(), 1.0)]
    assert found[3] == [("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0", 1.0)]
    assert [f[0] for f in found[6]] == ["GPL-3.0"] and 0.9 < found[6][0][2] < 1
    assert [f[2] for f in found[4]] == [0.8]  # one word of five is missing
    assert 2 not in found and 5 not in found


def test_packing_of_long_white_space(spark):
    plain = Tokenizer.from_file(PATH)
    runs = [" " * 2_000_000, "\n" * 2_000_000, "\t" * 2_000_000, " \n\t\r" * 500_000,
            "a" + " " * 1_000_001 + "b", "x" * 2_000_000, " " * 99_999 + "word"]
    docs = spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string").repartition(4)
    found = defaultdict(dict)
    for r in packing.packed(docs, PATH, RANKS).collect():
        found[r["doc_id"]][r["start"]] = (r["length"], r["ids_crc32"])
    for doc_id, text in enumerate(runs):
        ids = [*plain.encode(text, add_special_tokens=False).ids, 0]
        own = found[doc_id]
        assert sum(n for n, _ in own.values()) == len(ids)
        for start, (length, crc) in own.items():
            assert crc == zlib.crc32(struct.pack(f"<{length}I", *ids[start:start + length]))
