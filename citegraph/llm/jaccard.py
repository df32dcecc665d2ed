"""N-gram Jaccard join: parity sketches, pigeonhole keys per size band, verification.

A document is its set of distinct 5-word shingles; two link when
``100 * |intersection| >= 80 * |union|``.  The join goes in four steps:

1. ``shingle_classes``: every text becomes its set; equal sets (all copies) become
   one class, and only classes go on.
2. ``shared_sets``: a linked pair has at least 80 % of either set in common, so a class is a
   candidate only if 80 % of its shingles occur in another class.  Of any 30 % of a class's
   shingles a third must then occur elsewhere; the 30 % with the smallest hashes are tried
   first, and all shingles only of classes that pass.  Shingles are dealt by hash in packed
   blocks, and only the shared ones come back to their class.  This is exact and leaves
   everything that occurs once behind.
3. ``signatures``: the shared shingles are XOR-hashed into a bit sketch.  The Hamming
   distance of two sketches is at most the symmetric difference, which a link bounds by
   ``(|A| + |B|) / 9``.  A sketch of size band j has more than half as many groups of four
   64-bit words as that bound, so by the pigeonhole principle some group differs in at
   most one bit and agrees in three of its words: one key per omitted word.
4. ``linked_components``: the members of a key's bucket meet its first member.  Pairs that
   meet in several buckets make clusters.  A cluster is first compared with a few of its
   members, block by block; what is then not in its largest component is compared with all of
   it.  In a bucket that holds members of several clusters, every two members of different
   clusters are compared.  A comparison bounds the difference by a sketch and verifies the
   sets unless the two are in one component already.  So every pair that shares a key is
   either in one component or compared, and no link between components is lost.

Sets are compared by 64-bit shingle hashes and, after step 2, by 48 of these bits within
a pair.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.llm import textual as T
from citegraph.operators.graph.components import connected_components
from citegraph.scratch import Scratch

#: Shingles that one bucket of the exchange holds on average; bounds a task's memory.
BUCKET_SHINGLES = 1_000_000
#: Shingles that a task gathers before it sends blocks.
FLUSH_SHINGLES = 1_000_000
#: Bits of a filter per key in it, and at most; filters go to every task.  What passes one wrongly
#: costs time and is left later, so a full filter changes no result.
KEY_BITS, MOST_FILTER_BITS = 128, 1 << 27
GROUP_WORDS, OMITTED = 4, 1
#: Buckets in which two classes meet to be put into one cluster.
MEETINGS = 3
#: Members that a cluster is compared with first.
LEADERS = 8
#: Rows of a block on either side of a comparison.
LEFT_BLOCK, RIGHT_BLOCK = 128, 64
#: 64-bit words, at least, of the sketch that bounds a difference before sets are compared; a power
#: of two.
SKETCH_WORDS = 16


def text_key():
    """Tells the texts of rows that repeat a ``doc_id`` apart."""
    return F.xxhash64(F.col("text").cast("string"))


def shingle_classes(docs: DataFrame, width: int = 5) -> DataFrame:
    """``(doc_id, text_key, n_shingles, set_key)``, one row per row; equal sets share a key."""
    def sets(batches):
        for batch in batches:
            sizes, keys = [], []
            for words in T.row_words(batch.column(2)):
                found = T.shingle_set(words, width)
                sizes.append(len(found))
                keys.append(_key_of(found))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()),
                 pa.array(np.array(keys, dtype=np.uint64).view(np.int64))],
                names=["doc_id", "text_key", "n_shingles", "set_key"])

    return docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"),
                       F.col("text").cast("string")).mapInArrow(
        sets, "doc_id long, text_key long, n_shingles long, set_key long")


def _key_of(found: np.ndarray) -> int:
    if not len(found):
        return 0
    folded = int(np.bitwise_xor.reduce(found))
    return int(T.mix_one(int(found.sum(dtype=np.uint64)) + len(found) * 0x9E3779B97F4A7C15
                         ^ (folded << 1)))


def _narrow(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _widen(packed: bytes) -> np.ndarray:
    narrow = np.frombuffer(packed, dtype=np.uint8).reshape(-1, 6)
    out = np.zeros((len(narrow), 8), dtype=np.uint8)
    out[:, :6] = narrow
    return out.view(np.uint64).reshape(-1)


_BLOCK = "bucket int, keys binary, sizes binary, counts binary, hashes binary"
_BLOCK_TYPES = pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in
                                                    ("keys", "sizes", "counts", "hashes"))])


def _blocks(bucket: np.ndarray, owner: np.ndarray, keys, sizes, hashes):
    """One packed row per bucket; ``owner`` indexes keys and ascends."""
    order = np.argsort(bucket, kind="stable")
    bucket, owner, hashes = bucket[order], owner[order], hashes[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    rows = {name: [] for name in _BLOCK_TYPES.names}
    for lo, hi in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
        own = owner[lo:hi]
        at = np.flatnonzero(np.diff(own, prepend=-1))
        rows["bucket"].append(int(bucket[lo]))
        rows["keys"].append(keys[own[at]].tobytes())
        rows["sizes"].append(sizes[own[at]].astype(np.int64).tobytes())
        rows["counts"].append(np.diff(at, append=hi - lo).astype(np.int32).tobytes())
        rows["hashes"].append(_narrow(hashes[lo:hi]))
    return pa.record_batch([pa.array(rows[f.name], f.type) for f in _BLOCK_TYPES],
                           schema=_BLOCK_TYPES)


def _by_bucket(batches):
    """``(keys, sizes, counts, hashes)`` of each bucket; rows come sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["bucket"] != now:
                yield _joined(held)
                held = []
            now = row["bucket"]
            held.append(row)
    if held:
        yield _joined(held)


def _joined(rows):
    return (
        np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows]),
        np.concatenate([np.frombuffer(r["sizes"], np.int64) for r in rows]),
        np.concatenate([np.frombuffer(r["counts"], np.int32) for r in rows]),
        np.concatenate([_widen(r["hashes"]) for r in rows]),
    )


def _exchange(blocks: DataFrame, parts: int) -> DataFrame:
    home = F.pmod("bucket", F.lit(parts))
    return blocks.repartitionById(parts, home).sortWithinPartitions("bucket")


def row_key():
    """Tells rows apart, by ``doc_id`` and ``text_key``."""
    return F.xxhash64("doc_id", "text_key")


def first_rows(sets: DataFrame, scratch: Scratch) -> np.ndarray:
    """Filter with the ``row_key`` of one row of each class that has shingles."""
    rows, seen = scratch.save_observed(
        sets.where("n_shingles > 0").groupBy("set_key").agg(F.min(row_key()).alias("row_key")).select("row_key"),
        many=F.count(F.lit(1)))
    found = key_filter(rows, "row_key", int(seen["many"]))
    scratch.drop(rows)
    return found


def shared_sets(docs: DataFrame, first: np.ndarray, buckets: int, parts: int, scratch: Scratch,
                width: int = 5) -> DataFrame:
    """``(key, n, shared)``: classes of which 80 % of the shingles occur in another class.

    Only rows in the filter ``first`` send their shingles, so copies in other tasks add nothing.
    """
    passed, seen = scratch.save_observed(
        _sharing(docs, first, None, buckets, parts, width, tried=0.3).select("key"), many=F.count(F.lit(1)))
    likely = key_filter(passed, "key", int(seen["many"]))
    scratch.drop(passed)
    return scratch.save(_sharing(docs, first, likely, buckets, parts, width, tried=1.0))


def key_filter(table: DataFrame, column: str, many: int) -> np.ndarray:
    """Bits of ``many`` hashed keys as 64-bit words, by their lowest bits."""
    bits = 1 << min(max((KEY_BITS * many).bit_length(), 6), MOST_FILTER_BITS.bit_length() - 1)
    spot = F.col(column).bitwiseAND(F.lit(bits - 1))
    rows = table.groupBy(F.shiftright(spot, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, CAST({column} & 63 AS INT))")).alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return words.view(np.uint64)


def passes(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter holds, and a few others."""
    spot = keys & np.uint64(64 * len(words) - 1)
    return (words[(spot >> np.uint64(6)).astype(np.int64)] >> (keys & np.uint64(63)) & np.uint64(1)).astype(bool)


def tried_of(size: int, tried: float) -> int:
    """How many of a set's smallest hashes are tried."""
    return size if tried == 1.0 else int(tried * size) + 1


def least_shared(size: int, tried: float) -> int:
    """How many of the tried hashes of a set that links occur among those tried of another.

    Of a set that links at most ``size / 5`` shingles occur nowhere else.  A prefix meets only
    prefixes, and what the other set has alone takes places there: one place more is lost by a
    set of 4 that is in a set of 5, and by no other.
    """
    alone = size // 5
    return tried_of(size, tried) - (alone if tried == 1.0 else max(alone, 1))


def _sharing(docs: DataFrame, first: np.ndarray, likely: np.ndarray | None, buckets: int,
             parts: int, width: int, tried: float) -> DataFrame:
    """Classes that share enough of their ``tried`` smallest hashes; with those, if all are tried."""
    def wanted(found: np.ndarray, key: int) -> np.ndarray:
        if likely is not None and not passes(likely, np.array([key], np.uint64))[0]:
            return found[:0]
        return found[:tried_of(len(found), tried)]

    def send(batches):
        seen, keys, sizes, sets, held = set(), [], [], [], 0

        def packed():
            hashes = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            # Sorted prefixes leave the upper bits uneven, so buckets go by the mixed hash.
            bucket = (T.mix(hashes) % np.uint64(buckets)).astype(np.int64)
            return _blocks(bucket, owner, np.array(keys, np.uint64), np.array(sizes), hashes)

        for batch in batches:
            chosen = passes(first, batch.column(0).to_numpy().view(np.uint64))
            for words in T.row_words(batch.column(1).filter(pa.array(chosen))):
                found = T.shingle_set(words, width)
                key = _key_of(found)
                part = wanted(found, key)
                if not len(part) or key in seen:
                    continue
                seen.add(key)
                keys.append(key)
                sizes.append(len(found))
                sets.append(part)
                held += len(part)
                if held >= FLUSH_SHINGLES:
                    yield packed()
                    keys, sizes, sets, held = [], [], [], 0
        if sets:
            yield packed()

    def match(batches):
        for keys, sizes, counts, hashes in _by_bucket(batches):
            classes, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
            owner = np.repeat(inverse, counts)
            order = np.argsort(hashes, kind="stable")
            hashes, owner = hashes[order], owner[order]
            cuts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            differs = np.minimum.reduceat(owner, cuts) != np.maximum.reduceat(owner, cuts)
            kept = np.repeat(differs, np.diff(cuts, append=len(hashes)))
            if not kept.any():
                continue
            hashes, owner = hashes[kept], owner[kept]
            order = np.argsort(owner, kind="stable")
            hashes, owner = hashes[order], owner[order]
            home = (T.mix(classes) % np.uint64(buckets)).astype(np.int64)
            yield _blocks(home[owner], owner, classes, sizes[at], hashes)

    def gather(batches):
        for keys, sizes, counts, hashes in _by_bucket(batches):
            classes, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
            owner = np.repeat(inverse, counts)
            order = np.argsort(owner, kind="stable")
            hashes = hashes[order]
            cuts = np.searchsorted(owner[order], np.arange(len(classes) + 1))
            rows = ([], [], [])
            for k in range(len(classes)):
                own = np.unique(hashes[cuts[k]:cuts[k + 1]])
                size = int(sizes[at[k]])
                if len(own) >= least_shared(size, tried):
                    rows[0].append(int(classes[k].view(np.int64)))
                    rows[1].append(size)
                    rows[2].append(_narrow(own) if tried == 1.0 else b"")
            yield pa.record_batch([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()),
                                   pa.array(rows[2], pa.binary())], names=["key", "n", "shared"])

    sent = docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), F.col("text").cast("string")).select(
        row_key().alias("row_key"), "text").mapInArrow(send, _BLOCK)
    matched = _exchange(sent, parts).mapInArrow(match, _BLOCK)
    return _exchange(matched, parts).mapInArrow(gather, "key long, n long, shared binary")


def band_starts(largest: int) -> np.ndarray:
    """Lower ends of the size bands; linked sizes are in the same band or in neighbours."""
    starts = [1]
    while starts[-1] <= largest:
        starts.append(max(starts[-1] + 1, starts[-1] * 5 // 4))
    return np.array(starts, dtype=np.int64)


def sketch_words(hashes: np.ndarray, words: int) -> np.ndarray:
    """Parity sketch: bit b of word w is the parity of the shingles hashed to it."""
    spot = T.mix(hashes)
    cell = (spot % np.uint64(words)).astype(np.int64) * 64
    cell += (spot >> np.uint64(58)).astype(np.int64)
    bits = np.bincount(cell, minlength=words * 64).astype(np.uint8) & 1
    return np.packbits(bits).view(np.uint64)


def signature_keys(hashes: np.ndarray, size: int, starts: np.ndarray) -> np.ndarray:
    """The pigeonhole keys of one set in its own band, and in the next one up if a linked set
    can be there."""
    band = int(np.searchsorted(starts, size, side="right")) - 1
    targets = [band] + ([band + 1] if 5 * size >= 4 * starts[band + 1] else [])
    found = []
    for target in targets:
        bound = 2 * (int(starts[target + 1]) - 1) // 9
        if not bound:  # only equal sets could link, and they are one class already
            continue
        groups = bound // (OMITTED + 1) + 1
        parts = sketch_words(hashes, groups * GROUP_WORDS).reshape(groups, GROUP_WORDS)
        mixed = T.mix(parts ^ T.ROLES[:GROUP_WORDS])
        total = mixed.sum(axis=1, dtype=np.uint64)
        place = (np.uint64(target) << np.uint64(40)) + np.arange(groups, dtype=np.uint64) * np.uint64(32)
        for number, omitted in enumerate(itertools.combinations(range(GROUP_WORDS), OMITTED)):
            kept = total - mixed[:, list(omitted)].sum(axis=1, dtype=np.uint64)
            found.append(T.mix(kept + T.mix(place + np.uint64(number))))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def signatures(sets: DataFrame, *carried: str, wanted: np.ndarray | None = None) -> DataFrame:
    """``(sig, key)`` of sets ``(key, n, shared)``, and the long columns ``carried``; only those
    that pass the filter ``wanted``, if there is one."""
    names = ["key", *carried]

    def keys(batches):
        starts = band_starts(8)
        for batch in batches:
            sigs, own, held = [], [], 0
            for size, packed, *of in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if starts[-2] <= size * 4:
                    starts = band_starts(size * 16)
                found = signature_keys(_widen(packed), size, starts)
                if wanted is not None:
                    found = found[passes(wanted, found)]
                sigs.append(found)
                own.append(np.tile(np.array(of, np.int64), (len(found), 1)))
                held += len(found)
                if held > 200_000:
                    yield rows(sigs, own)
                    sigs, own, held = [], [], 0
            if sigs:
                yield rows(sigs, own)

    def rows(sigs, own):
        columns = np.ascontiguousarray(np.concatenate(own).T)
        return pa.record_batch([pa.array(T.signed(np.concatenate(sigs))), *map(pa.array, columns)],
                               names=["sig", *names])

    return sets.select("n", "shared", *names).mapInArrow(
        keys, ", ".join(f"{name} long" for name in ("sig", *names)))


def meetings(sets: DataFrame, parts: int) -> DataFrame:
    """``(a, b, times, low, high)``: how many buckets have ``a`` as the first member and ``b`` as
    another, with the least and the greatest of their signatures."""
    def stars(batches):
        sig, leader = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            sigs, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            first = np.concatenate([[sigs[0] != sig], sigs[1:] != sigs[:-1]])
            place = np.maximum.accumulate(np.where(first, np.arange(len(sigs)), -1))
            lead = np.where(place >= 0, keys[np.maximum(place, 0)], leader or 0)
            sig, leader = sigs[-1], lead[-1]
            other = ~first & (keys != lead)
            yield pa.record_batch([pa.array(c[other]) for c in (lead, keys, sigs)],
                                  names=["a", "b", "sig"])

    placed = signatures(sets).repartition(parts, "sig").sortWithinPartitions("sig", "key")
    return placed.mapInArrow(stars, "a long, b long, sig long").groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("times"), F.min("sig").alias("low"), F.max("sig").alias("high"))


class Components:
    """Which components one task has found linked."""

    def __init__(self):
        self.root: dict[int, int] = {}

    def find(self, comp: int) -> int:
        root = self.root
        while (above := root.get(comp, comp)) != comp:
            root[comp] = comp = root.get(above, above)
        return comp

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.root[max(a, b)] = min(a, b)


def sketch_size(size: int) -> int:
    """Words of the sketch of a set: a power of two, with more bits than shingles, as a fuller
    sketch tells no two sets apart."""
    return max(SKETCH_WORDS, 1 << (size // 64).bit_length())


def folded(sketches: list[bytes], words: int) -> np.ndarray:
    """Longer sketches as those of ``words`` words."""
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, words), axis=0)
                     for s in sketches])


def sketched(sets: DataFrame) -> DataFrame:
    """``(key, n, alone, sketch)``: the sketch of the shared shingles, and how many are not."""
    def sketch(batches):
        for batch in batches:
            found = [_widen(p) for p in batch.column(2).to_pylist()]
            yield pa.record_batch(
                [batch.column(0), batch.column(1),
                 pa.array([n - len(f) for n, f in zip(batch.column(1).to_pylist(), found, strict=True)],
                          pa.int64()),
                 pa.array([sketch_words(f, sketch_size(n)).tobytes()
                           for n, f in zip(batch.column(1).to_pylist(), found, strict=True)], pa.binary())],
                names=["key", "n", "alone", "sketch"])

    return sets.select("key", "n", "shared").mapInArrow(
        sketch, "key long, n long, alone long, sketch binary")


def near_rows(left: list[tuple], right: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Which rows ``(comp, n, alone, sketch)`` of either side may link with one of the other
    side that is in another component.  Two sketches are compared at the shorter's length."""
    sides = []
    for rows in (left, right):
        comps, sizes, alone = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 2))
        sides.append((comps, sizes, alone, np.array([len(r[3]) // 8 for r in rows])))
    (comp_l, size_l, alone_l, words_l), (comp_r, size_r, alone_r, words_r) = sides
    near = np.zeros((len(left), len(right)), bool)
    for words in sorted({*words_l.tolist(), *words_r.tolist()}):
        at, others = np.flatnonzero(words_l >= words), np.flatnonzero(words_r >= words)
        if not (len(at) and len(others)):
            continue
        sketch_l, sketch_r = (folded([rows[k][3] for k in own.tolist()], words)
                              for rows, own in ((left, at), (right, others)))
        for j, sketch in zip(others.tolist(), sketch_r, strict=True):
            apart = np.bitwise_count(sketch_l ^ sketch).sum(axis=1, dtype=np.int64)
            least = np.maximum(apart + alone_l[at] + alone_r[j], np.abs(size_l[at] - size_r[j]))
            near[at, j] = (least <= (size_l[at] + size_r[j]) // 9) & (comp_l[at] != comp_r[j])
    return near.any(axis=1), near.any(axis=0)


def links_between(left: list[tuple], right: list[tuple]) -> list[tuple[int, int]]:
    """Pairs of components, of rows ``(comp, n, shared)``, that some link joins; enough of them
    to connect all that are connected."""
    found, known = [], Components()
    sides = []
    for rows in (left, right):
        sets = [_widen(packed) for _, _, packed in rows]
        sizes = np.array([n for _, n, _ in rows])
        sides.append((sets, np.stack([sketch_words(s, SKETCH_WORDS) for s in sets]), sizes,
                      sizes - np.array([len(s) for s in sets]), [c for c, _, _ in rows]))
    (sets_l, sketch_l, size_l, alone_l, comp_l), (sets_r, sketch_r, size_r, alone_r, comp_r) = sides
    for j in range(len(right)):
        apart = np.bitwise_count(sketch_l ^ sketch_r[j]).sum(axis=1, dtype=np.int64)
        near = np.flatnonzero(apart + alone_l + alone_r[j] <= (size_l + size_r[j]) // 9)
        for i in near[np.argsort(apart[near], kind="stable")].tolist():
            if known.find(comp_l[i]) == known.find(comp_r[j]):
                continue
            both = np.concatenate([sets_l[i], sets_r[j]])
            both.sort()
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            if 100 * common >= 80 * (int(size_l[i]) + int(size_r[j]) - common):
                found.append((comp_l[i], comp_r[j]))
                known.join(comp_l[i], comp_r[j])
    return found


def _both_sides(batches):
    """``(block, left rows, right rows)`` of every block; rows come sorted by block."""
    now, sides = None, ([], [])
    for batch in batches:
        for pair, l, r, side, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (pair, l, r) != now:
                if all(sides):
                    yield now, *sides
                now, sides = (pair, l, r), ([], [])
            sides[side].append(tuple(row))
    if all(sides):
        yield now, *sides


def block_links(left: DataFrame, right: DataFrame, sets: DataFrame, sketches: DataFrame,
                parts: int, scratch: Scratch) -> DataFrame:
    """``(src, dst)`` components that a link joins; ``left`` and ``right`` are
    ``(pair, key, comp)`` and rows of one ``pair`` are compared across.

    Every block of the left meets every block of the right, first by sketches; only rows that
    may link go on with their sets.
    """
    def sizes(rows, block, name):
        return rows.groupBy("pair").agg(F.ceil(F.count(F.lit(1)) / block).alias(name))

    counts = scratch.save(sizes(left, LEFT_BLOCK, "lefts").join(
        sizes(right, RIGHT_BLOCK, "rights"), "pair"))

    def spread(rows, side, own, other):
        block = F.pmod(F.xxhash64("key"), F.col(own)).alias("own")
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias("other")
        dealt = rows.join(counts, "pair").select("pair", block, every, "key", "comp")
        l, r = ("own", "other") if side == 0 else ("other", "own")
        return dealt.select("pair", F.col(l).alias("l"), F.col(r).alias("r"),
                            F.lit(side).alias("side"), "key", "comp")

    def dealt(rows, *columns):
        return rows.repartition(parts, "pair", "l", "r").sortWithinPartitions("pair", "l", "r").select(
            "pair", "l", "r", "side", "key", "comp", *columns)

    def near(batches):
        for (pair, l, r), *sides in _both_sides(batches):
            kept = near_rows(*[[row[1:] for row in rows] for rows in sides])
            found = [(pair, l, r, side, row[0], row[1]) for side in (0, 1)
                     for row, k in zip(sides[side], kept[side].tolist(), strict=True) if k]
            columns = list(zip(*found, strict=True)) if found else [()] * 6
            types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                  names=["pair", "l", "r", "side", "key", "comp"])

    def link(batches):
        for _, *sides in _both_sides(batches):
            found = links_between(*[[row[1:] for row in rows] for rows in sides])
            yield pa.record_batch([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)],
                                  names=["src", "dst"])

    rows = spread(left, 0, "lefts", "rights").unionAll(spread(right, 1, "rights", "lefts"))
    passed = scratch.save(dealt(rows.join(sketches, "key"), "n", "alone", "sketch").mapInArrow(
        near, "pair string, l long, r long, side int, key long, comp long"))
    return scratch.save(dealt(passed.join(sets, "key"), "n", "shared").mapInArrow(
        link, "src long, dst long").distinct())


def _merged(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels ``(key, cluster, comp)`` after the linked components became one."""
    roots = connected_components(links).toDF("comp", "root")
    return scratch.save(labels.join(roots, "comp", "left").select(
        "key", "cluster", F.coalesce("root", "comp").alias("comp")))


def mixed_buckets(sets: DataFrame, met: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """``(pair, key, cluster, low, high)``: members of the buckets, named ``pair``, that hold more
    than one cluster, with their smallest and largest cluster.

    The first member of such a bucket has met one of another cluster there, and it has met all
    others.  If the two met in one or two buckets, these are known; only members' signatures in
    the filter of known buckets are sent.
    """
    of = labels.select("key", "cluster")
    apart = scratch.save(met.where(F.col("times") < MEETINGS).join(of.toDF("a", "left"), "a").join(
        of.toDF("b", "right"), "b").where("left <> right").select("a", "times", "low", "high"))
    known = None
    if MEETINGS <= 3:
        names, seen = scratch.save_observed(
            apart.select(F.explode(F.array("low", "high")).alias("sig")).distinct(),
            many=F.count(F.lit(1)))
        known = key_filter(names, "sig", int(seen["many"]))
    around = met.join(apart.select("a").distinct(), "a", "left_semi")
    keys = around.select(F.col("a").alias("key")).unionAll(around.select("b")).distinct()
    # Few signatures pass the filter, so they meet their clusters, not the sets.
    found = scratch.save(signatures(sets, wanted=known).join(keys.join(of, "key"), "key"))
    several = found.groupBy("sig").agg(
        F.min("cluster").alias("low"), F.max("cluster").alias("high")).where("low < high")
    return found.join(several, "sig").select(
        F.col("sig").cast("string").alias("pair"), "key", "cluster", "low", "high")


def linked_components(sets: DataFrame, parts: int, scratch: Scratch) -> DataFrame:
    """``(key, comp)`` for all ``sets``; linked ones share ``comp``."""
    met = scratch.save(meetings(sets, parts))
    sketches = scratch.save(sketched(sets))
    often = connected_components(
        met.where(F.col("times") >= MEETINGS).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    labels = scratch.save(sets.select("key").join(often.toDF("key", "root"), "key", "left").select(
        "key", F.coalesce("root", "key").alias("cluster"), F.col("key").alias("comp")))

    spot = F.xxhash64("key", F.lit(LEADERS))
    nth = F.pmod(spot, F.lit(LEADERS))
    leaders = labels.groupBy("cluster", nth.alias("nth")).agg(
        F.min_by("key", spot).alias("key")).select("cluster", "key")
    several = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    leaders = scratch.save(leaders.join(several.select("cluster"), "cluster"))
    rows = labels.join(several.select("cluster"), "cluster").select(
        F.col("cluster").cast("string").alias("pair"), "key", "comp")
    first = rows.join(leaders.select("key"), "key", "left_semi").select("pair", "key", "comp")
    labels = _merged(labels, block_links(first, rows, sets, sketches, parts, scratch), scratch)

    # What is outside the largest component of its cluster, against the whole cluster.
    held = labels.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("many"))
    largest = held.groupBy("cluster").agg(
        F.max_by("comp", F.col("many")).alias("main"), F.count(F.lit(1)).alias("comps"))
    split = scratch.save(largest.where("comps > 1").select("cluster", "main"))
    inside = labels.join(split, "cluster").select(
        F.col("cluster").cast("string").alias("pair"), "key", "comp",
        (F.col("comp") != F.col("main")).alias("minor"))
    columns = ["pair", "key", "comp"]
    labels = _merged(labels, block_links(
        inside.where("minor").select(*columns), inside.select(*columns), sets, sketches, parts,
        scratch), scratch)

    # Members of different clusters that share a bucket.
    mixed = scratch.save(mixed_buckets(sets, met, labels, scratch))
    rows = mixed.join(labels.select("key", "comp"), "key")
    links = block_links(rows.where("cluster < high").select(*columns),
                        rows.where("cluster > low").select(*columns), sets, sketches, parts, scratch)
    return _merged(labels, links, scratch).select("key", "comp")


def jaccard_components(docs: DataFrame, width: int = 5) -> DataFrame:
    """``(doc_id, n_shingles, component_id, text_key, group_key)``, one row per row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reachable by links; ``group_key`` is shared by
    linked texts and by no others.  Null or empty texts have no shingle and link with nothing.
    Rows that repeat a ``doc_id`` are texts of their own; a null ``doc_id`` takes part but names
    no component, unless all its members are null.  Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    sets, seen = scratch.save_observed(
        shingle_classes(docs, width), shingles=F.coalesce(F.sum("n_shingles"), F.lit(0)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, -(-int(seen["shingles"]) // BUCKET_SHINGLES))
    candidates = shared_sets(docs, first_rows(sets, scratch), buckets, parts, scratch, width)
    labels = linked_components(candidates, parts, scratch)
    classes = sets.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("first"))
    named = scratch.save(classes.join(labels.toDF("set_key", "comp"), "set_key", "left").select(
        "set_key", "first", F.coalesce("comp", "set_key").alias("group_key")))
    roots = named.groupBy("group_key").agg(F.min("first").alias("component_id"))
    whole = scratch.save(named.join(roots, "group_key").select(
        "set_key", "group_key", "component_id"))
    return sets.join(whole, "set_key", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
        .alias("component_id"), "text_key", "group_key")
