"""Vector codes by product quantization, with distances shared along a trie.

Vectors are made whole numbers and cut into equal parts; each part position has a codebook of
entries, refined in rounds of assigning parts and moving entries to their parts' means.

The distinct parts of a position, in lexicographic order, are the leaves of a trie whose levels
are the part's dimensions.  Spark deals them out by range and sorts them, so a task holds
neighbouring subtrees, and equal parts are one leaf with a weight, however many vectors hold
them.  A task walks its leaves depth first, a run at a time: a node's vector of distances to all
entries is its parent's plus one dimension, computed once for all leaves below it.  The leaves
take the nearest entry and add their weight to its sums.  Only sums per entry reach the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.scratch import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components beyond this are set to it, so that squared distances are exact in 64 bits.
LIMIT = 1 << 26
#: Leaves walked together.
RUN = 4096


def whole_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``(vec_id, label, n, packed)`` of vectors without null or non-finite components."""
    label = vectors.schema["label"].dataType.simpleString()
    out = f"vec_id long, label {label}, n int, packed binary"

    def pack(batches):
        for batch in batches:
            held = batch.column(2)
            sizes = held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = held.flatten()
            empty = flat.is_null().to_numpy(zero_copy_only=False)
            values = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            bad = np.cumsum(np.concatenate([[0], empty | ~np.isfinite(values)]))
            good = (bad[ends] == bad[ends - sizes]) & held.is_valid().to_numpy(zero_copy_only=False)
            with np.errstate(invalid="ignore"):
                whole = np.clip(np.floor(SCALE * values), -LIMIT, LIMIT)
            whole = np.where(np.isfinite(whole), whole, 0).astype("<i4").tobytes()
            pick = np.flatnonzero(good)
            packed = [whole[4 * (ends[k] - sizes[k]):4 * ends[k]] for k in pick]
            at = pa.array(pick)
            yield pa.record_batch(
                [batch.column(0).take(at), batch.column(1).take(at),
                 pa.array(sizes[pick].astype(np.int32)), pa.array(packed, pa.binary())],
                names=["vec_id", "label", "n", "packed"])

    return vectors.select(F.col("vec_id").cast("long"), "label",
                          F.col(column).cast("array<double>")).mapInArrow(pack, out)


def matrix(packed: list[bytes], width: int) -> np.ndarray:
    """Rows of ``width`` components; shorter vectors end in zeros."""
    if all(len(p) == 4 * width for p in packed):
        return np.frombuffer(b"".join(packed), "<i4").reshape(len(packed), width)
    return np.frombuffer(b"".join(p.ljust(4 * width, b"\0") for p in packed), "<i4").reshape(
        len(packed), width)


def _sortable(parts: np.ndarray) -> np.ndarray:
    """One byte string per part; their order is that of the components."""
    raised = (parts.astype(np.int64) + (1 << 31)).astype(">u4")
    return np.ascontiguousarray(raised).view(f"S{4 * parts.shape[1]}").reshape(-1)


def _components(strings: list[bytes], size: int) -> np.ndarray:
    flat = np.frombuffer(b"".join(strings), ">u4").astype(np.int64) - (1 << 31)
    return flat.reshape(len(strings), size)


def distinct_parts(kept: DataFrame, width: int) -> DataFrame:
    """``(pos, part, weight)`` by position and part: the leaves of the tries in order."""
    size = width // PARTS

    def cut(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = matrix(batch.column(0).to_pylist(), width)
            pos, strings, weights = [], [], []
            for p in range(PARTS):
                found, many = np.unique(_sortable(rows[:, p * size:(p + 1) * size]), return_counts=True)
                pos.append(np.full(len(found), p, np.int32))
                # numpy drops trailing zero bytes of a string.
                strings += [s.ljust(4 * size, b"\0") for s in found.tolist()]
                weights.append(many)
            yield pa.record_batch(
                [pa.array(np.concatenate(pos)), pa.array(strings, pa.binary()),
                 pa.array(np.concatenate(weights))], names=["pos", "part", "weight"])

    dealt = kept.select("packed").mapInArrow(cut, "pos int, part binary, weight long")
    return dealt.repartitionByRange("pos", "part").groupBy("pos", "part").agg(
        F.sum("weight").alias("weight")).sortWithinPartitions("pos", "part")


def nearest_entries(leaves: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry, the first of equals, and squared distance of leaves in trie order.

    Equal neighbours are allowed; what they share is computed once as well.
    """
    entry = np.empty(len(leaves), np.int64)
    distance = np.empty(len(leaves), np.int64)
    for lo in range(0, len(leaves), RUN):
        run = leaves[lo:lo + RUN]
        # Whether a leaf is the first below its node of each level.
        opens = np.ones(run.shape, bool)
        opens[1:] = np.logical_or.accumulate(run[1:] != run[:-1], axis=1)
        node = np.zeros(len(run), np.int64)
        sums = np.zeros((1, len(book)), np.int64)
        for level in range(run.shape[1]):
            first = np.flatnonzero(opens[:, level])
            apart = run[first, level, None] - book[None, :, level]
            sums = sums[node[first]] + apart * apart
            node = np.cumsum(opens[:, level]) - 1
        best = sums.argmin(axis=1)
        entry[lo:lo + RUN] = best[node]
        distance[lo:lo + RUN] = sums[np.arange(len(sums)), best][node]
    return entry, distance


def moved(leaves: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks ``[position, entry, component]`` after one round over the ``leaves``."""
    positions, entries, size = books.shape
    cells = positions * entries

    def walk(batches):
        sums = np.zeros((cells, size), np.int64)
        many = np.zeros(cells, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            pos = batch.column(0).to_numpy(zero_copy_only=False)
            rows = _components(batch.column(1).to_pylist(), size)
            weight = batch.column(2).to_numpy(zero_copy_only=False)
            for p in np.unique(pos):
                here = pos == p
                own, own_weight = rows[here], weight[here]
                cell = nearest_entries(own, books[p])[0] + p * entries
                np.add.at(many, cell, own_weight)
                np.add.at(sums, cell, own * own_weight[:, None])
        used = np.flatnonzero(many)
        yield pa.record_batch(
            [pa.array(np.repeat(used, size + 1)), pa.array(np.tile(np.arange(size + 1), len(used))),
             pa.array(np.concatenate([many[used, None], sums[used]], axis=1).reshape(-1))],
            names=["cell", "place", "total"])

    rows = leaves.select("pos", "part", "weight").mapInArrow(
        walk, "cell long, place long, total long")
    after = books.reshape(cells, size).copy()
    totals = np.zeros((cells, size + 1), np.int64)
    # At most a number per entry and component, whatever the input.
    for row in rows.groupBy("cell", "place").agg(F.sum("total").alias("total")).collect():
        totals[row["cell"], row["place"]] = row["total"]
    used = totals[:, 0] > 0
    after[used] = totals[used, 1:] // totals[used, :1]
    return after.reshape(books.shape)


def coded(kept: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """``(vec_id, label, code, error)`` of all vectors; a task's tries are those of its batches."""
    size = width // PARTS
    label = kept.schema["label"].dataType.simpleString()

    def walk(batches):
        for batch in batches:
            rows = matrix(batch.column(2).to_pylist(), width)
            code = np.zeros((len(rows), PARTS), np.int64)
            error = np.zeros(len(rows), np.int64)
            for p in range(PARTS if len(rows) else 0):
                part = rows[:, p * size:(p + 1) * size]
                _, first, leaf = np.unique(_sortable(part), return_index=True, return_inverse=True)
                entry, distance = nearest_entries(part[first].astype(np.int64), books[p])
                code[:, p] = entry[leaf]
                error += distance[leaf]
            yield pa.record_batch(
                [batch.column(0), batch.column(1),
                 pa.array(["".join(f"{e:02x}" for e in c) for c in code.tolist()], pa.string()),
                 pa.array(error)], names=["vec_id", "label", "code", "error"])

    return kept.select("vec_id", "label", "packed").mapInArrow(
        walk, f"vec_id long, label {label}, code string, error long")


def codebooks(vectors: DataFrame, kept: DataFrame, width: int, scratch: Scratch) -> np.ndarray:
    """``[position, entry, component]`` after all rounds."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "packed").limit(ENTRIES).collect()
    start = matrix([bytes(r["packed"]) for r in first], width).astype(np.int64)
    books = start.reshape(len(first), PARTS, width // PARTS).transpose(1, 0, 2).copy()
    leaves = scratch.save(distinct_parts(kept, width))
    for _ in range(ROUNDS):
        books = moved(leaves, books)
    scratch.drop(leaves)
    return books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)``, one row per vector that is kept.

    A vector that is null or holds a null or non-finite component is dropped.  Vectors shorter
    than the longest one, or of a length that the parts do not divide, end in zeros; components
    beyond ``LIMIT`` count as that.  Rows that repeat a ``vec_id`` are vectors of their own; of
    equal ids the lexicographically smallest vectors come first into the codebooks, null ids come
    last.  Fewer vectors than entries make shorter codebooks.  Null labels count as one label.
    Other columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession, "vectorcode")
    kept, seen = scratch.save_observed(
        whole_vectors(vectors, column), longest=F.max("n"), many=F.count(F.lit(1)))
    width = max(PARTS, -(-int(seen["longest"] or 0) // PARTS) * PARTS)
    if seen["many"]:
        books = codebooks(vectors, kept, width, scratch)
    else:
        books = np.zeros((PARTS, 1, width // PARTS), np.int64)
    table = scratch.save(coded(kept, books, width))
    sums = table.groupBy("label").agg(F.sum("error").alias("label_error")).alias("s")
    return table.alias("t").join(sums, F.col("t.label").eqNullSafe(F.col("s.label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
