"""Minimax contiguous partition of texts into shards, in DataFrame functions only.

Atoms are hash cells of whole groups of equal texts, so equal texts never part.  Their
number is fixed, whatever the input, and their sizes fit one row.  An atom that is larger
than an even share of what is left gets a shard of its own.  Over the others, in order of
cell, the smallest shard capacity that suffices is found by binary search; a greedy pass
checks a capacity.  At the smallest one the greedy passes from both ends bound the cuts.
Only the cells' sizes, at most 16,384 numbers, reach the driver.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citegraph.scratch import Scratch

#: Atoms.  A shard differs from the ideal by about one atom, so by 16 / 16384 of its size
#: where texts are many, and by the largest group of equal texts otherwise.
CELLS = 1 << 14
#: Parts into which every cell is split for numbering; a cell may hold a third of all rows.
SALTS = 32


def heavy_cells(cells: list[tuple[int, int]], shards: int) -> list[int]:
    """Cells, largest first, that exceed an even share of what is left."""
    found, total = [], sum(size for _, size in cells)
    for cell, size in sorted(cells, key=lambda c: (-c[1], c[0])):
        left = shards - len(found)
        if left < 2 or size * left <= total:
            break
        found.append(cell)
        total -= size
    return found


def greedy_ends(sizes: list[int], capacity: int) -> list[int]:
    """How many atoms end each shard's prefix, each shard as full as ``capacity`` allows."""
    ends, held = [], 0
    for place, size in enumerate(sizes):
        if held + size > capacity:
            ends.append(place)
            held = 0
        held += size
    return ends


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """Binary search for the least capacity at which the greedy pass needs ``shards`` at most."""
    if not sizes:
        return 0
    low = max(max(sizes), -(-sum(sizes) // shards))
    high = low + max(sizes)
    while low < high:
        middle = (low + high) // 2
        if len(greedy_ends(sizes, middle)) < shards:
            high = middle
        else:
            low = middle + 1
    return low


def minimax_cuts(sizes: list[int], shards: int) -> list[int]:
    """Places of the ``shards - 1`` cuts, ascending; no shard exceeds the smallest capacity.

    The greedy passes from both ends bound every cut; within the bounds a cut goes where the
    prefix is nearest to its even share.
    """
    capacity = smallest_capacity(sizes, shards)
    count = len(sizes)
    latest = (greedy_ends(sizes, capacity) + [count] * shards)[:shards - 1]
    backward = [count - e for e in greedy_ends(sizes[::-1], capacity)]
    earliest = ([0] * shards + backward[::-1])[-(shards - 1):] if shards > 1 else []
    before = [0]
    for size in sizes:
        before.append(before[-1] + size)
    cuts, last = [], 0
    for number, (low, high) in enumerate(zip(earliest, latest, strict=True), 1):
        share = before[-1] * number // shards
        reach = bisect.bisect_right(before, before[last] + capacity) - 1
        low, high = max(low, last), min(max(high, last), reach)
        near = bisect.bisect_left(before, share)
        if near > 0 and share - before[near - 1] < before[min(near, count)] - share:
            near -= 1
        last = min(max(near, low), high)
        cuts.append(last)
    return cuts


def sharded(docs: DataFrame, shards: int = 16, cells: int = CELLS) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``, one row per row of ``docs``.

    ``size`` is the UTF-8 bytes of the text plus 1; a null text counts as empty and is equal to
    it.  Law ``bytes``: the largest shard is as small as whole cells allow.  ``slot`` numbers
    the rows of a shard from 0 without gaps, by cell.  Rows that repeat a ``doc_id`` or lack
    one are rows like others.  No row gives no row; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = scratch.save(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(cells)).cast("int").alias("cell"),
        F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SALTS)).cast("int").alias("salt")))
    parts = scratch.save(rows.groupBy("cell", "salt").agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")))
    # One number per cell, at most ``cells`` of them, whatever the input.
    sizes = sorted((r["cell"], r["bytes"]) for r in parts.groupBy("cell").agg(
        F.sum("bytes").alias("bytes")).collect())
    alone = heavy_cells(sizes, shards)
    others = [(cell, size) for cell, size in sizes if cell not in set(alone)]
    shard = F.lit(len(alone))
    for cut in minimax_cuts([size for _, size in others], shards - len(alone)):
        if cut < len(others):
            shard = shard + F.when(F.col("cell") >= others[cut][0], 1).otherwise(0)
    for number, cell in enumerate(alone):
        shard = F.when(F.col("cell") == cell, number).otherwise(shard)
    # At most cells x salts rows, whatever the input.
    before = Window.partitionBy("shard").orderBy("cell", "salt").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = scratch.save(parts.withColumn("shard", shard.cast("int")).select(
        "cell", "salt", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before")))
    within = Window.partitionBy("cell", "salt").orderBy("doc_id", "size", "text_crc32")
    return rows.withColumn("place", F.row_number().over(within)).join(
        offsets, ["cell", "salt"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("place") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
