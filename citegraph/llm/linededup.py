"""Line dedup: repeated runs of lines, from suffixes ranked by distributed prefix doubling.

The lines with a word are the letters of one long sequence, document after document by
(doc_id, text hash).  Suffixes are grouped by their first 2**k letters, k doubling in turn:
suffixes that agree in 2**(k+1) letters agree in 2**k, and so do those 2**k letters further on.
Each group is an interval of the suffix array whose longest common prefix has that many
letters, and is named by its first suffix in the text; suffixes alone in their group leave.

A run of ``m`` letters equals an earlier one if the suffixes at its start and at its end less
2**k, 2**k <= m < 2**(k+1), are in the same groups as those of the earlier run.  Every stretch of
lines that repeats and has at least ``MIN_WORDS`` words is covered by the shortest runs of that
many words that begin, or end, at its lines; those are all looked up, which takes at most
log2(MIN_WORDS) + 1 rounds.  Where a run has an earlier copy its lines are deleted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.llm import textual as T
from citegraph.scratch import Scratch, number_rows

MIN_WORDS = 50
#: Bits of a place that number the lines of a document; the bits above number documents.
LINE_BITS = 27


def _text_key():
    return F.xxhash64(F.col("text").cast("string"))


def lettered(docs: DataFrame, min_words: int) -> DataFrame:
    """``(doc_id, text_key, line, letter, ahead, behind)`` of every line with a word.

    ``line`` counts those lines; ``ahead`` and ``behind`` are how many lines the shortest run of
    ``min_words`` words has that begins, or ends, there; 0 if the text has too few.
    """
    def lines(batches):
        for batch in batches:
            found = [[], [], [], [], [], []]
            for doc_id, key, (hashes, words) in zip(
                    batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                    T.row_lines(batch.column(2)), strict=True):
                own = words > 0
                hashes, words = hashes[own], words[own]
                count = len(words)
                if not count:
                    continue
                if count >> LINE_BITS:
                    raise ValueError(f"a text has {count} lines")
                before = np.concatenate([[0], np.cumsum(words)])
                place = np.arange(count)
                end = np.searchsorted(before, before[:-1] + min_words)
                start = np.searchsorted(before, before[1:] - min_words, side="right") - 1
                for column, values in zip(found, (
                        np.full(count, -1 if doc_id is None else doc_id), np.full(count, key), place,
                        hashes.view(np.int64), np.where(end <= count, end - place, 0),
                        np.where(start >= 0, place + 1 - start, 0)), strict=True):
                    column.append(values.astype(np.int64))
                if doc_id is None:
                    found[0][-1] = None
            columns = [pa.array([], pa.int64()) if not c else pa.concat_arrays(
                [pa.nulls(len(found[1][k]), pa.int64()) if v is None else pa.array(v)
                 for k, v in enumerate(c)]) for c in found]
            yield pa.record_batch(columns, names=["doc_id", "text_key", "line", "letter", "ahead",
                                                  "behind"])

    return docs.select(F.col("doc_id").cast("long"), _text_key().alias("text_key"),
                       F.col("text").cast("string")).mapInArrow(
        lines, "doc_id long, text_key long, line long, letter long, ahead long, behind long")


def placed(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """Lines that occur twice or more, with ``place``: document number and line in one number."""
    repeated = lines.groupBy("letter").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    active = scratch.save(lines.join(scratch.save(repeated.select("letter")), "letter", "left_semi"))
    owners = scratch.save(active.select("doc_id", "text_key").distinct())
    numbered = number_rows(owners, [F.col("doc_id").asc_nulls_last(), F.col("text_key")], "number")
    numbers = scratch.save(numbered)
    same = (F.col("l.doc_id").eqNullSafe(F.col("r.doc_id"))
            & (F.col("l.text_key") == F.col("r.text_key")))
    place = F.shiftleft(F.col("r.number"), LINE_BITS) + F.col("l.line")
    return active.alias("l").join(numbers.alias("r"), same).select(
        place.alias("place"), "l.letter", "l.ahead", "l.behind", "l.doc_id", "l.text_key"
    ).dropDuplicates(["place"])


def _grouped(pairs: DataFrame, by: list[str], scratch: Scratch) -> DataFrame:
    """``(place, name)``: groups of two or more, named by their first place."""
    firsts = scratch.save(pairs.groupBy(*by).agg(
        F.min("place").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    return scratch.save(pairs.join(firsts, by).select("place", F.col("leader").alias("name")))


def _further(groups: DataFrame, step) -> DataFrame:
    """The groups of the suffixes ``step`` lines on, under the place they are seen from."""
    return groups.select((F.col("place") - step).alias("place"), F.col("name").alias("then"))


def repeated_runs(lines: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """``(start, length, first)``: shortest runs of ``min_words`` words with an earlier copy."""
    ahead = lines.where("ahead > 0").select("place", F.col("ahead").alias("length"))
    behind = lines.where("behind > 0").select(
        (F.col("place") - F.col("behind") + 1).alias("place"), F.col("behind").alias("length"))
    runs = scratch.save(ahead.unionAll(behind).distinct())
    groups = _grouped(lines.select("place", "letter"), ["letter"], scratch)
    found, depth = None, 1
    while True:
        # Runs of depth .. 2 * depth - 1 lines: the suffix groups at both of their ends tell.
        own = runs.where((F.col("length") >= depth) & (F.col("length") < 2 * depth))
        ends = own.join(groups, "place").select(
            (F.col("place") + F.col("length") - depth).alias("end"), "place", "length", "name")
        both = ends.join(groups.select(F.col("place").alias("end"), F.col("name").alias("then")), "end")
        keys = ["length", "name", "then"]
        firsts = scratch.save(both.groupBy(*keys).agg(
            F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
        copies = both.join(firsts, keys).where("place > first").select(
            F.col("place").alias("start"), "length", "first")
        part = scratch.save(copies)
        found = part if found is None else found.unionAll(part)
        if 2 * depth > min_words:
            return found
        doubled = groups.join(_further(groups, depth), "place")
        groups = _grouped(doubled, ["name", "then"], scratch)
        depth *= 2


def deletions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, text_key, runs)``: the runs ``(start, length)`` of lines with a word to delete."""
    scratch = Scratch(docs.sparkSession, "linededup")
    lines = scratch.save(placed(scratch.save(lettered(docs, min_words)), scratch))
    runs = repeated_runs(lines, min_words, scratch)
    mask = (1 << LINE_BITS) - 1
    owners = lines.select(F.shiftright("place", LINE_BITS).alias("number"), "doc_id",
                          "text_key").distinct()
    # A document's own runs, at most two for each of its lines.
    by_number = runs.groupBy(F.shiftright("start", LINE_BITS).alias("number")).agg(
        F.collect_list(F.struct(F.col("start").bitwiseAND(mask).cast("int").alias("start"),
                                F.col("length").cast("int").alias("length"))).alias("runs"))
    return scratch.save(by_number.join(owners, "number").select("doc_id", "text_key", "runs"))


def cut_lines(text: str, runs) -> tuple[str, int, int]:
    """The text without the lines of ``runs``, its lines and how many went; a line without word
    goes with the line before it."""
    lines = text.split("\n")
    words = np.array([bool(line.strip(" \t\n\v\f\r")) for line in lines])
    change = np.zeros(int(words.sum()) + 1, np.int64)
    for run in runs:
        change[run["start"]] += 1
        change[run["start"] + run["length"]] -= 1
    gone = np.cumsum(change)[:-1] > 0
    number = np.cumsum(words) - 1
    deleted = np.where(number >= 0, gone[np.maximum(number, 0)], False)
    return ("\n".join(line for line, d in zip(lines, deleted, strict=True) if not d), len(lines),
            int(deleted.sum()))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, ``text`` cut, and ``n_lines`` and ``n_deleted``.

    Lines are equal if their bytes are.  The copy in the document with the smallest
    (doc_id, text hash) stays, and within a document the first; ids sort before null.  Null and
    empty texts stay as they are, with no line.  Rows that repeat both id and text are one
    document and are cut alike; rows that repeat only the id are documents of their own.
    Columns of ``docs`` called like the two new ones are replaced.
    """
    cuts = deletions(docs, min_words)
    columns = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    # In a struct the columns of ``docs`` cannot clash with the keys of the join.
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"),
                       _text_key().alias("key"), F.col("doc_id").cast("long").alias("id")).alias("l")
    # A sorted join at every size: the cuts grow with the texts.
    joined = left.join(cuts.hint("merge").alias("r"), (F.col("l.id").eqNullSafe(F.col("r.doc_id")))
                       & (F.col("l.key") == F.col("r.text_key")), "left")
    at = columns.index("text")
    schema = docs.select(*[f"`{c}`" for c in columns]).schema.add("n_lines", "long").add("n_deleted", "long")

    def cut(batches):
        for batch in batches:
            texts, counts, deleted = [], [], []
            for text, runs in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist(),
                                  strict=True):
                if runs:
                    text, lines, gone = cut_lines(text, runs)
                else:
                    lines, gone = (text.count("\n") + 1 if text else 0), 0
                texts.append(text)
                counts.append(lines)
                deleted.append(gone)
            kept = [pa.array(texts, batch.schema.field(at).type) if k == at else batch.column(k)
                    for k in range(len(columns))]
            yield pa.record_batch([*kept, pa.array(counts, pa.int64()), pa.array(deleted, pa.int64())],
                                  names=[*columns, "n_lines", "n_deleted"])

    return joined.select("l.row.*", "r.runs").mapInArrow(cut, schema)
