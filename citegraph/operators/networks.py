"""Paper networks as edge tables ``(src, dst, weight, type)``.

An undirected pair is stored once with ``dst > src``.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from citegraph.scratch import Scratch

# Workers may lack this library: what its tasks call travels with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 4096
UNDIRECTED = "undirected"


def pairs_sharing(rows: DataFrame, key: str, member: str, carry: str | None = None,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Unordered pairs of members that share a key: ``(src, dst[, src_x, dst_x])``.

    A key with more than ``block_rows`` members is split into blocks of that
    size and the pairs are formed block against block, so no task ever holds a
    whole hub.  Every pair comes out exactly once per shared key.  ``rows`` must
    hold each (key, member) once.
    """
    kept = [key, member] + ([carry] if carry else [])
    rows = rows.select(*kept)
    hubs = (
        rows.groupBy(key).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > block_rows)
    )
    blocks = F.coalesce(F.ceil(F.col("_size") / block_rows), F.lit(1)).cast("int")
    placed = (
        rows.join(hubs, key, "left")
        .withColumn("_blocks", blocks)
        .withColumn("_block", F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int"))
    )
    low = placed.select(
        F.col(key).alias("_key"),
        F.col(member).alias("_a"),
        *([F.col(carry).alias("_ax")] if carry else []),
        F.col("_block").alias("_i"),
        F.explode(F.sequence(F.col("_block"), F.col("_blocks") - 1)).alias("_j"),
    ).alias("low")
    high = placed.select(
        F.col(key).alias("_key"),
        F.col(member).alias("_b"),
        *([F.col(carry).alias("_bx")] if carry else []),
        F.explode(F.sequence(F.lit(0), F.col("_block"))).alias("_i"),
        F.col("_block").alias("_j"),
    ).alias("high")
    met = low.join(
        high,
        (F.col("low._key") == F.col("high._key"))
        & (F.col("low._i") == F.col("high._i"))
        & (F.col("low._j") == F.col("high._j"))
        & ((F.col("low._i") < F.col("low._j")) | (F.col("_b") > F.col("_a"))),
    )
    ends = [F.least("_a", "_b").alias("src"), F.greatest("_a", "_b").alias("dst")]
    if carry is None:
        return met.select(*ends)
    ordered = F.col("_a") < F.col("_b")
    return met.select(
        *ends,
        F.when(ordered, F.col("_ax")).otherwise(F.col("_bx")).alias("src_x"),
        F.when(ordered, F.col("_bx")).otherwise(F.col("_ax")).alias("dst_x"),
    )


def _links(citations: DataFrame) -> DataFrame:
    return citations.select("citing_ut", "cited_ut").distinct()


#: Keys of a hub's size whose pairs one task counts together.
TILE_KEYS = 64


#: Pairs, not summed yet, that one task takes.
TASK_PAIRS = 1 << 20

#: Keys beyond which the pairs of a member are spread over tasks.
HEAVY_KEYS = 100_000


def _later_members(small: DataFrame, key: str, member: str) -> DataFrame:
    """``(src, later)``: a row per key and member with the members after it, where there are any."""
    listed = small.groupBy(key).agg(F.sort_array(F.collect_list(member)).alias("_all"))
    at = listed.where(F.size("_all") > 1).select("_all", F.posexplode("_all").alias("_at", "src"))
    later = F.slice("_all", F.col("_at") + 2, F.size("_all"))
    return at.where(F.col("_at") + 1 < F.size("_all")).select("src", later.alias("later"))


def _summed(listed: DataFrame) -> DataFrame:
    """``(src, dst, weight)`` of listed members."""
    pairs = listed.select("src", F.explode("later").alias("dst"))
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def _hub_pairs(hubs: DataFrame, key: str, member: str, block_rows: int) -> DataFrame:
    """``(src, dst, weight)`` of keys with ``_size`` members, more than ``block_rows``.

    Keys of like size share a square grid over their members, so fine that no cell's
    side holds much more than ``block_rows`` members of a key.  The members go to the cells of their row
    and column; a cell forms its pairs of up to ``TILE_KEYS`` keys and counts them,
    so what is shuffled is members times the side of the grid, not pairs.
    """
    power = F.ceil(F.log2(F.col("_size") / block_rows)).cast("int")
    sized = hubs.select(F.col(key).alias("_key"), F.col(member).alias("_m"), power.alias("_power"))
    keys = sized.select("_power", "_key").distinct().groupBy("_power").agg(
        F.ceil(F.count(F.lit(1)) / TILE_KEYS).alias("_parts"))
    side = F.pow(F.lit(2), F.col("_power")).cast("int")
    # One row per power of two, so a few dozen at most.
    placed = sized.join(F.broadcast(keys), "_power").select(
        "_key", "_m", "_power", F.pmod(F.xxhash64("_key"), F.col("_parts")).alias("_part"),
        F.pmod(F.xxhash64("_m"), side).cast("int").alias("_block"),
        F.explode(F.sequence(F.lit(0), side - 1)).alias("_other"))
    cell = ["_power", "_part", "_i", "_j"]
    sent = placed.select(
        "_key", "_m", "_power", "_part", F.least("_block", "_other").alias("_i"),
        F.greatest("_block", "_other").alias("_j"), (F.col("_block") <= F.col("_other")).alias("_low"),
    ).repartition(*cell)
    # Grouped by the cell and more, so nothing below is shuffled again.
    met = sent.groupBy(*cell, "_key").agg(
        F.collect_list(F.when(F.col("_low"), F.col("_m"))).alias("_a"),
        F.collect_list(F.when(~F.col("_low"), F.col("_m"))).alias("_b"))
    pairs = (
        met.select(*cell, F.explode("_a").alias("_x"),
                   F.when(F.col("_i") == F.col("_j"), F.col("_a")).otherwise(F.col("_b")).alias("_b"))
        .select(*cell, "_x", F.explode("_b").alias("_y"))
        .where((F.col("_i") < F.col("_j")) | (F.col("_x") < F.col("_y")))
    )
    return pairs.groupBy(*cell, F.least("_x", "_y").alias("src"), F.greatest("_x", "_y").alias("dst")).agg(
        F.count(F.lit(1)).alias("weight")).select("src", "dst", "weight")


def _count_pairs(rows: DataFrame, key: str, member: str, block_rows: int,
                 task_pairs: int = TASK_PAIRS, heavy_keys: int = HEAVY_KEYS) -> DataFrame:
    """Pairs of members with the number of keys they share, as ``A x A'`` of a sparse ``A``.

    The members of a key come together in one row, and each goes with the list of those
    after it to the task that sums its pairs, so a pair travels as one list entry.  There
    are as many tasks as the pairs need.  Members of very many keys, and networks with
    more pairs than could be different, are summed before they travel.  Hubs go through
    the cells of a grid.  A missing key or member is in no pair.
    """
    rows = Scratch(rows.sparkSession, "members").save(
        rows.select(key, member).where(F.col(key).isNotNull() & F.col(member).isNotNull()))
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_size"))
    degrees = rows.groupBy(member).agg(F.count(F.lit(1)).alias("_keys"))
    inner = F.when(F.col("_size") <= block_rows, F.col("_size") * (F.col("_size") - 1) / 2)
    seen = sizes.agg(F.coalesce(F.sum(inner), F.lit(0.0)).alias("pairs"),
                     F.count_if(F.col("_size") > block_rows).alias("hubs")).crossJoin(
        degrees.agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("_keys") > heavy_keys).alias("heavy"))).first()
    hub_sizes = sizes.where(F.col("_size") > block_rows)
    listed = _later_members(rows.join(hub_sizes, key, "left_anti") if seen["hubs"] else rows, key, member)
    if seen["pairs"] > seen["members"] * (seen["members"] - 1) / 2:
        formed = _summed(listed)
    else:
        tasks = math.ceil(seen["pairs"] / task_pairs) or 1
        many = degrees.where(F.col("_keys") > heavy_keys).select(F.col(member).alias("src"))
        light = listed.join(F.broadcast(many), "src", "left_anti") if seen["heavy"] else listed
        formed = _summed(light.repartition(tasks, "src"))
        if seen["heavy"]:
            # At most one member in so many rows, so the list of them is short.
            formed = formed.unionByName(_summed(listed.join(F.broadcast(many), "src", "left_semi")))
    if seen["hubs"]:
        hubs = _hub_pairs(rows.join(hub_sizes, key), key, member, block_rows)
        formed = formed.unionByName(hubs).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    return formed.withColumn("type", F.lit(UNDIRECTED))


def bibliographic_coupling(articles: DataFrame, citations: DataFrame,
                           block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Weight = number of references two papers of the set have in common."""
    rows = _links(citations).join(
        articles.select(F.col("ut").alias("citing_ut")), "citing_ut", "left_semi"
    )
    return _count_pairs(rows, "cited_ut", "citing_ut", block_rows)


def co_citation(articles: DataFrame, citations: DataFrame,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Weight = number of papers that cite both papers of the set."""
    rows = _links(citations).join(
        articles.select(F.col("ut").alias("cited_ut")), "cited_ut", "left_semi"
    )
    return _count_pairs(rows, "citing_ut", "cited_ut", block_rows)


def direct_citation(articles: DataFrame, citations: DataFrame) -> DataFrame:
    """Citation links with both ends in the set; self citations stay."""
    members = articles.select("ut")
    return (
        _links(citations)
        .join(members.withColumnRenamed("ut", "citing_ut"), "citing_ut", "left_semi")
        .join(members.withColumnRenamed("ut", "cited_ut"), "cited_ut", "left_semi")
        .select(
            F.col("citing_ut").alias("src"),
            F.col("cited_ut").alias("dst"),
            F.lit(1).cast("bigint").alias("weight"),
            F.lit("directed").alias("type"),
        )
    )


def combine_networks(*networks: DataFrame) -> DataFrame:
    """Bag union; a pair present in several networks gets the sum of its weights."""
    together = networks[0].select("src", "dst", "weight", "type")
    for network in networks[1:]:
        together = together.unionByName(network.select("src", "dst", "weight", "type"))
    return together.groupBy("src", "dst", "type").agg(F.sum("weight").alias("weight"))


def keyword_cooccurrence(keywords: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Weight = number of papers that carry both keywords; the text NULL is no keyword."""
    rows = keywords.where(F.col("keyword") != "NULL").select("ut", "keyword").distinct()
    return _count_pairs(rows, "ut", "keyword", block_rows)


def similarity_candidates(tfidf: DataFrame, min_weight: float, doc: str = "ut", term: str = "word",
                          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs ``(src, dst)`` of documents that may reach ``min_weight``, each once; none is missed.

    The words of a document are ordered from rare to common.  Its last words are
    left out as long as they could not add up to ``min_weight``, whatever the other
    document: each counts with its own score and the highest any document gives it.
    The first word that a pair shares is then among the kept ones of both.  Of a
    pair, the document with the higher top score may assume that the other scores
    no word higher than that, which keeps few words of long texts.  Scores must
    not be negative.  Words of more than ``block_rows`` documents meet block
    against block, as in ``pairs_sharing``.  This is for callers that judge pairs
    otherwise; ``similar_pairs`` sums them all in place.
    """
    rows = tfidf.where(F.col(doc).isNotNull() & F.col("tf_idf").isNotNull()).select(
        F.col(doc).alias("_doc"), F.col(term).alias("_word"), F.col("tf_idf").alias("_own"))
    words = rows.groupBy("_word").agg(F.count(F.lit(1)).alias("_n"), F.max("_own").alias("_max"))
    texts = rows.groupBy("_doc").agg(F.max("_own").alias("_top"))
    common_first = Window.partitionBy("_doc").orderBy(F.col("_n").desc(), F.col("_word").desc())
    so_far = common_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    enough = min_weight * (1 - 1e-9)
    any_other = F.sum((F.col("_own") + F.col("_max")) / 2).over(so_far)
    lower_other = F.sum((F.col("_own") + F.least("_max", "_top")) / 2).over(so_far)
    blocks = F.ceil(F.col("_n") / block_rows).cast("int")
    kept = (
        rows.join(words, "_word").join(texts, "_doc")
        .withColumn("_any", any_other).withColumn("_lower", lower_other)
        .where(F.col("_any") >= enough)
        .select("_doc", "_word", "_top", (F.col("_lower") >= enough).alias("_leads"), blocks.alias("_blocks"),
                F.pmod(F.xxhash64("_doc"), blocks).cast("int").alias("_block"))
    )
    each = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    one = kept.where("_leads").select(
        "_word", F.col("_block").alias("_i"), each.alias("_j"), F.struct("_top", "_doc").alias("_a"))
    two = kept.select(
        "_word", each.alias("_i"), F.col("_block").alias("_j"), F.struct("_top", "_doc").alias("_b"))
    met = one.join(two, ["_word", "_i", "_j"]).where(F.col("_a") > F.col("_b"))
    ends = F.col("_a._doc"), F.col("_b._doc")
    return met.select(F.least(*ends).alias("src"), F.greatest(*ends).alias("dst")).distinct()


#: Documents on a side of a cell, and words on it, whose similarities one task holds.
CELL_ROWS = 2048
CELL_WORDS = 2_000_000
#: Words that two documents share which one array step adds up.
CELL_STEP = 1 << 21


def word_vectors(tfidf: DataFrame, doc: str = "ut", term: str = "word") -> DataFrame:
    """``(id, words)``: a row per document with ``(word, score, n)`` of its rows, by word.

    Rows that repeat a document and word are ``n``, with their sum as ``score``.
    """
    rows = tfidf.where(F.col(doc).isNotNull() & F.col(term).isNotNull() & F.col("tf_idf").isNotNull()).select(
        F.col(doc).alias("id"), F.col(term).alias("word"), "tf_idf").repartition("id")
    # Grouped twice where the document is, so nothing is shuffled again.
    cells = rows.groupBy("id", "word").agg(F.sum("tf_idf").alias("score"), F.count(F.lit(1)).alias("n"))
    # Plus zero, as zeros have two signs.
    listed = F.struct("word", (F.col("score") + 0.0).alias("score"), "n")
    return cells.groupBy("id").agg(F.sort_array(F.collect_list(listed)).alias("words"))


def _by_word(owners: np.ndarray, codes: np.ndarray, *values: np.ndarray):
    """Entries of a block in the order of their words."""
    order = np.argsort(codes, kind="stable")
    return owners[order], codes[order], *(v[order] for v in values)


def _products(one, two, shape: tuple[int, int], n_words: int) -> np.ndarray:
    """Sums over shared words of both scores, each as often as the other side has the word."""
    total = np.zeros(shape)
    (row_a, code_a, score_a, n_a), (row_b, code_b, score_b, n_b) = one, two
    size_a, size_b = (np.bincount(c, minlength=n_words) for c in (code_a, code_b))
    common = size_a * size_b > 0.02 * shape[0] * shape[1]
    # Words of many pairs as a matrix product, some at a time.
    many = np.flatnonzero(common)
    for at in range(0, len(many), 256):
        column = np.full(n_words, -1)
        column[many[at:at + 256]] = np.arange(len(many[at:at + 256]))
        parts = []
        for row, code, score, n, rows in ((row_a, code_a, score_a, n_a, shape[0]),
                                          (row_b, code_b, score_b, n_b, shape[1])):
            kept = column[code] >= 0
            pair = np.zeros((2, rows, len(many[at:at + 256])))
            pair[0, row[kept], column[code[kept]]] = score[kept]
            pair[1, row[kept], column[code[kept]]] = n[kept]
            parts.append(pair)
        total += parts[0][0] @ parts[1][1].T
        total += parts[0][1] @ parts[1][0].T
    # The others pair by pair: every entry of one side meets those of its word on the other.
    first = np.cumsum(size_b) - size_b
    rare = np.flatnonzero(~common[code_a] & (size_b[code_a] > 0))
    meets = size_b[code_a[rare]]
    ends = np.cumsum(meets)
    flat = total.reshape(-1)
    begin = 0
    while begin < len(rare):
        stop = max(begin + 1, int(np.searchsorted(ends, ends[begin] - meets[begin] + CELL_STEP, "right")))
        a, times = rare[begin:stop], meets[begin:stop]
        b = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[code_a[a]], times)
        a = np.repeat(a, times)
        np.add.at(flat, row_a[a] * shape[1] + row_b[b], score_a[a] * n_b[b] + n_a[a] * score_b[b])
        begin = stop
    return total


def _entries(rows: pa.Table):
    """Ids of a block's documents, their words, and per entry the document, place among the words, score and n."""
    rows = rows.combine_chunks()
    ids, words = (rows[c].combine_chunks() for c in ("id", "words"))
    flat = words.flatten()
    word = flat.field("word").dictionary_encode()
    owners = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    return ids, word.dictionary, owners, word.indices.to_numpy(zero_copy_only=False).astype(np.int64), *(
        flat.field(c).to_numpy(zero_copy_only=False) for c in ("score", "n"))


def _cell_pairs(folder: str, min_weight: float, kind: pa.DataType):
    """Pairs of each given cell, a block against another, or on the diagonal among its own documents."""
    known = {}

    def block(number: int):
        if number not in known:
            files, at = pafs.FileSystem.from_uri(folder)
            listed = files.get_file_info(pafs.FileSelector(f"{at}/_b={number}", allow_not_found=True))
            parts = [pq.read_table(f.path, filesystem=files, columns=["id", "words"], partitioning=None)
                     for f in listed if f.path.endswith(".parquet")]
            known[number] = _entries(pa.concat_tables(parts)) if parts else None
        return known[number]

    def meet(cell: pa.Table) -> pa.Table:
        i, j = cell["_i"][0].as_py(), cell["_j"][0].as_py()
        for number in set(known) - {i, j}:
            del known[number]
        one, two = block(i), block(j)
        if one is None or two is None:
            return pa.table({"src": pa.array([], kind), "dst": pa.array([], kind), "weight": pa.array([], pa.float64())})
        ids_a, words, owners, codes, *values = one
        ids_b, others, owners_b, codes_b, *values_b = two
        # Words of the second block by their place in the first; the others are shared by no pair.
        place = pc.fill_null(pc.index_in(others, value_set=words), -1).to_numpy(zero_copy_only=False)[codes_b]
        kept = place >= 0
        total = _products(_by_word(owners, codes, *values),
                          _by_word(owners_b[kept], place[kept], *(v[kept] for v in values_b)),
                          (len(ids_a), len(ids_b)), len(words))
        total /= 2
        reached = total >= min_weight
        if i == j:
            reached = np.triu(reached, 1)
        a, b = np.nonzero(reached)
        return pa.table({"src": ids_a.take(pa.array(a)), "dst": ids_b.take(pa.array(b)), "weight": total[a, b]})

    return meet


def similar_pairs(vectors: DataFrame, min_weight: float, cell_rows: int = CELL_ROWS,
                  cell_words: int = CELL_WORDS) -> DataFrame:
    """``(src, dst, weight)`` of the pairs that reach ``min_weight``, which is positive, each once.

    ``vectors`` are those of ``word_vectors``, an id each.  They are dealt into blocks, which are
    written once, and each pair of blocks meets in a cell of a grid, whose task reads both and sums
    all their pairs in place: what lies on disk grows with the documents, and a pair is not sent
    before it is known to reach the weight.
    """
    spark = vectors.sparkSession
    seen = vectors.agg(F.count(F.lit(1)).alias("rows"),
                       F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("words")).first()
    side = max(1, math.ceil(seen["rows"] / cell_rows), math.ceil(seen["words"] / cell_words))
    folder = Scratch(spark, "blocks").write_by(
        vectors.select("id", "words", F.pmod(F.xxhash64("id"), F.lit(side)).cast("int").alias("_b")), "_b",
        min(side, 10_000))
    kind = vectors.schema["id"].dataType
    work = math.ceil(seen["rows"] ** 2 / 2 / TASK_PAIRS) + math.ceil(seen["words"] * side / cell_words)
    tasks = max(1, min(side * (side + 1) // 2, work, 10_000))
    cells = spark.range(side).select(F.col("id").alias("_i"), F.explode(F.sequence("id", F.lit(side - 1))).alias("_j"))
    # Cells of a run share a block, and a run is one task's.
    run = F.floor(F.col("_j") / max(1, side * (side + 1) // 2 // tasks)).alias("_run")
    met = cells.select("_i", run, "_j").repartition(tasks, "_i", "_run").groupBy("_i", "_run", "_j").applyInArrow(
        _cell_pairs(folder, min_weight, to_arrow_type(kind)),
        f"src {kind.simpleString()}, dst {kind.simpleString()}, weight double")
    return met.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")


def text_similarity_network(tfidf: DataFrame, doc: str = "ut", term: str = "word",
                            min_weight: float | None = None,
                            block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Sum over shared words of the mean of both tf-idf values; both directions kept.

    Each unordered pair is summed once and mirrored afterwards.  With a positive
    ``min_weight`` only pairs that reach it leave the tasks that sum them.
    """
    if min_weight is not None and min_weight > 0:
        vectors = Scratch(tfidf.sparkSession, "similarity").save(word_vectors(tfidf, doc, term))
        once = similar_pairs(vectors, min_weight, min(block_rows, CELL_ROWS))
        return both_directions(once).withColumn("type", F.lit(UNDIRECTED))
    shared = pairs_sharing(tfidf, term, doc, carry="tf_idf", block_rows=block_rows)
    half = (F.col("src_x") + F.col("dst_x")) / 2
    once = shared.groupBy("src", "dst").agg(F.sum(half).alias("weight"))
    if min_weight is not None:
        once = once.where(F.col("weight") >= min_weight)
    return both_directions(once).withColumn("type", F.lit(UNDIRECTED))


def text_similarity_classes(tfidf: DataFrame, min_weight: float, doc: str = "ut",
                            term: str = "word") -> DataFrame:
    """``(src, dst, weight, type)``: the network above with documents of equal scores as one.

    Documents with the same words and scores are a class, represented by the smallest.  Rows of
    type ``copy`` lead from every document with a word to its representative, itself included, and
    weigh what two documents of the class do: copies are linked if that reaches ``min_weight``.  The
    other rows are the links between representatives, both directions; they hold for all members.
    """
    scratch = Scratch(tfidf.sparkSession, "classes")
    vectors = scratch.save(word_vectors(tfidf, doc, term))
    least = scratch.save(vectors.groupBy("words").agg(F.min("id").alias("id")))
    own = F.aggregate("words", F.lit(0.0), lambda total, w: total + w["score"] * w["n"])
    copies = vectors.join(least.withColumnRenamed("id", "_least"), "words").select(
        F.col("id").alias("src"), F.col("_least").alias("dst"), own.alias("weight"), F.lit("copy").alias("type"))
    links = both_directions(similar_pairs(least, min_weight)).withColumn("type", F.lit(UNDIRECTED))
    return links.select("src", "dst", "weight", "type").unionByName(copies)


def both_directions(edges: DataFrame) -> DataFrame:
    """Every edge in both orientations, from one pass over the edges."""
    others = [c for c in edges.columns if c not in ("src", "dst")]
    way = F.explode(
        F.array(
            F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")),
            F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")),
        )
    )
    return edges.select(way.alias("_way"), *others).select("_way.src", "_way.dst", *others)


def project_network(edges: DataFrame, membership: DataFrame, paper: str = "id_art",
                    name: str = "name") -> DataFrame:
    """Paper network to a network of names, ``dst > src``.

    ``edges`` holds both directions, of which one is sent: the ends of its links with
    names are put in order instead.  Weights are summed per (name, paper) before the second
    join, which keeps the intermediate small; both happen where the second paper is, so the
    links with names travel once.
    """
    people = membership.select(F.col(paper).alias("_paper"), F.col(name).alias("_name"))
    half_way = (
        edges.where(F.col("src") <= F.col("dst"))
        .join(people, F.col("src") == F.col("_paper"))
        .select(F.col("_name").alias("src_name"), "dst", "weight", (F.col("src") == F.col("dst")).alias("_loop"))
        .repartition("dst")
        .groupBy("src_name", "dst", "_loop")
        .agg(F.sum("weight").alias("weight"))
    )
    # A loop holds both directions in its two rows.
    named = F.when(F.col("_loop"), F.col("_name") > F.col("src_name")).otherwise(F.col("_name") != F.col("src_name"))
    return (
        half_way.join(people, F.col("dst") == F.col("_paper")).where(named)
        .groupBy(F.least("src_name", "_name").alias("src"), F.greatest("src_name", "_name").alias("dst"))
        .agg(F.sum("weight").alias("weight"))
        .withColumn("type", F.lit(UNDIRECTED))
    )


def simplify(edges: DataFrame, weight_col: str | None = "weight") -> DataFrame:
    """Merge parallel edges and drop loops: ``(src, dst, weight)``.

    Without a weight column the merged network is unweighted (weight 1).
    """
    pairs = edges.where(F.col("src") != F.col("dst"))
    ends = [F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")]
    if weight_col is None:
        return pairs.select(*ends).distinct().withColumn("weight", F.lit(1.0))
    return (
        pairs.select(*ends, F.col(weight_col).alias("weight"))
        .groupBy("src", "dst")
        .agg(F.sum("weight").cast("double").alias("weight"))
    )


def induced_edges(edges: DataFrame, membership: DataFrame, cluster: str,
                  vertex: str = "ut") -> DataFrame:
    """Edges whose two ends share a cluster, for all clusters at once."""
    side = membership.where(F.col(cluster).isNotNull()).select(
        F.col(vertex).alias("_v"), F.col(cluster).alias("_c")
    )
    return (
        edges.join(side.withColumnRenamed("_c", cluster), F.col("src") == F.col("_v"))
        .drop("_v")
        .join(side, (F.col("dst") == F.col("_v")) & (F.col(cluster) == F.col("_c")))
        .drop("_v", "_c")
    )


def supernode_graph(edges: DataFrame, membership: DataFrame, level: str, vertex: str = "ut",
                    canonical: bool = True) -> DataFrame:
    """Edges between clusters with summed weights.

    ``canonical`` puts both orientations of a cluster pair together; without it
    only pairs that arrive with the larger cluster second are kept.  Weights are
    summed per (cluster, vertex) before the second join.
    """
    side = membership.where(F.col(level).isNotNull()).select(
        F.col(vertex).alias("_v"), F.col(level).alias("_c")
    )
    half_way = (
        edges.join(side, F.col("src") == F.col("_v"))
        .groupBy(F.col("_c").alias("_src"), "dst", "type")
        .agg(F.sum("weight").alias("weight"))
    )
    across = half_way.join(side, F.col("dst") == F.col("_v"))
    if canonical:
        ends = [F.least("_src", "_c").alias("src"), F.greatest("_src", "_c").alias("dst")]
        across = across.where(F.col("_src") != F.col("_c"))
    else:
        ends = [F.col("_src").alias("src"), F.col("_c").alias("dst")]
        across = across.where(F.col("_c") > F.col("_src"))
    return across.groupBy(*ends, "type").agg(F.sum("weight").alias("weight"))


def vertices_of(edges: DataFrame, name: str = "id") -> DataFrame:
    """Distinct ends of the edges."""
    return edges.select(
        F.explode(F.array("src", "dst")).alias(name)
    ).distinct()


#: Neighbours in one row of a list.
LIST_ROWS = 1024


def neighbour_lists(links: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """``(id, around)``: the links out of a vertex as lists of ``(id, weight)``.

    Joining them by vertex moves and sorts a row per list.  The lists of a vertex are cut
    at about ``list_rows`` neighbours, so a hub is many rows.
    """
    degree = links.groupBy("src").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > list_rows)
    pieces = F.coalesce(F.ceil(F.col("_n") / list_rows), F.lit(1))
    placed = links.join(degree, "src", "left").withColumn("_piece", F.pmod(F.xxhash64("dst"), pieces))
    return placed.groupBy("src", "_piece").agg(
        F.collect_list(F.struct(F.col("dst").alias("id"), "weight")).alias("around")
    ).select(F.col("src").alias("id"), "around")


def graph_tables(edges: DataFrame, membership: DataFrame, vertex: str = "ut",
                 cluster: str = "community") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices with their attributes, edges, and (vertex, cluster) rows."""
    vertices = vertices_of(edges, vertex).join(membership, vertex, "left")
    members = vertices.where(F.col(cluster).isNotNull()).select(vertex, cluster)
    return vertices, edges, members
