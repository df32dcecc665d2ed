import random
import struct
import zlib

import public_tokenizers
import pytest
from test_jaccard import brute_force
from tokenizers import Tokenizer

import corpus_pipeline as P
from citegraph.llm import importance, packing

ITEM = "who wrote the well known play about the prince that was told by a ghost of the murder"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    words = [a + b for a in ("the", "one", "in", "ers") for b in ("tion", "ness", "and", "of", "est")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    rows = [(k, "\n".join(prose(25) for _ in range(6))) for k in range(120)]
    texts = dict(rows)
    rows += [(200 + k, texts[k]) for k in range(5)]                                # exact copies
    rows += [(300 + k, texts[10 + k].replace(".", " changed.", 2)) for k in range(5)]  # near copies
    rows += [(400 + k, f"{prose(40)} {ITEM} {prose(40)}") for k in range(4)]        # leaks
    rows += [(500 + k, prose(150).upper().replace(" ", "!! ###$ ")) for k in range(20)]   # junk
    rows += [(600, None), (601, ""), (3, texts[3])]
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = [(d, t, "en", "src0", len(t or ""), "extra") for d, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, "
                          "id string").write.parquet(f"{path}/documents.parquet")
    labels = [(d, int(not 500 <= d < 600), 0) for d, _ in rows if d % 5]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(
        f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in P.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if stage is not P.best_fit_packing:
            assert docs.columns == columns
        seen.append(sorted(r["doc_id"] for r in docs.select("doc_id").collect()))
    quality, lines, near, clean, packed = seen
    assert not [d for d in quality if 500 <= d < 600] and set(range(120)) <= set(quality)
    # Whole copies lose every line; near copies keep the lines that were changed.
    assert not [d for d in lines if 200 <= d < 300]
    assert set(range(120)) <= set(lines) and lines.count(3) == 2
    assert near.count(3) == 1 and {600, 601} <= set(near)
    assert set(range(120)) <= set(clean) and not [d for d in clean if 400 <= d < 500]
    assert set(packed) == set(clean)
    kept = {name: [(r["doc_id"], r["text"]) for r in
                   spark.read.parquet(f"{folder}/{name}").select("doc_id", "text").collect()]
            for name, _ in P.STAGES[:4]}
    # Near duplicates: the smallest id of each component by comparing all pairs, and texts without words.
    compared = brute_force(kept["line dedup"])
    expected = {c for _, n, c in compared if n} | {d for d, n, _ in compared if not n}
    assert near == sorted(expected)
    # Decontamination: texts without the item in them.
    held = kept["n-gram Jaccard join"]
    assert clean == sorted(d for d, t in held if ITEM not in (t or ""))
    # Packing: the tokenizer's ids of every text, cut from the end.
    tokenizer, pieces = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for doc_id, text in kept["benchmark decontamination"]:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        edges = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        pieces += [(doc_id, lo, hi - lo, zlib.crc32(struct.pack(f"<{hi - lo}I", *ids[lo:hi])))
                   for lo, hi in zip(edges, edges[1:])]
    found = docs.select("doc_id", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, found)) == sorted(pieces)


def test_run_is_the_stages(spark, folder):
    found = P.run(spark, folder)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = found.collect()
    assert len({r["sequence_id"] for r in rows}) <= 1.15 * sum(r["length"] for r in rows) / 2048
    assert packing.CAPACITY == 2048 and importance.MAX_LOSS < 0.01


def test_no_documents(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id > 9999")
    for _, stage in P.STAGES:
        assert stage(spark, docs, folder).count() == 0
