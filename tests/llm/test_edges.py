"""Nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import public_tokenizers
import pytest

from citegraph.llm import (
    bitslice,
    decontaminate,
    importance,
    jaccard,
    langid,
    licenses,
    linededup,
    packing,
    rules,
    sharding,
    tiers,
    vectorcode,
    warc,
)

LABELS = "doc_id long, quality int, toxic int"
PATH = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ITEM = "the benchmark passage that nobody should ever train on, word for word"

OPERATORS = {
    "warc": lambda spark, docs: warc.archived_pages(
        docs.withColumnsRenamed({"doc_id": "page_id", "text": "html", "lang": "url"})),
    "leaks": lambda spark, docs: decontaminate.leaks(docs, items(spark)),
    "clean": lambda spark, docs: decontaminate.without_leaks(docs, items(spark)),
    "jaccard": lambda spark, docs: jaccard.jaccard_components(docs),
    "rules": lambda spark, docs: rules.judged(docs, labels(spark)),
    "langid": lambda spark, docs: langid.languages(docs, steps=5),
    "packing": lambda spark, docs: packing.packed(docs, PATH, RANKS),
    "licenses": lambda spark, docs: licenses.license_spans(docs),
    "sharding": lambda spark, docs: sharding.sharded(docs),
    "linededup": lambda spark, docs: linededup.without_repeats(docs),
    "importance": lambda spark, docs: importance.resampled(docs, labels(spark)),
    "bitslice": lambda spark, docs: bitslice.drawn(docs, items(spark)),
    "tiers": lambda spark, docs: tiers.tiered(docs, public_tokenizers.path("word_bpe_49k.json")),
    "vectorcode": lambda spark, docs: vectorcode.compressed(docs.selectExpr(
        "doc_id AS vec_id", "lang AS label", "place AS part", "n_lines AS weight",
        "IF(text IS NULL, NULL, array(length(text), 0.5D, n_lines)) AS embedding")),
    "kept": lambda spark, docs: importance.kept_rows(docs, labels(spark)),
}


def items(spark):
    return spark.createDataFrame([(1, ITEM), (2, ITEM), (3, None), (None, "x"), (4, "")],
                                 "item_id long, text string")


def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (1, 0, 0), (2, 1, None), (None, 1, 0), (3, None, 0), (99, 0, 1)], LABELS)


@pytest.fixture(scope="module")
def docs(spark):
    long = "\n".join(f"line {k} of a long text about {k * k}" for k in range(20000))
    rows = [(1, ITEM, "en"), (1, ITEM, "en"), (1, "another text", None), (2, None, "en"),
            (None, None, None), (None, ITEM.upper(), "en"), (3, "", "de"), (4, " \n\t\n ", "de"),
            (5, long, "en"), (6, long, "en"), (7, "é中\U0001f600 <|endoftext|> x", "fr"),
            (8, "x" * 100_000, None)]
    # Columns that are called like what operators add.
    return spark.createDataFrame(
        [(*r, "a", 1, 2.0, "b", 3) for r in rows],
        "doc_id long, text string, lang string, place string, n_lines int, key double, "
        "_key string, length int")


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, docs, name):
    found = OPERATORS[name](spark, docs).collect()
    if name in ("warc", "jaccard", "rules", "langid", "sharding", "linededup",
                "bitslice"):
        assert len(found) == 12
    if name == "vectorcode":
        assert len(found) == 10
    if name == "leaks":
        hits = sorted((str(r["doc_id"]), r["item_id"], r["edits"]) for r in found)
        assert hits == [("1", 1, 0), ("1", 1, 0), ("1", 2, 0), ("1", 2, 0), ("None", 1, 0),
                        ("None", 2, 0)]
    if name == "clean":
        assert len(found) == 9
    if name == "linededup":
        cut = {r["doc_id"]: (r["n_lines"], r["n_deleted"]) for r in found if r["doc_id"]}
        assert cut[5] == (20000, 0) and cut[6] == (20000, 20000)
    if name == "langid":
        und = {r["doc_id"] for r in found if r["lang_pred"] == "und"}
        assert und >= {2, 3, 4}
        assert all(0 <= r["score"] <= 1 for r in found)
    if name in ("importance", "kept"):
        assert len(found) >= 11


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_no_rows(spark, docs, name):
    assert OPERATORS[name](spark, docs.where("doc_id > 1000")).collect() == []
