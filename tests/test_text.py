import math

import pytest

from citegraph.functions.stem import stem_vocabulary
from citegraph.functions.text import contains_word, replace_first
from citegraph.operators import text as t
from citegraph.operators import topics as tp
from citegraph.plans import corpus, reports
from citegraph.sources.lexicons import stop_words
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F


def clean(spark, *texts, **options):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "ut int, abstract string")
    return [r.abstract for r in t.clean_text(df, "abstract", **options).orderBy("ut").collect()]


def test_clean_text_order_of_steps(spark):
    got = clean(spark, "Photo-identification of X/Y 42 (C) Elsevier\nall rights")
    assert " ".join(got[0].split()) == "photoidentification of x y"
    assert clean(spark, "see http://a.b/c and\nmore") == ["see"]
    assert clean(spark, "annulled", None, "ok") == ["ok"]
    assert clean(spark, "Sharks and sharkskin, café_bar [x] ^ - \\") == ["shark and sharkskin cafbar x   "]
    assert clean(spark, "keep (c) small", "lone http://x") == ["keep c small", "lone http  x"]
    merged = clean(spark, "sharks species", replace=(("sharks", "shark"), ("species", "shark")))
    assert merged == ["shark shark"]


def test_tokens_and_stop_words(spark, rows):
    df = spark.createDataFrame([(1, "The don't of U.S naïve words words", None)],
                               "ut int, abstract string, k int")
    tokens = t.tokenize(df, "abstract")
    assert tokens.columns == ["ut", "k", "word"]
    kept = t.remove_stop_words(tokens, stop_words(spark))
    assert rows(t.term_counts(kept, "ut"), "word", "n") == {
        ("u.s", 1), ("naïve", 1), ("words", 2)}


# Examples printed in the 1980 paper that describes the algorithm.
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat",
    "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor",
    "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size",
    "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz",
    "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat",
    "conditional": "condit", "rational": "ration", "valenci": "valenc", "digitizer": "digit",
    "conformabli": "conform", "radicalli": "radic", "differentli": "differ", "vileli": "vile",
    "analogousli": "analog", "vietnamization": "vietnam", "predication": "predic",
    "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope",
    "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit",
    "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "formalize": "formal",
    "electriciti": "electr", "electrical": "electr", "hopeful": "hope", "goodness": "good",
    "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin",
    "gyroscopic": "gyroscop", "adjustable": "adjust", "defensible": "defens",
    "irritant": "irrit", "replacement": "replac", "adjustment": "adjust", "dependent": "depend",
    "adoption": "adopt", "homologou": "homolog", "communism": "commun", "activate": "activ",
    "angulariti": "angular", "homologous": "homolog", "effective": "effect",
    "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas",
    "controll": "control", "roll": "roll", "as": "as", "generalizations": "gener",
    "oscillators": "oscil", "yes": "ye", "toy": "toi",
}


def test_stems(spark, rows):
    words = spark.createDataFrame([(w,) for w in STEMS], "word string")
    got = dict(rows(stem_vocabulary(words), "word", "stemmed"))
    assert got == STEMS


def test_stem_stop_words_drops_whole_families(spark, rows):
    tokens = spark.createDataFrame([(1, "doing"), (1, "reefs"), (1, "reef")], "ut int, word string")
    kept = t.stem_stop_words(tokens, stop_words(spark, extra=()))
    assert rows(kept, "word", "stemmed") == {("reefs", "reef"), ("reef", "reef")}


def test_frequent_words_are_dealt_over_tasks(spark):
    tokens = spark.createDataFrame(
        [(i % 50, "reefs") for i in range(300)] + [(1, "doing"), (2, "coral"), (2, "coral"), (3, None)],
        "ut int, word string")
    dealt = t.stem_stop_words(tokens, stop_words(spark, extra=()), word_tokens=40)
    assert dealt.columns == ["word", "ut", "stemmed"]
    got = sorted(tuple(r) for r in dealt.collect())
    assert got == sorted([("reefs", i % 50, "reef") for i in range(300)] + [("coral", 2, "coral")] * 2)
    assert "_piece" in next(line for line in dealt._jdf.queryExecution().simpleString().splitlines() if "Join" in line)


def test_tf_idf_of_many_documents_sorts_no_counts(spark):
    """Also with a missing document and word, and rows that repeat."""
    rows = [(i % 40, f"w{i % 7}", i % 5 + 1) for i in range(200)] + [(None, "w1", 2), (None, "w1", 2), (3, None, 4)]
    counts = spark.createDataFrame(rows, "ut int, word string, n int")
    few, many = t.tf_idf(counts), t.tf_idf(counts, many_docs=10)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = many._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in plan
        assert few._jdf.queryExecution().sparkPlan().toString().count("ShuffledHashJoin") == 1
        got, same = (sorted(map(repr, df.collect())) for df in (many, few))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == same and len(got) == 202
    totals, holders = {}, {}
    for ut, word, n in rows:
        totals[ut] = totals.get(ut, 0) + n
        holders[word] = holders.get(word, 0) + 1
    for r in many.collect():
        if r.ut is None:
            assert r.tf_idf is None
        else:
            assert r.tf_idf == pytest.approx(r.n / totals[r.ut] * math.log(40 / holders[r.word]))


def test_tf_idf_with_a_missing_cluster(spark):
    counts = spark.createDataFrame(
        [("a", "w", 2), ("a", "v", 2), ("b", "w", 1), (None, "w", 5), (None, "u", 1)],
        "cluster string, word string, n long")
    got = {(r.cluster, r.word): r.tf_idf for r in t.tf_idf(counts, doc="cluster").collect()}
    assert got[("a", "w")] == pytest.approx(0.5 * math.log(2 / 3))
    assert got[("a", "v")] == pytest.approx(0.5 * math.log(2))
    assert got[(None, "w")] is None and got[(None, "u")] is None


def test_ties_stay_and_words_stand_by_count(spark):
    words = [("c1", i, f"w{i:02d}") for i in range(12)] + [("c2", 99, "other"), ("c2", 99, "other")]
    tokens = spark.createDataFrame(words, "cluster string, ut int, word string")
    lines = {r.cluster: r for r in reports.cluster_words(tokens, "cluster").collect()}
    assert lines["c1"].words == ", ".join(f"w{i:02d}" for i in range(12))
    assert (lines["c1"].npapers, lines["c2"].npapers) == (12, 1)


def test_word_predicate_and_extraction(spark, rows):
    texts = spark.createDataFrame(
        [("1", "Shark!", None, None, None), ("2", "sharkskin", "k", "p", "no"),
         ("3", None, None, None, "two sharks."), ("1", "Shark!", None, None, None)],
        "ut string, title string, keyword string, keyword_plus string, abstract string")
    assert rows(corpus.extract_corpus(texts), "ut") == {("1",), ("3",)}
    assert corpus.extract_corpus(texts).count() == 2
    row = spark.sql("SELECT 'a thé b' AS x").select(
        contains_word("x", "th").alias("part"), contains_word("x", "thé").alias("whole")).first()
    assert (row.part, row.whole) == (False, True)


def test_replace_first(spark):
    row = spark.sql("SELECT 'Peace/Love/x' AS x, 'plain' AS y").select(
        replace_first("x", "/", " ").alias("x"), replace_first("y", "/", " ").alias("y")).first()
    assert (row.x, row.y) == ("Peace Love/x", "plain")


def test_topic_model_tables(spark):
    docs = [(i, w, 3) for i in range(12) for w in (("reef", "coral") if i % 2 else ("fin", "trade"))]
    counts = spark.createDataFrame(docs, "ut int, word string, n long")
    matrix, vocabulary = tp.doc_term_matrix(t.tf_idf(counts))
    model = tp.topic_model(matrix, k=2, seed=1)
    gamma = tp.doc_topics(model, matrix)
    sums = gamma.groupBy("ut").agg(F.sum("gamma").alias("s"), F.count("*").alias("n"))
    assert sums.where("abs(s - 1) > 1e-6 or n <> 2").count() == 0
    betas = tp.topic_betas(model, vocabulary)
    assert betas.count() == 8
    assert betas.groupBy("topic").agg(F.sum("beta").alias("s")).where("abs(s - 1) > 1e-6").count() == 0
    assert tp.topic_terms(betas, 2).count() >= 4
    wide = tp.topic_main(gamma, 2)
    assert wide.columns == ["ut", "topic", "gamma", "gamma1", "gamma2"]
    assert wide.where("gamma <> greatest(gamma1, gamma2)").count() == 0
    with pytest.raises(ValueError):
        tp.doc_term_matrix(t.tf_idf(counts), max_vocabulary=2)


def test_cells_of_a_paper_are_read_without_a_dense_row(spark, rows):
    wide = 1 << 30
    matrix = spark.createDataFrame(
        [(1, Vectors.sparse(wide, [3, wide - 1], [2.0, 1.0])), (2, Vectors.sparse(wide, [], []))], ["ut", "features"])
    assert rows(tp.cells_per_paper(matrix), "ut", "terms", "occurrences") == {(1, 2, 3), (2, 0, 0)}


def test_topic_betas_build_no_list_on_the_driver(spark, rows, monkeypatch):
    docs = [(i, w, 3) for i in range(12) for w in (("reef", "coral") if i % 2 else ("fin", "trade", "sea"))]
    counts = spark.createDataFrame(docs, "ut int, word string, n long")
    matrix, vocabulary = tp.doc_term_matrix(t.tf_idf(counts))
    model = tp.topic_model(matrix, k=3, seed=1)
    words = vocabulary.vocabulary
    expected = {(r.topic + 1, words[i]): x for r in model.describeTopics(5).collect()
                for i, x in zip(r.termIndices, r.termWeights)}

    def refused(*_):
        raise AssertionError("the topics are described on the driver")

    monkeypatch.setattr(type(model), "describeTopics", refused)
    monkeypatch.setattr(type(vocabulary), "vocabulary", property(refused))
    got = {(a, b): x for a, b, x in rows(tp.topic_betas(model, vocabulary), "topic", "term", "beta")}
    assert got == pytest.approx(expected)
