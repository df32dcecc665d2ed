import itertools
import random
from collections import Counter

import pytest

from citegraph.operators import networks as net

CITES = [(p, r) for p, r in [
    ("a", "x"), ("b", "x"), ("c", "x"), ("d", "x"), ("e", "x"), ("a", "y"), ("b", "y"),
    ("z", "y"), ("a", "b"), ("c", "c"), ("b", "b"), ("a", "x"),
]]


@pytest.fixture(scope="module")
def citations(spark):
    return spark.createDataFrame(CITES, "citing_ut string, cited_ut string")


def articles(spark, names):
    return spark.createDataFrame([(n,) for n in names], "ut string")


def brute_coupling(papers):
    found = Counter()
    links = set(CITES)
    for ref in {r for _, r in links}:
        citing = sorted(p for p, r in links if r == ref and p in papers)
        found.update(itertools.combinations(citing, 2))
    return {(s, d, w) for (s, d), w in found.items()}


@pytest.mark.parametrize("block_rows", [1, 2, 3, 1000])
def test_coupling_is_the_same_for_every_block_size(spark, rows, citations, block_rows):
    got = net.bibliographic_coupling(articles(spark, "abcde"), citations, block_rows)
    assert rows(got, "src", "dst", "weight") == brute_coupling(set("abcde"))


def test_coupling_keeps_a_hub_whole(spark):
    n = 300
    links = spark.range(n).selectExpr("cast(id as string) citing_ut", "'hub' cited_ut")
    papers = links.selectExpr("citing_ut as ut")
    got = net.bibliographic_coupling(papers, links, block_rows=32)
    assert got.count() == n * (n - 1) // 2
    assert got.where("weight <> 1 or dst <= src").count() == 0


@pytest.mark.parametrize("block_rows", [4, 7, 50])
def test_hubs_that_share_members_are_counted_in_cells(spark, rows, block_rows):
    rng = random.Random(block_rows)
    names = [f"p{i}" for i in range(60)]
    links = [(p, f"hub{h}") for h in range(70) for p in rng.sample(names, rng.randint(1, 1 + h // 2))]
    expected = Counter()
    for h in range(70):
        expected.update(itertools.combinations(sorted(p for p, r in links if r == f"hub{h}"), 2))
    citing = spark.createDataFrame([*links, (None, "hub1"), ("p1", None)], "citing_ut string, cited_ut string")
    got = net.bibliographic_coupling(articles(spark, names), citing, block_rows)
    assert rows(got, "src", "dst", "weight") == {(a, b, w) for (a, b), w in expected.items()}
    assert got.count() == len(expected)


@pytest.mark.parametrize("task_pairs, heavy_keys, block_rows", [(1 << 20, 1000, 4096), (7, 3, 4096), (5, 2, 6), (1 << 20, 0, 3)])
def test_pairs_are_the_same_for_every_share_of_the_work(spark, rows, task_pairs, heavy_keys, block_rows):
    rng = random.Random(task_pairs)
    names = [f"p{i:03d}" for i in range(200)]
    links = {(rng.choice(names), f"r{rng.randrange(60)}") for _ in range(300)}
    links |= {("p000", f"r{r}") for r in range(60)}
    expected = Counter()
    for ref in {r for _, r in links}:
        expected.update(itertools.combinations(sorted(p for p, r in links if r == ref), 2))
    table = spark.createDataFrame([*links, (None, "r1"), ("p1", None)], "member string, key string")
    got = net._count_pairs(table, "key", "member", block_rows, task_pairs, heavy_keys)
    assert rows(got, "src", "dst", "weight") == {(a, b, w) for (a, b), w in expected.items()}
    assert got.count() == len(expected)


def test_tasks_grow_with_the_pairs(spark):
    """Pairs travel as lists, once, to as many tasks as they need."""
    links = spark.range(3000).selectExpr("id as member", "id div 10 as key")
    found = net._count_pairs(links, "key", "member", 4096, task_pairs=1000)
    assert found.rdd.getNumPartitions() == 14  # 300 keys with 45 pairs
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1
    assert found.count() == 13500


def test_duplicated_citation_counts_once(spark, rows):
    twice = spark.createDataFrame(
        [("a", "x"), ("a", "x"), ("b", "x")], "citing_ut string, cited_ut string"
    )
    got = net.bibliographic_coupling(articles(spark, "ab"), twice)
    assert rows(got, "src", "dst", "weight") == {("a", "b", 1)}


def test_co_citation_and_combination(spark, rows, citations):
    cc = net.co_citation(articles(spark, "xyb"), citations)
    assert rows(cc, "src", "dst", "weight") == {("x", "y", 2), ("b", "x", 2), ("b", "y", 2)}
    bc = net.bibliographic_coupling(articles(spark, "abcde"), citations)
    both = net.combine_networks(cc, bc)
    total = sum(r[2] for n in (cc, bc) for r in n.select("src", "dst", "weight").collect())
    assert sum(r.weight for r in both.collect()) == total
    assert both.select("src", "dst").distinct().count() == both.count()


def test_direct_citation_keeps_self_citations(spark, rows, citations):
    got = net.direct_citation(articles(spark, "abc"), citations)
    assert rows(got, "src", "dst") == {("a", "b"), ("c", "c"), ("b", "b")}


def test_simplify(spark, rows):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 2), ("a", "a", 5)],
                                  "src string, dst string, weight long")
    assert rows(net.simplify(edges), "src", "dst", "weight") == {("a", "b", 3.0)}
    assert rows(net.simplify(edges, None), "src", "dst", "weight") == {("a", "b", 1.0)}


def test_quotient_orientation(spark, rows):
    edges = spark.createDataFrame(
        [("a", "b", 1, "undirected"), ("c", "d", 1, "undirected")],
        "src string, dst string, weight long, type string")
    member = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1), ("d", 2)], "ut string, k int")
    both = net.supernode_graph(edges, member, "k")
    literal = net.supernode_graph(edges, member, "k", canonical=False)
    assert rows(both, "src", "dst", "weight") == {(1, 2, 2)}
    assert rows(literal, "src", "dst", "weight") == {(1, 2, 1)}


def test_keywords_and_similarity(spark, rows):
    keywords = spark.createDataFrame(
        [(1, "k"), (1, "l"), (1, "NULL"), (2, "k"), (2, "l"), (2, "l")], "ut int, keyword string")
    assert rows(net.keyword_cooccurrence(keywords), "src", "dst", "weight") == {("k", "l", 2)}
    scores = spark.createDataFrame(
        [(1, "w", 0.4), (2, "w", 0.8), (3, "w", 0.1), (1, "v", 0.2), (2, "v", 0.2)],
        "ut int, word string, tf_idf double")
    got = net.text_similarity_network(scores, min_weight=0.5, block_rows=1)
    assert {(s, d, round(w, 6)) for s, d, w in rows(got, "src", "dst", "weight")} == {
        (1, 2, 0.8), (2, 1, 0.8)}


def word_scores(seed):
    """Scores with common and rare words, texts of one word and of many, ties and repeated texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    texts = [rng.sample(words[:6], rng.randint(1, 3)) + rng.sample(words, rng.choice((0, 1, 4, 15)))
             for _ in range(60)]
    found = {(i, w): rng.choice((0.0, 0.05, 0.1, 0.25, 0.6)) / rng.choice((1, 1, 3))
             for i, text in enumerate(texts) for w in text}
    found |= {(i + 1000, w): x for (i, w), x in found.items() if i < 5}
    return found


@pytest.mark.parametrize("seed, min_weight, block_rows", [(1, 0.501, 4096), (2, 0.301, 3), (3, 0.901, 1), (4, 0.0, 7)])
def test_similarity_against_all_pairs(spark, seed, min_weight, block_rows):
    scores = word_scores(seed)
    expected = {}
    for (a, w), x in scores.items():
        for (b, v), y in scores.items():
            if w == v and a != b:
                expected[a, b] = expected.get((a, b), 0) + (x + y) / 2
    table = spark.createDataFrame([(i, w, x) for (i, w), x in scores.items()],
                                  "ut long, word string, tf_idf double")
    got = net.text_similarity_network(table, min_weight=min_weight, block_rows=block_rows).collect()
    assert len({(r.src, r.dst) for r in got}) == len(got)
    assert {(r.src, r.dst): r.weight for r in got} == pytest.approx(
        {pair: w for pair, w in expected.items() if w >= min_weight - 1e-12})


@pytest.mark.parametrize("cell_rows, cell_words", [(2048, 2_000_000), (7, 2_000_000), (2048, 50)])
def test_copies_are_one_class_and_lose_no_link(spark, cell_rows, cell_words):
    """Links of representatives and copies give every pair back; sums are formed in cells of any size."""
    scores = {(i, w): x for (i, w), x in word_scores(5).items() if i < 60}
    scores |= {(i + 100 * k, w): x for (i, w), x in scores.items() if i < 20 for k in (1, 2, 3)}
    table = spark.createDataFrame([(i, w, x) for (i, w), x in scores.items()] + [(None, "w1", 1.0), (7, None, 1.0)],
                                  "ut long, word string, tf_idf double")
    every = {(r.src, r.dst): r.weight for r in net.text_similarity_network(table, min_weight=0.3).collect()}
    got = net.text_similarity_classes(table, 0.3).collect()
    copies = {r.src: (r.dst, r.weight) for r in got if r.type == "copy"}
    assert len(copies) == sum(r.type == "copy" for r in got) == len({i for i, _ in scores})
    links = {(r.src, r.dst): r.weight for r in got if r.type != "copy"}
    assert 0 < len(links) < len(every) / 4
    assert {end for pair in links for end in pair} <= {least for least, _ in copies.values()}
    links |= {(least, least): w for least, w in copies.values() if w >= 0.3}
    assert every == pytest.approx({
        (a, b): links[x, y] for a, (x, _) in copies.items() for b, (y, _) in copies.items()
        if a != b and (x, y) in links})
    pairs = net.similar_pairs(net.word_vectors(table), 0.3, cell_rows, cell_words).collect()
    assert {(r.src, r.dst): r.weight for r in pairs} == pytest.approx({p: w for p, w in every.items() if p[0] < p[1]})


def test_similarity_sends_no_pair_before_it_is_known(spark):
    """Pairs below the weight are not formed as rows, and rows that repeat a word count as often."""
    table = spark.createDataFrame([(i, w, 0.1) for i in range(50) for w in ("a", "b")] + [(50, "a", 0.3)] * 2,
                                  "ut long, word string, tf_idf double")
    got = {(r.src, r.dst): round(r.weight, 9) for r in net.text_similarity_network(table, min_weight=0.35).collect()}
    assert got == {(a, b): 0.4 for i in range(50) for a, b in ((i, 50), (50, i))}
    plan = net.similar_pairs(net.word_vectors(table), 0.35)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" in plan and "Join" not in plan


def test_candidates_of_long_texts_are_few(spark):
    """Common words of long texts form no pairs beside a text of one heavy word."""
    texts = [(i, f"common{j}", 0.01) for i in range(50) for j in range(10)]
    texts += [(i, f"own{i // 2}", 0.45) for i in range(50)] + [(99, "common0", 4.0)]
    table = spark.createDataFrame(texts, "ut long, word string, tf_idf double")
    met = net.similarity_candidates(table, 0.5)
    assert met.count() == 25 + 50
    no_rows = table.limit(0)
    assert net.text_similarity_network(no_rows, min_weight=0.5).count() == 0
    unknown = spark.createDataFrame([(None, "own1", 1.0), (3, "own1", None), (7, None, 1.0)], table.schema)
    assert net.similarity_candidates(table.unionByName(unknown), 0.5).count() >= 75


def test_links_with_names_travel_once(spark):
    edges = spark.createDataFrame([(1, 2, 3), (2, 1, 3)], "src int, dst int, weight long")
    people = spark.createDataFrame([(1, "ann"), (2, "bob")], "id_art int, name string")
    for setting, value in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false")):
        spark.conf.set(setting, value)
    try:
        plan = net.project_network(edges, people)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    # Links and people by source, links and people by target, pairs of names.
    assert plan.count("Exchange hashpartitioning") == 5


def test_project_network(spark, rows):
    edges = spark.createDataFrame([(1, 2, 3), (2, 1, 3)], "src int, dst int, weight long")
    people = spark.createDataFrame([(1, "ann"), (2, "bob"), (2, "ann")], "id_art int, name string")
    assert rows(net.project_network(edges, people), "src", "dst", "weight") == {("ann", "bob", 3)}


@pytest.mark.parametrize("name", ["text_similarity_network", "similar_documents"])
def test_copies_keep_all_their_pairs(spark, tmp_path, name):
    """Every two documents that reach the weight are a row each way, equal ones too."""
    import __spark_entry__ as registered

    texts = ["alpha beta", "alpha beta", "alpha beta", "gamma delta", "gamma epsilon", "zeta"]
    spark.createDataFrame([(i, x, f"b{x[0]}", f"t{x[-1]}") for i, x in enumerate(texts)],
                          "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(i, x, "en", "s") for i, x in enumerate(texts)],
                          "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registered.queries()[name](spark, str(tmp_path)).collect()
    assert {(r.src, r.dst) for r in got if r.src < 3} == {(a, b) for a in range(3) for b in range(3) if a != b}
    assert {r.type for r in got} == {"undirected"}


def test_similarity_writes_every_document_once(spark, tmp_path):
    """What lies on disk does not grow with the cells that a document meets."""
    table = spark.createDataFrame([(i, f"word{i % 7}", 0.3) for i in range(400)], "ut long, word string, tf_idf double")
    vectors = net.word_vectors(table).cache()
    written = []
    keep = net.Scratch.write_by
    net.Scratch.write_by = lambda self, df, *args: written.append(df.count()) or keep(self, df, *args)
    try:
        pairs = net.similar_pairs(vectors, 0.3, cell_rows=20)
    finally:
        net.Scratch.write_by = keep
    assert written == [400]
    assert pairs.count() == sum(n * (n - 1) // 2 for n in (len(range(k, 400, 7)) for k in range(7)))


def test_projection_sends_one_direction_and_counts_both(spark, rows):
    """Papers with several names, shared names and loops give what both directions gave."""
    rng = random.Random(3)
    once = [(a, b, rng.randint(1, 4)) for a in range(12) for b in range(a, 12) if rng.random() < 0.5]
    names = {(p, rng.choice("abcdef")) for p in range(12) for _ in range(rng.randint(0, 3))}
    expected = {}
    for src, dst, weight in [r for a, b, w in once for r in ((a, b, w), (b, a, w))]:
        for p, one in names:
            for q, two in names:
                if p == src and q == dst and two > one:
                    expected[one, two] = expected.get((one, two), 0) + weight
    both = net.both_directions(spark.createDataFrame(once, "src int, dst int, weight long"))
    found = net.project_network(both, spark.createDataFrame(list(names), "id_art int, name string"))
    assert rows(found, "src", "dst", "weight") == {(*k, w) for k, w in expected.items()}
    assert "<= dst#" in found._jdf.queryExecution().analyzed().toString()
