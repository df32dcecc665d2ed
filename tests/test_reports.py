import statistics

import pytest
from pyspark.sql import functions as F

from citegraph.functions import nulls
from citegraph.operators import relational as rel
from citegraph.plans import reports
from citegraph.scratch import number_rows, running_total


def test_not_in_keeps_null(spark, rows):
    df = spark.createDataFrame([(1,), (2,), (None,)], "c int")
    assert rows(df.where(nulls.not_in_keep_null("c", (2,))), "c") == {(1,), (None,)}
    assert df.where(nulls.not_in_keep_null("c", ())).count() == 3


def test_null_policies(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2)], "g string, x int")
    got = {r.g: (r.s, r.p, r.u) for r in df.groupBy("g").agg(
        nulls.sum_of("x").alias("s"), nulls.sum_of("x", "propagate").alias("p"),
        nulls.distinct_with_null("x").alias("u")).collect()}
    assert got == {"a": (1, None, 2), "b": (2, 2, 1)}


def scored(spark, groups):
    data = [(i, g, v, v, v, v) for i, (g, v) in enumerate(groups)]
    return spark.createDataFrame(data, "ut int, k int, twitter int, news int, policy int, total int")


def test_missing_cluster_takes_part_in_scores(spark):
    groups = [(1, 1), (2, 2), (3, 3), (None, 10)]
    table = reports.impact_by_cluster(scored(spark, groups), "k", drop_null_cluster=True)
    values = [1, 2, 3, 10]
    mean, sd = statistics.mean(values), statistics.stdev(values)
    got = {r.k: r.z_tweets for r in table.collect()}
    assert got == pytest.approx({k: (k - mean) / sd for k in (1, 2, 3)})


def test_degenerate_scores_are_null(spark):
    for groups in ([(1, 5), (2, 5)], [(1, 5)]):
        table = reports.impact_by_cluster(scored(spark, groups), "k")
        assert {r.z_news for r in table.collect()} == {None}


def test_means_are_rounded_before_scoring(spark):
    groups = [(1, 1), (1, 1), (1, 2), (2, 4), (3, 9)]
    table = reports.impact_by_cluster(scored(spark, groups), "k", round_digits=2)
    got = {r.k: (r.avg_tweets, r.z_tweets) for r in table.collect()}
    values = [1.33, 4.0, 9.0]
    mean, sd = statistics.mean(values), statistics.stdev(values)
    assert got == {k: (v, round((v - mean) / sd, 2)) for k, v in zip((1, 2, 3), values)}


def test_profile_keeps_clusters_with_scores(spark, rows):
    words = spark.createDataFrame([(1, 4, "w"), (2, 5, "v")], "k int, npapers long, words string")
    impact = spark.createDataFrame([(1, 0.5), (3, -0.5)], "k int, z_all_indicators double")
    got = reports.cluster_profile(words, impact, "k")
    assert rows(got, "k", "npapers", "z_all_indicators") == {(1, 4, 0.5), (3, None, -0.5)}


def test_topics_by_community(spark):
    data = [(1, 18, 2, 0.46, 0.05, 0.46), (2, 18, 1, 0.48, 0.48, 0.01), (3, 4, 1, 0.3, 0.3, 0.2)]
    vertices = spark.createDataFrame(
        data, "name int, community int, topic int, gamma double, gamma1 double, gamma2 double")
    got = {r.community: r for r in reports.topics_by_community(vertices, k=2).collect()}
    assert (got[18].npapers, got[18].ntopic, got[18].most_topic) == (2, 2, 1)
    assert got[18].most_topic_median == pytest.approx(0.47)
    assert (got[18].gamma1, got[18].gamma2) == (0.48, 0.46)
    low = vertices.withColumn("gamma2", F.lit(0.01))
    assert reports.topics_by_community(low, k=2).where("gamma2 is not null").count() == 0


@pytest.mark.parametrize("sizes", [(1, 2, 7, 40), (5,)])
def test_grouped_median_matches_the_built_in(spark, rows, sizes):
    data = [(g if g else None, float((i * 7919) % 13)) for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(data + [(1, None)], "g int, x double")
    expected = df.where("x is not null").groupBy("g").agg(F.median("x").alias("m"))
    assert rows(rel.grouped_median(df, ["g"], "x", "m"), "g", "m") == rows(expected, "g", "m")


def test_numbers_and_totals_run_across_partitions(spark, rows):
    df = spark.range(0, 5000, 1, 6).withColumn("k", (F.col("id") * 7919) % 5000)
    numbered = number_rows(df, [F.col("k")], "n")
    assert numbered.where("n <> k + 1").count() == 0
    totals = running_total(df, [F.col("k")], "k", "s")
    assert totals.where("s <> k * (k + 1) div 2").count() == 0


def test_running_numbers(spark, rows):
    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (4, 1), (4, 2)], "p int, c int")
    got = rel.running_numbers(pairs, "p", "c", "g")
    assert rows(got, "p", "c", "g") == {(1, 1, 1), (1, 2, 2), (2, 1, 3), (4, 1, 4), (4, 2, 5)}


def test_flags_do_not_repeat_rows(spark, rows):
    papers = spark.createDataFrame(
        [(1, "t", 2000, "MCGILL-UNIV MCGILL-UNIV X"), (2, "u", 2001, "")],
        "id_art int, Title string, Year int, Affiliation string")
    got = reports.institution_flags(papers)
    assert rows(got, "id", "label", "McGill", "Toronto") == {(1, "t", 1, 0), (2, "u", 0, 0)}
    assert len(got.columns) == 11


def test_shares(spark, rows):
    people = spark.createDataFrame(
        [(1, 10, "t", "A", 2000), (1, 11, "t", "A", 2000), (2, 10, "t", "A", 2000),
         (2, 11, "t", "A", 2000)],
        "PersonID int, id_art int, Title string, Affiliation string, Year int")
    clusters = spark.createDataFrame([(10, "x"), (11, "y")], "id_art int, cluster string")
    kept = reports.people_in_clusters(people, clusters, min_size=1)
    shares = reports.person_cluster_share(kept, clusters)
    assert rows(shares, "PersonID", "cluster", "pct_cluster") == {
        (1, "x", 0.5), (1, "y", 0.5), (2, "x", 0.5), (2, "y", 0.5)}
    once = reports.institution_cluster_share(shares)
    every = reports.institution_cluster_share(shares, dedupe=False)
    assert rows(once, "cluster", "total") == {("x", 0.5), ("y", 0.5)}
    assert rows(every, "cluster", "total") == {("x", 1.0), ("y", 1.0)}
    assert reports.cluster_sizes(clusters).count() == 0


def test_recode_and_cast(spark, rows):
    df = spark.createDataFrame([("28",), ("7",), ("x",)], "cluster string")
    assert rows(rel.recode(df, "cluster"), "cluster") == {("20",), ("7",), ("x",)}
    assert rows(rel.to_integer(df, "cluster"), "cluster") == {(28,), (7,), (None,)}
