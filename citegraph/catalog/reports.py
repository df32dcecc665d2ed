"""Corpus tables and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from citegraph.catalog import query
from citegraph.catalog.text import CLEANING, tokens, top_sql
from citegraph.plans import adapters as a
from citegraph.plans import corpus, reports
from citegraph.plans.adapters import table, with_views

# --- corpus ---------------------------------------------------------------------


@query("enrich_corpus", """
    SELECT c_custkey AS ut, c_name AS doi, c_mktsegment AS abstract, 'k' AS keyword,
           'p' AS keyword_plus, lang AS cluster_id1, r_name AS nsf_discipline,
           n_name AS nsf_specialty
    FROM customer LEFT JOIN documents ON doc_id = c_custkey
    LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey <> 2
    LEFT JOIN region ON r_regionkey = n_regionkey""")
def enrich_corpus(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    docs, r = table(spark, sf_dir, "documents"), table(spark, sf_dir, "region")
    selected = c.select(
        F.col("c_custkey").alias("ut"), F.col("c_mktsegment").alias("abstract"),
        F.lit("k").alias("keyword"), F.lit("p").alias("keyword_plus"),
    )
    details = c.select(F.col("c_custkey").alias("ut"), F.col("c_name").alias("doi"))
    clustering = docs.select(F.col("doc_id").alias("ut"), F.col("lang").alias("cluster_id1"))
    codes = c.select(F.col("c_custkey").alias("ut"), F.col("c_nationkey").alias("journal_code"))
    journals = n.where("n_regionkey <> 2").select(
        F.col("n_nationkey").alias("journal_code"), F.col("n_regionkey").alias("discipline_code"),
        F.col("n_name").alias("nsf_specialty"),
    )
    disciplines = r.select(
        F.col("r_regionkey").alias("discipline_code"), F.col("r_name").alias("nsf_discipline")
    )
    return corpus.enrich_corpus(selected, details, clustering, codes, journals, disciplines)


@query("noun_phrase_table", """
    SELECT l_suppkey AS ut, p_name AS noun_phrase, l_linenumber AS freq, 'title' AS source
    FROM lineitem JOIN part ON p_partkey = l_partkey
    WHERE l_returnflag = 'R'
    UNION SELECT l_suppkey, p_name, l_linenumber, 'abstract'
    FROM lineitem JOIN part ON p_partkey = l_partkey
    WHERE l_returnflag = 'A'""")
def noun_phrase_table(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")

    def phrases(flag: str):
        return lines.where(F.col("l_returnflag") == flag).select(
            F.col("l_suppkey").alias("ut"), F.col("l_partkey").alias("noun_phrase_id"),
            F.col("l_linenumber").alias("freq"),
        )

    names = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("noun_phrase_id"), F.col("p_name").alias("noun_phrase")
    )
    papers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ut"))
    return corpus.noun_phrase_table(papers, phrases("R"), phrases("A"), names)


@query("citation_links", with_views("part_links parts", """
    SELECT citing_ut, cited_ut FROM parts JOIN part_links ON citing_ut = ut
    WHERE macro_cluster = 'ECONOMY'
    UNION SELECT citing_ut, cited_ut FROM parts JOIN part_links ON cited_ut = ut
    WHERE macro_cluster = 'ECONOMY'"""))
def citation_links(spark, sf_dir):
    papers = a.parts(spark, sf_dir).where("macro_cluster = 'ECONOMY'")
    return corpus.citation_links(papers, a.part_links(spark, sf_dir))


@query("altmetric_links", with_views("attention", """
    SELECT c_custkey AS ut, c_name AS doi, s.record_id, twitter, news, policy, total
    FROM customer LEFT JOIN (SELECT c_name AS doi, c_custkey AS record_id FROM customer
                             WHERE c_acctbal > 0) s ON s.doi = c_name
    LEFT JOIN attention t ON t.ut = s.record_id"""))
def altmetric_links(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    papers = c.select(F.col("c_custkey").alias("ut"))
    details = c.select(F.col("c_custkey").alias("ut"), F.col("c_name").alias("doi"))
    records = c.where("c_acctbal > 0").select(
        F.col("c_name").alias("doi"), F.col("c_custkey").alias("record_id")
    )
    counts = a.attention(spark, sf_dir).withColumnRenamed("ut", "record_id")
    return corpus.altmetric_links(papers, details, records, counts)


# --- impact ---------------------------------------------------------------------

NOISE = (2,)


def scored(spark, sf_dir):
    papers = a.customers_as_papers(spark, sf_dir)
    return reports.scored_papers(papers, a.attention(spark, sf_dir), NOISE)


SCORED_SQL = """
    scored AS (SELECT p.*, twitter, news, policy, total
      FROM customers_as_papers p JOIN attention t ON t.ut = p.ut
      WHERE total IS NOT NULL AND (macro_cluster IS NULL OR macro_cluster NOT IN (2)))"""


def impact_sql(level: str) -> str:
    names = {"twitter": "tweets", "news": "news", "policy": "policy", "total": "all_indicators"}
    sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS n_{n}" for c, n in names.items())
    means = ", ".join(f"avg({c}) AS avg_{n}" for c, n in names.items())
    shown = ", ".join(
        f"n_{n}, round(avg_{n}, 6) AS avg_{n}, round((avg_{n} - (SELECT avg(avg_{n}) FROM g))"
        f" / (SELECT stddev_samp(avg_{n}) FROM g), 6) AS z_{n}" for n in names.values()
    )
    return with_views("customers_as_papers attention", f"""WITH {SCORED_SQL},
      g AS (SELECT {level}, count(*) AS n_articles, {sums}, {means} FROM scored GROUP BY {level})
      SELECT {level}, n_articles, {shown} FROM g""")


def _six_digits(df):
    doubles = [c for c, kind in df.dtypes if kind == "double"]
    return df.withColumns({c: F.round(c, 6) for c in doubles})


@query("impact_by_macro_cluster", impact_sql("macro_cluster"))
def impact_by_macro_cluster(spark, sf_dir):
    return _six_digits(reports.impact_by_cluster(scored(spark, sf_dir), "macro_cluster"))


@query("impact_by_meso_cluster", impact_sql("meso_cluster"))
def impact_by_meso_cluster(spark, sf_dir):
    return _six_digits(reports.impact_by_cluster(scored(spark, sf_dir), "meso_cluster"))


def rounded_sql(level: str) -> str:
    names = {"n_cits": "citations", "twitter": "tweets", "news": "news", "policy": "policy",
             "total": "all_indicators"}
    sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS n_{n}" for c, n in names.items())
    means = ", ".join(f"round_even(avg({c}), 2) AS avg_{n}" for c, n in names.items())
    shown = ", ".join(
        f"n_{n}, avg_{n}, round_even((avg_{n} - (SELECT avg(avg_{n}) FROM g))"
        f" / (SELECT stddev_samp(avg_{n}) FROM g), 2) AS z_{n}" for n in names.values()
    )
    return f"""{SCORED_SQL},
      g AS (SELECT {level}, {sums}, {means} FROM scored GROUP BY {level}),
      impact AS (SELECT {level}, {shown} FROM g WHERE {level} IS NOT NULL)"""


def rounded_impact(spark, sf_dir, level: str):
    return reports.impact_by_cluster(
        scored(spark, sf_dir), level, reports.INDICATORS_WITH_CITATIONS, with_count=False,
        round_digits=2, drop_null_cluster=True,
    )


@query("impact_rounded_macro", with_views(
    "customers_as_papers attention", f"WITH {rounded_sql('macro_cluster')} SELECT * FROM impact"))
def impact_rounded_macro(spark, sf_dir):
    return rounded_impact(spark, sf_dir, "macro_cluster")


@query("impact_rounded_meso", with_views(
    "customers_as_papers attention", f"WITH {rounded_sql('meso_cluster')} SELECT * FROM impact"))
def impact_rounded_meso(spark, sf_dir):
    return rounded_impact(spark, sf_dir, "meso_cluster")


def paper_attention(spark, sf_dir):
    """Documents as papers with the events of the user of the same number."""
    papers = a.papers(spark, sf_dir).select("ut", "macro_cluster", "meso_cluster")
    return reports.scored_papers(papers, a.attention(spark, sf_dir))


@query("cluster_profile", with_views("papers attention", f"""
    WITH {CLEANING}, {top_sql('macro_cluster', 'macro_cluster')},
    g AS (SELECT macro_cluster, avg(twitter) AS t, avg(news) AS n, avg(policy) AS p,
                 avg(total) AS a
      FROM papers JOIN attention USING (ut) GROUP BY macro_cluster),
    z AS (SELECT macro_cluster,
        (t - (SELECT avg(t) FROM g)) / (SELECT stddev_samp(t) FROM g) AS z_tweets,
        (n - (SELECT avg(n) FROM g)) / (SELECT stddev_samp(n) FROM g) AS z_news,
        (p - (SELECT avg(p) FROM g)) / (SELECT stddev_samp(p) FROM g) AS z_policy,
        (a - (SELECT avg(a) FROM g)) / (SELECT stddev_samp(a) FROM g) AS z_all_indicators
      FROM g)
    SELECT coalesce(l.macro_cluster, z.macro_cluster) AS macro_cluster, npapers,
           round(z_tweets, 6) AS z_tweets, round(z_news, 6) AS z_news,
           round(z_policy, 6) AS z_policy, round(z_all_indicators, 6) AS z_all_indicators
    FROM lines l FULL JOIN (SELECT * FROM z WHERE macro_cluster IS NOT NULL) z
      ON z.macro_cluster = l.macro_cluster WHERE z_all_indicators IS NOT NULL"""))
def cluster_profile(spark, sf_dir):
    words = reports.cluster_words(tokens(spark, sf_dir), "macro_cluster")
    impact = reports.impact_by_cluster(
        paper_attention(spark, sf_dir), "macro_cluster", drop_null_cluster=True
    )
    return _six_digits(reports.cluster_profile(words, impact, "macro_cluster"))


# --- people and institutions --------------------------------------------------------

FLAGS = {"Brand#1": "Brand1", "Brand#7": "Brand7", "ECONOMY": "Economy", "PROMO": "Promo"}


@query("institution_flags", with_views("affiliations", """
    WITH codes AS (SELECT id_art, unnest(string_split(Affiliation, ' ')) AS code
                   FROM affiliations WHERE Affiliation <> '')
    SELECT a.id_art AS id, a.Title AS label, a.Year,
      CAST(EXISTS (FROM codes c WHERE c.id_art = a.id_art AND code = 'Brand#1') AS INTEGER)
        AS Brand1,
      CAST(EXISTS (FROM codes c WHERE c.id_art = a.id_art AND code = 'Brand#7') AS INTEGER)
        AS Brand7,
      CAST(EXISTS (FROM codes c WHERE c.id_art = a.id_art AND code = 'ECONOMY') AS INTEGER)
        AS Economy,
      CAST(EXISTS (FROM codes c WHERE c.id_art = a.id_art AND code = 'PROMO') AS INTEGER)
        AS Promo
    FROM affiliations a"""))
def institution_flags(spark, sf_dir):
    return reports.institution_flags(a.affiliations(spark, sf_dir), FLAGS)


@query("cluster_sizes", """
    SELECT o_orderpriority AS cluster, count(DISTINCT o_orderkey) AS n FROM orders
    GROUP BY o_orderpriority HAVING count(DISTINCT o_orderkey) >= 10""")
def cluster_sizes(spark, sf_dir):
    return reports.cluster_sizes(a.order_clusters(spark, sf_dir))


SHARES_SQL = """
    kept AS (SELECT cluster FROM order_clusters GROUP BY cluster
             HAVING count(DISTINCT id_art) >= 10),
    final AS (SELECT DISTINCT PersonID, p.id_art, Title, Affiliation, Year, cluster
      FROM people p JOIN order_clusters USING (id_art) JOIN kept USING (cluster)),
    person AS (SELECT PersonID, cluster, count(*) / max(person_total) AS pct_cluster FROM (
      SELECT PersonID, id_art, count(*) OVER (PARTITION BY PersonID) AS person_total
      FROM (SELECT DISTINCT PersonID, id_art FROM final))
      LEFT JOIN order_clusters USING (id_art) GROUP BY PersonID, cluster),
    shares AS (SELECT f.PersonID, Affiliation, Year, f.cluster, pct_cluster
      FROM (SELECT DISTINCT PersonID, Affiliation, Year, cluster FROM final) f
      LEFT JOIN person p ON p.PersonID = f.PersonID AND p.cluster = f.cluster)"""


def shares(spark, sf_dir):
    clusters = a.order_clusters(spark, sf_dir)
    people = reports.people_in_clusters(a.people(spark, sf_dir), clusters)
    return reports.person_cluster_share(people, clusters)


@query("people_in_clusters", with_views(
    "people order_clusters", f"WITH {SHARES_SQL} SELECT * FROM final"))
def people_in_clusters(spark, sf_dir):
    return reports.people_in_clusters(a.people(spark, sf_dir), a.order_clusters(spark, sf_dir))


@query("person_cluster_share", with_views(
    "people order_clusters", f"""WITH {SHARES_SQL}
    SELECT PersonID, Affiliation, Year, cluster, round(pct_cluster, 6) AS pct_cluster FROM shares"""))
def person_cluster_share(spark, sf_dir):
    return shares(spark, sf_dir).withColumn("pct_cluster", F.round("pct_cluster", 6))


@query("institution_cluster_share", with_views("people order_clusters", f"""
    WITH {SHARES_SQL} SELECT Affiliation, cluster, round(sum(pct_cluster), 4) AS total
    FROM (SELECT DISTINCT Affiliation, cluster, pct_cluster FROM shares)
    GROUP BY Affiliation, cluster"""))
def institution_cluster_share(spark, sf_dir):
    totals = reports.institution_cluster_share(shares(spark, sf_dir))
    return totals.withColumn("total", F.round("total", 4))


@query("institution_cluster_share_all", with_views("people order_clusters", f"""
    WITH {SHARES_SQL} SELECT Affiliation, cluster, round(sum(pct_cluster), 4) AS total
    FROM shares GROUP BY Affiliation, cluster"""))
def institution_cluster_share_all(spark, sf_dir):
    totals = reports.institution_cluster_share(shares(spark, sf_dir), dedupe=False)
    return totals.withColumn("total", F.round("total", 4))
