"""Paper networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from citegraph import fixed_values as fixed
from citegraph.catalog import query
from citegraph.operators import networks as net
from citegraph.operators.text import term_counts, tf_idf
from citegraph.plans import adapters as a
from citegraph.plans.adapters import with_views

CO_CITATION_SQL = """
    SELECT x.cited_ut AS src, y.cited_ut AS dst, count(*) AS weight, 'undirected' AS type
    FROM order_part_links x JOIN order_part_links y
      ON y.citing_ut = x.citing_ut AND y.cited_ut > x.cited_ut
    GROUP BY x.cited_ut, y.cited_ut"""

COUPLING_SQL = """
    SELECT x.citing_ut AS src, y.citing_ut AS dst, count(*) AS weight, 'undirected' AS type
    FROM part_links x JOIN part_links y
      ON y.cited_ut = x.cited_ut AND y.citing_ut > x.citing_ut
    GROUP BY x.citing_ut, y.citing_ut"""


def co_cited_parts(spark, sf_dir):
    return net.co_citation(a.parts(spark, sf_dir), a.order_part_links(spark, sf_dir))


@query("co_citation", with_views("order_part_links", CO_CITATION_SQL))
def co_citation(spark, sf_dir):
    return co_cited_parts(spark, sf_dir)


@query("bibliographic_coupling", with_views("part_links", COUPLING_SQL))
def bibliographic_coupling(spark, sf_dir):
    return net.bibliographic_coupling(a.parts(spark, sf_dir), a.part_links(spark, sf_dir))


@query("direct_citation", with_views("part_links", """
    SELECT citing_ut AS src, cited_ut AS dst, 1 AS weight, 'directed' AS type FROM part_links"""))
def direct_citation(spark, sf_dir):
    return net.direct_citation(a.parts(spark, sf_dir), a.part_links(spark, sf_dir))


@query("combined_network", with_views("order_part_links part_links", f"""
    SELECT src, dst, type, CAST(sum(weight) AS BIGINT) AS weight
    FROM ({CO_CITATION_SQL} UNION ALL {COUPLING_SQL}) GROUP BY src, dst, type"""))
def combined_network(spark, sf_dir):
    return net.combine_networks(co_citation(spark, sf_dir), bibliographic_coupling(spark, sf_dir))


@query("keyword_cooccurrence", with_views("part_keywords", """
    SELECT x.keyword AS src, y.keyword AS dst, count(DISTINCT x.ut) AS weight,
           'undirected' AS type
    FROM part_keywords x JOIN part_keywords y ON y.ut = x.ut AND y.keyword > x.keyword
    WHERE x.keyword <> 'NULL' AND y.keyword <> 'NULL' GROUP BY x.keyword, y.keyword"""))
def keyword_cooccurrence(spark, sf_dir):
    return net.keyword_cooccurrence(a.part_keywords(spark, sf_dir))


# tf-idf of the keywords of a part, as SQL.
KEYWORD_SCORES_SQL = """
    counts AS (SELECT ut, keyword AS word, count(*) AS n FROM part_keywords GROUP BY ut, keyword),
    scores AS (SELECT c.ut, c.word, n, n / t.total
        * ln((SELECT count(DISTINCT ut) FROM counts) / h.holders) AS tf_idf
      FROM counts c JOIN (SELECT ut, sum(n) AS total FROM counts GROUP BY ut) t ON t.ut = c.ut
      JOIN (SELECT word, count(*) AS holders FROM counts GROUP BY word) h ON h.word = c.word)"""


def keyword_scores(spark, sf_dir):
    keywords = a.part_keywords(spark, sf_dir).withColumnRenamed("keyword", "word")
    return tf_idf(term_counts(keywords, "ut"))


@query("text_similarity_network", with_views("part_keywords", f"""
    WITH {KEYWORD_SCORES_SQL}
    SELECT x.ut AS src, y.ut AS dst, round(sum((x.tf_idf + y.tf_idf) / 2), 6) AS weight,
           'undirected' AS type
    FROM scores x JOIN scores y ON y.word = x.word AND y.ut <> x.ut
    GROUP BY x.ut, y.ut HAVING sum((x.tf_idf + y.tf_idf) / 2) >= 0.5"""))
def text_similarity_network(spark, sf_dir):
    edges = net.text_similarity_network(keyword_scores(spark, sf_dir), min_weight=fixed.MIN_SIMILARITY)
    return edges.withColumn("weight", F.round("weight", 6))


@query("projected_network", with_views("order_part_links people", """
    WITH e AS (SELECT x.citing_ut AS src, y.citing_ut AS dst, count(*) AS weight
      FROM order_part_links x JOIN order_part_links y
        ON y.cited_ut = x.cited_ut AND y.citing_ut <> x.citing_ut
      GROUP BY x.citing_ut, y.citing_ut)
    SELECT p.name AS src, q.name AS dst, CAST(sum(weight) AS BIGINT) AS weight,
           'undirected' AS type
    FROM e JOIN people p ON p.id_art = e.src
    JOIN people q ON q.id_art = e.dst AND q.name > p.name GROUP BY p.name, q.name"""))
def projected_network(spark, sf_dir):
    coupled = net.bibliographic_coupling(
        a.orders_as_papers(spark, sf_dir), a.order_part_links(spark, sf_dir)
    )
    return net.project_network(net.both_directions(coupled), a.people(spark, sf_dir))


@query("simplified_network", with_views("part_links", """
    SELECT least(citing_ut, cited_ut) AS src, greatest(citing_ut, cited_ut) AS dst,
           CAST(count(*) AS DOUBLE) AS weight
    FROM part_links WHERE citing_ut <> cited_ut GROUP BY ALL"""))
def simplified_network(spark, sf_dir):
    return net.simplify(direct_citation(spark, sf_dir))


@query("unweighted_network", with_views("part_links", """
    SELECT DISTINCT least(citing_ut, cited_ut) AS src, greatest(citing_ut, cited_ut) AS dst,
           CAST(1 AS DOUBLE) AS weight FROM part_links WHERE citing_ut <> cited_ut"""))
def unweighted_network(spark, sf_dir):
    return net.simplify(direct_citation(spark, sf_dir), None)


@query("induced_network", with_views("order_part_links parts", f"""
    WITH e AS ({CO_CITATION_SQL})
    SELECT e.src, e.dst, weight, p.macro_cluster AS cluster FROM e
    JOIN parts p ON p.ut = e.src
    JOIN parts q ON q.ut = e.dst AND q.macro_cluster = p.macro_cluster"""))
def induced_network(spark, sf_dir):
    inside = net.induced_edges(co_citation(spark, sf_dir), a.parts(spark, sf_dir), "macro_cluster")
    return inside.select("src", "dst", "weight", F.col("macro_cluster").alias("cluster"))


@query("graph_tables", with_views("order_part_links parts", """
    SELECT ut, macro_cluster AS community FROM parts WHERE ut IN (
      SELECT x.cited_ut FROM order_part_links x JOIN order_part_links y
        ON y.citing_ut = x.citing_ut AND y.cited_ut <> x.cited_ut)"""))
def graph_tables(spark, sf_dir):
    membership = a.parts(spark, sf_dir).select("ut", F.col("macro_cluster").alias("community"))
    _, _, members = net.graph_tables(co_citation(spark, sf_dir), membership)
    return members


def _supernode_sql(level: str, ends: str, keep: str) -> str:
    return with_views("order_part_links parts", f"""
    WITH e AS ({CO_CITATION_SQL})
    SELECT {ends}, type, CAST(sum(weight) AS BIGINT) AS weight
    FROM e JOIN parts p ON p.ut = e.src JOIN parts q ON q.ut = e.dst
    WHERE q.{level} {keep} p.{level} GROUP BY ALL""")


def _canonical(level: str) -> str:
    pair = f"p.{level}, q.{level}"
    return _supernode_sql(level, f"least({pair}) AS src, greatest({pair}) AS dst", "<>")


@query("supernode_graph_macro", _canonical("macro_cluster"))
def supernode_graph_macro(spark, sf_dir):
    edges = co_citation(spark, sf_dir)
    return net.supernode_graph(edges, a.parts(spark, sf_dir), "macro_cluster")


@query("supernode_graph_meso", _canonical("meso_cluster"))
def supernode_graph_meso(spark, sf_dir):
    return net.supernode_graph(co_citation(spark, sf_dir), a.parts(spark, sf_dir), "meso_cluster")


@query("supernode_graph_as_ordered",
       _supernode_sql("macro_cluster", "p.macro_cluster AS src, q.macro_cluster AS dst", ">"))
def supernode_graph_as_ordered(spark, sf_dir):
    edges = co_citation(spark, sf_dir)
    return net.supernode_graph(edges, a.parts(spark, sf_dir), "macro_cluster", canonical=False)
