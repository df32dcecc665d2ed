"""Components, communities and graph measures."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from citegraph.catalog import query
from citegraph.catalog.networks import CO_CITATION_SQL, co_cited_parts, keyword_cooccurrence
from citegraph.operators.graph import metrics
from citegraph.operators.graph.components import (
    connected_components, keep_vertices, main_component,
)
from citegraph.operators.graph.greedy import greedy_modularity
from citegraph.operators.graph.label_propagation import label_propagation
from citegraph.operators.graph.leading_eigenvector import leading_eigenvector
from citegraph.operators.graph.louvain import louvain, nested_louvain
from citegraph.operators.graph.walktrap import walktrap
from citegraph.plans import adapters as a
from citegraph.plans import maps, reports
from citegraph.plans.adapters import table, with_views
from citegraph.scratch import Scratch


def co_citation_links(spark, sf_dir):
    """The whole co-citation network."""
    return Scratch(spark, "links").save(
        co_cited_parts(spark, sf_dir).select("src", "dst", "weight"))


def keyword_links(spark, sf_dir):
    """The main component of the keyword network."""
    links = Scratch(spark, "links").save(keyword_cooccurrence(spark, sf_dir).select("src", "dst"))
    return keep_vertices(links, main_component(links))


BOTH_SQL = f"""
    links AS (SELECT src, dst, weight FROM ({CO_CITATION_SQL})),
    both_ways AS (SELECT src, dst, weight FROM links
                  UNION ALL SELECT dst, src, weight FROM links)"""


def _components_sql(rounds: int = 8) -> str:
    """Smallest label within ``rounds`` links of every vertex; the network is far less deep."""
    text = "c0 AS MATERIALIZED (SELECT DISTINCT src AS id, src AS component FROM both_ways)"
    for i in range(rounds):
        text += f""",
    c{i + 1} AS MATERIALIZED (SELECT id, min(component) AS component FROM (
      SELECT * FROM c{i} UNION ALL
      SELECT e.src, c.component FROM both_ways e JOIN c{i} c ON c.id = e.dst) GROUP BY id)"""
    return text + f", components AS (SELECT * FROM c{rounds})"


def _recursive(body: str) -> str:
    return with_views("order_part_links", f"WITH {BOTH_SQL}, {_components_sql()}{body}")


@query("connected_components", _recursive(" SELECT id, component FROM components"))
def components(spark, sf_dir):
    return connected_components(co_citation_links(spark, sf_dir))


LARGEST_SQL = """,
    main AS (SELECT id FROM components WHERE component = (
      SELECT component FROM components GROUP BY component
      ORDER BY count(*) DESC, component LIMIT 1))"""


@query("main_component", _recursive(LARGEST_SQL + " SELECT id FROM main"))
def main_component_vertices(spark, sf_dir):
    return main_component(co_citation_links(spark, sf_dir))


@query("first_component", _recursive(
    " SELECT id FROM components WHERE component = (SELECT min(component) FROM components)"))
def first_component_vertices(spark, sf_dir):
    return main_component(co_citation_links(spark, sf_dir), "first")


# --- measures --------------------------------------------------------------------


@query("edge_density", with_views("order_part_links", f"""WITH {BOTH_SQL}
    SELECT n_vertices, n_edges, round(2.0 * n_edges / (n_vertices * (n_vertices - 1)), 6) AS density
    FROM (SELECT count(DISTINCT src) AS n_vertices FROM both_ways),
         (SELECT count(*) AS n_edges FROM links)"""))
def edge_density(spark, sf_dir):
    row = metrics.edge_density(co_citation_links(spark, sf_dir))
    return row.withColumn("density", F.round("density", 6))


@query("degree", with_views("order_part_links", f"""
    WITH edges AS ({CO_CITATION_SQL}) SELECT id, count(*) AS degree FROM (
      SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id"""))
def degree(spark, sf_dir):
    return metrics.degree(co_cited_parts(spark, sf_dir))


@query("modularity", with_views("order_part_links parts", f"""
    WITH edges AS ({CO_CITATION_SQL}),
    placed AS (SELECT p.macro_cluster AS a, q.macro_cluster AS b, weight FROM edges
      JOIN parts p ON p.ut = src JOIN parts q ON q.ut = dst),
    ends AS (SELECT a AS c, weight AS k, CASE WHEN a = b THEN weight ELSE 0 END AS w FROM placed
      UNION ALL SELECT b, weight, 0 FROM placed),
    sums AS (SELECT c, sum(k) AS k, sum(w) AS w FROM ends GROUP BY c)
    SELECT count(*) AS n_communities,
           round(2 * sum(w) / sum(k) - sum(k * k) / (sum(k) * sum(k)), 6) AS modularity
    FROM sums"""))
def modularity(spark, sf_dir):
    membership = a.parts(spark, sf_dir).select(
        F.col("ut").alias("id"), F.col("macro_cluster").alias("community")
    )
    row = metrics.modularity(co_cited_parts(spark, sf_dir), membership)
    return row.withColumn("modularity", F.round("modularity", 6))


def _power_sql(rounds: int) -> str:
    text = "v0 AS MATERIALIZED (SELECT DISTINCT src AS id, CAST(1 AS DOUBLE) AS x FROM both_ways)"
    for i in range(1, rounds + 1):
        text += f""",
    v{i} AS MATERIALIZED (SELECT id, sum(x) AS x FROM (
      SELECT e.src AS id, v.x FROM both_ways e JOIN v{i - 1} v ON v.id = e.dst
      UNION ALL SELECT id, x FROM v{i - 1}) GROUP BY id)"""
    return text


@query("eigenvector_centrality", with_views("order_part_links", f"""
    WITH {BOTH_SQL}, {_power_sql(20)}
    SELECT id, round(x / (SELECT max(x) FROM v20), 6) AS centrality FROM v20"""))
def eigenvector_centrality(spark, sf_dir):
    scores = metrics.eigenvector_centrality(co_citation_links(spark, sf_dir))
    return scores.select("id", F.round("centrality", 6).alias("centrality"))


# All shortest paths of the keyword network, level by level; deeper than it is.
DEPTH = 8


def _paths_sql() -> str:
    text = """
    pairs AS (SELECT DISTINCT x.keyword AS src, y.keyword AS dst FROM part_keywords x
      JOIN part_keywords y ON y.ut = x.ut AND y.keyword <> x.keyword
      WHERE x.keyword <> 'NULL' AND y.keyword <> 'NULL'),
    p0 AS MATERIALIZED (SELECT DISTINCT src AS a, src AS b, 0 AS d, CAST(1 AS DOUBLE) AS paths FROM pairs),
    s0 AS (SELECT * FROM p0)"""
    for i in range(1, DEPTH + 1):
        text += f""",
    p{i} AS MATERIALIZED (SELECT n.* FROM (SELECT p.a, e.dst AS b, {i} AS d, sum(p.paths) AS paths
        FROM p{i - 1} p JOIN pairs e ON e.src = p.b GROUP BY p.a, e.dst) n
      WHERE NOT EXISTS (SELECT 1 FROM s{i - 1} s WHERE s.a = n.a AND s.b = n.b)),
    s{i} AS MATERIALIZED (SELECT * FROM s{i - 1} UNION ALL SELECT * FROM p{i})"""
    return text + f""",
    root AS (SELECT b AS id, min(a) AS component FROM s{DEPTH} GROUP BY b),
    main AS (SELECT id FROM root WHERE component = (SELECT component FROM root
      GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)),
    paths AS MATERIALIZED (SELECT s.* FROM s{DEPTH} s WHERE a IN (SELECT id FROM main))"""


@query("closeness", with_views("part_keywords", f"""WITH {_paths_sql()}
    SELECT a AS id, CAST(sum(d) AS BIGINT) AS farness, count(*) - 1 AS reached,
           round(1.0 / sum(d), 9) AS closeness FROM paths GROUP BY a"""))
def closeness(spark, sf_dir):
    scores = metrics.closeness(keyword_links(spark, sf_dir))
    return scores.withColumn("closeness", F.round("closeness", 9))


@query("closeness_co_citation")
def closeness_of_parts(spark, sf_dir):
    """Closeness in the whole co-citation network, estimated."""
    return metrics.estimated_closeness(co_citation_links(spark, sf_dir))


@query("betweenness", with_views("part_keywords", f"""WITH {_paths_sql()},
    through AS (SELECT v.b AS id, sum(v.paths * w.paths / t.paths) AS score
      FROM paths v JOIN paths w ON w.a = v.b JOIN paths t ON t.a = v.a AND t.b = w.b
      WHERE v.d > 0 AND w.d > 0 AND t.d = v.d + w.d AND v.a < w.b GROUP BY v.b)
    SELECT m.id, round(coalesce(score, 0), 4) AS betweenness
    FROM main m LEFT JOIN through t ON t.id = m.id"""))
def betweenness(spark, sf_dir):
    scores = metrics.betweenness(keyword_links(spark, sf_dir))
    return scores.select("id", F.round("betweenness", 4).alias("betweenness"))


@query("betweenness_co_citation")
def betweenness_of_parts(spark, sf_dir):
    """Betweenness in the whole co-citation network, estimated within one hundredth of all pairs."""
    return metrics.sampled_betweenness(co_citation_links(spark, sf_dir))


# --- communities -------------------------------------------------------------------

DETECTORS = {
    "louvain": lambda e: louvain(e).select("id", "community"),
    "label_propagation": lambda e: label_propagation(e, "weight"),
    "leading_eigenvector": lambda e: leading_eigenvector(e, "weight"),
    "greedy_modularity": lambda e: greedy_modularity(e, "weight"),
    "walktrap": lambda e: walktrap(e, weight_col="weight"),
}

# The planted communities, named by their smallest member.
NATIONS_SQL = with_views("placed_customers", """
    SELECT id, min(id) OVER (PARTITION BY nation) AS community FROM placed_customers""")


def _planted(spark, sf_dir):
    return Scratch(spark, "planted").save(a.nation_network(spark, sf_dir))


def _detected(spark, sf_dir, name: str, links=None):
    """Communities of the planted network, or of ``links``, named by their smallest member."""
    links = _planted(spark, sf_dir) if links is None else links
    found = Scratch(spark, name).save(DETECTORS[name](links))
    names = found.groupBy("community").agg(F.min("id").alias("name"))
    return found.join(names, "community").select("id", F.col("name").alias("community"))


@query("louvain_communities", NATIONS_SQL)
def louvain_communities(spark, sf_dir):
    return _detected(spark, sf_dir, "louvain")


@query("label_propagation", NATIONS_SQL)
def label_propagation_communities(spark, sf_dir):
    links = Scratch(spark, "planted").save(a.anchored_network(spark, sf_dir))
    return _detected(spark, sf_dir, "label_propagation", links)


@query("label_propagation_co_citation")
def label_propagation_of_parts(spark, sf_dir):
    """Labels of the whole co-citation network."""
    return _detected(spark, sf_dir, "label_propagation", co_citation_links(spark, sf_dir))


@query("leading_eigenvector_co_citation")
def leading_eigenvector_of_parts(spark, sf_dir):
    """Splits of the whole co-citation network."""
    return _detected(spark, sf_dir, "leading_eigenvector", co_citation_links(spark, sf_dir))


@query("leading_eigenvector_communities")
def leading_eigenvector_communities(spark, sf_dir):
    return _detected(spark, sf_dir, "leading_eigenvector")


@query("greedy_modularity_communities", NATIONS_SQL)
def greedy_modularity_communities(spark, sf_dir):
    return _detected(spark, sf_dir, "greedy_modularity")


@query("walktrap_communities", NATIONS_SQL)
def walktrap_communities(spark, sf_dir):
    return _detected(spark, sf_dir, "walktrap")


@query("compare_modularity")
def compare_modularity(spark, sf_dir):
    links = _planted(spark, sf_dir)
    # Many short jobs each: side by side they fill the executors.
    with ThreadPoolExecutor(len(DETECTORS)) as pool:
        found = dict(zip(DETECTORS, pool.map(
            lambda name: _detected(spark, sf_dir, name, links), DETECTORS)))
    rows = metrics.compare_modularity(links, found)
    return rows.withColumn("modularity", F.round("modularity", 6))


# Regions and nations, named by their smallest member.
NESTED_SQL = """
    named AS (SELECT id AS ut, min(id) OVER (PARTITION BY region) AS macro_cluster,
                     min(id) OVER (PARTITION BY nation) AS meso_cluster FROM placed_customers)"""


def found_levels(spark, sf_dir, levels=("macro_cluster", "meso_cluster")):
    """Customers with the clusters found in their network, named as above."""
    links = Scratch(spark, "planted").save(a.region_network(spark, sf_dir))
    articles = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ut"))
    found = Scratch(spark, "nested").save(nested_louvain(articles, links, levels))
    for level in levels:
        names = found.groupBy(level).agg(F.min("ut").alias("_name"))
        found = found.join(names, level).drop(level).withColumnRenamed("_name", level)
    return found.select("ut", *levels)


@query("nested_louvain", with_views(
    "placed_customers", f"WITH {NESTED_SQL} SELECT ut, macro_cluster, meso_cluster FROM named"))
def nested_clusters(spark, sf_dir):
    """Regions and nations, each named by its smallest member."""
    return found_levels(spark, sf_dir)


def _found_impact_sql() -> str:
    names = {"twitter": "tweets", "news": "news", "policy": "policy", "total": "all_indicators"}
    sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS n_{n}, avg({c}) AS avg_{n}" for c, n in names.items())
    levels, rows = [], []
    for level in ("macro_cluster", "meso_cluster"):
        scores = ", ".join(
            f"n_{n}, round(avg_{n}, 6) AS avg_{n}, round((avg_{n} - (SELECT avg(avg_{n}) FROM {level}_g))"
            f" / (SELECT stddev_samp(avg_{n}) FROM {level}_g), 6) AS z_{n}" for n in names.values())
        levels.append(f"{level}_g AS (SELECT {level} AS cluster, count(*) AS n_articles, {sums}"
                      f" FROM scored GROUP BY {level})")
        rows.append(f"SELECT '{level}' AS level, cluster, n_articles, {scores} FROM {level}_g")
    return with_views("placed_customers attention", f"""WITH {NESTED_SQL},
      scored AS (SELECT n.*, twitter, news, policy, total FROM named n JOIN attention t ON t.ut = n.ut
                 WHERE total IS NOT NULL),
      {", ".join(levels)} {" UNION ALL ".join(rows)}""")


@query("impact_of_found_clusters", _found_impact_sql())
def impact_of_found_clusters(spark, sf_dir):
    """Network, nested communities and their impact, in one chain."""
    papers = Scratch(spark, "levels").save(found_levels(spark, sf_dir))
    scored = Scratch(spark, "scored").save(
        reports.scored_papers(papers, a.attention(spark, sf_dir), noise=()))
    rows = None
    for level in ("macro_cluster", "meso_cluster"):
        impact = reports.impact_by_cluster(scored, level).withColumnRenamed(level, "cluster")
        part = impact.select(F.lit(level).alias("level"), *impact.columns)
        rows = part if rows is None else rows.unionByName(part)
    doubles = [c for c, kind in rows.dtypes if kind == "double"]
    return rows.withColumns({c: F.round(c, 6) for c in doubles})


# --- one chain from a network to reports --------------------------------------------------

MAP_LEVELS = maps.LEVELS

# The links inside a nation are a star, whose best split is the nation as a whole.
MAP_SQL = f"""{NESTED_SQL},
    levels AS (SELECT *, meso_cluster AS micro_cluster FROM named),
    first AS (SELECT region, nation, min(id) AS dst FROM placed_customers GROUP BY region, nation),
    heads AS (SELECT region, min(id) AS id FROM placed_customers GROUP BY region),
    net AS (
      SELECT p.id AS src, f.dst, CAST(CASE WHEN p.nation = f.nation THEN {a.OWN} ELSE {a.OTHER} END AS DOUBLE) AS weight
      FROM placed_customers p JOIN first f ON f.region = p.region WHERE p.id <> f.dst
      UNION ALL SELECT x.id, y.id, CAST({a.BRIDGE} AS DOUBLE) FROM heads x JOIN heads y ON y.region = x.region + 1)"""


def _map_links_sql() -> str:
    return " UNION ALL ".join(f"""
      SELECT '{level}' AS level, least(x.{level}, y.{level}) AS src, greatest(x.{level}, y.{level}) AS dst,
             sum(weight) AS weight
      FROM net JOIN levels x ON x.ut = net.src JOIN levels y ON y.ut = net.dst GROUP BY ALL"""
                             for level in MAP_LEVELS)


def _map_sql() -> str:
    names = {"twitter": "tweets", "news": "news", "policy": "policy", "total": "all_indicators"}
    tables, rows = [], []
    for level, parent in zip(MAP_LEVELS, ("CAST(NULL AS BIGINT)", *MAP_LEVELS)):
        v = level[:2] + level[3]
        sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS n_{n}, avg({c}) AS avg_{n}" for c, n in names.items())
        scores = ", ".join(
            f"n_{n}, round(avg_{n}, 6) AS avg_{n}, round((avg_{n} - (SELECT avg(avg_{n}) FROM {v}_g))"
            f" / (SELECT stddev_samp(avg_{n}) FROM {v}_g), 6) AS z_{n}" for n in names.values())
        tables.append(f"""
    {v}_n AS (SELECT {level} AS c, word, count(*) AS n FROM tokens JOIN levels USING (ut) GROUP BY ALL),
    {v}_t AS (SELECT c, word, n, (n / sum(n) OVER (PARTITION BY c))
        * ln((SELECT count(DISTINCT c) FROM {v}_n) / count(*) OVER (PARTITION BY word)) AS x FROM {v}_n),
    {v}_k AS (SELECT *, rank() OVER (PARTITION BY c ORDER BY x DESC) AS rk FROM {v}_t),
    {v}_w AS (SELECT c, string_agg(word, ', ' ORDER BY n DESC, word) AS words FROM {v}_k WHERE rk <= 10 GROUP BY c),
    {v}_p AS (SELECT {level} AS c, count(DISTINCT ut) AS npapers FROM tokens JOIN levels USING (ut) GROUP BY ALL),
    {v}_s AS (SELECT {level} AS c, min({parent}) AS parent, count(*) AS n_members FROM levels GROUP BY ALL),
    {v}_g AS (SELECT {level} AS c, count(*) AS n_articles, {sums}
      FROM levels JOIN attention USING (ut) GROUP BY ALL),
    {v}_i AS (SELECT c, sum(CASE WHEN src = dst THEN weight ELSE 0 END) AS inside,
        sum(CASE WHEN src = dst THEN 0 ELSE weight END) AS outside
      FROM {v}_s JOIN map_links l ON l.level = '{level}' AND c IN (src, dst) GROUP BY c)""")
        rows.append(f"""
    SELECT '{level}' AS level, c AS cluster, parent, n_members, npapers, words, n_articles, {scores},
           round(inside, 6) AS inside, round(outside, 6) AS outside
    FROM {v}_s LEFT JOIN {v}_w USING (c) LEFT JOIN {v}_p USING (c) LEFT JOIN {v}_g USING (c) LEFT JOIN {v}_i USING (c)""")
    return f"""WITH {MAP_SQL}, map_links AS ({_map_links_sql()}),
    tokens AS (SELECT o_custkey AS ut, strftime(o_orderdate, '%Y-%m-%d') AS word FROM orders),
    {",".join(tables)} {" UNION ALL ".join(rows)}"""


def customer_map(spark, sf_dir):
    """Levels found in the network of customers, the links between them, and their reports; the
    words of a customer are the days of its orders."""
    tokens = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("ut"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("word"))
    membership = Scratch(spark, "levels").save(found_levels(spark, sf_dir, MAP_LEVELS))
    links = Scratch(spark, "level_links").save(maps.level_links(
        a.region_network(spark, sf_dir), membership, MAP_LEVELS))
    return links, maps.cluster_reports(membership, links, tokens, a.attention(spark, sf_dir), MAP_LEVELS)


@query("network_map", with_views("placed_customers attention", _map_sql()))
def network_map(spark, sf_dir):
    """Every cluster of the three found levels with its parent, size, weights, words and impact."""
    rows = customer_map(spark, sf_dir)[1]
    doubles = [c for c, kind in rows.dtypes if kind == "double"]
    return rows.withColumns({c: F.round(c, 6) for c in doubles})


@query("network_map_links", with_views(
    "placed_customers", f"WITH {MAP_SQL} SELECT level, src, dst, round(weight, 6) AS weight FROM ({_map_links_sql()})"))
def network_map_links(spark, sf_dir):
    """Weights between and inside the clusters of the three found levels."""
    levels = Scratch(spark, "levels").save(found_levels(spark, sf_dir, MAP_LEVELS))
    rows = maps.level_links(a.region_network(spark, sf_dir), levels, MAP_LEVELS)
    return rows.withColumn("weight", F.round("weight", 6))
