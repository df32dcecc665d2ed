"""The given tables seen as papers, links, people and indicators.

Every adapter is a projection of the tables; its SQL twin in ``VIEWS`` says the
same for the cross-check in another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citegraph import fixed_values as fixed
from citegraph.functions.text import words
from citegraph.scratch import number_rows

#: Components of every vector of the given table.
TOPICS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def order_part_links(spark, sf_dir) -> DataFrame:
    """Orders cite parts."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("citing_ut"), F.col("l_partkey").alias("cited_ut")
    )


def part_links(spark, sf_dir) -> DataFrame:
    """A part cites the part on the next line of an order."""
    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            F.col("l_partkey").alias("citing_ut"),
            F.lead("l_partkey").over(line).alias("cited_ut"),
        )
        .where(F.col("cited_ut").isNotNull())
    )


def parts(spark, sf_dir) -> DataFrame:
    """Parts as papers with clusters: type, then type and brand."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ut"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("macro_cluster"),
        F.concat_ws("/", "p_type", "p_brand").alias("meso_cluster"),
    )


def orders_as_papers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ut"))


def part_keywords(spark, sf_dir) -> DataFrame:
    """Words of the part name, its brand and its type."""
    p = table(spark, sf_dir, "part")
    listed = F.array_union(F.split("p_name", " "), F.array("p_brand", "p_type"))
    return p.select(F.col("p_partkey").alias("ut"), F.explode(listed).alias("keyword"))


def papers(spark, sf_dir) -> DataFrame:
    """Documents as papers; every seventeenth has no cluster."""
    clustered = F.col("doc_id") % 17 != 0
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("ut"),
        F.col("source").alias("title"),
        F.col("text").alias("abstract"),
        F.when(clustered, F.col("lang")).alias("macro_cluster"),
        F.when(clustered, F.concat_ws("-", "lang", "source")).alias("meso_cluster"),
    )


def text_data(spark, sf_dir) -> DataFrame:
    """Documents with the four searchable columns."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("ut"),
        F.col("source").alias("title"),
        F.col("text").alias("abstract"),
        F.col("lang").alias("keyword"),
        F.concat_ws(" ", "lang", "source").alias("keyword_plus"),
    )


def raw_words(spark, sf_dir) -> DataFrame:
    """(ut, word) over the uncleaned texts."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("ut"), F.explode(words("text")).alias("word")
    )


def attention(spark, sf_dir) -> DataFrame:
    """Events of a user as attention counts of a paper."""
    def kind(name: str):
        return F.sum((F.col("event_type") == name).cast("bigint"))

    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("ut")).agg(
        kind("view").alias("twitter"),
        kind("click").alias("news"),
        kind("purchase").alias("policy"),
        F.count(F.lit(1)).alias("total"),
    )


def customers_as_papers(spark, sf_dir) -> DataFrame:
    """Customers as papers with citation counts and nested clusters (region, nation)."""
    cited = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_cits")
    )
    nation = table(spark, sf_dir, "nation")
    region_free = F.col("c_custkey") % 10 == 0
    return (
        table(spark, sf_dir, "customer")
        .join(cited, F.col("c_custkey") == F.col("o_custkey"), "left")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").alias("ut"),
            F.coalesce("n_cits", F.lit(0)).cast("bigint").alias("n_cits"),
            F.when(~region_free, F.col("n_regionkey")).alias("macro_cluster"),
            F.when(~region_free, F.col("c_nationkey")).alias("meso_cluster"),
        )
    )


def people(spark, sf_dir) -> DataFrame:
    """Customers as authors of orders, with their market segment as affiliation."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_custkey").alias("PersonID"),
        F.col("o_orderkey").alias("id_art"),
        F.col("c_name").alias("name"),
        F.col("o_orderstatus").alias("Title"),
        F.col("c_mktsegment").alias("Affiliation"),
        F.year("o_orderdate").alias("Year"),
    )


def order_clusters(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id_art"), F.col("o_orderpriority").alias("cluster")
    )


def affiliations(spark, sf_dir) -> DataFrame:
    """Parts as papers whose affiliation lists brand and type codes."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id_art"),
        F.col("p_name").alias("Title"),
        F.col("p_size").alias("Year"),
        F.concat_ws(" ", "p_brand", "p_type").alias("Affiliation"),
    )


def topic_shares(spark, sf_dir) -> DataFrame:
    """The vector components as document-topic shares."""
    e = table(spark, sf_dir, "embeddings")
    absolute = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    total = F.aggregate(absolute, F.lit(0.0), lambda a, x: a + x)
    cells = e.select(
        F.col("vec_id").alias("ut"), total.alias("_total"),
        F.posexplode(absolute).alias("_at", "_size"),
    )
    return cells.select(
        "ut", (F.col("_at") + 1).alias("topic"), (F.col("_size") / F.col("_total")).alias("gamma")
    )


def vector_labels(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("name"), F.col("label").alias("community")
    )


#: What links between communities weigh, and how far on in its order a customer is linked.
BRIDGE = 0.05
NEAR = (1, 2, 3, 5, 8, 13, 21, 34, 4, 7, 11, 18)


def _ring(customers: DataFrame, group: str, order: list, offsets) -> DataFrame:
    """Customers linked to those some places on in an order, inside their group; the next one
    is linked also across groups, lightly, which connects the groups in a chain."""
    numbered = number_rows(customers, order, "n").select("id", F.col(group).alias("g"), "n")
    on = numbered.select(
        F.col("id").alias("src"), "g", F.explode(F.array(*map(F.lit, offsets))).alias("o"), "n")
    to = numbered.select(F.col("id").alias("dst"), F.col("g").alias("to_g"), F.col("n").alias("to_n"))
    inside = F.col("g") == F.col("to_g")
    return on.join(to, F.col("n") + F.col("o") == F.col("to_n")).where(
        inside | (F.col("o") == 1)).select(
        "src", "dst", F.when(inside, 1.0).otherwise(BRIDGE).alias("weight"))


def _placed_customers(spark, sf_dir) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"), F.col("n_regionkey").alias("region"),
        F.col("n_nationkey").alias("nation"), F.md5(F.col("c_custkey").cast("string")).alias("h"))


def nation_network(spark, sf_dir) -> DataFrame:
    """Planted communities: customers of a nation are linked, neighbouring nations by one link."""
    rows = _placed_customers(spark, sf_dir)
    return _ring(rows, "nation", ["nation", "h"], NEAR)


#: What the link of a customer to its nation's first one weighs; its other links weigh less together.
ANCHOR = 100.0


def anchored_network(spark, sf_dir) -> DataFrame:
    """The nation network with a heavy link of every customer to the first one of its nation.

    Whatever way labels spread, every customer ends with that of its anchor, so the nations are the
    only labelling that no vertex leaves.
    """
    rows = _placed_customers(spark, sf_dir)
    first = rows.groupBy("nation").agg(F.min("id").alias("dst"))
    return nation_network(spark, sf_dir).unionAll(
        rows.join(first, "nation").where("id <> dst").select(
            F.col("id").alias("src"), "dst", F.lit(ANCHOR).alias("weight")))


#: Weights of a customer's links to the first one of its nation, and of the others of its region:
#: nations are the best communities of a region, and regions those of the whole.
OWN, OTHER = 8.5, 1.0


def region_network(spark, sf_dir) -> DataFrame:
    """Planted hierarchy: every customer is linked to the first customer of each nation of its
    region, most to its own; neighbouring regions are linked lightly."""
    rows = _placed_customers(spark, sf_dir)
    first = rows.groupBy("region", F.col("nation").alias("to")).agg(F.min("id").alias("dst"))
    links = rows.join(first, "region").where("id <> dst").select(
        F.col("id").alias("src"), "dst",
        F.when(F.col("nation") == F.col("to"), OWN).otherwise(OTHER).alias("weight"))
    ends = rows.groupBy("region").agg(F.min("id").alias("src"))
    following = ends.select((F.col("region") - 1).alias("region"), F.col("src").alias("dst"))
    return links.unionAll(ends.join(following, "region").select("src", "dst", F.lit(BRIDGE).alias("weight")))


WORD = fixed.WORD_PATTERN.replace("'", "''")

# SQL twins of the adapters above, as (name, body) of common table expressions.
VIEWS = {
    "order_part_links": """
        SELECT DISTINCT l_orderkey AS citing_ut, l_partkey AS cited_ut FROM lineitem""",
    "part_links": """
        SELECT DISTINCT citing_ut, cited_ut FROM (
          SELECT l_partkey AS citing_ut, lead(l_partkey) OVER (
            PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS cited_ut
          FROM lineitem) WHERE cited_ut IS NOT NULL""",
    "parts": """
        SELECT p_partkey AS ut, p_name AS title, p_type AS macro_cluster,
               p_type || '/' || p_brand AS meso_cluster FROM part""",
    "part_keywords": """
        SELECT DISTINCT ut, keyword FROM (
          SELECT p_partkey AS ut, unnest(string_split(p_name, ' ')) AS keyword FROM part
          UNION ALL SELECT p_partkey, p_brand FROM part
          UNION ALL SELECT p_partkey, p_type FROM part)""",
    "papers": """
        SELECT doc_id AS ut, source AS title, text AS abstract,
               CASE WHEN doc_id % 17 <> 0 THEN lang END AS macro_cluster,
               CASE WHEN doc_id % 17 <> 0 THEN lang || '-' || source END AS meso_cluster
        FROM documents""",
    "text_data": """
        SELECT doc_id AS ut, source AS title, text AS abstract, lang AS keyword,
               concat_ws(' ', lang, source) AS keyword_plus FROM documents""",
    "raw_words": f"""
        SELECT doc_id AS ut, unnest(regexp_extract_all(lower(text), '{WORD}')) AS word
        FROM documents""",
    "attention": """
        SELECT user_id AS ut, count(*) FILTER (event_type = 'view') AS twitter,
               count(*) FILTER (event_type = 'click') AS news,
               count(*) FILTER (event_type = 'purchase') AS policy, count(*) AS total
        FROM events GROUP BY user_id""",
    "customers_as_papers": """
        SELECT c_custkey AS ut, coalesce(n, 0) AS n_cits,
               CASE WHEN c_custkey % 10 <> 0 THEN n_regionkey END AS macro_cluster,
               CASE WHEN c_custkey % 10 <> 0 THEN c_nationkey END AS meso_cluster
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
          ON o_custkey = c_custkey""",
    "people": """
        SELECT c_custkey AS PersonID, o_orderkey AS id_art, c_name AS name,
               o_orderstatus AS Title, c_mktsegment AS Affiliation,
               CAST(year(o_orderdate) AS INTEGER) AS Year
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "order_clusters": """
        SELECT o_orderkey AS id_art, o_orderpriority AS cluster FROM orders""",
    "placed_customers": """
        SELECT c_custkey AS id, n_regionkey AS region, n_nationkey AS nation
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "nation_order": """
        SELECT id, nation, row_number() OVER (ORDER BY nation, md5(CAST(id AS VARCHAR))) AS n
        FROM placed_customers""",
    "nation_network": f"""
        SELECT x.id AS src, y.id AS dst,
               CASE WHEN x.nation = y.nation THEN 1.0 ELSE {BRIDGE} END AS weight
        FROM nation_order x, unnest([{', '.join(map(str, NEAR))}]) AS r(o)
        JOIN nation_order y ON y.n = x.n + r.o WHERE x.nation = y.nation OR r.o = 1""",
    "affiliations": """
        SELECT p_partkey AS id_art, p_name AS Title, p_size AS Year,
               p_brand || ' ' || p_type AS Affiliation FROM part""",
    "vector_parts": """
        SELECT vec_id AS ut, label, CAST(i AS INTEGER) AS topic,
               abs(CAST(embedding[i] AS DOUBLE)) AS size
        FROM embeddings, unnest(range(1, 65)) AS r(i)""",
    "topic_shares": """
        SELECT ut, topic, size / sum(size) OVER (PARTITION BY ut) AS gamma FROM vector_parts""",
}


def with_views(names: str, body: str) -> str:
    """SQL text with the named adapters in front."""
    views = ", ".join(f"{name} AS ({VIEWS[name]})" for name in names.split())
    body = body.strip()
    if body.startswith("WITH "):
        return f"WITH {views}, {body[5:]}"
    return f"WITH {views} {body}"
