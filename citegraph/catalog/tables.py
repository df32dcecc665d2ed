"""Sources and sinks, projections, filters, joins, aggregates, windows, set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from citegraph.catalog import query
from citegraph.functions import nulls
from citegraph.functions.text import contains_any, replace_first
from citegraph.operators import relational as rel
from citegraph.operators.networks import combine_networks
from citegraph.plans import adapters as a
from citegraph.plans.adapters import table, with_views
from citegraph.scratch import Scratch
from citegraph.sources import files
from citegraph.sources.lexicons import STOP_LANGUAGES, STOP_SQL, stop_words

# --- sources and sinks -----------------------------------------------------


@query("tsv_scan", "SELECT doc_id, lang, source, text FROM documents")
def tsv_scan(spark, sf_dir):
    path = Scratch(spark, "tsv").new_path()
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    files.write_tsv(docs, path)
    return files.read_tsv(spark, path, docs.schema, escaped_breaks=True)


@query("csv_scan", "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def csv_scan(spark, sf_dir):
    path = Scratch(spark, "csv").new_path()
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"
    )
    files.write_csv(parts, path)
    return files.read_csv(spark, path, parts.schema)


@query("workbook_sheet_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def workbook_sheet_scan(spark, sf_dir):
    workbook = Scratch(spark, "workbook").new_path()
    sheets = {"nation": ("n_nationkey", "n_name", "n_regionkey"), "region": ("r_regionkey", "r_name")}
    for sheet, columns in sheets.items():
        files.write_csv(table(spark, sf_dir, sheet).select(*columns), f"{workbook}/{sheet}")
    return files.read_sheet(spark, workbook, "nation",
                            "n_nationkey BIGINT, n_name STRING, n_regionkey BIGINT")


@query("table_scan", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
def table_scan(spark, sf_dir):
    lines = files.read_table(spark, f"{sf_dir}/lineitem.parquet")
    return lines.select("l_orderkey", "l_partkey", "l_quantity")


@query("materialised_selection", """
    SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'""")
def materialised_selection(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    path = Scratch(spark, "table").new_path()
    name = f"urgent_orders_{uuid.uuid4().hex}"
    return files.keep_as_table(urgent.select("o_orderkey", "o_custkey"), name, path)


@query("csv_sink", "SELECT l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def csv_sink(spark, sf_dir):
    path = Scratch(spark, "csv").new_path()
    flags = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.count(F.lit(1)).alias("n")
    )
    files.write_csv(flags, path)
    return files.read_csv(spark, path, "flag STRING, n BIGINT")


@query("tsv_sink", with_views("customers_as_papers", """
    SELECT ut, n_cits, macro_cluster, meso_cluster FROM customers_as_papers"""))
def tsv_sink(spark, sf_dir):
    path = Scratch(spark, "tsv").new_path()
    papers = a.customers_as_papers(spark, sf_dir)
    files.write_tsv(papers, path)
    return files.read_tsv(spark, path, papers.schema)


@query("stop_word_lexicon")
def stop_word_lexicon(spark, sf_dir):
    """How often each listed stop word occurs in the documents, zero included."""
    listed = stop_words(spark, ("english", "french")).groupBy("word").agg(
        F.count(F.lit(1)).alias("lists")
    )
    used = a.raw_words(spark, sf_dir).groupBy("word").agg(F.count(F.lit(1)).alias("uses"))
    return listed.join(used, "word", "left").fillna(0, ["uses"])


# --- projections and filters ----------------------------------------------


@query("project_columns", "SELECT ut, macro_cluster AS cluster FROM "
       "(SELECT p_partkey AS ut, p_type AS macro_cluster FROM part)")
def project_columns(spark, sf_dir):
    return a.parts(spark, sf_dir).select("ut", F.col("macro_cluster").alias("cluster"))


@query("rename_columns", 'SELECT vec_id AS name, label AS community FROM embeddings')
def rename_columns(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return vectors.withColumnsRenamed({"vec_id": "name", "label": "community"})


@query("derived_columns", """
    SELECT l_orderkey, l_partkey, round(l_extendedprice * (1 - l_discount), 4) AS weight,
           'undirected' AS type FROM lineitem""")
def derived_columns(spark, sf_dir):
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", F.round(price, 4).alias("weight"),
        F.lit("undirected").alias("type"),
    )


EDGE = r"[^\p{L}\p{N}_]"


def _contains(column: str, word: str) -> str:
    return f"coalesce(regexp_matches({column}, '(?i)(^|{EDGE}){word}($|{EDGE})'), false)"


@query("word_predicate", with_views("text_data", f"""
    SELECT ut, title FROM text_data
    WHERE {_contains('keyword_plus', 'this')} OR {_contains('abstract', 'estion')}
       OR {_contains('keyword_plus', 'estion')} OR {_contains('abstract', 'this')}"""))
def word_predicate(spark, sf_dir):
    texts = a.text_data(spark, sf_dir)
    found = contains_any(("keyword_plus", "abstract"), ("this", "estion"))
    return texts.where(found).select("ut", "title")


@query("ordered_pairs", with_views("part_links", """
    SELECT citing_ut AS src, cited_ut AS dst FROM part_links WHERE cited_ut > citing_ut"""))
def ordered_pairs(spark, sf_dir):
    links = a.part_links(spark, sf_dir).where(F.col("cited_ut") > F.col("citing_ut")).distinct()
    return links.select(F.col("citing_ut").alias("src"), F.col("cited_ut").alias("dst"))


@query("numeric_threshold", "SELECT event_id, value FROM events WHERE value >= 10")
def numeric_threshold(spark, sf_dir):
    return table(spark, sf_dir, "events").where("value >= 10").select("event_id", "value")


@query("not_in_list_keep_null", with_views("customers_as_papers", """
    SELECT ut, meso_cluster FROM customers_as_papers
    WHERE meso_cluster IS NULL OR meso_cluster NOT IN (3, 5, 9, 14, 21)"""))
def not_in_list_keep_null(spark, sf_dir):
    noise = (3, 5, 9, 14, 21)
    papers = a.customers_as_papers(spark, sf_dir)
    return papers.where(nulls.not_in_keep_null("meso_cluster", noise)).select("ut", "meso_cluster")


@query("not_null_filter", with_views("papers", """
    SELECT ut, macro_cluster FROM papers WHERE macro_cluster IS NOT NULL"""))
def not_null_filter(spark, sf_dir):
    papers = a.papers(spark, sf_dir).select("ut", "macro_cluster")
    return papers.dropna(subset=["macro_cluster"])


@query("substring_exclusion", "SELECT doc_id FROM documents WHERE NOT contains(text, 'ation')")
def substring_exclusion(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.where(~F.contains("text", F.lit("ation"))).select("doc_id")


@query("equality_filter", """
    SELECT l_orderkey, l_linenumber FROM lineitem
    WHERE l_returnflag = 'R' AND l_linestatus = 'F'""")
def equality_filter(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.where("l_returnflag = 'R' AND l_linestatus = 'F'").select(
        "l_orderkey", "l_linenumber"
    )


@query("non_empty_filter", """
    SELECT page_id, href FROM (
      SELECT page_id, unnest(string_split(url, '/')) AS href FROM pages) WHERE href <> ''""")
def non_empty_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    steps = pages.select("page_id", F.explode(F.split("url", "/")).alias("href"))
    return steps.where(F.col("href") != "")


@query("indicator_columns", """
    SELECT o_custkey AS id, max(CAST(o_orderpriority = '1-URGENT' AS INTEGER)) AS urgent,
           max(CAST(o_orderpriority = '5-LOW' AS INTEGER)) AS low
    FROM orders GROUP BY o_custkey""")
def indicator_columns(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "id")
    return rel.value_flags(orders, "id", "o_orderpriority", {"1-URGENT": "urgent", "5-LOW": "low"})


@query("recode_value", """
    SELECT p_partkey AS id_art, CASE WHEN CAST(p_size AS VARCHAR) = '28' THEN '20'
           ELSE CAST(p_size AS VARCHAR) END AS cluster FROM part""")
def recode_value(spark, sf_dir):
    clusters = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id_art"), F.col("p_size").cast("string").alias("cluster")
    )
    return rel.recode(clusters, "cluster")


@query("cast_ids", """
    SELECT conv_id, turn, TRY_CAST(regexp_extract(text, '[0-9]+') AS BIGINT) AS id_art
    FROM conversations""")
def cast_ids(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations")
    found = talk.select("conv_id", "turn", F.regexp_extract("text", "[0-9]+", 0).alias("id_art"))
    return rel.to_integer(found, "id_art")


@query("concatenate_columns", with_views("papers", """
    SELECT ut, coalesce(title, 'NA') || '_' || coalesce(meso_cluster, 'NA') AS text FROM papers"""))
def concatenate_columns(spark, sf_dir):
    return a.papers(spark, sf_dir).select("ut", nulls.unite("title", "meso_cluster").alias("text"))


@query("distinct_rows", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()


# --- joins -------------------------------------------------------------------


@query("inner_join", """
    SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey""")
def inner_join(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("left_join_chain", """
    SELECT s_suppkey, n_name, r_name FROM supplier
    LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey <> 3
    LEFT JOIN region ON n_regionkey = r_regionkey""")
def left_join_chain(spark, sf_dir):
    n = table(spark, sf_dir, "nation").where("n_regionkey <> 3")
    r = table(spark, sf_dir, "region")
    return (
        table(spark, sf_dir, "supplier")
        .join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select("s_suppkey", "n_name", "r_name")
    )




@query("anti_join", with_views("raw_words", f"""
    SELECT ut, word, count(*) AS n FROM raw_words WHERE word NOT IN ({STOP_SQL})
    GROUP BY ut, word"""))
def anti_join(spark, sf_dir):
    stop = stop_words(spark, STOP_LANGUAGES)
    kept = a.raw_words(spark, sf_dir).join(stop, "word", "left_anti")
    return kept.groupBy("ut", "word").agg(F.count(F.lit(1)).alias("n"))


@query("attribute_join", """
    SELECT d.doc_id AS ut, lang, quality, toxic FROM documents d
    LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def attribute_join(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("ut"), "lang", "quality", "toxic"
    )


@query("left_join_not_null", with_views("customers_as_papers attention", """
    SELECT p.ut, macro_cluster, total FROM customers_as_papers p
    LEFT JOIN attention t ON t.ut = p.ut WHERE total IS NOT NULL"""))
def left_join_not_null(spark, sf_dir):
    papers, seen = a.customers_as_papers(spark, sf_dir), a.attention(spark, sf_dir)
    return papers.join(seen, "ut", "left").where("total IS NOT NULL").select(
        "ut", "macro_cluster", "total"
    )


@query("full_outer_join", """
    SELECT coalesce(c_nationkey, s_nationkey) AS nationkey, customers, suppliers
    FROM (SELECT c_nationkey, count(*) AS customers FROM customer
          WHERE c_acctbal > 9000 GROUP BY c_nationkey)
    FULL JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier
               WHERE s_acctbal > 5000 GROUP BY s_nationkey)
      ON c_nationkey = s_nationkey""")
def full_outer_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000")
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000")
    c = c.groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("customers"))
    s = s.groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "nationkey", "outer")


@query("equi_and_inequality_join", """
    SELECT a.s_suppkey AS low, b.s_suppkey AS high, a.s_nationkey AS nationkey
    FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND b.s_name > a.s_name""")
def equi_and_inequality_join(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_name")
    x, y = s.alias("x"), s.alias("y")
    same = F.col("x.s_nationkey") == F.col("y.s_nationkey")
    return x.join(y, same & (F.col("y.s_name") > F.col("x.s_name"))).select(
        F.col("x.s_suppkey").alias("low"), F.col("y.s_suppkey").alias("high"),
        F.col("x.s_nationkey").alias("nationkey"),
    )


@query("composite_key_join", """
    SELECT l.l_orderkey, l.l_linenumber, pct FROM lineitem l LEFT JOIN (
      SELECT l_returnflag, l_linestatus, round(avg(l_discount), 6) AS pct FROM lineitem
      GROUP BY l_returnflag, l_linestatus) g
    ON g.l_returnflag = l.l_returnflag AND g.l_linestatus = l.l_linestatus""")
def composite_key_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    keys = ["l_returnflag", "l_linestatus"]
    means = lines.groupBy(*keys).agg(F.round(F.avg("l_discount"), 6).alias("pct"))
    return lines.join(means, keys, "left").select("l_orderkey", "l_linenumber", "pct")


# --- aggregates ----------------------------------------------------------------


@query("group_count", "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def group_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("count_distinct", """
    SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_suppkey""")
def count_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.countDistinct("l_partkey").alias("parts")
    )


@query("count_distinct_with_null", with_views("papers", """
    SELECT title, count(DISTINCT macro_cluster) AS known,
           count(DISTINCT macro_cluster) + max(CAST(macro_cluster IS NULL AS INTEGER)) AS clusters
    FROM papers GROUP BY title"""))
def count_distinct_with_null(spark, sf_dir):
    return a.papers(spark, sf_dir).groupBy("title").agg(
        F.countDistinct("macro_cluster").alias("known"),
        nulls.distinct_with_null("macro_cluster").alias("clusters"),
    )


@query("sum_per_group", """
    SELECT l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS weight
    FROM lineitem GROUP BY l_partkey""")
def sum_per_group(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("weight")
    )


@query("sum_null_policies", """
    SELECT d.lang, CAST(sum(quality) AS BIGINT) AS skipped,
           CASE WHEN count(quality) = count(*) THEN CAST(sum(quality) AS BIGINT) END AS propagated
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.lang""")
def sum_null_policies(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").groupBy("lang").agg(
        nulls.sum_of("quality").alias("skipped"),
        nulls.sum_of("quality", "propagate").alias("propagated"),
    )


@query("mean_per_group", """
    SELECT user_id, round(avg(value), 6) AS mean_value FROM events GROUP BY user_id""")
def mean_per_group(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.round(nulls.mean_of("value"), 6).alias("mean_value")
    )


@query("median_per_group", """
    SELECT o_orderpriority, round(median(o_totalprice), 6) AS median
    FROM orders GROUP BY o_orderpriority""")
def median_per_group(spark, sf_dir):
    medians = rel.grouped_median(
        table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", "median"
    )
    return medians.withColumn("median", F.round("median", 6))


@query("conditional_median", """
    SELECT l_suppkey, round(median(l_tax) FILTER (l_tax >= 0.03), 6) AS median
    FROM lineitem GROUP BY l_suppkey HAVING count(*) FILTER (l_tax >= 0.03) > 0""")
def conditional_median(spark, sf_dir):
    taxed = table(spark, sf_dir, "lineitem").where("l_tax >= 0.03")
    medians = rel.grouped_median(taxed, ["l_suppkey"], "l_tax", "median")
    return medians.withColumn("median", F.round("median", 6))


@query("mode_lowest_on_ties", """
    SELECT user_id, event_type AS mode FROM (
      SELECT user_id, event_type, row_number() OVER (
        PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rk
      FROM events GROUP BY user_id, event_type) WHERE rk = 1""")
def mode_lowest_on_ties(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.mode("event_type", True).alias("mode")
    )


@query("ordered_string_aggregate", """
    SELECT lang, string_agg(source, ', ' ORDER BY n DESC, source) AS sources FROM (
      SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source) GROUP BY lang""")
def ordered_string_aggregate(spark, sf_dir):
    counts = group_count(spark, sf_dir)
    return counts.groupBy("lang").agg(
        F.expr("listagg(source, ', ') WITHIN GROUP (ORDER BY n DESC, source)").alias("sources")
    )


@query("first_row_per_group", """
    SELECT n_regionkey AS regionkey, min(n_name) AS first_name, count(*) AS n
    FROM nation GROUP BY n_regionkey""")
def first_row_per_group(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("regionkey")).agg(
        F.min("n_name").alias("first_name"), F.count(F.lit(1)).alias("n")
    )


@query("global_scalars", """
    SELECT max(l_linenumber) AS most_lines, count(DISTINCT l_partkey) AS parts,
           count(*) AS rows FROM lineitem""")
def global_scalars(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(
        F.max("l_linenumber").alias("most_lines"), F.countDistinct("l_partkey").alias("parts"),
        F.count(F.lit(1)).alias("rows"),
    )


@query("bag_union_reaggregate", """
    SELECT src, dst, type, CAST(sum(weight) AS BIGINT) AS weight FROM (
      SELECT l_partkey AS src, l_suppkey AS dst, 1 AS weight, 'undirected' AS type
      FROM lineitem WHERE l_returnflag = 'R'
      UNION ALL SELECT l_partkey, l_suppkey, 2, 'undirected'
      FROM lineitem WHERE l_returnflag <> 'R') GROUP BY src, dst, type""")
def bag_union_reaggregate(spark, sf_dir):
    def network(chosen, weight: int):
        return table(spark, sf_dir, "lineitem").where(chosen).select(
            F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"),
            F.lit(weight).cast("bigint").alias("weight"), F.lit("undirected").alias("type"),
        )

    returned = F.col("l_returnflag") == "R"
    return combine_networks(network(returned, 1), network(~returned, 2))


# --- windows -------------------------------------------------------------------


@query("top_numbered_rows", """
    SELECT * FROM (
      SELECT l_suppkey, l_partkey, n, row_number() OVER (
        PARTITION BY l_suppkey ORDER BY n DESC, l_partkey) AS rk
      FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem
            GROUP BY l_suppkey, l_partkey)) WHERE rk <= 20""")
def top_numbered_rows(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(
        F.count(F.lit(1)).alias("n")
    )
    return rel.top_numbered(counts, ["l_suppkey"], [F.col("n").desc(), F.col("l_partkey")], 20)


@query("top_with_ties", """
    SELECT l_suppkey, l_partkey, n FROM (
      SELECT l_suppkey, l_partkey, n, rank() OVER (
        PARTITION BY l_suppkey ORDER BY n DESC) AS rk
      FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem
            GROUP BY l_suppkey, l_partkey)) WHERE rk <= 10""")
def top_with_ties(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(
        F.count(F.lit(1)).alias("n")
    )
    return rel.top_with_ties(counts, ["l_suppkey"], "n", 10)


@query("group_totals_on_rows", """
    SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id) AS person_total,
           round(sum(value) OVER (PARTITION BY user_id), 4) AS value_total FROM events""")
def group_totals_on_rows(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    totals = rel.with_group_totals(
        events, ["user_id"], person_total=F.count(F.lit(1)), value_total=F.round(F.sum("value"), 4)
    )
    return totals.drop("value")


@query("row_with_group_max", """
    SELECT o_custkey, o_orderkey, o_totalprice FROM orders o WHERE o_totalprice = (
      SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)""")
def row_with_group_max(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return rel.rows_at_group_max(orders, "o_custkey", "o_totalprice")


@query("standard_scores", """
    WITH g AS (SELECT l_suppkey, avg(l_quantity) AS mean FROM lineitem GROUP BY l_suppkey)
    SELECT l_suppkey, round((mean - (SELECT avg(mean) FROM g))
      / (SELECT stddev_samp(mean) FROM g), 6) AS z FROM g""")
def standard_scores(spark, sf_dir):
    means = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.avg("l_quantity").alias("mean")
    )
    scored = nulls.standardise(means, {"mean": "z"})
    return scored.select("l_suppkey", F.round("z", 6).alias("z"))


@query("running_cluster_numbers", """
    WITH l AS (SELECT DISTINCT n_regionkey + 1 AS parent, dense_rank() OVER (
      PARTITION BY n_regionkey ORDER BY n_nationkey) AS local FROM nation)
    SELECT parent, local, dense_rank() OVER (ORDER BY parent, local) AS number FROM l""")
def running_cluster_numbers(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    pairs = rel.top_numbered(nation, ["n_regionkey"], [F.col("n_nationkey")], 1000, "local").select(
        (F.col("n_regionkey") + 1).alias("parent"), "local"
    )
    return rel.running_numbers(pairs, "parent", "local", "number")


@query("papers_per_cluster", with_views("papers", """
    SELECT macro_cluster, word, n, npapers FROM (
      SELECT macro_cluster, lower(title) AS word, count(*) AS n FROM papers
      GROUP BY macro_cluster, lower(title))
    JOIN (SELECT macro_cluster AS c, count(DISTINCT ut) AS npapers FROM papers
          GROUP BY macro_cluster) ON c IS NOT DISTINCT FROM macro_cluster"""))
def papers_per_cluster(spark, sf_dir):
    papers = a.papers(spark, sf_dir).select("ut", "macro_cluster", F.lower("title").alias("word"))
    per_cluster = papers.groupBy(F.col("macro_cluster").alias("c")).agg(
        F.countDistinct("ut").alias("npapers")
    )
    counts = papers.groupBy("macro_cluster", "word").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(per_cluster, F.col("c").eqNullSafe(F.col("macro_cluster"))).drop("c")


# --- order, limit, set operations ---------------------------------------------------


@query("sort_by_aggregate", """
    SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey""")
def sort_by_aggregate(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.orderBy(F.col("n").desc(), "l_partkey")


@query("peek", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 6")
def peek(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type").orderBy(
        "event_id"
    ).limit(6)


@query("union_distinct_tagged", """
    SELECT c_nationkey AS nationkey, 'customer' AS source FROM customer
    UNION SELECT s_nationkey, 'supplier' FROM supplier""")
def union_distinct_tagged(spark, sf_dir):
    def keys(name: str, column: str):
        rows = table(spark, sf_dir, name).select(F.col(column).alias("nationkey"))
        return rows.withColumn("source", F.lit(name))

    return keys("customer", "c_nationkey").unionByName(keys("supplier", "s_nationkey")).distinct()


@query("bag_union", """
    SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark""")
def bag_union(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return docs.unionByName(items)


# --- scalar functions ------------------------------------------------------------------


@query("regex_replace_all", """
    SELECT page_id, regexp_replace(url, '[0-9]+', '', 'g') AS url FROM pages""")
def regex_replace_all(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.regexp_replace("url", "[0-9]+", "").alias("url"))


@query("regex_replace_first", """
    SELECT page_id, regexp_replace(url, '/', ' ') AS url FROM pages""")
def regex_replace_first(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", replace_first("url", "/", " ").alias("url")
    )


@query("lower_case", "SELECT item_id, lower(text) AS text FROM benchmark")
def lower_case(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("text"))


@query("substring_test", "SELECT doc_id, contains(text, 'ation') AS found FROM documents")
def substring_test(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.contains("text", F.lit("ation")).alias("found")
    )


@query("split_and_explode", with_views("affiliations", """
    SELECT id_art, unnest(string_split(Affiliation, ' ')) AS code FROM affiliations"""))
def split_and_explode(spark, sf_dir):
    return a.affiliations(spark, sf_dir).select(
        "id_art", F.explode(F.split("Affiliation", " ")).alias("code")
    )


@query("arithmetic_and_log", """
    SELECT o_orderkey, round((o_totalprice + o_custkey) / 2, 4) AS half,
           round(1.0 / (o_custkey + 1), 6) AS share, round(ln(o_totalprice), 6) AS log_price
    FROM orders""")
def arithmetic_and_log(spark, sf_dir):
    price, key = F.col("o_totalprice"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.round((price + key) / 2, 4).alias("half"),
        F.round(F.lit(1.0) / (key + 1), 6).alias("share"), F.round(F.log(price), 6).alias("log_price"),
    )


@query("rounding", """
    SELECT event_id, round(value, 1) AS up, round_even(value, 1) AS even FROM events""")
def rounding(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", F.round("value", 1).alias("up"), F.bround("value", 1).alias("even")
    )
