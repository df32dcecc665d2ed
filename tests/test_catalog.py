"""Registered queries against their SQL twins on the smallest tables."""

import os

import pytest

import __spark_entry__ as registered
import crosscheck

duckdb = pytest.importorskip("duckdb")
SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
SAMPLE = [
    "tsv_scan", "csv_sink", "materialised_selection", "word_predicate", "not_in_list_keep_null",
    "conditional_median", "top_with_ties", "standard_scores", "running_cluster_numbers",
    "co_citation", "bibliographic_coupling", "combined_network", "keyword_cooccurrence",
    "text_similarity_network", "projected_network", "supernode_graph_as_ordered", "clean_text",
    "tokenize", "tf_idf_by_cluster", "cluster_words_meso", "extract_corpus", "citation_links",
    "noun_phrase_table", "enrich_corpus", "altmetric_links", "impact_by_macro_cluster",
    "impact_rounded_meso", "cluster_profile", "institution_flags", "person_cluster_share",
    "institution_cluster_share", "topics_by_community", "gamma_wide", "cluster_keywords",
    "modularity", "degree", "label_propagation", "connected_components",
]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in crosscheck.TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')"
        )
    return connection


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_sql(spark, db, name):
    df = registered.queries()[name](spark, SF_DIR)
    found = db.execute(registered.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert crosscheck.rows_of(df.columns, df.collect()) == crosscheck.rows_of(
        columns, found.fetchall()
    )


def test_every_query_is_listed_once_and_sql_belongs_to_a_query():
    assert set(registered.oracle_sql()) <= set(registered.queries())
    assert len(registered.queries()) > 100


def test_entry(spark):
    assert registered.entry(spark).columns == ["src", "dst", "weight", "type"]
