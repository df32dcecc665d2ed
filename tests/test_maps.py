import itertools
import math
import random
from collections import Counter, defaultdict

import duckdb
import pytest

from citegraph.plans import maps

WORDS = "ant bee cat dog eel fox gnu hen".split()


def nested_network():
    """Two halves of three groups of two cliques, with ever fewer links further out."""
    links = Counter()
    cliques = list(itertools.product(range(2), range(3), range(2)))
    name = {c: 1000 * c[0] + 100 * c[1] + 10 * c[2] for c in cliques}
    for c in cliques:
        for i, j in itertools.combinations(range(6), 2):
            links[name[c] + i, name[c] + j] += 4
    for c, d in itertools.combinations(cliques, 2):
        shared = 4 if c[:2] == d[:2] else 1 if c[0] == d[0] else 0
        for i in range(shared):
            links[name[c] + i, name[d] + i] += 1
    links[0, 1000] += 1
    return [(a, b, w) for (a, b), w in links.items()]


@pytest.fixture(scope="module")
def mapped(spark):
    rng = random.Random(4)
    links = nested_network()
    names = sorted({v for a, b, _ in links for v in (a, b)})
    tokens = [(v, rng.choice(WORDS[: 3 + v // 300])) for v in names for _ in range(rng.randint(0, 4))]
    known = [(v, *(rng.randint(0, 9) for _ in range(4))) for v in names if rng.random() < 0.8]
    articles = spark.createDataFrame([(v,) for v in [*names, 99999]], "ut long")
    found = maps.network_map(
        articles, spark.createDataFrame(links, "src long, dst long, weight long"),
        spark.createDataFrame(tokens, "ut long, word string"),
        spark.createDataFrame(known, "ut long, twitter long, news long, policy long, total long"))
    return links, tokens, known, *(df.toPandas() for df in found)


def test_levels_are_nested_and_find_the_planted_halves(mapped):
    membership = mapped[3]
    placed = membership.dropna()
    assert len(membership) == 73 and membership.ut.is_unique
    assert placed.groupby("macro_cluster").ut.apply(lambda u: {v // 1000 for v in u}).map(len).max() == 1
    for upper, lower in zip(maps.LEVELS, maps.LEVELS[1:]):
        assert placed.groupby(lower)[upper].nunique().max() == 1


def test_links_of_all_levels_against_plain_sums(mapped):
    links, membership, found = mapped[0], mapped[3].set_index("ut"), mapped[4]
    expected = Counter()
    for a, b, w in links:
        for level in maps.LEVELS:
            x, y = membership.loc[a, level], membership.loc[b, level]
            if not (math.isnan(x) or math.isnan(y)):
                expected[level, int(min(x, y)), int(max(x, y))] += w
    assert {(r.level, r.src, r.dst): r.weight for r in found.itertuples()} == expected
    assert len(found) == len(expected)


def test_reports_against_sql_given_the_membership(mapped):
    links, tokens, known, membership, _, found = mapped
    con = duckdb.connect()
    con.register("membership", membership)
    con.execute("CREATE TABLE tokens (ut BIGINT, word VARCHAR)")
    con.executemany("INSERT INTO tokens VALUES (?, ?)", tokens)
    con.execute("CREATE TABLE known (ut BIGINT, twitter BIGINT, news BIGINT, policy BIGINT, total BIGINT)")
    con.executemany("INSERT INTO known VALUES (?, ?, ?, ?, ?)", known)
    con.execute("CREATE TABLE links (src BIGINT, dst BIGINT, weight BIGINT)")
    con.executemany("INSERT INTO links VALUES (?, ?, ?)", links)
    seen = 0
    for level in maps.LEVELS:
        expected = con.execute(f"""
            WITH m AS (SELECT ut, CAST({level} AS INTEGER) AS c FROM membership WHERE NOT isnan({level})),
            s AS (SELECT c, count(*) AS n_members FROM m GROUP BY c),
            n AS (SELECT c, word, count(*) AS n FROM tokens JOIN m USING (ut) GROUP BY c, word),
            t AS (SELECT c, word, n, (n / sum(n) OVER (PARTITION BY c))
                    * ln((SELECT count(DISTINCT c) FROM n) / count(*) OVER (PARTITION BY word)) AS x FROM n),
            k AS (SELECT *, rank() OVER (PARTITION BY c ORDER BY x DESC) AS rk FROM t),
            w AS (SELECT c, string_agg(word, ', ' ORDER BY n DESC, word) AS words FROM k WHERE rk <= 10 GROUP BY c),
            p AS (SELECT c, count(DISTINCT ut) AS npapers FROM tokens JOIN m USING (ut) GROUP BY c),
            g AS (SELECT CASE WHEN isnan({level}) THEN NULL ELSE CAST({level} AS INTEGER) END AS c,
                    avg(total) AS a, count(*) AS n_articles FROM membership JOIN known USING (ut) GROUP BY 1),
            z AS (SELECT c, n_articles, (a - (SELECT avg(a) FROM g)) / (SELECT stddev_samp(a) FROM g) AS z FROM g),
            e AS (SELECT a.c AS x, b.c AS y, weight FROM links JOIN m a ON a.ut = src JOIN m b ON b.ut = dst),
            i AS (SELECT c, coalesce(sum(weight) FILTER (x = c AND y = c), 0) AS inside,
                    coalesce(sum(weight) FILTER ((x = c) <> (y = c)), 0) AS outside FROM s JOIN e ON true GROUP BY c)
            SELECT c, n_members, npapers, words, n_articles, z, inside, outside
            FROM s LEFT JOIN w USING (c) LEFT JOIN p USING (c) LEFT JOIN z USING (c) LEFT JOIN i USING (c)
            """).fetchall()
        got = {r.cluster: r for r in found[found.level == level].itertuples()}
        assert len(got) == len(expected) == len(found[found.level == level])
        for c, n_members, npapers, words, n_articles, z, inside, outside in expected:
            r = got[c]
            assert (r.n_members, r.npapers, r.words, r.n_articles, r.inside, r.outside) == (
                n_members, npapers, words, n_articles, inside, outside)
            assert r.z_all_indicators == pytest.approx(z, nan_ok=True)
            seen += 1
    parents = defaultdict(set)
    for r in found[found.level == "meso_cluster"].itertuples():
        parents[r.parent].add(r.cluster)
    assert set(parents) == set(found[found.level == "macro_cluster"].cluster)
    assert seen == len(found)


def test_map_queries_go_down_to_the_third_level(spark, tmp_path):
    """Macro, meso and micro clusters are found, linked and reported, as their SQL says."""
    import __spark_entry__ as registered
    import crosscheck

    rng = random.Random(3)
    tables = {
        "nation": ([(n, n // 5) for n in range(25)], "n_nationkey int, n_regionkey int"),
        "customer": ([(c, rng.randrange(25)) for c in range(1, 501)], "c_custkey long, c_nationkey int"),
        "events": ([(rng.randint(1, 500), rng.choice(("view", "click", "purchase"))) for _ in range(900)],
                   "user_id long, event_type string"),
    }
    for name, (found, kinds) in tables.items():
        spark.createDataFrame(found, kinds).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([(rng.randint(1, 500), f"1995-01-{rng.randint(1, 28):02d}") for _ in range(1200)],
                          "o_custkey long, d string").selectExpr("o_custkey", "CAST(d AS DATE) AS o_orderdate").write.parquet(
        f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for name in ("nation", "customer", "events", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    for name, clusters in (("network_map", {"macro_cluster": 5, "meso_cluster": 25, "micro_cluster": 25}),
                           ("network_map_links", None)):
        df = registered.queries()[name](spark, str(tmp_path))
        got = df.collect()
        assert {r.level for r in got} == set(maps.LEVELS)
        if clusters:
            assert Counter(r.level for r in got) == clusters
        expected = con.execute(registered.oracle_sql()[name])
        columns = [d[0] for d in expected.description]
        assert crosscheck.rows_of(df.columns, got) == crosscheck.rows_of(columns, expected.fetchall())
