"""SQL twins of the operators that SQL can express."""

from __future__ import annotations

from citegraph.llm import bitslice, linededup, rules, vectorcode

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"

WARC = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
    d AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest
          FROM p),
    f AS (SELECT *, CASE WHEN payload_bytes >= 100
                    THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM d)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id
                THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id
                THEN first_id END AS refers_to
    FROM f"""

# All pairs that share a shingle, counted.
JACCARD = rf"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')
        AS words FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []
        WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END)
        AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a
      JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
    l AS MATERIALIZED (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y
      WHERE 100 * c >= 80 * (i.n + j.n - c)),
    e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
    reach AS (SELECT x AS doc_id, x AS root FROM e
      UNION SELECT e.y, r.root FROM reach r JOIN e ON e.x = r.doc_id),
    c AS (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.root, d.doc_id) AS component_id
    FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id"""


def _rules() -> str:
    choices = ", ".join(f"('{rule}', {cutoff})" for rule, (_, _, cutoffs) in rules.RULES.items()
                        for cutoff in cutoffs)
    ratio = " ".join(f"WHEN '{rule}' THEN 1000 * {above} > cutoff * {below}"
                     for rule, (above, below, _) in rules.RULES.items())
    rate = rules.RISK / len(rules.RULES)
    return rf"""
    WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
    w AS MATERIALIZED (SELECT *, regexp_extract_all(text, '{WORD}') AS words, list_filter(
        string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM t),
    win AS (SELECT doc_id, i, array_to_string(words[i:i + 2], ' ') AS g FROM (
      SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
    rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
    cov AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (
      SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM rep) GROUP BY doc_id),
    m AS MATERIALIZED (SELECT w.doc_id, stratum, len(words)::BIGINT AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '{rules.SYMBOL}', '', 'g')))::BIGINT AS n_symbols,
        (length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')))::BIGINT AS n_capitals,
        len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
    choices(rule, cutoff) AS (VALUES {choices}),
    good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
    counts AS (SELECT stratum, rule, cutoff, count(*) AS n,
        sum((CASE rule {ratio} END)::INT)::BIGINT AS k
      FROM b JOIN good USING (doc_id), choices WHERE NOT base_failed GROUP BY stratum, rule, cutoff),
    tested AS (SELECT *, count(*) OVER (PARTITION BY rule, cutoff) AS strata,
        CASE WHEN k > n * {rate} THEN 1 ELSE list_sum(list_transform(range(0, k + 1),
          lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({rate})
                   + (n - i) * ln(1 - {rate})))) END AS p FROM counts),
    chain AS (SELECT *, max((p * strata * {len(rules.RULES)} > {rules.DELTA})::INT) OVER (
        PARTITION BY stratum, rule ORDER BY cutoff DESC) AS open FROM tested),
    cut AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM chain WHERE open = 0 GROUP BY stratum, rule),
    lost AS (SELECT DISTINCT doc_id FROM b JOIN cut USING (stratum) WHERE CASE rule {ratio} END)
    SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND lost.doc_id IS NULL AS kept
    FROM b LEFT JOIN lost ON lost.doc_id = b.doc_id"""


RULES = _rules()

# Every shortest run of enough words, from each of its lines on and back, against all others.
LINES = rf"""
    WITH t AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text <> ''),
    x AS (SELECT *, len(regexp_extract_all(line, '{WORD}')) AS words FROM t),
    y AS MATERIALIZED (SELECT *, sum((words > 0)::INT) OVER d AS k, sum(words) OVER d AS total
      FROM x WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
    l AS MATERIALIZED (SELECT doc_id, k, line, words, total FROM y WHERE words > 0),
    runs AS (SELECT a.doc_id, a.k AS first, min(b.k) AS last FROM l a
        JOIN l b ON b.doc_id = a.doc_id AND b.total - a.total + a.words >= {linededup.MIN_WORDS}
        GROUP BY a.doc_id, a.k
      UNION SELECT b.doc_id, max(a.k), b.k FROM l b
        JOIN l a ON a.doc_id = b.doc_id AND b.total - a.total + a.words >= {linededup.MIN_WORDS}
        GROUP BY b.doc_id, b.k),
    texts AS (SELECT r.doc_id, first, last, list(line ORDER BY k) AS own FROM runs r
      JOIN l ON l.doc_id = r.doc_id AND k BETWEEN first AND last GROUP BY r.doc_id, first, last),
    later AS (SELECT doc_id, first, last FROM texts
      QUALIFY row_number() OVER (PARTITION BY own ORDER BY doc_id, first) > 1),
    gone AS (SELECT DISTINCT l.doc_id, k FROM l
      JOIN later r ON r.doc_id = l.doc_id AND k BETWEEN first AND last),
    kept AS (SELECT y.doc_id, count(*) AS n_lines, count(g.k) AS n_deleted,
        coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (g.k IS NULL), '') AS text
      FROM y LEFT JOIN gone g ON g.doc_id = y.doc_id AND g.k = y.k GROUP BY y.doc_id)
    SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_deleted, 0)::BIGINT AS n_deleted,
           coalesce(k.text, d.text) AS text
    FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id"""


def _vector_codes() -> str:
    """The rounds written out; every part against every entry."""
    parts, entries = vectorcode.PARTS, vectorcode.ENTRIES
    ctes = [f"""
    v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding,
        lambda x: floor({vectorcode.SCALE} * x::DOUBLE)::BIGINT) AS z
      FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding,
        lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS MATERIALIZED (SELECT vec_id, pos, z[pos * w + 1:(pos + 1) * w] AS part
      FROM (SELECT vec_id, z, len(z) // {parts} AS w, unnest(range({parts})) AS pos FROM v)),
    c0 AS MATERIALIZED (SELECT pos, e, part FROM (SELECT *, row_number() OVER (
        PARTITION BY pos ORDER BY vec_id) - 1 AS e FROM p) WHERE e < {entries})"""]
    for turn in range(vectorcode.ROUNDS + 1):
        ctes.append(f"""
    a{turn} AS MATERIALIZED (SELECT p.vec_id, p.pos, any_value(p.part) AS part,
        min({{'d': list_sum(list_transform(list_zip(p.part, c.part),
          lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT, 'e': c.e}}) AS near
      FROM p JOIN c{turn} c ON c.pos = p.pos GROUP BY p.vec_id, p.pos)""")
        if turn < vectorcode.ROUNDS:
            ctes.append(f"""
    c{turn + 1} AS MATERIALIZED (SELECT c.pos, c.e, coalesce(m.part, c.part) AS part
      FROM c{turn} c LEFT JOIN (
        SELECT pos, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS part FROM (
          SELECT pos, e, i, sum(x)::BIGINT AS s, count(*) AS n FROM (
            SELECT pos, near.e AS e, unnest(part) AS x, generate_subscripts(part, 1) AS i
            FROM a{turn}) GROUP BY pos, e, i) GROUP BY pos, e) m ON m.pos = c.pos AND m.e = c.e)""")
    last = vectorcode.ROUNDS
    return f"""
    WITH {",".join(ctes)},
    code AS (SELECT vec_id, string_agg(printf('%02x', near.e), '' ORDER BY pos) AS code,
        sum(near.d)::BIGINT AS error FROM a{last} GROUP BY vec_id),
    book AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY pos, e)) AS digest
      FROM c{last})
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
           (SELECT digest FROM book) AS codebooks_sha256
    FROM code JOIN v USING (vec_id)"""


VECTOR_CODES = _vector_codes()


def _bit_slices() -> str:
    """Every feature's CRC-32 by a table that is itself computed; weights as plain sums."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    buckets, scale = bitslice.BUCKETS, bitslice.SCALE
    step = "CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END"
    table = "i"
    for _ in range(8):
        table = f"(SELECT {step} FROM (SELECT {table} AS c))"

    def features(name: str, ident: str) -> str:
        return f"""
    {name}_w AS MATERIALIZED (SELECT {ident} AS id, regexp_extract_all(translate(coalesce(text, ''),
        '{UPPER}', '{LOWER}'), '{word}') AS words FROM {name}),
    {name}_f AS MATERIALIZED (SELECT id, unnest(list_concat(words, list_transform(
        range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS f FROM {name}_w)"""

    return f"""
    WITH one AS (SELECT i, {table} AS c FROM range(256) t(i)),
    crc AS MATERIALIZED (SELECT list(c::BIGINT ORDER BY i) AS t FROM one),
    {features("documents", "doc_id")}, {features("benchmark", "item_id")},
    d AS MATERIALIZED (SELECT DISTINCT f FROM (SELECT f FROM documents_f UNION ALL SELECT f FROM benchmark_f)),
    h AS (SELECT f, t, hex(encode(f)) AS x FROM d, crc),
    b AS MATERIALIZED (SELECT f, xor(list_reduce(list_transform(range(1, len(x), 2),
        lambda i: ('0x' || substr(x, i, 2))::BIGINT),
        lambda c, y: xor(t[xor(c & 255, y) + 1], c >> 8), 4294967295::BIGINT), 4294967295) % {buckets} AS bucket
      FROM h),
    s AS (SELECT bucket, count(*) AS s FROM documents_f JOIN b USING (f) GROUP BY bucket),
    t AS (SELECT bucket, count(*) AS t FROM benchmark_f JOIN b USING (f) GROUP BY bucket),
    g AS MATERIALIZED (SELECT i AS bucket, floor({scale} * ln(
        ((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM documents_f) + {buckets})::DOUBLE)
        / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM benchmark_f) + {buckets})::DOUBLE)))::BIGINT AS gain
      FROM range({buckets}) r(i) LEFT JOIN s ON s.bucket = i LEFT JOIN t ON t.bucket = i),
    sums AS (SELECT id, count(*) AS n, sum(gain)::BIGINT AS total
      FROM documents_f JOIN b USING (f) JOIN g USING (bucket) GROUP BY id),
    w AS (SELECT id AS doc_id, coalesce(n, 0)::BIGINT AS n_features, len(words) AS n_words,
        coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
        ('0x' || substr(sha256('{bitslice.SEED}:' || id), 1, 8))::BIGINT AS drawn
      FROM documents_w LEFT JOIN sums USING (id)),
    c AS MATERIALIZED (SELECT *, weight + floor(-{scale} * ln(-ln((drawn + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM w),
    r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank
      FROM c WHERE n_words >= {bitslice.MIN_WORDS}
      QUALIFY rank <= count(*) OVER () * {bitslice.PERCENT} // 100)
    SELECT doc_id, n_features, weight, score, rank FROM c LEFT JOIN r USING (doc_id)"""


BIT_SLICES = _bit_slices()
