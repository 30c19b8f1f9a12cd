"""SQL statements, for DuckDB, of the queries that SQL can express. Written from the contracts,
not from the Spark plans."""

SPACE_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# Resharing the excess is repeated once per source at most: every round fills at least one.
MIX_SOURCES = rf"""
WITH RECURSIVE sized AS (
    SELECT doc_id, source, len({SPACE_WORDS})::BIGINT AS size,
           md5(concat_ws('|', coalesce(doc_id::VARCHAR, '<null>'), coalesce(lang, '<null>'), coalesce(n_chars::VARCHAR, '<null>'),
                         coalesce(source, '<null>'), coalesce(text, '<null>'))) AS key
    FROM documents
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY key) AS number FROM sized
), named AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::BIGINT AS weight
    FROM sized GROUP BY source
), rounds AS (
    SELECT 0 AS step, source, source_size, weight, FALSE AS filled, NULL::DOUBLE AS level FROM named
    UNION ALL
    SELECT step + 1, source, source_size, weight, filled OR level_now * weight > 2 * source_size, level_now
    FROM (
        SELECT *, (sum(source_size) OVER () * 150 - 100 * coalesce(sum(2 * source_size) FILTER (WHERE filled) OVER (), 0))
                  / 100.0::DOUBLE / sum(weight) FILTER (WHERE NOT filled) OVER () AS level_now
        FROM rounds
    )
    WHERE step <= (SELECT count(*) FROM named)
), last AS (
    SELECT source, source_size, CASE WHEN filled THEN (2 * source_size)::DOUBLE ELSE level * weight END AS target
    FROM rounds WHERE step = (SELECT max(step) FROM rounds)
), rated AS (
    SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM last
), drawn AS (
    SELECT doc_id, size, source_size, target, rate,
           ('0x' || substr(md5('mix:' || key || ':' || number), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS chance
    FROM numbered JOIN rated ON numbered.source IS NOT DISTINCT FROM rated.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + (chance < rate - floor(rate))::INT))::BIGINT AS taken
FROM drawn
"""

LATIN_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

# Every window of the items against every stretch of as many words of the documents.
DECONTAMINATE = rf"""
WITH doc AS (
    SELECT row_number() OVER () AS row, doc_id, {LATIN_WORDS} AS w FROM documents
), item AS (
    SELECT item_id::VARCHAR AS item_id, {LATIN_WORDS} AS w FROM benchmark
), item_window AS (
    SELECT DISTINCT item_id, list_slice(w, s, s + least(10, len(w)) - 1) AS phrase
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM item WHERE len(w) > 0)
), doc_window AS (
    SELECT row, s, n, list_slice(w, s, s + n - 1) AS phrase
    FROM (
        SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS s
        FROM doc, (SELECT DISTINCT len(phrase) AS n FROM item_window)
        WHERE len(w) >= n
    )
), hit AS (
    SELECT row, s, n, item_id FROM doc_window JOIN item_window USING (phrase)
), counted AS (
    SELECT row, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT row, unnest(range(s, s + n)) AS p FROM hit) GROUP BY row
), listed AS (
    SELECT row, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
    FROM (SELECT DISTINCT row, item_id FROM hit) GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN counted USING (row) LEFT JOIN listed USING (row)
"""

# Every window of every document by its words; what a window covers goes if an earlier one starts it.
SUBSTRING_DEDUP = rf"""
WITH doc AS (
    SELECT row_number() OVER () AS row, doc_id, {SPACE_WORDS} AS w FROM documents
), win AS (
    SELECT row, doc_id, s, md5(array_to_string(list_slice(w, s, s + 49), ' ')) AS content
    FROM (SELECT row, doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM doc WHERE len(w) >= 50)
), owned AS (
    SELECT content, min(doc_id) AS owner FROM win GROUP BY content
), gone AS (
    SELECT DISTINCT row, unnest(range(s, s + 50)) AS p FROM win JOIN owned USING (content) WHERE owner < doc_id
), lost AS (
    SELECT row, list(p) AS ps FROM gone GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE
           list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(ps, i)), lambda i: w[i]) END, ' '), '')) AS kept_sha256
FROM doc LEFT JOIN lost USING (row)
"""

LOWER_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x20\x09-\x0D]+')"
)

# All pairs of documents that share a shingle, and the closure of their links.
JACCARD_JOIN = rf"""
WITH RECURSIVE doc AS (
    SELECT doc_id, {LOWER_WORDS} AS w FROM documents
), shingle AS (
    SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + least(3, len(w)) - 1), ' ') AS h
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 0) + 2)) AS s FROM doc WHERE len(w) > 0)
), size AS (
    SELECT doc_id, count(*)::BIGINT AS n FROM shingle GROUP BY doc_id
), pair AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
    FROM shingle a JOIN shingle b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
    SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
    WHERE 100 * shared >= 90 * (x.n + y.n - shared)
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM doc
    UNION
    SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
)
SELECT doc.doc_id, coalesce(n, 0) AS n_shingles, low AS component_id
FROM doc LEFT JOIN size USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) USING (doc_id)
"""

WARC = """
WITH payload AS (
    SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url NULLS LAST) AS place,
        first(page_id) OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url NULLS LAST) AS first_id
    FROM payload
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 100 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND place > 1 THEN first_id END AS refers_to
FROM placed
"""
