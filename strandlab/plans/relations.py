"""Joins, set operations, sources, validators and the event ledger."""

QUERIES = {
    "union_keys": ("", "SELECT conv_id, turn FROM conversations WHERE role = 'user' UNION SELECT conv_id, turn FROM conversations WHERE role = 'assistant'"),
    "common_keys": (
        "",
        """SELECT conv_id FROM conversations WHERE role = 'user' INTERSECT SELECT conv_id FROM conversations
            WHERE role = 'assistant' INTERSECT SELECT conv_id FROM conversations WHERE role = 'system'""",
    ),
    "missing_pages_anti": ("", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL"),
    "except_keys": ("", "SELECT conv_id FROM conversations WHERE role = 'user' EXCEPT SELECT conv_id FROM conversations WHERE role = 'system'"),
    "lattice_coverage": (
        "",
        """WITH k AS (SELECT DISTINCT conv_id, turn FROM conversations),
        w AS (SELECT DISTINCT role FROM conversations),
        c AS (SELECT DISTINCT conv_id, role FROM conversations),
        r AS (SELECT conv_id, turn, role, min(text) AS text FROM conversations GROUP BY conv_id, turn, role)
        SELECT k.conv_id, k.turn, w.role, CASE WHEN r.text IS NOT NULL THEN 'present' WHEN c.role IS NOT NULL THEN 'locus-omitted' ELSE 'page-not-covered' END AS coverage
            FROM k CROSS JOIN w LEFT JOIN c ON k.conv_id = c.conv_id AND w.role = c.role LEFT JOIN r ON k.conv_id = r.conv_id AND k.turn = r.turn AND w.role = r.role""",
    ),
    "nearest_rank_summary": (
        "tok",
        """WITH v AS (SELECT lang, doc_id, avg(len) AS x FROM tok GROUP BY lang, doc_id),
        r AS (SELECT lang, x, row_number() OVER (PARTITION BY lang ORDER BY x, doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM v)
        SELECT lang, max(n) AS n, round(avg(x), 6) AS mean, round(max(CASE WHEN k = CAST(floor(1e-1 * (n - 1) + 5e-1) AS BIGINT) + 1 THEN x END), 6) AS p10, round(max(CASE WHEN k = CAST(floor(9e-1 * (n - 1) + 5e-1) AS BIGINT) + 1 THEN x END), 6) AS p90
            FROM r GROUP BY lang""",
    ),
    "pair_bank_cross_join": ("", "WITH f AS (SELECT item_id, CAST(length(text) AS DOUBLE) AS a, CAST(length(text) - length(@SUBALL(text; '[aeiou]'; '')) AS DOUBLE) AS b FROM benchmark) SELECT q.item_id AS query_id, c.item_id AS cand_id, round(abs(q.a - c.a) / (abs(q.a) + abs(c.a) + 1e-9), 6) AS d_len, round(abs(q.b - c.b) / (abs(q.b) + abs(c.b) + 1e-9), 6) AS d_vowels FROM f q CROSS JOIN f c"),
    "negative_sampling": (
        "",
        """WITH p AS (SELECT q.item_id AS query_id, c.item_id AS cand_id, row_number() OVER (PARTITION BY q.item_id ORDER BY md5(CAST(q.item_id AS STRING) || ':' || CAST(c.item_id AS STRING)), c.item_id) AS k
            FROM benchmark q CROSS JOIN benchmark c WHERE q.item_id <> c.item_id)
        SELECT query_id, cand_id, CAST(k AS BIGINT) AS k FROM p WHERE k <= 3""",
    ),
    "pairwise_agreement": (
        "",
        """WITH s AS (SELECT conv_id, turn, role, CAST(length(text) AS BIGINT) AS n FROM conversations)
        SELECT a.conv_id, a.turn AS turn_a, b.turn AS turn_b, least(a.n, b.n) AS shorter, greatest(a.n, b.n) AS longer
            FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.turn < b.turn AND a.role = b.role""",
    ),
    "html_title_extract": (
        "",
        """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, lower(regexp_extract(url, '://([^/]+)', 1)) AS host, @SIZE(@MATCHES(html; '<a ')) AS n_links
            FROM pages""",
    ),
    "json_props_profile": (
        "",
        """SELECT event_type, count(*) AS n, CAST(min(@JSONK(props)) AS BIGINT) AS low, CAST(max(@JSONK(props)) AS BIGINT) AS high, CAST(sum(@JSONK(props)) AS BIGINT) AS total
            FROM events GROUP BY event_type""",
    ),
    "regex_tokenizer": ("", "SELECT item_id, @SIZE(@MATCHES(text; '[A-Za-z0-9]+(?:[._:/-][A-Za-z0-9]+)*')) AS n_tokens FROM benchmark"),
    "unicode_units": (
        "tok chars",
        """SELECT doc_id, count(*) AS n_codepoints, count(DISTINCT c) AS n_distinct, count(CASE WHEN c > '~' THEN 1 END) AS n_non_ascii FROM chars GROUP BY doc_id""",
    ),
    "symbol_ids_first": (
        "bench",
        """WITH f AS (SELECT item_id, c, min(i) AS first_i FROM bench GROUP BY item_id, c)
        SELECT item_id, c AS symbol, CAST(row_number() OVER (PARTITION BY item_id ORDER BY first_i) AS BIGINT) - 1 AS id FROM f""",
    ),
    "symbol_ids_sorted": ("bench", "WITH f AS (SELECT DISTINCT c FROM bench) SELECT c AS symbol, CAST(dense_rank() OVER (ORDER BY c) AS BIGINT) - 1 AS id FROM f"),
    "eligibility_filter": (
        "ltok",
        """SELECT doc_id, count(*) AS groups, CAST(sum(len) AS BIGINT) AS symbols FROM ltok GROUP BY doc_id HAVING count(*) >= 30 AND sum(len) >= 120""",
    ),
    "manifest_hashes": (
        "",
        """SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, @SHA(text) AS sha256, CASE WHEN source LIKE 'src1%' THEN 'secondary' ELSE 'primary' END AS role FROM documents""",
    ),
    "payload_validation": (
        "",
        """SELECT doc_id, code FROM (SELECT doc_id, 'double-space' AS code FROM documents WHERE text LIKE '%  %' UNION ALL SELECT doc_id, 'empty' AS code FROM documents WHERE length(text) = 0 UNION ALL SELECT doc_id, 'length-mismatch' AS code FROM documents WHERE n_chars <> length(text) UNION ALL SELECT doc_id, 'too-long' AS code FROM documents WHERE length(text) > 2000) v""",
    ),
    "metadata_value_counts": (
        "",
        """SELECT 'lang' AS field, coalesce(lang, '<missing>') AS value, count(*) AS n FROM documents GROUP BY coalesce(lang, '<missing>')
            UNION ALL SELECT 'source' AS field, coalesce(source, '<missing>') AS value, count(*) AS n FROM documents
            GROUP BY coalesce(source, '<missing>')""",
    ),
    "coverage_grouping_sets": (
        "",
        """SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY GROUPING SETS ((), (lang), (source), (lang, source))""",
    ),
    "stale_leases": (
        "",
        """WITH l AS (SELECT user_id, max(@EPOCH(ts)) AS beat FROM events GROUP BY user_id),
        n AS (SELECT max(beat) AS now FROM l)
        SELECT user_id, beat, now - beat AS age FROM l CROSS JOIN n WHERE now - beat > 3600""",
    ),
    "robust_scale_with_tolerance": (
        "",
        """WITH q AS (SELECT l_returnflag, @PCT(CAST(l_quantity AS DOUBLE); 0.5) AS med, @PCT(CAST(l_quantity AS DOUBLE); 0.75) - @PCT(CAST(l_quantity AS DOUBLE); 0.25) AS iqr
            FROM lineitem GROUP BY l_returnflag)
        SELECT l_returnflag, round(med, 6) AS med, CASE WHEN iqr <= 1e-12 THEN 1e0 ELSE round(iqr, 6) END AS scale FROM q""",
    ),
    "top_k_first_occurrence": (
        "tok",
        """WITH k AS (SELECT doc_id, tok, count(*) AS n, min(pos) AS p FROM tok GROUP BY doc_id, tok),
        r AS (SELECT doc_id, tok, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS rnk FROM k)
        SELECT doc_id, tok, n, CAST(rnk AS BIGINT) AS rnk FROM r WHERE rnk <= 12""",
    ),
}
