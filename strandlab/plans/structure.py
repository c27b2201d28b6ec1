"""Held-out models, ledger checks, alignment, validation, sampling and permutation queries. Row order and random draws are
those of plans/inference.py: orders of md5, so that both engines draw alike."""

#: A document's side, its characters' events (with their two predecessors, open and closed) and its groups' events.
EVENTS = """
s AS (SELECT doc_id, pos, tok, len, CASE WHEN md5('split:' || CAST(doc_id AS STRING)) < 'c' THEN 1 ELSE 0 END AS train FROM tok),
ci AS (SELECT train, tok, len, @SPAN(0; CAST(len AS INT)) AS i FROM s),
ce AS (
  SELECT train, CASE WHEN i < len THEN substr(tok, CAST(i + 1 AS INT), 1) ELSE '<EOS>' END AS u,
         CASE WHEN i >= 1 THEN substr(tok, CAST(i AS INT), 1) ELSE '<BOS>' END AS a1,
         CASE WHEN i >= 2 THEN substr(tok, CAST(i - 1 AS INT), 1) ELSE '<BOS>' END AS a2
  FROM ci),
n3 AS (SELECT a2, a1, u, sum(train) AS tr, sum(1 - train) AS te FROM ce GROUP BY a2, a1, u),
n2 AS (SELECT a2, a1, sum(tr) AS tr, sum(te) AS te FROM n3 GROUP BY a2, a1),
n1 AS (SELECT a1, u, sum(tr) AS tr, sum(te) AS te FROM n3 GROUP BY a1, u),
c1 AS (SELECT a1, sum(tr) AS tr, sum(te) AS te FROM n1 GROUP BY a1),
n0 AS (SELECT u, sum(tr) AS tr, sum(te) AS te FROM n1 GROUP BY u),
cv AS (SELECT (sum(CASE WHEN tr > 0 AND u <> '<EOS>' THEN 1 ELSE 0 END) + 2) * 1e-1 AS w, sum(tr) AS tr, sum(te) AS te FROM n0)"""

#: sum(te * log2(tr + alpha)) and the like.
UNITS = "sum(te * log2(tr + 1e-1))"

HELD_OUT = {
    "heldout_ngram_cross_entropy": (
        "tok",
        f"""WITH {EVENTS},
        b AS (
          SELECT 0 AS k, max(te * log2(tr + w)) AS context FROM cv
          UNION ALL SELECT 1 AS k, sum(c1.te * log2(c1.tr + w)) AS context FROM c1 CROSS JOIN cv
          UNION ALL SELECT 2 AS k, sum(n2.te * log2(n2.tr + w)) AS context FROM n2 CROSS JOIN cv),
        a AS (
          SELECT 0 AS k, {UNITS} AS units FROM n0 UNION ALL SELECT 1 AS k, {UNITS} AS units FROM n1
          UNION ALL SELECT 2 AS k, {UNITS} AS units FROM n3)
        SELECT CAST(a.k AS BIGINT) AS model_order, round((context - units) / cv.te, 6) AS cross_entropy_bits, CAST(cv.te AS BIGINT) AS n_test
        FROM a JOIN b ON a.k = b.k CROSS JOIN cv""",
    ),
    "predictive_panel": (
        "tok",
        f"""WITH {EVENTS},
        gl AS (SELECT train, tok, lag(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS a, lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM s),
        ge AS (
          SELECT train, coalesce(a, '<BOS>') AS a, tok AS u FROM gl
          UNION ALL SELECT train, tok AS a, '<EOS>' AS u FROM gl WHERE b IS NULL),
        g1 AS (SELECT a, u, sum(train) AS tr, sum(1 - train) AS te FROM ge GROUP BY a, u),
        gc AS (SELECT a, sum(tr) AS tr, sum(te) AS te FROM g1 GROUP BY a),
        g0 AS (SELECT u, sum(tr) AS tr, sum(te) AS te FROM g1 GROUP BY u),
        gv AS (SELECT (sum(CASE WHEN tr > 0 AND u <> '<EOS>' THEN 1 ELSE 0 END) + 2) * 1e-1 AS w, sum(tr) AS tr, sum(te) AS te FROM g0),
        x AS (
          SELECT (cv.te * log2(cv.tr + w) - (SELECT {UNITS} FROM n0)) / te AS c0,
                 ((SELECT sum(n2.te * log2(n2.tr + v.w)) FROM n2 CROSS JOIN cv v) - (SELECT {UNITS} FROM n3)) / te AS c2 FROM cv),
        y AS (
          SELECT (gv.te * log2(gv.tr + w) - (SELECT {UNITS} FROM g0)) / te AS h0,
                 ((SELECT sum(gc.te * log2(gc.tr + v.w)) FROM gc CROSS JOIN gv v) - (SELECT {UNITS} FROM g1)) / te AS h1 FROM gv)
        SELECT round(c0, 6) AS char_order0_bits, round(c2, 6) AS char_order2_bits, round(c0 - c2, 6) AS char_trigram_gain,
               round(h0, 6) AS group_order0_bits, round(h1, 6) AS group_order1_bits, round(h0 - h1, 6) AS group_bigram_gain
        FROM x CROSS JOIN y""",
    ),
    "block_fano": (
        "tok",
        """WITH f AS (SELECT doc_id, tok, count(*) AS n, min(pos) AS p FROM tok GROUP BY doc_id, tok),
        r AS (SELECT doc_id, tok, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS rnk FROM f WHERE n >= 3),
        d AS (SELECT doc_id, CAST(floor(max(pos) / 20) AS BIGINT) + 1 AS blocks FROM tok GROUP BY doc_id),
        k AS (SELECT doc_id, tok, CAST(floor(pos / 20) AS BIGINT) AS b, count(*) AS n FROM tok GROUP BY doc_id, tok, CAST(floor(pos / 20) AS BIGINT)),
        q AS (SELECT doc_id, tok, sum(n * n) AS s2, sum(n) AS s1 FROM k GROUP BY doc_id, tok),
        z AS (
          SELECT r.doc_id, CAST(floor(1e9 * CAST(d.blocks * q.s2 - q.s1 * q.s1 AS DOUBLE) / CAST(d.blocks * q.s1 AS DOUBLE) + 5e-1) AS BIGINT) AS fano
          FROM r JOIN q ON q.doc_id = r.doc_id AND q.tok = r.tok JOIN d ON d.doc_id = r.doc_id WHERE rnk <= 16)
        SELECT d.doc_id, round(coalesce(CAST(sum(fano) AS DOUBLE) / count(fano) / 1e9, 0e0), 6) AS frequent_token_fano
        FROM d LEFT JOIN z ON d.doc_id = z.doc_id GROUP BY d.doc_id""",
    ),
    "recurrence_burstiness": (
        "tok",
        """WITH g AS (SELECT doc_id, tok, pos - lag(pos) OVER (PARTITION BY doc_id, tok ORDER BY pos) AS gap FROM tok),
        t AS (SELECT doc_id, tok, stddev_pop(gap) AS s, avg(gap) AS m FROM g WHERE gap IS NOT NULL GROUP BY doc_id, tok HAVING count(gap) >= 2),
        d AS (SELECT DISTINCT doc_id FROM tok)
        SELECT d.doc_id, round(coalesce(avg((s - m) / (s + m)), 0e0), 6) AS burstiness, round(coalesce(avg(s / m), 0e0), 6) AS gap_cv
        FROM d LEFT JOIN t ON d.doc_id = t.doc_id GROUP BY d.doc_id""",
    ),
    "heaps_fit": (
        "tok",
        """WITH f AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id, tok ORDER BY pos) AS k FROM tok),
        c AS (SELECT doc_id, pos + 1 AS prefix, n, sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS types FROM f),
        p AS (
          SELECT DISTINCT doc_id, ln(CAST(prefix AS DOUBLE)) AS x, ln(CAST(types AS DOUBLE)) AS y FROM c CROSS JOIN (SELECT @RANGE(8) AS g)
          WHERE prefix = greatest(10, least(n, CAST(@BROUND(n * (g + 1) / 8e0) AS BIGINT)))),
        z AS (SELECT doc_id, covar_pop(x, y) AS c, var_pop(x) AS vx, var_pop(y) AS vy FROM p GROUP BY doc_id HAVING count(*) >= 2),
        d AS (SELECT DISTINCT doc_id FROM tok)
        SELECT d.doc_id, round(coalesce(CASE WHEN vx > 1e-12 THEN c / vx END, 0e0), 6) AS heaps_exponent,
               round(coalesce(CASE WHEN vx > 1e-12 AND vy > 1e-12 THEN c * c / (vx * vy) END, 0e0), 6) AS heaps_r2
        FROM d LEFT JOIN z ON d.doc_id = z.doc_id""",
    ),
    "null_iid_symbol": (
        "tok chars",
        """WITH k AS (SELECT c, count(*) AS n FROM chars GROUP BY c), n AS (SELECT CAST(sum(n) AS BIGINT) AS tot FROM k),
        u AS (SELECT c, n, tot, CAST(sum(n) OVER (ORDER BY c ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hi FROM k CROSS JOIN n),
        v AS (SELECT c, hi - n AS lo, hi, @SPAN(CAST(floor((hi - n) * 1024e0 / tot) AS BIGINT); CAST(floor((hi - 1) * 1024e0 / tot) AS BIGINT)) AS cell FROM u),
        d AS (SELECT doc_id, pos, i, tot, @DRAW('iid:' || CAST(doc_id AS STRING) || ':' || CAST(pos AS STRING) || ':' || CAST(i AS STRING); tot) AS x FROM chars CROSS JOIN n),
        m AS (SELECT d.doc_id, d.pos, v.c, count(*) AS n FROM d JOIN v ON v.cell = CAST(floor(d.x * 1024e0 / d.tot) AS BIGINT) AND d.x >= v.lo AND d.x < v.hi GROUP BY d.doc_id, d.pos, v.c)
        SELECT doc_id, c, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * (pos + 1)) AS BIGINT) AS place_sum FROM m GROUP BY doc_id, c""",
    ),
}

ALIGNMENT = {
    "lattice_full_outer": (
        "",
        """WITH r AS (SELECT conv_id, turn, role, min(text) AS text, count(*) AS n FROM conversations GROUP BY conv_id, turn, role),
        a AS (SELECT * FROM r WHERE role = 'user'), b AS (SELECT * FROM r WHERE role = 'assistant'), s AS (SELECT * FROM r WHERE role = 'system'),
        p AS (SELECT conv_id, max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS u, max(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS v, max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) AS w FROM r GROUP BY conv_id),
        j AS (
          SELECT coalesce(a.conv_id, b.conv_id, s.conv_id) AS conv_id, coalesce(a.turn, b.turn, s.turn) AS turn, a.n AS an, b.n AS bn, s.n AS sn
          FROM a FULL OUTER JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn
          FULL OUTER JOIN s ON coalesce(a.conv_id, b.conv_id) = s.conv_id AND coalesce(a.turn, b.turn) = s.turn)
        SELECT j.conv_id, j.turn, CASE WHEN an > 0 THEN 'present' WHEN u = 1 THEN 'locus-omitted' ELSE 'page-not-covered' END AS user_reading,
               CASE WHEN bn > 0 THEN 'present' WHEN v = 1 THEN 'locus-omitted' ELSE 'page-not-covered' END AS assistant_reading,
               CASE WHEN sn > 0 THEN 'present' WHEN w = 1 THEN 'locus-omitted' ELSE 'page-not-covered' END AS system_reading,
               CAST(coalesce(an, 0) + coalesce(bn, 0) + coalesce(sn, 0) AS BIGINT) AS readings
        FROM j JOIN p ON j.conv_id = p.conv_id""",
    ),
    "comparison_status": (
        "",
        """WITH n AS (SELECT doc_id, text, trim(@SUBALL(lower(text); '[^a-z]+'; ' ')) AS t FROM documents),
        g AS (SELECT substr(t, 1, 12) AS opening, count(*) AS n, count(DISTINCT text) AS forms, count(DISTINCT t) AS readings, min(doc_id) AS first_id FROM n GROUP BY substr(t, 1, 12))
        SELECT first_id, n, CASE WHEN n = 1 THEN 'single' WHEN forms = 1 THEN 'exact-diplomatic' WHEN readings = 1 THEN 'markup-only' ELSE 'reading-difference' END AS status FROM g""",
    ),
    "many_to_many_links": (
        "",
        """WITH l AS (SELECT doc_id, @SPAN(0; 1) AS f FROM documents), loci AS (SELECT doc_id, (doc_id * 3 + f * 7) % 97 AS folio FROM l),
        c AS (SELECT page_id, @SPAN(0; 1) AS f FROM pages), canvases AS (SELECT page_id, (page_id * 5 + f * 11) % 97 AS folio FROM c)
        SELECT DISTINCT doc_id, page_id FROM loci JOIN canvases ON loci.folio = canvases.folio""",
    ),
    "mapping_audit": (
        "",
        """WITH l AS (SELECT doc_id, @SPAN(0; 1) AS f FROM documents), loci AS (SELECT doc_id, (doc_id * 3 + f * 7) % 197 AS folio FROM l),
        c AS (SELECT page_id, page_id % 97 AS folio FROM pages),
        k AS (SELECT loci.doc_id, count(DISTINCT c.page_id) AS canvases FROM loci LEFT JOIN c ON loci.folio = c.folio GROUP BY loci.doc_id)
        SELECT count(*) AS loci, CAST(sum(CASE WHEN canvases > 0 THEN 1 ELSE 0 END) AS BIGINT) AS linked, CAST(sum(CASE WHEN canvases > 1 THEN 1 ELSE 0 END) AS BIGINT) AS multi_canvas,
               CAST(sum(canvases) AS BIGINT) AS links FROM k""",
    ),
    "unlinked_loci_anti": ("", "SELECT d.doc_id, d.source FROM documents d @ANTI() labels l ON d.doc_id = l.doc_id"),
    "zip_rankings": (
        "",
        """WITH a AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents),
        b AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS STRING)), doc_id) AS k FROM documents)
        SELECT a.source, a.k AS place, a.doc_id AS by_length, b.doc_id AS by_hash FROM a JOIN b ON a.source = b.source AND a.k = b.k""",
    ),
    "cohort_union_all": (
        "",
        """WITH f AS (SELECT DISTINCT source AS family FROM documents), d AS (SELECT doc_id, source FROM documents)
        SELECT d.doc_id, f.family, 'cohort' AS origin FROM d JOIN f ON d.source <= f.family UNION ALL SELECT page_id AS doc_id, 'external' AS family, 'page' AS origin FROM pages""",
    ),
    "as_of_join": (
        "ev",
        """WITH m AS (SELECT user_id, pos, event_type, value, max(CASE WHEN event_type = 'view' THEN pos END) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS view_pos FROM ev)
        SELECT m.user_id, m.pos, m.view_pos, round(v.value, 6) AS view_value FROM m LEFT JOIN ev v ON v.user_id = m.user_id AND v.pos = m.view_pos WHERE m.event_type = 'purchase'""",
    ),
    "interval_join": (
        "",
        """WITH b AS (SELECT doc_id, n_chars AS lo, n_chars + 50 AS hi, @SPAN(CAST(floor(n_chars / 64) AS BIGINT); CAST(floor((n_chars + 49) / 64) AS BIGINT)) AS cell FROM documents WHERE doc_id % 20 = 0)
        SELECT b.doc_id AS query_id, d.doc_id FROM b JOIN documents d ON CAST(floor(d.n_chars / 64) AS BIGINT) = b.cell AND d.n_chars >= b.lo AND d.n_chars < b.hi WHERE d.doc_id <> b.doc_id""",
    ),
}

LEDGER = {
    "event_chain_verify": (
        "ev",
        """WITH h AS (SELECT user_id, pos, event_type, @SHA(CAST(user_id AS STRING) || ':' || CAST(pos AS STRING) || ':' || event_type) AS own FROM ev),
        stored AS (
          SELECT user_id, pos, event_type, CASE WHEN pos % 70 = 69 THEN @SHA('altered:' || own) ELSE own END AS event_hash,
                 CASE WHEN pos % 50 = 49 THEN @SHA('elsewhere:' || own) ELSE lag(CASE WHEN pos % 70 = 69 THEN @SHA('altered:' || own) ELSE own END) OVER (PARTITION BY user_id ORDER BY pos) END AS previous_hash
          FROM h),
        c AS (
          SELECT user_id, pos, CASE WHEN event_hash <> @SHA(CAST(user_id AS STRING) || ':' || CAST(pos AS STRING) || ':' || event_type) THEN 1 ELSE 0 END AS own_error,
                 CASE WHEN coalesce(previous_hash, '') <> coalesce(lag(event_hash) OVER (PARTITION BY user_id ORDER BY pos), '') THEN 1 ELSE 0 END AS link_error
          FROM stored)
        SELECT user_id, count(*) AS n_events, CAST(sum(own_error) AS BIGINT) AS hash_errors, CAST(sum(link_error) AS BIGINT) AS link_errors,
               CAST(min(CASE WHEN own_error + link_error > 0 THEN pos END) AS BIGINT) AS first_error FROM c GROUP BY user_id""",
    ),
    "state_transitions": (
        "ev",
        """WITH a AS (
          SELECT 'signup' AS f, 'view' AS t UNION ALL SELECT 'view', 'click' UNION ALL SELECT 'view', 'view' UNION ALL SELECT 'click', 'purchase' UNION ALL SELECT 'click', 'view'
          UNION ALL SELECT 'purchase', 'view' UNION ALL SELECT 'error', 'view' UNION ALL SELECT 'view', 'error' UNION ALL SELECT 'click', 'error'),
        e AS (SELECT user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY pos) AS from_status, event_type AS to_status FROM ev)
        SELECT from_status, to_status, count(*) AS n, max(CASE WHEN a.f IS NULL THEN 0 ELSE 1 END) AS allowed
        FROM e LEFT JOIN a ON a.f = e.from_status AND a.t = e.to_status WHERE from_status IS NOT NULL GROUP BY from_status, to_status""",
    ),
    "manifest_verify": (
        "",
        """WITH m AS (SELECT doc_id, @SHA(text) AS sha, n_chars AS size, CASE WHEN doc_id % 41 = 0 THEN '../' ELSE 'data/' END || CAST(doc_id AS STRING) AS path FROM documents),
        declared AS (SELECT doc_id, path, CASE WHEN doc_id % 31 = 0 THEN @SHA('other') ELSE sha END AS sha, CASE WHEN doc_id % 29 = 0 THEN size + 1 ELSE size END AS size FROM m),
        actual AS (SELECT doc_id, @SHA(text) AS sha, n_chars AS size FROM documents WHERE doc_id % 37 <> 0)
        SELECT d.doc_id, CASE WHEN d.path LIKE '../%' THEN 'outside-root' WHEN a.doc_id IS NULL THEN 'missing' WHEN a.size <> d.size THEN 'size' WHEN a.sha <> d.sha THEN 'hash' ELSE 'ok' END AS status
        FROM declared d LEFT JOIN actual a ON a.doc_id = d.doc_id""",
    ),
    "receipt_upsert": (
        "",
        """WITH r AS (SELECT 'u/' || CAST(user_id % 50 AS STRING) AS path, event_id, value FROM events), k AS (SELECT path, event_id, value, row_number() OVER (PARTITION BY path ORDER BY event_id DESC) AS rnk FROM r)
        SELECT path, event_id, round(value, 6) AS value FROM k WHERE rnk = 1""",
    ),
    "tumbling_sliding_session": (
        "",
        """WITH e AS (SELECT user_id, event_id, @EPOCH(ts) AS t FROM events), p AS (SELECT user_id, event_id, t, lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS before FROM e),
        s AS (SELECT user_id, t, sum(CASE WHEN before IS NULL OR t - before > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS session FROM p),
        h AS (SELECT t, @SPAN(0; 1) AS k FROM e)
        SELECT 'tumbling' AS kind, CAST(floor(t / 3600) AS BIGINT) * 3600 AS start, CAST(0 AS BIGINT) AS key, count(*) AS n FROM e GROUP BY CAST(floor(t / 3600) AS BIGINT) * 3600
        UNION ALL SELECT 'sliding' AS kind, (CAST(floor(t / 1800) AS BIGINT) - k) * 1800 AS start, CAST(0 AS BIGINT) AS key, count(*) AS n FROM h GROUP BY (CAST(floor(t / 1800) AS BIGINT) - k) * 1800
        UNION ALL SELECT 'session' AS kind, min(t) AS start, user_id AS key, count(*) AS n FROM s GROUP BY user_id, session""",
    ),
}

CHECKS = {
    "content_kind_policy": (
        "",
        """WITH p AS (SELECT 'en' AS kind, 1 AS allow, 0 AS deny UNION ALL SELECT 'de', 1, 0 UNION ALL SELECT 'fr', 1, 1)
        SELECT d.doc_id, CASE WHEN coalesce(p.deny, 0) = 1 THEN 'denied' WHEN coalesce(p.allow, 0) = 1 THEN 'allowed' ELSE 'unlisted' END AS verdict FROM documents d LEFT JOIN p ON p.kind = d.lang""",
    ),
    "page_filter_and_views": (
        "ltok",
        """WITH v AS (SELECT doc_id, CASE WHEN line % 2 = 0 THEN 'first' ELSE 'second' END AS view, count(*) AS n_groups, sum(len) AS symbols FROM ltok GROUP BY doc_id, CASE WHEN line % 2 = 0 THEN 'first' ELSE 'second' END)
        SELECT v.doc_id, count(*) AS views, bool_and(n_groups >= 5 AND symbols >= 20) AS eligible FROM v JOIN documents d ON d.doc_id = v.doc_id WHERE d.lang IN ('en', 'de') GROUP BY v.doc_id""",
    ),
    "threshold_gates": (
        "",
        """WITH g AS (SELECT user_id, avg(value) AS m, max(value) AS hi, CASE WHEN count(*) < 8 THEN CAST('NaN' AS DOUBLE) ELSE stddev_pop(value) END AS sd FROM events GROUP BY user_id),
        t AS (SELECT user_id, m >= 45 AND m < 1e300 AS mean_gate, hi <= 99 AND hi > -1e300 AS high_gate, sd < 1e300 AND sd = sd AND sd >= 20 AS spread_gate FROM g)
        SELECT user_id, mean_gate, high_gate, spread_gate, mean_gate AND high_gate AND spread_gate AS all_gates FROM t""",
    ),
    "argmax_ties": (
        "",
        """WITH k AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type), m AS (SELECT user_id, max(n) AS top FROM k GROUP BY user_id)
        SELECT k.user_id, k.event_type, k.n FROM k JOIN m ON k.user_id = m.user_id WHERE abs(k.n - m.top) <= 1e-9 * m.top""",
    ),
    "feature_top_k": (
        "",
        """WITH f AS (SELECT source AS feature, min(doc_id) AS place, round(stddev_pop(n_chars) / (1 + avg(n_chars)), 9) AS score FROM documents GROUP BY source),
        r AS (SELECT *, row_number() OVER (ORDER BY score DESC, feature) AS rnk FROM f)
        SELECT feature, score, CAST(rnk AS BIGINT) AS rnk, CAST(row_number() OVER (ORDER BY place, feature) AS BIGINT) AS kept_order FROM r WHERE rnk <= 6""",
    ),
    "variant_registry_complete": (
        "",
        """WITH e AS (SELECT DISTINCT lang, source FROM documents), l AS (SELECT DISTINCT lang FROM e), s AS (SELECT DISTINCT source FROM e)
        SELECT l.lang, count(*) AS expected, CAST(sum(CASE WHEN e.source IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing FROM l CROSS JOIN s LEFT JOIN e ON e.lang = l.lang AND e.source = s.source GROUP BY l.lang""",
    ),
    "disjointness_check": (
        "",
        """WITH r AS (SELECT doc_id, source, CASE WHEN md5('split:' || CAST(doc_id AS STRING)) < '5' THEN 'heldout' ELSE 'train' END AS side, text FROM documents),
        k AS (SELECT @SHA(text) AS h, count(DISTINCT side) AS sides, count(*) AS n FROM r GROUP BY @SHA(text))
        SELECT count(*) AS texts, CAST(sum(CASE WHEN sides > 1 THEN 1 ELSE 0 END) AS BIGINT) AS on_both_sides, CAST(sum(CASE WHEN sides > 1 THEN n ELSE 0 END) AS BIGINT) AS leaked_rows FROM k""",
    ),
    "selection_audit": (
        "",
        """WITH r AS (SELECT @RANGE(10) AS rep), d AS (SELECT doc_id, rep, CASE WHEN md5('select:' || CAST(rep AS STRING) || ':' || CAST(doc_id AS STRING)) < '9' THEN 1 ELSE 0 END AS chosen FROM documents CROSS JOIN r),
        k AS (SELECT doc_id, sum(chosen) AS times FROM d GROUP BY doc_id)
        SELECT CAST(times AS BIGINT) AS times, count(*) AS documents, max(CASE WHEN times = 10 THEN 'always' WHEN times = 0 THEN 'never' ELSE 'sometimes' END) AS kind FROM k GROUP BY times""",
    ),
}

SAMPLING = {
    "fixed_width_groups": (
        "",
        """WITH t AS (SELECT item_id, @SUBALL(lower(text); '[^a-z]'; '') AS t FROM benchmark), u AS (SELECT item_id, t, CAST(length(t) AS BIGINT) AS n FROM t WHERE length(t) % 2 = 0),
        g AS (SELECT item_id, t, n, @SPAN(0; CAST(n / 2 AS INT) - 1) AS g FROM u WHERE n > 0)
        SELECT item_id, CAST(g AS BIGINT) AS place, substr(t, CAST(g * 2 + 1 AS INT), 2) AS pair FROM g""",
    ),
    "spread_segments": (
        "tok",
        """WITH d AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM tok GROUP BY doc_id HAVING count(*) >= 20), k AS (SELECT doc_id, n, least(4, CAST(floor(n / 20) AS BIGINT)) AS k FROM d),
        s AS (SELECT doc_id, n, k, @SPAN(0; CAST(k AS INT) - 1) AS j FROM k)
        SELECT doc_id, CAST(j AS BIGINT) AS segment, CAST(CASE WHEN k = 1 THEN floor((n - 20) / 2) ELSE @BROUND(j * (n - 20) / CAST(k - 1 AS DOUBLE)) END AS BIGINT) AS start FROM s""",
    ),
    "block_aligned_window": (
        "tok",
        """WITH d AS (SELECT doc_id, CAST(floor(count(*) / 10) AS BIGINT) AS blocks FROM tok GROUP BY doc_id), w AS (SELECT doc_id, blocks, @DRAW('window:' || CAST(doc_id AS STRING); blocks - 1) * 10 AS start FROM d WHERE blocks >= 2)
        SELECT w.doc_id, w.start, min(tok.tok) AS least_token, count(*) AS n FROM w JOIN tok ON tok.doc_id = w.doc_id AND tok.pos >= w.start AND tok.pos < w.start + 20 GROUP BY w.doc_id, w.start""",
    ),
    "pseudo_pages": ("tok", "SELECT doc_id, CAST(floor(pos / 10) AS BIGINT) AS page, count(*) AS n, max(CASE WHEN pos % 10 = 0 THEN tok END) AS first_token, CAST(sum(len) AS BIGINT) AS symbols FROM tok GROUP BY doc_id, CAST(floor(pos / 10) AS BIGINT)"),
    "rank_values_mod25": (
        "tok",
        """WITH k AS (SELECT doc_id, tok, count(*) AS n, min(pos) AS p FROM tok GROUP BY doc_id, tok), r AS (SELECT doc_id, tok, (row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) - 1) % 25 AS v FROM k)
        SELECT tok.doc_id, CAST(sum(v * (pos % 1000 + 1)) AS BIGINT) AS weighted, CAST(sum(CASE WHEN v = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zeros FROM tok JOIN r ON r.doc_id = tok.doc_id AND r.tok = tok.tok GROUP BY tok.doc_id""",
    ),
    "align_resampled": (
        "bwords",
        """WITH n AS (SELECT item_id, CAST(count(*) AS BIGINT) AS n FROM bwords GROUP BY item_id), p AS (SELECT a.item_id AS a, b.item_id AS b, a.n AS na, b.n AS nb, least(a.n, b.n) AS m FROM n a JOIN n b ON b.item_id = a.item_id + 1),
        i AS (SELECT a, b, na, nb, m, @SPAN(0; CAST(m AS INT) - 1) AS i FROM p),
        x AS (SELECT a, b, CAST(floor(i * na / CAST(m AS DOUBLE)) AS BIGINT) AS ia, CAST(floor(i * nb / CAST(m AS DOUBLE)) AS BIGINT) AS ib FROM i)
        SELECT x.a AS item_a, x.b AS item_b, count(*) AS aligned, CAST(sum(CASE WHEN u.tok = v.tok THEN 1 ELSE 0 END) AS BIGINT) AS equal
        FROM x JOIN bwords u ON u.item_id = x.a AND u.pos = x.ia JOIN bwords v ON v.item_id = x.b AND v.pos = x.ib GROUP BY x.a, x.b""",
    ),
    "centered_sample": (
        "tok",
        """WITH d AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM tok GROUP BY doc_id HAVING count(*) >= 30)
        SELECT tok.doc_id, min(pos) AS start, count(*) AS n, CAST(sum(len) AS BIGINT) AS symbols FROM tok JOIN d ON d.doc_id = tok.doc_id WHERE pos >= floor((n - 30) / 2) AND pos < floor((n - 30) / 2) + 30 GROUP BY tok.doc_id""",
    ),
    "stratified_group_folds": (
        "",
        """WITH g AS (SELECT source AS grp, max(toxic) AS y, count(*) AS n FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY source)
        SELECT grp, y, n, (CAST(row_number() OVER (PARTITION BY y ORDER BY n DESC, md5(grp)) AS BIGINT) - 1) % 5 AS fold FROM g""",
    ),
    "doubly_held_out": (
        "",
        """WITH d AS (SELECT doc_id, source AS family, (CAST(row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS STRING)), doc_id) AS BIGINT) - 1) % 5 AS fold FROM documents),
        c AS (SELECT family, fold, count(*) AS n FROM d GROUP BY family, fold), f AS (SELECT family, sum(n) AS n FROM c GROUP BY family), k AS (SELECT fold, sum(n) AS n FROM c GROUP BY fold), t AS (SELECT sum(n) AS n FROM c)
        SELECT c.family, c.fold, c.n AS scored, CAST(t.n - f.n - k.n + c.n AS BIGINT) AS trained FROM c JOIN f ON f.family = c.family JOIN k ON k.fold = c.fold CROSS JOIN t""",
    ),
}

PERMUTATIONS = {
    "worst_view_conjunction": (
        "tok",
        """WITH d AS (SELECT doc_id, lang, source, avg(len) - 4 AS x FROM tok GROUP BY doc_id, lang, source), r AS (SELECT @RANGE(20) AS rep),
        m AS (
          SELECT lang, source, rep, sum(CAST(floor(1e6 * CASE WHEN rep = 0 OR @UNIT('view:' || CAST(rep AS STRING) || ':' || CAST(doc_id AS STRING)) < 5e-1 THEN x ELSE 0e0 - x END) AS BIGINT)) / count(*) AS effect
          FROM d CROSS JOIN r GROUP BY lang, source, rep),
        o AS (SELECT lang, source, effect FROM m WHERE rep = 0),
        v AS (SELECT o.lang, o.source, max(o.effect) AS effect, (1 + sum(CASE WHEN m.effect >= o.effect THEN 1 ELSE 0 END)) / (1e0 + count(*)) AS p FROM o JOIN m ON m.lang = o.lang AND m.source = o.source AND m.rep > 0 GROUP BY o.lang, o.source),
        w AS (SELECT source, max(p) AS p, min(effect) AS least_effect, count(*) AS n_views FROM v GROUP BY source),
        h AS (SELECT *, row_number() OVER (ORDER BY p, source) AS i, count(*) OVER () AS c FROM w)
        SELECT source, round(p, 8) AS worst_p, CASE WHEN least_effect > 0 THEN 1 ELSE 0 END AS all_positive, n_views,
               round(least(1e0, max(p * (c - i + 1)) OVER (ORDER BY p, i ROWS UNBOUNDED PRECEDING)), 8) AS p_holm FROM h""",
    ),
    "identity_permutation": (
        "",
        """WITH n AS (SELECT item_id, CAST(length(text) AS BIGINT) AS n, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS c FROM benchmark), r AS (SELECT @RANGE(20) AS rep),
        p AS (SELECT item_id, rep, row_number() OVER (PARTITION BY rep ORDER BY CASE WHEN rep = 0 THEN '' ELSE md5('identity:' || CAST(rep AS STRING) || ':' || CAST(item_id AS STRING)) END, item_id) - 1 AS j FROM benchmark CROSS JOIN r),
        s AS (SELECT p.rep, sum(abs(a.n - b.n)) AS distance FROM p JOIN n a ON a.i = p.j JOIN n b ON b.item_id = p.item_id GROUP BY p.rep), o AS (SELECT distance FROM s WHERE rep = 0)
        SELECT CAST(max(o.distance) AS BIGINT) AS observed, (1 + sum(CASE WHEN s.distance <= o.distance THEN 1 ELSE 0 END)) / (1e0 + count(*)) AS p FROM s CROSS JOIN o WHERE s.rep > 0""",
    ),
    "family_label_permutation": (
        "",
        """WITH d AS (SELECT source, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) AS n FROM documents GROUP BY source), k AS (SELECT *, row_number() OVER (ORDER BY source) AS i, count(*) OVER () AS c FROM d), r AS (SELECT @RANGE(40) AS rep),
        p AS (SELECT rep, source, row_number() OVER (PARTITION BY rep ORDER BY CASE WHEN rep = 0 THEN '' ELSE md5('family:' || CAST(rep AS STRING) || ':' || source) END, source) AS i FROM k CROSS JOIN r),
        s AS (SELECT p.rep, sum(CASE WHEN k.i * 2 <= c THEN u.chars ELSE 0 END) / CAST(sum(CASE WHEN k.i * 2 <= c THEN u.n ELSE 0 END) AS DOUBLE) AS m FROM p JOIN k ON k.i = p.i JOIN d u ON u.source = p.source GROUP BY p.rep),
        o AS (SELECT m FROM s WHERE rep = 0)
        SELECT round(max(o.m), 6) AS observed, (1 + sum(CASE WHEN s.m >= o.m THEN 1 ELSE 0 END)) / (1e0 + count(*)) AS p FROM s CROSS JOIN o WHERE s.rep > 0""",
    ),
    "stratified_bootstrap": (
        "",
        """WITH d AS (SELECT toxic AS y, CAST(l.quality AS BIGINT) AS hit, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY toxic) AS n FROM labels l), r AS (SELECT @RANGE(40) AS rep),
        i AS (SELECT y, rep, CAST(floor(@UNIT('strata:' || CAST(y AS STRING) || ':' || CAST(rep AS STRING) || ':' || CAST(k AS STRING)) * n) AS BIGINT) AS k FROM d CROSS JOIN r),
        m AS (SELECT i.rep, i.y, avg(CAST(d.hit AS DOUBLE)) AS rate FROM i JOIN d ON d.y = i.y AND d.k = i.k GROUP BY i.rep, i.y),
        b AS (SELECT rep, avg(CASE WHEN y = 1 THEN 1 - rate ELSE rate END) AS balanced FROM m GROUP BY rep)
        SELECT count(*) AS draws, round(@PCT(balanced; 0.025), 6) AS low, round(@PCT(balanced; 0.5), 6) AS middle, round(@PCT(balanced; 0.975), 6) AS high FROM b""",
    ),
    "normalized_mi_modulus": (
        "bench",
        """WITH p AS (SELECT item_id, v % 5 AS a, lead(v % 5) OVER (PARTITION BY item_id ORDER BY i) AS b FROM bench), k AS (SELECT item_id, a, b, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY item_id, a, b),
        t AS (SELECT *, sum(n) OVER (PARTITION BY item_id) AS tot, sum(n) OVER (PARTITION BY item_id, a) AS l, sum(n) OVER (PARTITION BY item_id, b) AS r FROM k),
        m AS (SELECT item_id, sum(n / tot * log2(CAST(n AS DOUBLE) * tot / (CAST(l AS DOUBLE) * r))) AS mi, 0e0 - sum(n / tot * log2(l / tot)) AS hx, 0e0 - sum(n / tot * log2(r / tot)) AS hy FROM t GROUP BY item_id)
        SELECT item_id, round(CASE WHEN greatest(hx, hy) > 1e-12 THEN mi / greatest(hx, hy) ELSE 0e0 END, 6) AS normalized_mi FROM m""",
    ),
    "keyword_column_order": (
        "bench",
        """WITH k AS (SELECT item_id, i, c FROM bench WHERE i < 7)
        SELECT item_id, i AS column_place, CAST(row_number() OVER (PARTITION BY item_id ORDER BY c, i) AS BIGINT) - 1 AS read_order FROM k""",
    ),
    "nomenclator_hybrid": (
        "tok",
        """WITH k AS (SELECT doc_id, tok, count(*) AS n, min(pos) AS p FROM tok GROUP BY doc_id, tok), r AS (SELECT doc_id, tok, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS rnk FROM k),
        c AS (SELECT tok.doc_id, tok.pos, tok.tok, CASE WHEN rnk <= 32 THEN 'N' || CAST(rnk AS STRING) ELSE 'H' || tok.tok || CAST(pos % 3 AS STRING) END AS code, rnk FROM tok JOIN r ON r.doc_id = tok.doc_id AND r.tok = tok.tok),
        b AS (SELECT c.doc_id, c.pos, c.tok, c.code, CASE WHEN substr(code, 1, 1) = 'N' THEN r.tok ELSE substr(code, 2, CAST(length(code) AS INT) - 2) END AS back FROM c LEFT JOIN r ON r.doc_id = c.doc_id AND c.rnk <= 32 AND 'N' || CAST(r.rnk AS STRING) = c.code)
        SELECT doc_id, count(*) AS n, count(DISTINCT code) AS codes, bool_and(back = tok) AS restored FROM b GROUP BY doc_id""",
    ),
}

#: Okapi weights of the documents that share a word with an item, how many of its words they have, and the cosine of counts.
SCORES = """
q AS (SELECT item_id, tok, count(*) AS m FROM bwords GROUP BY item_id, tok),
qn AS (SELECT item_id, count(*) AS types, sqrt(CAST(sum(m * m) AS DOUBLE)) AS norm FROM q GROUP BY item_id),
tf AS (SELECT doc_id, tok, count(*) AS f FROM tok GROUP BY doc_id, tok),
dl AS (SELECT doc_id, sum(f) AS n, sqrt(CAST(sum(f * f) AS DOUBLE)) AS norm FROM tf GROUP BY doc_id),
av AS (SELECT avg(n) AS avgdl, count(*) AS docs FROM dl),
df AS (SELECT tok, count(*) AS df FROM tf GROUP BY tok),
s AS (
  SELECT q.item_id, tf.doc_id, count(*) AS hit, sum(q.m * f) / (max(qn.norm) * max(dl.norm)) AS cosine,
         sum(q.m * ln(1 + (docs - df + 5e-1) / (df + 5e-1)) * f * 25e-1 / (f + 15e-1 * (25e-2 + 75e-2 * n / avgdl))) AS score
  FROM q JOIN tf ON q.tok = tf.tok JOIN df ON df.tok = q.tok JOIN dl ON dl.doc_id = tf.doc_id JOIN qn ON qn.item_id = q.item_id CROSS JOIN av GROUP BY q.item_id, tf.doc_id),
ph AS (
  SELECT s.item_id, s.doc_id, 2e0 AS bonus FROM s JOIN qn ON qn.item_id = s.item_id AND qn.types = s.hit JOIN benchmark b ON b.item_id = s.item_id JOIN documents d ON d.doc_id = s.doc_id
  WHERE instr(lower(d.text), lower(b.text)) > 0),
z AS (SELECT s.item_id, s.doc_id, round(score + coalesce(bonus, 0e0), 5) AS score, round(cosine, 7) AS cosine FROM s LEFT JOIN ph ON ph.item_id = s.item_id AND ph.doc_id = s.doc_id)"""

RETRIEVAL = {
    "bm25_rank": (
        "tok bwords",
        f"""WITH {SCORES}, k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rnk FROM z)
        SELECT item_id, doc_id, score, CAST(rnk AS BIGINT) AS rnk FROM k WHERE rnk <= 10""",
    ),
    "rrf_hybrid": (
        "tok bwords",
        f"""WITH {SCORES},
        r AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS a, row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, doc_id) AS b FROM z),
        f AS (SELECT item_id, doc_id, a, b, round(1 / (60e0 + a) + 1 / (60e0 + b), 8) AS score FROM r),
        k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rnk FROM f)
        SELECT item_id, doc_id, score, CAST(a AS BIGINT) AS lexical_rank, CAST(b AS BIGINT) AS vector_rank, CAST(rnk AS BIGINT) AS rnk FROM k WHERE rnk <= 10""",
    ),
    "candidate_truncation": (
        "tok bwords",
        f"""WITH {SCORES},
        r AS (SELECT item_id, doc_id, score, cosine, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS a FROM z),
        t AS (SELECT item_id, doc_id, cosine, a, row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, doc_id) AS b FROM r WHERE a <= 24),
        f AS (SELECT item_id, doc_id, cosine, round(1 / (60e0 + a) + 1 / (60e0 + b), 8) AS fused FROM t),
        k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY fused DESC, doc_id) AS c FROM f),
        p AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, doc_id) AS packet FROM k WHERE c <= 12)
        SELECT item_id, doc_id, fused, CAST(packet AS BIGINT) AS packet FROM p""",
    ),
    "retrieval_metrics_rectangular": (
        "tok bwords",
        f"""WITH {SCORES},
        truth AS (SELECT item_id, min(doc_id) AS doc_id FROM ph GROUP BY item_id),
        k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rnk, count(*) OVER (PARTITION BY item_id) AS n FROM z),
        m AS (SELECT k.item_id, 1e0 / rnk AS rr, CASE WHEN rnk = 1 THEN 1e0 ELSE 0e0 END AS top1, n FROM k JOIN truth ON truth.item_id = k.item_id AND truth.doc_id = k.doc_id),
        e AS (SELECT DISTINCT n FROM m), h AS (SELECT n, @SPAN(1; CAST(n AS INT)) AS i FROM e), x AS (SELECT n, sum(1e0 / i) / n AS chance FROM h GROUP BY n)
        SELECT count(*) AS queries, round(avg(rr), 6) AS mrr, round(avg((rr - chance) / (1 - chance)), 6) AS normalized_mrr, round(avg(top1), 6) AS top1, round(avg(top1 - 1e0 / m.n), 6) AS top1_lift
        FROM m JOIN x ON x.n = m.n WHERE m.n > 1""",
    ),
}

#: Three features of each document under three variants: as it is, its first half, its second half.
FEATURES = """
h AS (SELECT doc_id, pos, tok, len, count(*) OVER (PARTITION BY doc_id) AS n FROM tok),
v AS (
  SELECT 'whole' AS variant, doc_id, tok, len FROM h UNION ALL SELECT 'first' AS variant, doc_id, tok, len FROM h WHERE pos * 2 < n
  UNION ALL SELECT 'second' AS variant, doc_id, tok, len FROM h WHERE pos * 2 >= n AND n > 1),
w AS (
  SELECT variant, doc_id, avg(len) AS mean_length, count(DISTINCT tok) / CAST(count(*) AS DOUBLE) AS type_ratio, sum(CASE WHEN len <= 3 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS short_share
  FROM v GROUP BY variant, doc_id),
f AS (
  SELECT variant, doc_id, 'mean_length' AS feature, mean_length AS x FROM w UNION ALL SELECT variant, doc_id, 'type_ratio' AS feature, type_ratio AS x FROM w
  UNION ALL SELECT variant, doc_id, 'short_share' AS feature, short_share AS x FROM w)"""

SELECTION = {
    "invariant_feature_selection": (
        "tok",
        f"""WITH {FEATURES},
        t AS (SELECT f.variant, f.doc_id, f.feature, f.x, l.quality AS y FROM f JOIN labels l ON l.doc_id = f.doc_id WHERE md5('split:' || CAST(f.doc_id AS STRING)) < 'c'),
        m AS (SELECT variant, feature, avg(x) AS mean, CASE WHEN stddev_pop(x) > 1e-12 THEN stddev_pop(x) ELSE 1e0 END AS sd, avg(CASE WHEN y = 1 THEN x END) AS x1, avg(CASE WHEN y = 0 THEN x END) AS x0 FROM t GROUP BY variant, feature),
        p AS (SELECT feature, @PCT(abs(x1 - x0) / sd; 0.5) AS separation FROM m GROUP BY feature),
        d AS (SELECT t.feature, t.doc_id, stddev_pop((t.x - m.mean) / m.sd) AS spread FROM t JOIN m ON m.variant = t.variant AND m.feature = t.feature GROUP BY t.feature, t.doc_id HAVING count(*) = 3),
        i AS (SELECT feature, @PCT(spread; 0.5) AS instability FROM d GROUP BY feature),
        s AS (SELECT p.feature, separation, instability, round(separation / (1 + instability), 9) AS score FROM p JOIN i ON i.feature = p.feature)
        SELECT feature, round(separation, 6) AS separation, round(instability, 6) AS instability, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, feature) AS BIGINT) AS rnk FROM s""",
    ),
    "feature_survival": (
        "tok",
        f"""WITH {FEATURES},
        b AS (SELECT doc_id, feature, x FROM f WHERE variant = 'whole'), sd AS (SELECT feature, CASE WHEN stddev_pop(x) > 1e-12 THEN stddev_pop(x) ELSE 1e0 END AS sd FROM b GROUP BY feature),
        j AS (SELECT f.variant, f.feature, b.x AS x, f.x AS y FROM f JOIN b ON b.doc_id = f.doc_id AND b.feature = f.feature WHERE f.variant <> 'whole'),
        r AS (
          SELECT variant, feature, x, y, rank() OVER (PARTITION BY variant, feature ORDER BY round(x, 9)) + (count(*) OVER (PARTITION BY variant, feature, round(x, 9)) - 1) / 2e0 AS a,
                 rank() OVER (PARTITION BY variant, feature ORDER BY round(y, 9)) + (count(*) OVER (PARTITION BY variant, feature, round(y, 9)) - 1) / 2e0 AS b FROM j)
        SELECT r.variant, r.feature, round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0e0), 6) AS spearman, round(@PCT(abs(y - x) / sd; 0.5), 6) AS median_shift
        FROM r JOIN sd ON sd.feature = r.feature GROUP BY r.variant, r.feature""",
    ),
    "score_summary": (
        "tok",
        """WITH s AS (SELECT source, doc_id, avg(len) AS score FROM tok GROUP BY source, doc_id)
        SELECT source, CASE WHEN source IS NULL THEN 'all' ELSE 'subgroup' END AS level, count(*) AS n, round(@PCT(score; 0.5), 6) AS median, round(@PCT(score; 0.75) - @PCT(score; 0.25), 6) AS iqr
        FROM s GROUP BY GROUPING SETS ((), (source))""",
    ),
    "scoped_uncertainty": (
        "ltok",
        """WITH p AS (SELECT source, doc_id, substr(tok, CAST(len AS INT), 1) AS ctx, lead(substr(tok, 1, 1)) OVER (PARTITION BY doc_id, line ORDER BY pos) AS unit FROM ltok),
        k AS (SELECT source, ctx, unit, count(*) AS n FROM p WHERE unit IS NOT NULL GROUP BY source, ctx, unit), c AS (SELECT source, ctx, sum(n) AS n FROM k GROUP BY source, ctx), u AS (SELECT source, unit, sum(n) AS n FROM k GROUP BY source, unit),
        j AS (SELECT source, log2(CAST(sum(n) AS DOUBLE)) - sum(n * log2(CAST(n AS DOUBLE))) / sum(n) AS joint, sum(n) AS tot FROM k GROUP BY source),
        x AS (SELECT source, log2(CAST(sum(n) AS DOUBLE)) - sum(n * log2(CAST(n AS DOUBLE))) / sum(n) AS ctx_bits FROM c GROUP BY source),
        y AS (SELECT source, log2(CAST(sum(n) AS DOUBLE)) - sum(n * log2(CAST(n AS DOUBLE))) / sum(n) AS unit_bits FROM u GROUP BY source)
        SELECT j.source, CASE WHEN tot >= 30 THEN round(unit_bits, 6) END AS unit_entropy_bits, CASE WHEN tot >= 30 THEN round(joint - ctx_bits, 6) END AS conditional_entropy_bits, CAST(tot AS BIGINT) AS pairs
        FROM j JOIN x ON x.source = j.source JOIN y ON y.source = j.source""",
    ),
}

QUERIES = SELECTION | RETRIEVAL | HELD_OUT | ALIGNMENT | LEDGER | CHECKS | SAMPLING | PERMUTATIONS
