"""Entropy, mutual information, divergence, coincidence and predictive statistics."""

ENTROPY = "round(0e0 - sum(n / tot * log2(n / tot)), 6)"

QUERIES = {
    "char_entropy_by_doc": (
        "tok chars",
        f"""WITH k AS (SELECT doc_id, c, count(*) AS n FROM chars GROUP BY doc_id, c),
        t AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS tot FROM k)
        SELECT doc_id, {ENTROPY} AS char_entropy_bits, CAST(sum(n) AS BIGINT) AS n_chars, count(*) AS alphabet_size FROM t GROUP BY doc_id""",
    ),
    "token_entropy_by_lang": (
        "tok",
        f"""WITH k AS (SELECT lang, tok, count(*) AS n FROM tok GROUP BY lang, tok),
        s AS (SELECT lang, sum(n) AS tot FROM k GROUP BY lang)
        SELECT k.lang, {ENTROPY} AS token_entropy_bits, count(*) AS n_types FROM k JOIN s ON k.lang = s.lang GROUP BY k.lang""",
    ),
    "normalized_entropy": (
        "bench",
        """WITH k AS (SELECT item_id, v % 25 AS v, count(*) AS n FROM bench GROUP BY item_id, v % 25),
        t AS (SELECT *, sum(n) OVER (PARTITION BY item_id) AS tot FROM k)
        SELECT item_id, round((0e0 - sum(n / tot * log2(n / tot))) / log2(25e0), 6) AS h_norm FROM t GROUP BY item_id""",
    ),
    "bigram_mutual_information": (
        "tok",
        """WITH b AS (SELECT doc_id, tok AS a, lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM tok),
        k AS (SELECT doc_id, a, b, count(*) AS n FROM b WHERE b IS NOT NULL GROUP BY doc_id, a, b),
        t AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS tot, sum(n) OVER (PARTITION BY doc_id, a) AS l, sum(n) OVER (PARTITION BY doc_id, b) AS r FROM k)
        SELECT doc_id, round(sum(n / tot * log2(CAST(n AS DOUBLE) * tot / (CAST(l AS DOUBLE) * r))), 6) AS mi_bits FROM t GROUP BY doc_id""",
    ),
    "length_transition_mi": (
        "tok",
        """WITH b AS (SELECT doc_id, len AS a, lead(len) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM tok),
        k AS (SELECT doc_id, a, b, count(*) AS n FROM b WHERE b IS NOT NULL GROUP BY doc_id, a, b),
        t AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS tot, sum(n) OVER (PARTITION BY doc_id, a) AS l, sum(n) OVER (PARTITION BY doc_id, b) AS r FROM k)
        SELECT doc_id, round(sum(n / tot * log2(CAST(n AS DOUBLE) * tot / (CAST(l AS DOUBLE) * r))), 6) AS mi_bits FROM t GROUP BY doc_id""",
    ),
    "first_last_char_l1": (
        "tok",
        """WITH e AS (SELECT doc_id, substr(tok, 1, 1) AS c, 1 AS f, 0 AS l FROM tok UNION ALL SELECT doc_id, substr(tok, CAST(len AS INT), 1) AS c, 0 AS f, 1 AS l FROM tok),
        k AS (SELECT doc_id, c, sum(f) AS f, sum(l) AS l FROM e GROUP BY doc_id, c),
        t AS (SELECT *, sum(f) OVER (PARTITION BY doc_id) AS n FROM k)
        SELECT doc_id, round(sum(abs(f - l) / n), 6) AS l1, round(0e0 - sum(CASE WHEN f > 0 THEN f / n * log2(f / n) ELSE 0e0 END), 6) AS first_entropy_bits, round(0e0 - sum(CASE WHEN l > 0 THEN l / n * log2(l / n) ELSE 0e0 END), 6) AS last_entropy_bits
            FROM t GROUP BY doc_id""",
    ),
    "js_drift_by_source": (
        "tok",
        """WITH k AS (SELECT source, tok, count(*) AS n FROM tok GROUP BY source, tok),
        p AS (SELECT source, tok, n / sum(n) OVER (PARTITION BY source) AS p FROM k),
        o AS (SELECT source, row_number() OVER (ORDER BY source) AS r FROM (SELECT DISTINCT source FROM k)),
        w AS (SELECT r, tok, p FROM p JOIN o ON p.source = o.source),
        u AS (SELECT r AS pair, tok, p AS a, 0e0 AS b FROM w UNION ALL SELECT r - 1 AS pair, tok, 0e0 AS a, p AS b FROM w),
        g AS (SELECT pair, tok, sum(a) AS a, sum(b) AS b FROM u GROUP BY pair, tok)
        SELECT CAST(pair AS BIGINT) AS pair, round(sum(CASE WHEN a > 0 THEN a / 2 * log2(2 * a / (a + b)) ELSE 0e0 END + CASE WHEN b > 0 THEN b / 2 * log2(2 * b / (a + b)) ELSE 0e0 END), 6) AS js_bits
            FROM g GROUP BY pair HAVING sum(a) > 0 AND sum(b) > 0""",
    ),
    "js_drift_consecutive_turns": (
        "turns",
        """WITH k AS (SELECT conv_id, turn, tok, count(*) AS n FROM turns GROUP BY conv_id, turn, tok),
        p AS (SELECT conv_id, turn, tok, n / sum(n) OVER (PARTITION BY conv_id, turn) AS p FROM k),
        o AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM (SELECT DISTINCT conv_id, turn FROM k)),
        w AS (SELECT p.conv_id, r, tok, p FROM p JOIN o ON p.conv_id = o.conv_id AND p.turn = o.turn),
        u AS (SELECT conv_id, r AS pair, tok, p AS a, 0e0 AS b FROM w UNION ALL SELECT conv_id, r - 1 AS pair, tok, 0e0 AS a, p AS b FROM w),
        g AS (SELECT conv_id, pair, tok, sum(a) AS a, sum(b) AS b FROM u GROUP BY conv_id, pair, tok),
        j AS (SELECT conv_id, pair, sum(CASE WHEN a > 0 THEN a / 2 * log2(2 * a / (a + b)) ELSE 0e0 END + CASE WHEN b > 0 THEN b / 2 * log2(2 * b / (a + b)) ELSE 0e0 END) AS js
            FROM g GROUP BY conv_id, pair HAVING sum(a) > 0 AND sum(b) > 0)
        SELECT conv_id, round(avg(js), 6) AS mean_js_bits, count(*) AS n_pairs FROM j GROUP BY conv_id""",
    ),
    "index_of_coincidence": (
        "ev",
        """WITH k AS (SELECT user_id, event_type, count(*) AS n FROM ev GROUP BY user_id, event_type),
        t AS (SELECT user_id, sum(n * (n - 1)) AS hit, sum(n) AS tot FROM k GROUP BY user_id)
        SELECT user_id, CASE WHEN tot < 2 THEN 0e0 ELSE round(hit / (tot * (tot - 1)), 6) END AS ic FROM t""",
    ),
    "lag_coincidence": (
        "ev",
        """WITH g AS (SELECT @RANGE(12) AS g),
        x AS (SELECT user_id, event_type, pos, g + 1 AS gap FROM ev CROSS JOIN g),
        j AS (SELECT x.user_id, x.gap, CASE WHEN x.event_type = y.event_type THEN 1 ELSE 0 END AS same FROM x JOIN ev y ON x.user_id = y.user_id AND y.pos = x.pos + x.gap)
        SELECT user_id, CAST(gap AS BIGINT) AS lag, round(sum(same) / count(*), 6) AS rate, count(*) AS n FROM j GROUP BY user_id, gap""",
    ),
    "periodic_slice_ic": (
        "ev",
        """WITH g AS (SELECT @RANGE(6) AS g),
        x AS (SELECT user_id, g + 1 AS period, pos % (g + 1) AS r, event_type, count(*) AS n FROM ev CROSS JOIN g GROUP BY user_id, g + 1, pos % (g + 1), event_type),
        s AS (SELECT user_id, period, r, sum(n * (n - 1)) AS hit, sum(n) AS tot FROM x GROUP BY user_id, period, r)
        SELECT user_id, CAST(period AS BIGINT) AS period, round(avg(CASE WHEN tot < 2 THEN 0e0 ELSE hit / (tot * (tot - 1)) END), 6) AS mean_ic FROM s GROUP BY user_id, period""",
    ),
    "ngram_spacings": (
        "ev",
        """WITH b AS (SELECT user_id, pos, event_type AS a, lead(event_type, 1) OVER (PARTITION BY user_id ORDER BY pos) AS b, lead(event_type, 2) OVER (PARTITION BY user_id ORDER BY pos) AS c
            FROM ev),
        s AS (SELECT user_id, a, b, c, pos, pos - lag(pos) OVER (PARTITION BY user_id, a, b, c ORDER BY pos) AS gap FROM b WHERE c IS NOT NULL)
        SELECT user_id, a, b, c, count(gap) AS repeats, CAST(min(gap) AS BIGINT) AS least_gap, CAST(sum(gap) AS BIGINT) AS total_gap
            FROM s GROUP BY user_id, a, b, c HAVING count(gap) > 0""",
    ),
    "count_spectrum": (
        "tok",
        """WITH k AS (SELECT doc_id, tok, count(*) AS n FROM tok GROUP BY doc_id, tok),
        r AS (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS share, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, tok) AS rnk FROM k),
        d AS (SELECT doc_id, g + 1 AS rnk FROM (SELECT DISTINCT doc_id FROM k) CROSS JOIN (SELECT @RANGE(8) AS g))
        SELECT d.doc_id, CAST(d.rnk AS BIGINT) AS rnk, round(coalesce(share, 0e0), 6) AS share FROM d LEFT JOIN r ON d.doc_id = r.doc_id AND d.rnk = r.rnk""",
    ),
    "modal_consistency": (
        "bench",
        """WITH p AS (SELECT item_id, v AS p, (v * 7 + i % 3) % 26 AS c FROM bench),
        k AS (SELECT item_id, p, c, count(*) AS n FROM p GROUP BY item_id, p, c),
        a AS (SELECT item_id, sum(m) AS m FROM (SELECT item_id, p, max(n) AS m FROM k GROUP BY item_id, p) GROUP BY item_id),
        b AS (SELECT item_id, sum(m) AS m FROM (SELECT item_id, c, max(n) AS m FROM k GROUP BY item_id, c) GROUP BY item_id),
        t AS (SELECT item_id, sum(n) AS n FROM k GROUP BY item_id)
        SELECT t.item_id, round((a.m + b.m) / (2 * t.n), 6) AS consistency FROM t JOIN a ON t.item_id = a.item_id JOIN b ON t.item_id = b.item_id""",
    ),
    "block_information": (
        "tok",
        """WITH k AS (SELECT doc_id, tok AS a, CAST(floor(pos / 20) AS BIGINT) AS b, count(*) AS n FROM tok GROUP BY doc_id, tok, CAST(floor(pos / 20) AS BIGINT)),
        t AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS tot, sum(n) OVER (PARTITION BY doc_id, a) AS l, sum(n) OVER (PARTITION BY doc_id, b) AS r FROM k)
        SELECT doc_id, round(sum(n / tot * log2(CAST(n AS DOUBLE) * tot / (CAST(l AS DOUBLE) * r))), 6) AS block_mi_bits FROM t GROUP BY doc_id""",
    ),
}
