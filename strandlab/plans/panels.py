"""Feature panels of documents, pages and records."""

SKEW = "CASE WHEN count(*) > 2 AND var_pop(x) > 0 THEN (avg(x * x * x) - 3 * avg(x) * avg(x * x) + 2 * avg(x) * avg(x) * avg(x)) / power(var_pop(x), 15e-1) * sqrt(CAST(count(*) AS DOUBLE) * (count(*) - 1)) / (count(*) - 2) ELSE 0e0 END"
CORR = "coalesce(covar_pop({0}, {1}) / nullif(stddev_pop({0}) * stddev_pop({1}), 0e0), 0e0)"

QUERIES = {
    "type_token_hapax": (
        "tok",
        """WITH k AS (SELECT doc_id, tok, count(*) AS n FROM tok GROUP BY doc_id, tok)
        SELECT doc_id, count(*) AS n_types, CAST(sum(n) AS BIGINT) AS n_tokens, round(count(*) / sum(n), 6) AS type_ratio, round(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) / count(*), 6) AS hapax_ratio, round(max(n) / sum(n), 6) AS most_common_rate
            FROM k GROUP BY doc_id""",
    ),
    "zipf_fit": (
        "tok",
        """WITH k AS (SELECT doc_id, tok, count(*) AS n FROM tok GROUP BY doc_id, tok),
        r AS (SELECT doc_id, ln(CAST(n AS DOUBLE)) AS y, ln(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, tok) AS DOUBLE)) AS x FROM k)
        SELECT doc_id, CASE WHEN count(*) < 3 THEN 0e0 ELSE round(covar_pop(y, x) / nullif(var_pop(x), 0e0), 6) END AS slope, CASE WHEN count(*) < 3 OR var_pop(y) < 1e-12 THEN 0e0 ELSE round(covar_pop(y, x) * covar_pop(y, x) / nullif(var_pop(x) * var_pop(y), 0e0), 6) END AS r2
            FROM r GROUP BY doc_id""",
    ),
    "repeat_triple_rates": (
        "tok",
        """WITH b AS (SELECT doc_id, tok AS a, lead(tok, 1) OVER (PARTITION BY doc_id ORDER BY pos) AS b, lead(tok, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS c FROM tok)
        SELECT doc_id, round(sum(CASE WHEN a = b THEN 1 ELSE 0 END) / nullif(count(b), 0), 6) AS repeat_rate, round(sum(CASE WHEN a = b AND b = c THEN 1 ELSE 0 END) / nullif(count(c), 0), 6) AS triple_rate, round(count(DISTINCT a || ' ' || b) / nullif(count(b), 0), 6) AS bigram_type_ratio, round(count(DISTINCT a || ' ' || b || ' ' || c) / nullif(count(c), 0), 6) AS trigram_type_ratio
            FROM b GROUP BY doc_id""",
    ),
    "token_length_moments": (
        "tok",
        f"""WITH t AS (SELECT doc_id, CAST(len AS DOUBLE) AS x, CAST(lead(len) OVER (PARTITION BY doc_id ORDER BY pos) AS DOUBLE) AS y FROM tok),
        m AS (SELECT doc_id, avg(x) AS mean, stddev_pop(x) AS sd, {SKEW} AS skew FROM t GROUP BY doc_id),
        a AS (SELECT doc_id, CASE WHEN count(*) < 2 THEN 0e0 ELSE {CORR.format('x', 'y')} END AS lag1 FROM t WHERE y IS NOT NULL GROUP BY doc_id)
        SELECT m.doc_id, round(mean, 6) AS mean_token_length, round(sd, 6) AS token_length_std, round(skew, 5) AS token_length_skew, round(coalesce(lag1, 0e0), 6) AS token_length_lag1
            FROM m LEFT JOIN a ON m.doc_id = a.doc_id""",
    ),
    "surface_panel": (
        "tok chars",
        """WITH s AS (SELECT doc_id, count(*) AS n, avg(len) AS mean_len, stddev_pop(len) AS sd_len FROM tok GROUP BY doc_id HAVING count(*) >= 20),
        k AS (SELECT doc_id, tok, count(*) AS n FROM tok GROUP BY doc_id, tok),
        kt AS (SELECT doc_id, count(*) AS types, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS hapax, max(n) AS top, 0e0 - sum(n * log2(CAST(n AS DOUBLE))) AS nl, sum(n) AS tot
            FROM k GROUP BY doc_id),
        c AS (SELECT doc_id, c, count(*) AS n FROM chars GROUP BY doc_id, c),
        kc AS (SELECT doc_id, count(*) AS alphabet, max(n) AS top, 0e0 - sum(n * log2(CAST(n AS DOUBLE))) AS nl, sum(n) AS tot FROM c GROUP BY doc_id),
        b AS (SELECT doc_id, tok AS a, lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM tok),
        kb AS (SELECT doc_id, sum(CASE WHEN @EDIT1(a; b) THEN 1 ELSE 0 END) / nullif(count(b), 0) AS edit1, count(DISTINCT a || ' ' || b) / nullif(count(b), 0) AS bigrams
            FROM b GROUP BY doc_id)
        SELECT s.doc_id, round(mean_len, 6) AS mean_token_length, round(sd_len, 6) AS token_length_std, round(types / s.n, 6) AS token_type_ratio, round(hapax / types, 6) AS token_hapax_ratio, round(kt.nl / kt.tot + log2(CAST(kt.tot AS DOUBLE)), 6) AS token_entropy_bits, round(kc.nl / kc.tot + log2(CAST(kc.tot AS DOUBLE)), 6) AS char_entropy_bits, round(edit1, 6) AS adjacent_edit1_rate, round(bigrams, 6) AS token_bigram_type_ratio, alphabet AS alphabet_size, round(kt.top / s.n, 6) AS most_common_token_rate, round(kc.top / kc.tot, 6) AS most_common_char_rate
            FROM s JOIN kt ON s.doc_id = kt.doc_id JOIN kc ON s.doc_id = kc.doc_id JOIN kb ON s.doc_id = kb.doc_id""",
    ),
    "page_panel": (
        "ltok",
        """WITH k AS (SELECT doc_id, tok, count(*) AS n FROM ltok GROUP BY doc_id, tok),
        kt AS (SELECT doc_id, count(*) AS types, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS hapax FROM k GROUP BY doc_id),
        b AS (SELECT doc_id, len, CASE WHEN lead(tok) OVER (PARTITION BY doc_id, line ORDER BY pos) = tok THEN 1 ELSE 0 END AS same, CASE WHEN lead(tok) OVER (PARTITION BY doc_id, line ORDER BY pos) IS NULL THEN 0 ELSE 1 END AS pair, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id, line, tok ORDER BY pos) <= 20 THEN 1 ELSE 0 END AS again
            FROM ltok)
        SELECT b.doc_id, round(avg(len), 6) AS group_length_mean, round(stddev_pop(len) / avg(len), 6) AS group_length_cv, round(max(types) / count(*), 6) AS group_type_token_ratio, round(max(hapax) / max(types), 6) AS group_hapax_ratio, round(sum(same) / nullif(sum(pair), 0), 6) AS adjacent_group_repeat_rate, round(sum(again) / count(*), 6) AS window20_group_recurrence
            FROM b JOIN kt ON b.doc_id = kt.doc_id GROUP BY b.doc_id""",
    ),
    "window20_copy_rate": (
        "tok",
        """WITH w AS (SELECT doc_id, tok, pos, @LIST(tok) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS prev FROM tok)
        SELECT doc_id, round(sum(CASE WHEN @ANYNEAR(prev; tok) THEN 1 ELSE 0 END) / count(*), 6) AS copy_rate, count(*) AS n FROM w WHERE pos > 0 GROUP BY doc_id""",
    ),
    "adjacent_edit1_rate": (
        "tok",
        """WITH b AS (SELECT doc_id, tok AS a, lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM tok)
        SELECT doc_id, round(sum(CASE WHEN @EDIT1(a; b) THEN 1 ELSE 0 END) / count(*), 6) AS edit1_rate FROM b WHERE b IS NOT NULL GROUP BY doc_id""",
    ),
    "window20_exact_recurrence": (
        "tok",
        """WITH g AS (SELECT doc_id, pos - lag(pos) OVER (PARTITION BY doc_id, tok ORDER BY pos) AS gap FROM tok)
        SELECT doc_id, round(sum(CASE WHEN gap <= 20 THEN 1 ELSE 0 END) / count(*), 6) AS recurrence FROM g GROUP BY doc_id""",
    ),
    "recurrence_median": (
        "tok",
        """WITH g AS (SELECT doc_id, pos - lag(pos) OVER (PARTITION BY doc_id, tok ORDER BY pos) AS gap FROM tok)
        SELECT doc_id, round(CAST(median(gap) AS DOUBLE), 6) AS median_gap, count(gap) AS n_gaps FROM g GROUP BY doc_id""",
    ),
    # Rows without doc_id: all documents after another, by doc_id.
    "vocabulary_growth_pooled": (
        "tok",
        """WITH d AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id),
        o AS (SELECT doc_id, n, CAST(sum(n) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - n AS earlier FROM d),
        f AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id, tok ORDER BY pos) AS k FROM tok),
        c AS (SELECT doc_id, pos + 1 AS prefix, sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS types FROM f),
        g AS (SELECT tok, min(earlier + pos + 1) AS at FROM tok JOIN o ON tok.doc_id = o.doc_id GROUP BY tok),
        t AS (SELECT CAST(sum(n) AS BIGINT) AS n FROM d),
        b AS (SELECT CAST(power(2, e) AS BIGINT) AS prefix, n FROM t CROSS JOIN (SELECT @RANGE(52) AS e) z),
        q AS (SELECT prefix FROM b WHERE prefix <= n UNION SELECT n AS prefix FROM t UNION SELECT CAST(floor(n / 2) AS BIGINT) AS prefix FROM t)
        SELECT c.doc_id, CAST(prefix AS BIGINT) AS prefix, CAST(types AS BIGINT) AS types FROM c JOIN d ON c.doc_id = d.doc_id
            WHERE (prefix & (prefix - 1)) = 0 OR prefix = n OR prefix = CAST(floor(n / 2) AS BIGINT) UNION ALL SELECT CAST(NULL AS BIGINT) AS doc_id, prefix, count(*) AS types
            FROM q JOIN g ON g.at <= q.prefix GROUP BY prefix""",
    ),
    "vocabulary_growth_page_reset": (
        "ltok",
        """WITH f AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line, tok ORDER BY pos) AS k, pos, count(*) OVER (PARTITION BY doc_id, line) AS n FROM ltok)
        SELECT doc_id, CAST(sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) AS BIGINT) AS discoveries, round(sum(CASE WHEN k = 1 AND 2 * pos >= n THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN 2 * pos >= n THEN 1 ELSE 0 END), 0), 6) AS second_half_novelty
            FROM f GROUP BY doc_id""",
    ),
    "length_autocorrelation": (
        "tok",
        f"""WITH g AS (SELECT @RANGE(20) AS g),
        x AS (SELECT a.doc_id, g + 1 AS lag, CAST(a.len AS DOUBLE) AS x, CAST(b.len AS DOUBLE) AS y
            FROM tok a CROSS JOIN g JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + g + 1 WHERE g + 1 IN (1, 2, 5, 10, 20))
        SELECT doc_id, CAST(lag AS BIGINT) AS lag, round({CORR.format('x', 'y')}, 6) AS r FROM x GROUP BY doc_id, lag HAVING count(*) >= 3""",
    ),
    "length_block_cv": (
        "tok",
        """WITH b AS (SELECT doc_id, floor(pos / 20) AS b, avg(len) AS m, stddev_pop(len) AS s FROM tok GROUP BY doc_id, floor(pos / 20))
        SELECT doc_id, round(coalesce(stddev_pop(m) / nullif(avg(m), 0e0), 0e0), 6) AS mean_cv, round(coalesce(stddev_pop(s) / nullif(avg(s), 0e0), 0e0), 6) AS std_cv
            FROM b GROUP BY doc_id""",
    ),
    "cooccurrence_graph": (
        "tok",
        """WITH b AS (SELECT doc_id, tok AS a, lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM tok),
        e AS (SELECT doc_id, least(a, b) AS u, greatest(a, b) AS v, count(*) AS w FROM b WHERE b IS NOT NULL AND a <> b GROUP BY doc_id, least(a, b), greatest(a, b)),
        s AS (SELECT doc_id, u, v, w FROM e UNION ALL SELECT doc_id, v AS u, u AS v, w FROM e),
        n AS (SELECT doc_id, u, sum(w) AS strength, count(*) AS degree FROM s GROUP BY doc_id, u),
        z AS (SELECT doc_id, stddev_pop(strength / degree) AS sd, avg(strength / degree) AS m, count(*) AS nodes FROM n GROUP BY doc_id),
        p AS (SELECT s.doc_id, CAST(a.degree AS DOUBLE) AS x, CAST(b.degree AS DOUBLE) AS y, CAST(s.w AS DOUBLE) AS w
            FROM s JOIN n a ON s.doc_id = a.doc_id AND s.u = a.u JOIN n b ON s.doc_id = b.doc_id AND s.v = b.u),
        q AS (SELECT doc_id, sum(w * x) / sum(w) AS mx, sum(w * x * y) / sum(w) AS mxy, sum(w * x * x) / sum(w) AS mxx, count(*) / 2 AS edges FROM p GROUP BY doc_id)
        SELECT q.doc_id, CAST(edges AS BIGINT) AS n_edges, nodes AS n_nodes, round(coalesce(sd / nullif(m, 0e0), 0e0), 6) AS selectivity_cv, CASE WHEN mxx - mx * mx < 1e-9 THEN 0e0 ELSE round((mxy - mx * mx) / (mxx - mx * mx), 5) END AS degree_assortativity
            FROM q JOIN z ON q.doc_id = z.doc_id""",
    ),
    "core_battery": (
        "ltok",
        """WITH k AS (SELECT doc_id, tok, count(*) AS n FROM ltok GROUP BY doc_id, tok),
        kt AS (SELECT doc_id, count(*) AS types, sum(n) AS tot, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS singles FROM k GROUP BY doc_id),
        b AS (SELECT doc_id, tok AS a, lead(tok) OVER (PARTITION BY doc_id, line ORDER BY pos) AS b FROM ltok),
        s AS (SELECT doc_id, sum(CASE WHEN a = b THEN 1 ELSE 0 END) / nullif(count(b), 0) AS same, count(b) AS pairs FROM b GROUP BY doc_id),
        x AS (SELECT doc_id, substr(a, CAST(length(a) AS INT), 1) AS l, substr(b, 1, 1) AS r, count(*) AS n
            FROM b WHERE b IS NOT NULL GROUP BY doc_id, substr(a, CAST(length(a) AS INT), 1), substr(b, 1, 1)),
        y AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS tot, sum(n) OVER (PARTITION BY doc_id, l) AS ln, sum(n) OVER (PARTITION BY doc_id, r) AS rn FROM x),
        mi AS (SELECT doc_id, sum(n / tot * log2(CAST(n AS DOUBLE) * tot / (CAST(ln AS DOUBLE) * rn))) AS edge FROM y GROUP BY doc_id)
        SELECT kt.doc_id, round(types / tot, 6) AS group_type_token_ratio, round(singles / types, 6) AS singleton_type_ratio, round(same, 6) AS adjacent_group_identity_rate, round(edge, 6) AS cross_separator_edge_mi_bits, pairs AS n_pairs
            FROM kt JOIN s ON kt.doc_id = s.doc_id LEFT JOIN mi ON kt.doc_id = mi.doc_id""",
    ),
    "measurement_support": (
        "ltok",
        """WITH t AS (SELECT doc_id, count(*) AS groups, @DISTINCTS(line) AS lines, @DISTINCTS(tok) AS types FROM ltok GROUP BY doc_id)
        SELECT doc_id, groups, lines, types, CASE WHEN groups - lines < 1 THEN 'no adjacent pairs' END AS adjacency_undefined, CASE WHEN groups = types THEN 'no recurrence' END AS recurrence_undefined, CASE WHEN lines < 3 THEN 'fewer than three lines' END AS position_undefined
            FROM t""",
    ),
    "line_position_length_spearman": (
        "ltok",
        f"""WITH r AS (SELECT doc_id, rank() OVER (PARTITION BY doc_id ORDER BY len) + (count(*) OVER (PARTITION BY doc_id, len) - 1) / 2 AS a, rank() OVER (PARTITION BY doc_id ORDER BY line) + (count(*) OVER (PARTITION BY doc_id, line) - 1) / 2 AS b
            FROM ltok)
        SELECT doc_id, CASE WHEN count(*) < 3 THEN 0e0 ELSE round({CORR.format('a', 'b')}, 6) END AS rho FROM r GROUP BY doc_id""",
    ),
    "finite_sample_profile": (
        "ltok",
        """WITH g AS (SELECT 4 AS size UNION ALL SELECT 8 UNION ALL SELECT 16 UNION ALL SELECT 32),
        k AS (SELECT doc_id, size, tok, count(*) AS n FROM ltok CROSS JOIN g WHERE line < size GROUP BY doc_id, size, tok)
        SELECT doc_id, CAST(size AS BIGINT) AS size, round(count(*) / sum(n), 6) AS type_ratio, round(log2(CAST(sum(n) AS DOUBLE)) - sum(n * log2(CAST(n AS DOUBLE))) / sum(n), 6) AS entropy_bits
            FROM k GROUP BY doc_id, size""",
    ),
    "layout_panel": (
        "turns",
        f"""WITH t AS (SELECT conv_id, turn, role, count(*) AS n FROM turns GROUP BY conv_id, turn, role),
        r AS (SELECT conv_id, rank() OVER (PARTITION BY conv_id ORDER BY n) + (count(*) OVER (PARTITION BY conv_id, n) - 1) / 2 AS a, rank() OVER (PARTITION BY conv_id ORDER BY turn) + (count(*) OVER (PARTITION BY conv_id, turn) - 1) / 2 AS b, n
            FROM t)
        SELECT conv_id, count(*) AS n_turns, round(avg(n), 6) AS mean_tokens, round({CORR.format('a', 'b')}, 6) AS turn_length_spearman FROM r GROUP BY conv_id""",
    ),
}
