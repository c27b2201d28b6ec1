"""Panels of many measures for each document, put together from the queries that have them, and measures of neighbouring
characters. These come from distinct words with their counts: no row for each character passes a shuffle."""

from strandlab.plans import information, panels, structure

#: Neighbours within a word (a, b) with their number; the same with the word's edges as ^ and $; three in a row.
WORDS = "dw AS (SELECT doc_id, tok, len, count(*) AS n FROM tok GROUP BY doc_id, tok, len)"
PAIRS = f"""{WORDS},
pw AS (SELECT doc_id, tok, n, @SPAN(1; CAST(len - 1 AS INT)) AS i FROM dw WHERE len >= 2),
k AS (
  SELECT doc_id, substr(tok, CAST(i AS INT), 1) AS a, substr(tok, CAST(i + 1 AS INT), 1) AS b, CAST(sum(n) AS BIGINT) AS n FROM pw
  GROUP BY doc_id, substr(tok, CAST(i AS INT), 1), substr(tok, CAST(i + 1 AS INT), 1))"""
EDGED = f"""{WORDS},
pw AS (SELECT doc_id, tok, len, n, @SPAN(0; CAST(len AS INT)) AS i FROM dw),
pe AS (SELECT doc_id, n, CASE WHEN i = 0 THEN '^' ELSE substr(tok, CAST(i AS INT), 1) END AS a, CASE WHEN i = len THEN '$' ELSE substr(tok, CAST(i + 1 AS INT), 1) END AS b FROM pw),
k AS (SELECT doc_id, a, b, CAST(sum(n) AS BIGINT) AS n FROM pe GROUP BY doc_id, a, b)"""
SHARES = "t AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS tot, sum(n) OVER (PARTITION BY doc_id, a) AS ctx, sum(n) OVER (PARTITION BY doc_id, b) AS nxt FROM k)"

CHARACTERS = {
    "cond_entropy_within_token": ("tok", f"WITH {PAIRS}, {SHARES} SELECT doc_id, round(0e0 - sum(n / tot * log2(n / ctx)), 6) AS cond_entropy_bits FROM t GROUP BY doc_id"),
    "cond_entropy_padded_by_doc": ("tok", f"WITH {EDGED}, {SHARES} SELECT doc_id, round(0e0 - sum(n / tot * log2(n / ctx)), 6) AS cond_entropy_bits FROM t GROUP BY doc_id"),
    "char_mutual_information": ("tok", f"WITH {PAIRS}, {SHARES} SELECT doc_id, round(sum(n / tot * log2(CAST(n AS DOUBLE) * tot / (CAST(ctx AS DOUBLE) * nxt))), 6) AS mi_bits FROM t GROUP BY doc_id"),
    "char_repeat_rates": (
        "tok",
        f"""WITH {WORDS}, pw AS (SELECT doc_id, tok, len, n, @SPAN(1; CAST(len AS INT)) AS i FROM dw),
        p AS (
          SELECT doc_id, n, len, i, CASE WHEN i < len AND substr(tok, CAST(i AS INT), 1) = substr(tok, CAST(i + 1 AS INT), 1) THEN 1 ELSE 0 END AS two,
                 CASE WHEN i < len - 1 AND substr(tok, CAST(i AS INT), 1) = substr(tok, CAST(i + 1 AS INT), 1) AND substr(tok, CAST(i AS INT), 1) = substr(tok, CAST(i + 2 AS INT), 1) THEN 1 ELSE 0 END AS three FROM pw)
        SELECT doc_id, round(sum(n * two) / nullif(sum(CASE WHEN i < len THEN n ELSE 0 END), 0), 6) AS repeat_rate,
               round(sum(n * three) / nullif(sum(CASE WHEN i < len - 1 THEN n ELSE 0 END), 0), 6) AS triple_rate FROM p GROUP BY doc_id""",
    ),
    "symbol_page_measures": (
        "tok",
        f"""WITH {PAIRS}, {SHARES}, u AS (SELECT doc_id, tok, n, @SPAN(1; CAST(len AS INT)) AS i FROM dw),
        c AS (SELECT doc_id, substr(tok, CAST(i AS INT), 1) AS c, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY doc_id, substr(tok, CAST(i AS INT), 1)),
        h AS (SELECT doc_id, count(*) AS alphabet, log2(CAST(sum(n) AS DOUBLE)) - sum(n * log2(CAST(n AS DOUBLE))) / sum(n) AS bits FROM c GROUP BY doc_id),
        p AS (SELECT doc_id, 0e0 - sum(n / tot * log2(n / ctx)) AS cond, sum(CASE WHEN a = b THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE) AS same, count(*) / CAST(sum(n) AS DOUBLE) AS ratio FROM t GROUP BY doc_id)
        SELECT h.doc_id, CASE WHEN alphabet > 1 THEN round(bits / log2(CAST(alphabet AS DOUBLE)), 6) END AS symbol_entropy_normalized,
               CASE WHEN alphabet > 1 THEN round(cond / log2(CAST(alphabet AS DOUBLE)), 6) END AS symbol_conditional_entropy_normalized,
               round(same, 6) AS symbol_repeat_rate, round(ratio, 6) AS symbol_bigram_type_ratio FROM h LEFT JOIN p ON p.doc_id = h.doc_id""",
    ),
}

MORE = {
    "block_information_40": ("tok", information.QUERIES["block_information"][1].replace("/ 20", "/ 40")),
    "heaps_early_late": (
        "tok",
        """WITH f AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id, tok ORDER BY pos) AS k FROM tok),
        c AS (SELECT doc_id, pos + 1 AS prefix, n, sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS types FROM f),
        p AS (
          SELECT DISTINCT doc_id, prefix, ln(CAST(prefix AS DOUBLE)) AS x, ln(CAST(types AS DOUBLE)) AS y FROM c CROSS JOIN (SELECT @RANGE(8) AS g)
          WHERE prefix = greatest(10, least(n, CAST(@BROUND(n * (g + 1) / 8e0) AS BIGINT)))),
        q AS (SELECT doc_id, x, y, row_number() OVER (PARTITION BY doc_id ORDER BY prefix) - 1 AS i, CAST(floor(count(*) OVER (PARTITION BY doc_id) / 2) AS BIGINT) AS mid FROM p),
        z AS (
          SELECT doc_id, covar_pop(CASE WHEN i <= mid THEN x END, CASE WHEN i <= mid THEN y END) AS c1, var_pop(CASE WHEN i <= mid THEN x END) AS v1,
                 covar_pop(CASE WHEN i >= mid THEN x END, CASE WHEN i >= mid THEN y END) AS c2, var_pop(CASE WHEN i >= mid THEN x END) AS v2 FROM q GROUP BY doc_id)
        SELECT doc_id, round(coalesce(CASE WHEN v1 > 1e-12 THEN c1 / v1 END, 0e0) - coalesce(CASE WHEN v2 > 1e-12 THEN c2 / v2 END, 0e0), 6) AS heaps_early_late_delta FROM z""",
    ),
    "separator_identity_mi": (
        "ltok",
        """WITH o AS (SELECT doc_id, line, tok, lead(tok) OVER (PARTITION BY doc_id ORDER BY line, pos) AS nxt, lead(line) OVER (PARTITION BY doc_id ORDER BY line, pos) AS nline FROM ltok),
        k AS (SELECT doc_id, CASE WHEN nline = line THEN 0 ELSE 1 END AS kind, CASE WHEN tok = nxt THEN 1 ELSE 0 END AS same, count(*) AS n FROM o WHERE nxt IS NOT NULL GROUP BY doc_id, CASE WHEN nline = line THEN 0 ELSE 1 END, CASE WHEN tok = nxt THEN 1 ELSE 0 END),
        t AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS tot, sum(n) OVER (PARTITION BY doc_id, kind) AS l, sum(n) OVER (PARTITION BY doc_id, same) AS r FROM k)
        SELECT doc_id, round(sum(n / tot * log2(CAST(n AS DOUBLE) * tot / (CAST(l AS DOUBLE) * r))), 6) AS separator_identity_mi_bits FROM t GROUP BY doc_id""",
    ),
    "line_drift_js": (
        "ltok",
        """WITH k AS (SELECT doc_id, line, tok, count(*) AS n FROM ltok GROUP BY doc_id, line, tok), p AS (SELECT doc_id, line, tok, n / sum(n) OVER (PARTITION BY doc_id, line) AS p FROM k),
        o AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS r FROM (SELECT DISTINCT doc_id, line FROM k) z),
        w AS (SELECT p.doc_id, r, tok, p FROM p JOIN o ON p.doc_id = o.doc_id AND p.line = o.line),
        u AS (SELECT doc_id, r AS pair, tok, p AS a, 0e0 AS b FROM w UNION ALL SELECT doc_id, r - 1 AS pair, tok, 0e0 AS a, p AS b FROM w),
        g AS (SELECT doc_id, pair, tok, sum(a) AS a, sum(b) AS b FROM u GROUP BY doc_id, pair, tok),
        j AS (
          SELECT doc_id, pair, sum(CASE WHEN a > 0 THEN a / 2 * log2(2 * a / (a + b)) ELSE 0e0 END + CASE WHEN b > 0 THEN b / 2 * log2(2 * b / (a + b)) ELSE 0e0 END) AS js
          FROM g GROUP BY doc_id, pair HAVING sum(a) > 0 AND sum(b) > 0)
        SELECT doc_id, round(avg(js), 6) AS page_unigram_drift_js FROM j GROUP BY doc_id""",
    ),
    "length_lags": (
        "tok",
        "WITH z AS (" + panels.QUERIES["length_autocorrelation"][1] + ") SELECT doc_id, " + ", ".join(f"max(CASE WHEN lag = {k} THEN r END) AS length_autocorrelation_lag_{k}" for k in (1, 2, 5, 10, 20)) + " FROM z GROUP BY doc_id",
    ),
}

_ALL = information.QUERIES | panels.QUERIES | structure.QUERIES | CHARACTERS | MORE

#: Panel: the queries that it joins (the first one's documents are the panel's) and their columns.
PANELS = {
    "sequence_panel": [
        ("surface_panel", "mean_token_length token_length_std token_type_ratio token_hapax_ratio token_entropy_bits char_entropy_bits adjacent_edit1_rate token_bigram_type_ratio alphabet_size most_common_token_rate most_common_char_rate"),
        ("token_length_moments", "token_length_skew token_length_lag1"),
        ("repeat_triple_rates", "repeat_rate=token_repeat_rate triple_rate=token_triple_rate trigram_type_ratio=token_trigram_type_ratio"),
        ("cond_entropy_padded_by_doc", "cond_entropy_bits=char_conditional_entropy_bits"),
        ("char_repeat_rates", "repeat_rate=char_repeat_rate triple_rate=char_triple_rate"),
        ("zipf_fit", "slope=zipf_loglog_slope r2=zipf_loglog_r2"),
        ("bigram_mutual_information", "mi_bits=token_mutual_information_bits"),
        ("char_mutual_information", "mi_bits=char_mutual_information_bits"),
        ("length_transition_mi", "mi_bits=length_transition_mi_bits"),
        ("first_last_char_l1", "first_entropy_bits=first_char_entropy_bits last_entropy_bits=last_char_entropy_bits l1=boundary_char_distribution_l1"),
        ("window20_copy_rate", "copy_rate=window20_copy_rate"),
    ],
    "page_panel_full": [
        ("page_panel", "group_length_mean group_length_cv group_type_token_ratio group_hapax_ratio adjacent_group_repeat_rate window20_group_recurrence"),
        ("symbol_page_measures", "symbol_entropy_normalized symbol_conditional_entropy_normalized symbol_repeat_rate symbol_bigram_type_ratio"),
    ],
    "battery_panel": [
        ("core_battery", "group_type_token_ratio singleton_type_ratio adjacent_group_identity_rate cross_separator_edge_mi_bits"),
        ("char_entropy_by_doc", "char_entropy_bits=unit_entropy_bits"),
        ("cond_entropy_within_token", "cond_entropy_bits=conditional_unit_entropy_order1_bits"),
        ("recurrence_median", "median_gap=median_recurrence_distance"),
        ("separator_identity_mi", "separator_identity_mi_bits"),
        ("line_position_length_spearman", "rho=line_position_length_spearman"),
        ("line_drift_js", "page_unigram_drift_js"),
        ("block_information", "block_mi_bits=contextual_block_mi_bits"),
        ("measurement_support", "adjacency_undefined recurrence_undefined position_undefined"),
    ],
    "higher_order_panel": [
        ("heaps_fit", "heaps_exponent heaps_r2"),
        ("heaps_early_late", "heaps_early_late_delta"),
        ("length_lags", "length_autocorrelation_lag_1 length_autocorrelation_lag_2 length_autocorrelation_lag_5 length_autocorrelation_lag_10 length_autocorrelation_lag_20"),
        ("length_block_cv", "mean_cv=length_block_mean_cv std_cv=length_block_std_cv"),
        ("recurrence_burstiness", "burstiness=recurrence_gap_burstiness gap_cv=recurrence_gap_cv"),
        ("block_fano", "frequent_token_fano=frequent_token_block_fano"),
        ("block_information", "block_mi_bits=token_block_information_20"),
        ("block_information_40", "block_mi_bits=token_block_information_40"),
        ("cooccurrence_graph", "degree_assortativity=cooccurrence_degree_assortativity selectivity_cv=cooccurrence_selectivity_cv"),
    ],
}


def joined(parts: list[tuple[str, str]]) -> tuple[str, str]:
    """One query of several: each becomes a table, all of them are joined on doc_id."""
    shared, tables, columns, joins = [], [], [], []
    for i, (name, wanted) in enumerate(parts):
        own, body = _ALL[name]
        shared += [t for t in own.split() if t not in shared]
        tables.append(f"part{i} AS ({body})")
        columns += [f"part{i}.{a} AS {b or a}" for a, _, b in (c.partition("=") for c in wanted.split())]
        joins.append("FROM part0" if i == 0 else f"LEFT JOIN part{i} ON part{i}.doc_id = part0.doc_id")
    # a shared table may stand on one before it
    order = [t for t in ("tok", "ltok", "chars", "bench", "ev", "turns", "bwords") if t in shared]
    return " ".join(order), f"WITH {', '.join(tables)} SELECT part0.doc_id, {', '.join(columns)} {' '.join(joins)}"


QUERIES = CHARACTERS | MORE | {name: joined(parts) for name, parts in PANELS.items()}
