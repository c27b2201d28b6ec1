"""Null models by hash-ordered permutation, resampling, multiple testing, folds, retrieval and evaluation metrics.

Random orders are orders of md5 of (seed, replicate, key), so both engines, and any partitioning, draw alike."""

SPLIT = "md5('split:' || CAST(doc_id AS STRING))"
CORR = "covar_pop({0}, {1}) / nullif(stddev_pop({0}) * stddev_pop({1}), 0e0)"

#: Similarity of benchmark items to each other: shared word types over the square root of the product.
SIM = "w AS (SELECT DISTINCT item_id, tok FROM bwords), n AS (SELECT item_id, count(*) AS n FROM w GROUP BY item_id), x AS (SELECT a.item_id AS q, b.item_id AS c, count(*) AS k FROM w a JOIN w b ON a.tok = b.tok GROUP BY a.item_id, b.item_id), s AS (SELECT a.item_id AS q, b.item_id AS c, coalesce(k, 0) / sqrt(CAST(a.n AS DOUBLE) * b.n) + 1e-1 * ((a.item_id * 7 + b.item_id * 13) % 11) AS score FROM n a CROSS JOIN n b LEFT JOIN x ON x.q = a.item_id AND x.c = b.item_id)"

#: Types with their share of 0..tot-1, [lo, hi), by exact counts, once for each cell of 16 numbers that it meets; needs k (tok, n).
CELLS = "n AS (SELECT CAST(sum(n) AS BIGINT) AS tot FROM k), u AS (SELECT tok, n, CAST(sum(n) OVER (ORDER BY n DESC, tok ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hi FROM k), c AS (SELECT tok, hi - n AS lo, hi, @SPAN(CAST(floor((hi - n) / 16) AS BIGINT); CAST(floor((hi - 1) / 16) AS BIGINT)) AS cell FROM u)"

NULLS = {
    "null_symbol_shuffle": (
        "tok chars",
        """WITH p AS (SELECT doc_id, pos, c, row_number() OVER (PARTITION BY doc_id, pos ORDER BY md5('symbol:' || CAST(doc_id AS STRING) || ':' || CAST(pos AS STRING) || ':' || CAST(i AS STRING)), i) AS k
            FROM chars),
        b AS (SELECT doc_id, c AS a, lead(c) OVER (PARTITION BY doc_id, pos ORDER BY k) AS b FROM p)
        SELECT doc_id, CAST(sum(CASE WHEN a = b THEN 1 ELSE 0 END) AS BIGINT) AS repeats, count(b) AS pairs FROM b GROUP BY doc_id""",
    ),
    "null_global_resample": (
        "tok",
        f"""WITH k AS (SELECT tok, count(*) AS n FROM tok GROUP BY tok), {CELLS}, d AS (SELECT doc_id, pos, @DRAW('resample:' || CAST(doc_id AS STRING) || ':' || CAST(pos AS STRING); tot) AS x
            FROM tok CROSS JOIN n)
        SELECT d.doc_id, d.pos, c.tok FROM d JOIN c ON c.cell = CAST(floor(d.x / 16) AS BIGINT) AND d.x >= c.lo AND d.x < c.hi""",
    ),
    "holm_adjust": (
        "",
        """WITH t AS (SELECT event_type, (1 + sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)) / (1 + count(*)) / 10 AS p FROM events GROUP BY event_type),
        h AS (SELECT event_type, p, row_number() OVER (ORDER BY p, event_type) AS i, count(*) OVER () AS c FROM t)
        SELECT event_type, round(p, 6) AS p, round(least(1e0, max(p * (c - i + 1)) OVER (ORDER BY p, i ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM h""",
    ),
    "stratified_page_split": (
        "",
        f"""WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY {SPLIT}, doc_id) AS k, count(*) OVER (PARTITION BY lang, source) AS n
            FROM documents)
        SELECT doc_id, CASE WHEN n > 1 AND k <= least(n - 1, greatest(1, CAST(floor(n * 3e-1 + 5e-1) AS BIGINT))) THEN 'heldout' ELSE 'train' END AS split FROM r""",
    ),
    "contiguous_folds": ("", "SELECT doc_id, CAST(ntile(5) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) - 1 AS fold FROM documents"),
    "hash_folds": ("", "SELECT doc_id, (CAST(row_number() OVER (PARTITION BY source ORDER BY @SHA(CAST(doc_id AS STRING))) AS BIGINT) - 1) % 5 AS fold FROM documents"),
    "crossfit_median_iqr": (
        "",
        """WITH f AS (SELECT doc_id, source, CAST(n_chars AS DOUBLE) AS x, CAST(ntile(4) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS fold FROM documents),
        g AS (SELECT DISTINCT fold FROM f),
        s AS (SELECT f.source, g.fold, @PCT(x; 0.5) AS med, @PCT(x; 0.75) - @PCT(x; 0.25) AS iqr FROM f JOIN g ON f.fold <> g.fold GROUP BY f.source, g.fold)
        SELECT f.doc_id, round((x - med) / CASE WHEN iqr <= 1e-12 THEN 1e0 ELSE iqr END, 6) AS z FROM f JOIN s ON f.source = s.source AND f.fold = s.fold""",
    ),
    "spearman_by_pair": (
        "tok",
        f"""WITH v AS (SELECT lang, doc_id, CAST(count(*) AS DOUBLE) AS a, avg(len) AS b FROM tok GROUP BY lang, doc_id),
        r AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY a) + (count(*) OVER (PARTITION BY lang, a) - 1) / 2 AS a, rank() OVER (PARTITION BY lang ORDER BY b) + (count(*) OVER (PARTITION BY lang, b) - 1) / 2 AS b
            FROM v)
        SELECT lang, round({CORR.format('a', 'b')}, 6) AS rho, count(*) AS n FROM r GROUP BY lang""",
    ),
    "bootstrap_pair_ci": (
        "",
        """WITH d AS (SELECT lang, CAST(n_chars AS DOUBLE) AS x, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n
            FROM documents),
        r AS (SELECT @RANGE(40) AS rep),
        i AS (SELECT lang, rep, CAST(floor(@UNIT('boot:' || lang || ':' || CAST(rep AS STRING) || ':' || CAST(k AS STRING)) * n) AS BIGINT) AS k FROM d CROSS JOIN r),
        m AS (SELECT i.lang, i.rep, avg(d.x) AS m FROM i JOIN d ON d.lang = i.lang AND d.k = i.k GROUP BY i.lang, i.rep)
        SELECT lang, round(@PCT(m; 0.025), 4) AS low, round(@PCT(m; 0.975), 4) AS high FROM m GROUP BY lang""",
    ),
    "page_label_permutation": (
        "",
        """WITH d AS (SELECT l.doc_id, toxic, CAST(n_chars AS DOUBLE) AS x FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
        k AS (SELECT toxic AS y, row_number() OVER (ORDER BY doc_id) AS i FROM d),
        r AS (SELECT @RANGE(30) AS rep),
        p AS (SELECT rep, x, row_number() OVER (PARTITION BY rep ORDER BY md5('perm:' || CAST(rep AS STRING) || ':' || CAST(doc_id AS STRING))) AS i
            FROM d CROSS JOIN r WHERE rep > 0 UNION ALL SELECT 0 AS rep, x, row_number() OVER (ORDER BY doc_id) AS i
            FROM d),
        s AS (SELECT rep, avg(CASE WHEN y = 1 THEN x END) - avg(CASE WHEN y = 0 THEN x END) AS stat FROM p JOIN k ON p.i = k.i GROUP BY rep),
        o AS (SELECT stat FROM s WHERE rep = 0)
        SELECT round(max(o.stat), 4) AS observed, (1 + sum(CASE WHEN s.stat >= o.stat THEN 1 ELSE 0 END)) / (1e0 + count(*)) AS p FROM s CROSS JOIN o WHERE s.rep > 0""",
    ),
    "sign_flip_permutation": (
        "",
        """WITH d AS (SELECT user_id, avg(value) - 50 AS x FROM events GROUP BY user_id),
        r AS (SELECT @RANGE(64) AS rep),
        s AS (SELECT rep, avg(CASE WHEN rep = 0 OR @UNIT('sign:' || CAST(rep AS STRING) || ':' || CAST(user_id AS STRING)) < 5e-1 THEN x ELSE 0e0 - x END) AS m
            FROM d CROSS JOIN r GROUP BY rep),
        o AS (SELECT m FROM s WHERE rep = 0)
        SELECT round(max(o.m), 6) AS observed, (1 + sum(CASE WHEN s.m >= o.m THEN 1 ELSE 0 END)) / (1e0 + count(*)) AS p FROM s CROSS JOIN o WHERE s.rep > 0""",
    ),
}

RETRIEVAL = {
    "cosine_rank": (
        "",
        """WITH v AS (SELECT vec_id, embedding AS e, sqrt(@DOT(embedding; embedding)) AS norm FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CASE WHEN c.norm = 0 THEN -1e0 ELSE round(@DOT(q.e; c.e) / (q.norm * c.norm), 6) END AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rnk FROM s)
        SELECT query_id, vec_id, score, CAST(rnk AS BIGINT) AS rnk FROM k WHERE rnk <= 10""",
    ),
    "retrieval_metrics_stable": (
        "bwords",
        f"""WITH {SIM}, r AS (SELECT q, c, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, c) AS rnk, count(*) OVER (PARTITION BY q) AS n FROM s)
        SELECT count(*) AS n_queries, round(avg(1e0 / rnk), 6) AS mrr, round(avg(CASE WHEN rnk = 1 THEN 1e0 ELSE 0e0 END), 6) AS top1, CAST(median(rnk) AS DOUBLE) AS median_rank
            FROM r WHERE q = c""",
    ),
    "retrieval_metrics_tiesafe": (
        "bwords",
        f"""WITH {SIM}, t AS (SELECT q, round(score, 9) AS score FROM s WHERE q = c),
        r AS (SELECT s.q, 1 + sum(CASE WHEN round(s.score, 9) > t.score THEN 1 ELSE 0 END) + 5e-1 * (sum(CASE WHEN round(s.score, 9) = t.score THEN 1 ELSE 0 END) - 1) AS rnk
            FROM s JOIN t ON s.q = t.q GROUP BY s.q)
        SELECT q AS item_id, CAST(rnk AS DOUBLE) AS rnk, round(1 / CAST(rnk AS DOUBLE), 6) AS reciprocal FROM r""",
    ),
    "document_level_metrics": (
        "ltok",
        """WITH c AS (SELECT l.doc_id, toxic AS y, line, avg(len) / 10 AS s FROM ltok t JOIN labels l ON t.doc_id = l.doc_id GROUP BY l.doc_id, toxic, line),
        d AS (SELECT doc_id, max(y) AS y, count(DISTINCT y) AS labels, least(1e0, avg(s)) AS s FROM c GROUP BY doc_id)
        SELECT count(*) AS n, CAST(max(labels) AS BIGINT) AS labels_per_doc, round(avg((s - y) * (s - y)), 6) AS brier, round((avg(CASE WHEN y = 1 THEN CASE WHEN s >= 45e-2 THEN 1e0 ELSE 0e0 END END) + avg(CASE WHEN y = 0 THEN CASE WHEN s < 45e-2 THEN 1e0 ELSE 0e0 END END)) / 2, 6) AS balanced_accuracy
            FROM d""",
    ),
    "family_recall": (
        "",
        """WITH d AS (SELECT source AS family, toxic AS y, CASE WHEN lower(text) LIKE '%idiot%' OR lower(text) LIKE '%moron%' THEN 1 ELSE 0 END AS p
            FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
        SELECT family, count(*) AS n, round(avg(CASE WHEN y = p THEN 1e0 ELSE 0e0 END), 6) AS recall, CAST(sum(p) AS BIGINT) AS predicted FROM d GROUP BY family""",
    ),
    "order_percentile": (
        "bwords",
        f"""WITH {SIM}, t AS (SELECT q, round(score, 9) AS score FROM s WHERE q = c)
        SELECT s.q AS item_id, round((sum(CASE WHEN round(s.score, 9) < t.score THEN 1 ELSE 0 END) + 5e-1 * sum(CASE WHEN round(s.score, 9) = t.score THEN 1 ELSE 0 END)) / count(*), 6) AS percentile
            FROM s JOIN t ON s.q = t.q GROUP BY s.q""",
    ),
    "sample_weights": (
        "ltok",
        """SELECT DISTINCT doc_id, line, round(1e0 / max(k) OVER (PARTITION BY doc_id), 9) AS weight FROM (SELECT doc_id, line, dense_rank() OVER (PARTITION BY doc_id ORDER BY line) AS k FROM ltok) z""",
    ),
}
#: Shuffles within documents happen inside each document's row: no word leaves it.
WITHIN = {
    "null_within_page_shuffle": (
        "dtok",
        """WITH r AS (SELECT @RANGE(4) AS rep), d AS (SELECT doc_id, rep, @SHUFFLED(t; 'shuffle:' || CAST(rep AS STRING) || ':' || CAST(doc_id AS STRING)) AS s, @SIZE(t) AS n FROM dtok CROSS JOIN r)
        SELECT doc_id, CAST(rep AS BIGINT) AS rep, @EQUALS(s) AS repeats, n FROM d WHERE n > 0""",
    ),
    "null_ensemble_summary": (
        "dtok",
        """WITH r AS (SELECT @RANGE(8) AS rep), d AS (SELECT lang, rep, @SHUFFLED(t; 'ens:' || CAST(rep AS STRING) || ':' || CAST(doc_id AS STRING)) AS s, @SIZE(t) AS n FROM dtok CROSS JOIN r),
        m AS (SELECT lang, rep, sum(@EQUALS(s)) / nullif(sum(n - 1), 0) AS v FROM d WHERE n > 0 GROUP BY lang, rep)
        SELECT lang, count(v) AS defined, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd FROM m GROUP BY lang""",
    ),
    "pair_auc": (
        "",
        """WITH d AS (SELECT toxic AS y, CAST(n_chars AS DOUBLE) AS x FROM labels l JOIN documents d ON l.doc_id = d.doc_id), k AS (SELECT x, sum(y) AS p, sum(1 - y) AS q FROM d GROUP BY x),
        c AS (SELECT p, q, sum(q) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) - q AS below FROM k)
        SELECT round(CAST(sum(p * (2 * below + q)) AS DOUBLE) / (2e0 * sum(p) * sum(q)), 6) AS auc FROM c""",
    ),
}
QUERIES = NULLS | RETRIEVAL | WITHIN
