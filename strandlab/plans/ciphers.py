"""Cipher transforms of letter sequences (a = 0 ... z = 25), each with its inverse: the round trip is part of the result.

They are plain arithmetic on positions, so a text of any length is enciphered in parallel; only the digest at the end
brings a text's letters together."""

KEY = "CASE i % 5 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 17 WHEN 3 THEN 6 ELSE 14 END"
PROGRESSIVE = "CASE i % 3 WHEN 0 THEN 3 WHEN 1 THEN 11 ELSE 19 END + 2 * CAST(floor(i / 3) AS BIGINT)"
OUT = "SELECT item_id, @JOINED(ch; i; ch) AS cipher, CAST(sum(CASE WHEN back = v THEN 0 ELSE 1 END) AS BIGINT) AS errors, count(*) AS n FROM o GROUP BY item_id"


def _arithmetic(forward: str, backward: str) -> tuple[str, str]:
    return "bench", f"WITH e AS (SELECT item_id, i, v, CAST({forward} AS BIGINT) AS e FROM bench), o AS (SELECT item_id, i, v, @CHR(97 + e) AS ch, CAST({backward} AS BIGINT) AS back FROM e) {OUT}"


def _moved(order: str) -> tuple[str, str]:
    """Transposition: letters are read in another order; the inverse puts the k-th one back to its place."""
    return "bench", f"WITH e AS (SELECT item_id, i AS j, v, c AS ch, row_number() OVER (PARTITION BY item_id ORDER BY {order}) - 1 AS i FROM bench), b AS (SELECT item_id, j, row_number() OVER (PARTITION BY item_id ORDER BY j) - 1 AS home FROM e), o AS (SELECT e.item_id, e.i, e.v, e.ch, CASE WHEN b.home = e.j THEN e.v ELSE -1 END AS back FROM e JOIN b ON e.item_id = b.item_id AND e.j = b.j) {OUT}"


SQUARE = "CASE WHEN v >= 9 THEN v - 1 ELSE v END"  # 25 letters: j counts as i

QUERIES = {
    "vigenere_roundtrip": _arithmetic(f"(v + {KEY}) % 26", f"(e - ({KEY}) + 26) % 26"),
    "progressive_key_roundtrip": _arithmetic(f"(v + {PROGRESSIVE}) % 26", f"((e - ({PROGRESSIVE})) % 26 + 26) % 26"),
    "affine_roundtrip": _arithmetic("(5 * v + 8) % 26", "(21 * (e - 8 + 26)) % 26"),
    "beaufort_roundtrip": _arithmetic(f"({KEY} - v + 26) % 26", f"({KEY} - e + 26) % 26"),
    "mono_cipher_rename_invariance": (
        "bench",
        """WITH k AS (SELECT item_id, v, count(*) AS n FROM bench GROUP BY item_id, v),
        m AS (SELECT item_id, (v * 11 + 4) % 26 AS v, n FROM k),
        a AS (SELECT item_id, log2(CAST(sum(n) AS DOUBLE)) - sum(n * log2(CAST(n AS DOUBLE))) / sum(n) AS h, CAST(sum(n * (n - 1)) AS BIGINT) AS ic FROM k GROUP BY item_id),
        b AS (SELECT item_id, log2(CAST(sum(n) AS DOUBLE)) - sum(n * log2(CAST(n AS DOUBLE))) / sum(n) AS h, CAST(sum(n * (n - 1)) AS BIGINT) AS ic FROM m GROUP BY item_id)
        SELECT a.item_id, round(a.h, 6) AS entropy_bits, round(abs(a.h - b.h), 6) AS entropy_change, a.ic - b.ic AS ic_change FROM a JOIN b ON a.item_id = b.item_id""",
    ),
    "autokey_roundtrip": (
        "bench",
        f"""WITH e AS (SELECT item_id, i, v, CASE WHEN i < 3 THEN i * 5 ELSE lag(v, 3) OVER (PARTITION BY item_id ORDER BY i) END AS k FROM bench),
        o AS (SELECT item_id, i, v, @CHR(97 + (v + k) % 26) AS ch, ((v + k) % 26 - k + 26) % 26 AS back FROM e) {OUT}""",
    ),
    "homophonic_roundtrip": (
        "bench",
        """WITH e AS (SELECT item_id, i, v, v * 3 + CAST(floor(@UNIT('homophone:' || CAST(item_id AS STRING) || ':' || CAST(i AS STRING)) * 3) AS BIGINT) AS e FROM bench)
        SELECT item_id, CAST(sum(e * (i % 97 + 1)) AS BIGINT) AS checksum, count(DISTINCT e) AS symbols, CAST(sum(CASE WHEN CAST(floor(e / 3) AS BIGINT) = v THEN 0 ELSE 1 END) AS BIGINT) AS errors
            FROM e GROUP BY item_id""",
    ),
    "verbose_homophonic": (
        "bench",
        """WITH e AS (SELECT item_id, i, v, (row_number() OVER (PARTITION BY item_id, v ORDER BY i) - 1) % 4 AS k FROM bench)
        SELECT item_id, count(*) * 2 AS n_symbols, CAST(sum((v * 4 + k) * (i % 89 + 1)) AS BIGINT) AS checksum, count(DISTINCT v * 4 + k) AS pairs FROM e GROUP BY item_id""",
    ),
    "nomenclator_topk": (
        "bwords",
        """WITH k AS (SELECT item_id, tok, count(*) AS n, min(pos) AS p FROM bwords GROUP BY item_id, tok),
        r AS (SELECT item_id, tok, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, p) AS code FROM k)
        SELECT w.item_id, count(*) AS n, CAST(sum(CASE WHEN code <= 12 THEN 1 ELSE 0 END) AS BIGINT) AS coded, CAST(sum(CASE WHEN code <= 12 THEN code * (pos % 31 + 1) ELSE 0 END) AS BIGINT) AS checksum
            FROM bwords w JOIN r ON w.item_id = r.item_id AND w.tok = r.tok GROUP BY w.item_id""",
    ),
    "railfence_roundtrip": _moved("CASE WHEN i % 4 <= 2 THEN i % 4 ELSE 4 - i % 4 END, i"),
    "columnar_roundtrip": _moved("CASE i % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 4 WHEN 3 THEN 2 ELSE 3 END, i"),
    "block8_shuffle": _moved("md5('block:' || CAST(item_id AS STRING) || ':' || CAST(CAST(floor(i / 8) AS BIGINT) AS STRING)), CAST(floor(i / 8) AS BIGINT), i"),
    "unigram_shuffle": _moved("md5('unigram:' || CAST(item_id AS STRING) || ':' || CAST(i AS STRING)), i"),
    "polybius_roundtrip": (
        "bench",
        f"""WITH s AS (SELECT item_id, i, v, {SQUARE} AS s FROM bench),
        o AS (SELECT item_id, i, CASE WHEN v = 9 THEN 8 ELSE v END AS v, substr('ADFGX', CAST(CAST(floor(s / 5) AS BIGINT) + 1 AS INT), 1) || substr('ADFGX', CAST(s % 5 + 1 AS INT), 1) AS ch, CASE WHEN s >= 9 THEN s + 1 ELSE s END AS back
            FROM s) {OUT}""",
    ),
    "adfgx_encipher": (
        "bench",
        f"""WITH s AS (SELECT item_id, i, {SQUARE} AS s FROM bench),
        f AS (SELECT item_id, 2 * i AS i, CAST(floor(s / 5) AS BIGINT) AS d FROM s UNION ALL SELECT item_id, 2 * i + 1 AS i, s % 5 AS d FROM s),
        e AS (SELECT item_id, d, row_number() OVER (PARTITION BY item_id ORDER BY CASE i % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 4 WHEN 3 THEN 2 ELSE 3 END, i) AS i FROM f),
        o AS (SELECT item_id, i, substr('ADFGX', CAST(d + 1 AS INT), 1) AS ch FROM e)
        SELECT item_id, @JOINED(ch; i; ch) AS cipher, count(*) AS n FROM o GROUP BY item_id""",
    ),
    "bifid_encipher": (
        "bench",
        f"""WITH s AS (SELECT item_id, i, {SQUARE} AS s, count(*) OVER (PARTITION BY item_id) AS n FROM bench),
        f AS (SELECT item_id, i AS k, CAST(floor(s / 5) AS BIGINT) AS d FROM s UNION ALL SELECT item_id, n + i AS k, s % 5 AS d FROM s),
        o AS (SELECT item_id, CAST(floor(k / 2) AS BIGINT) AS i, sum(CASE WHEN k % 2 = 0 THEN 5 * d ELSE d END) AS x FROM f GROUP BY item_id, CAST(floor(k / 2) AS BIGINT)),
        p AS (SELECT item_id, i, @CHR(97 + x + CASE WHEN x >= 9 THEN 1 ELSE 0 END) AS ch FROM o)
        SELECT item_id, @JOINED(ch; i; ch) AS cipher, count(*) AS n FROM p GROUP BY item_id""",
    ),
    "binary_flip_entropy": (
        "",
        """WITH g AS (SELECT @RANGE(5000) AS i),
        f AS (SELECT i, CASE WHEN @UNIT('flip:' || CAST(i AS STRING)) < 1e-1 THEN 1 ELSE 0 END AS f FROM g),
        s AS (SELECT i, sum(f) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) % 2 AS s FROM f),
        b AS (SELECT s AS a, lead(s) OVER (ORDER BY i) AS b FROM s),
        k AS (SELECT a, b, count(*) AS n FROM b WHERE b IS NOT NULL GROUP BY a, b),
        t AS (SELECT *, sum(n) OVER () AS tot, sum(n) OVER (PARTITION BY a) AS ctx FROM k)
        SELECT round(0e0 - sum(n / tot * log2(n / ctx)), 6) AS cond_entropy_bits, round(0e0 - (1e-1 * log2(1e-1) + 9e-1 * log2(9e-1)), 6) AS true_bits FROM t""",
    ),
    "markov_copy_redraw_entropy": (
        "",
        """WITH g AS (SELECT @RANGE(5000) AS i),
        r AS (SELECT i, CASE WHEN i = 0 OR @UNIT('copy:' || CAST(i AS STRING)) >= 5e-1 THEN CAST(floor(@UNIT('draw:' || CAST(i AS STRING)) * 4) AS BIGINT) END AS d FROM g),
        q AS (SELECT i, d, count(d) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM r),
        s AS (SELECT i, max(d) OVER (PARTITION BY run) AS s FROM q),
        b AS (SELECT s AS a, lead(s) OVER (ORDER BY i) AS b FROM s),
        k AS (SELECT a, b, count(*) AS n FROM b WHERE b IS NOT NULL GROUP BY a, b),
        t AS (SELECT *, sum(n) OVER () AS tot, sum(n) OVER (PARTITION BY a) AS ctx FROM k)
        SELECT round(0e0 - sum(n / tot * log2(n / ctx)), 6) AS cond_entropy_bits, CAST(sum(n) AS BIGINT) AS n FROM t""",
    ),
}
