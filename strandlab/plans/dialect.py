"""One relational text for two engines: shared sub-queries (token, character, line and event tables) are written for
Spark and for the DuckDB oracle; what stands on them is plain SQL that both read alike."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Tables whose rows become many.
WIDE = ("documents", "conversations")

#: DuckDB's levenshtein counts bytes, Spark's characters: for the oracle each accented letter becomes one control character.
_ACCENTS = "äöüßéèêëçàâîïôûùñíóáúœæ"
_PLAIN = " || ".join(f"chr({i + 1})" for i in range(8)) + " || " + " || ".join(f"chr({i + 14})" for i in range(len(_ACCENTS) - 8))


def _bytes(x: str) -> str:
    return f"translate({x}, '{_ACCENTS}', {_PLAIN})"


#: name: (Spark, DuckDB)
SHARED: dict[str, tuple[str, str]] = {
    "tok": (
        r"SELECT doc_id, lang, source, CAST(pos AS BIGINT) AS pos, tok, CAST(length(tok) AS BIGINT) AS len FROM (SELECT doc_id, lang, source, posexplode(filter(split(lower(text), '[ \\t\\r\\n]+'), x -> x <> '')) AS (pos, tok) FROM documents)",
        r"SELECT doc_id, lang, source, CAST(pos AS BIGINT) AS pos, tok, CAST(length(tok) AS BIGINT) AS len FROM (SELECT doc_id, lang, source, unnest(range(len(t))) AS pos, unnest(t) AS tok FROM (SELECT doc_id, lang, source, list_filter(regexp_split_to_array(lower(text), '[ \t\r\n]+'), lambda x: x <> '') AS t FROM documents))",
    ),
    "ltok": (
        r"SELECT doc_id, source, CAST(line AS BIGINT) AS line, CAST(pos AS BIGINT) AS pos, tok, CAST(length(tok) AS BIGINT) AS len FROM (SELECT doc_id, source, line, posexplode(filter(split(lower(ln), '[ \\t\\r]+'), x -> x <> '')) AS (pos, tok) FROM (SELECT doc_id, source, posexplode(split(text, '\\n')) AS (line, ln) FROM documents))",
        r"SELECT doc_id, source, CAST(line AS BIGINT) AS line, CAST(pos AS BIGINT) AS pos, tok, CAST(length(tok) AS BIGINT) AS len FROM (SELECT doc_id, source, line, unnest(range(len(t))) AS pos, unnest(t) AS tok FROM (SELECT doc_id, source, line, list_filter(regexp_split_to_array(lower(ln), '[ \t\r]+'), lambda x: x <> '') AS t FROM (SELECT doc_id, source, unnest(range(len(l))) AS line, unnest(l) AS ln FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents))))",
    ),
    "chars": (
        "SELECT doc_id, source, pos, len, CAST(i AS BIGINT) AS i, c FROM (SELECT doc_id, source, pos, len, posexplode(split(tok, '')) AS (i, c) FROM tok)",
        "SELECT doc_id, source, pos, len, CAST(i AS BIGINT) AS i, c FROM (SELECT doc_id, source, pos, len, unnest(range(len(s))) AS i, unnest(s) AS c FROM (SELECT doc_id, source, pos, len, string_split(tok, '') AS s FROM tok))",
    ),
    "bench": (
        "SELECT item_id, CAST(i AS BIGINT) AS i, c, CAST(ascii(c) - 97 AS BIGINT) AS v FROM (SELECT item_id, posexplode(split(regexp_replace(lower(text), '[^a-z]', ''), '')) AS (i, c) FROM benchmark) WHERE c <> ''",
        "SELECT item_id, CAST(i AS BIGINT) AS i, c, CAST(ascii(c) - 97 AS BIGINT) AS v FROM (SELECT item_id, unnest(range(len(s))) AS i, unnest(s) AS c FROM (SELECT item_id, string_split(regexp_replace(lower(text), '[^a-z]', '', 'g'), '') AS s FROM benchmark)) WHERE c <> ''",
    ),
    "ev": (
        "SELECT user_id, event_type, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) - 1 AS pos FROM events",
        "SELECT user_id, event_type, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) - 1 AS pos FROM events",
    ),
    "turns": (
        r"SELECT conv_id, turn, role, CAST(pos AS BIGINT) AS pos, tok FROM (SELECT conv_id, turn, role, posexplode(filter(split(lower(text), '[ \\t\\r\\n]+'), x -> x <> '')) AS (pos, tok) FROM conversations)",
        "SELECT conv_id, turn, role, CAST(pos AS BIGINT) AS pos, tok FROM (SELECT conv_id, turn, role, unnest(range(len(t))) AS pos, unnest(t) AS tok FROM (SELECT conv_id, turn, role, list_filter(regexp_split_to_array(lower(text), '[ \\t\\r\\n]+'), lambda x: x <> '') AS t FROM conversations))",
    ),
    "bwords": (
        r"SELECT item_id, CAST(pos AS BIGINT) AS pos, tok FROM (SELECT item_id, posexplode(filter(split(lower(text), '[ \\t\\r\\n]+'), x -> x <> '')) AS (pos, tok) FROM benchmark)",
        r"SELECT item_id, CAST(pos AS BIGINT) AS pos, tok FROM (SELECT item_id, unnest(range(len(t))) AS pos, unnest(t) AS tok FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[ \t\r\n]+'), lambda x: x <> '') AS t FROM benchmark))",
    ),
}

SHARED["dtok"] = (
    r"SELECT doc_id, lang, source, filter(split(lower(text), '[ \\t\\r\\n]+'), x -> x <> '') AS t FROM documents",
    r"SELECT doc_id, lang, source, list_filter(regexp_split_to_array(lower(text), '[ \t\r\n]+'), lambda x: x <> '') AS t FROM documents",
)

#: Spelled differently in the two engines: (Spark, DuckDB); {0}, {1} are arguments.
WORDS: dict[str, tuple[str, str]] = {
    "PCT": ("percentile({0}, {1})", "quantile_cont({0}, {1})"),
    "SHA": ("sha2({0}, 256)", "sha256({0})"),
    "UNIT": ("(CAST(conv(substr(md5({0}), 1, 8), 16, 10) AS BIGINT) / 4294967296e0)", "(CAST(('0x' || substr(md5({0}), 1, 8)) AS BIGINT) / 4294967296e0)"),
    "DRAW": ("CAST(floor(CAST(conv(substr(md5({0}), 1, 13), 16, 10) AS BIGINT) / 4503599627370496e0 * {1}) AS BIGINT)", "CAST(floor(CAST(('0x' || substr(md5({0}), 1, 13)) AS BIGINT) / 4503599627370496e0 * {1}) AS BIGINT)"),
    "SPAN": ("explode(sequence({0}, {1}))", "unnest(range({0}, {1} + 1))"),
    "BROUND": ("bround({0}, 0)", "round_even({0}, 0)"),
    "ANTI": ("LEFT ANTI JOIN", "ANTI JOIN"),
    "RANGE": ("explode(sequence(0, {0} - 1))", "unnest(range(0, {0}))"),
    "CHR": ("char({0})", "chr(CAST({0} AS INTEGER))"),
    "JOINED": ("array_join(transform(sort_array(collect_list(struct({1}, {0}))), x -> x.{2}), '')", "string_agg({0}, '' ORDER BY {1})"),
    # a list in the order of md5(prefix:place), places from 0; how many neighbours are equal
    "SHUFFLED": ("transform(array_sort(transform({0}, (x, i) -> struct(md5({1} || ':' || CAST(i AS STRING)) AS h, i AS i, x AS x))), s -> s.x)", "list_transform(list_sort(list_transform({0}, lambda x, i: struct_pack(h := md5({1} || ':' || CAST(i - 1 AS STRING)), i := i, x := x))), lambda s: s.x)"),
    "EQUALS": ("CAST(size(filter(transform({0}, (x, i) -> i > 0 AND x = get({0}, i - 1)), y -> y)) AS BIGINT)", "CAST(len(list_filter({0}, lambda x, i: i > 1 AND x = {0}[i - 1])) AS BIGINT)"),
    # count(DISTINCT) of several columns makes Spark forget how the rows were dealt
    "DISTINCTS": ("CAST(size(collect_set({0})) AS BIGINT)", "count(DISTINCT {0})"),
    "LIST": ("collect_list({0})", "list({0})"),
    "DOT": ("aggregate(zip_with({0}, {1}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0e0, (s, x) -> s + x)", "list_sum(list_transform(list_zip({0}, {1}), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))"),
    "ANYNEAR": ("exists({0}, c -> levenshtein(c, {1}, 1) >= 0)", "len(list_filter(coalesce({0}, []), lambda c: levenshtein(" + _bytes("c") + ", " + _bytes("{1}") + ") <= 1)) > 0"),
    "EDIT1": ("levenshtein({0}, {1}, 1) >= 0", "levenshtein(" + _bytes("{0}") + ", " + _bytes("{1}") + ") <= 1"),
    "MATCHES": ("regexp_extract_all({0}, {1}, 0)", "regexp_extract_all({0}, {1})"),
    "SIZE": ("CAST(size({0}) AS BIGINT)", "CAST(len({0}) AS BIGINT)"),
    "SUBALL": ("regexp_replace({0}, {1}, {2})", "regexp_replace({0}, {1}, {2}, 'g')"),
    "JSONK": ("CAST(get_json_object({0}, '$.k') AS BIGINT)", "CAST(json_extract_string({0}, '$.k') AS BIGINT)"),
    "EPOCH": ("(CAST(datediff(CAST({0} AS DATE), DATE'1970-01-01') AS BIGINT) * 86400 + hour({0}) * 3600 + minute({0}) * 60 + CAST(floor(second({0})) AS BIGINT))", "CAST(floor(epoch({0})) AS BIGINT)"),
}


def _filled(text: str, engine: int) -> str:
    """Replace @NAME(arg; arg) by the engine's spelling."""
    while "@" in text:
        at = text.rindex("@")
        open_ = text.index("(", at)
        depth, end = 0, open_
        for end in range(open_, len(text)):
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            if not depth:
                break
        args = [a.strip() for a in text[open_ + 1 : end].split(";")]
        text = text[:at] + WORDS[text[at + 1 : open_]][engine].format(*args) + text[end + 1 :]
    return text


def rendered(shared: str, body: str, engine: int) -> str:
    """body with the named shared tables before it. A body that starts with WITH goes on with its own."""
    tables = ", ".join(f"{n} AS ({SHARED[n][engine]})" for n in shared.split())
    body = _filled(body.strip(), engine)
    if not tables:
        return body
    return f"WITH {tables}, {body[4:].strip()}" if body[:4].upper() == "WITH" else f"WITH {tables} {body}"


def spread(df: DataFrame) -> DataFrame:
    """df over all cores. A table in fewer pieces than there are cores (so a small one) is dealt out once, by rows; others
    stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def dealt(df: DataFrame, piece: int) -> DataFrame:
    """df dealt by doc_id, about `piece` bytes of stored input to each task. What groups, joins or orders by doc_id and more
    then stays where it is: the texts pass one shuffle, and none of the rows made from them does."""
    spark = df.sparkSession
    # else a join by doc_id and another column deals both sides anew
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    stored = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(max(spark.sparkContext.defaultParallelism, -(-stored // piece)), "doc_id")


def views(spark: SparkSession, sf_dir: str, text: str, piece: int = 0) -> None:
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            rows = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            (dealt(rows, piece) if t == "documents" and piece else spread(rows) if t in WIDE else rows).createOrReplaceTempView(t)


def query(shared: str, body: str, piece: int = 0) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """piece: documents are dealt by doc_id, so many bytes to a task (0: they stay as they are stored)."""
    text = rendered(shared, body, 0)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, text, piece)
        return spark.sql(text)

    return run, rendered(shared, body, 1)
