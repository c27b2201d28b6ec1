"""MinHash near-duplicate detection with tensored banding.

Two small collections of m half-keys (each of r minhashes) are computed for a document; the key of table (i, j) is the
pair (A_i, B_j), so 2*m*r minhashes serve m*m tables of 2*r minhashes. Two documents of similarity s share a table
unless no A or no B agrees: with r = 2 and m = 14 a pair at 0.8 is missed with a chance of about 1e-6.

Stages, all keyed shuffles: (1) word shingles, set fingerprint and half-keys of every document, in one pass over the
texts; (2) documents with one set form a class, its smallest doc_id stands for it, so copies cost no pairs; (3) half-keys
that only one class has are dropped before the tables' keys are formed; (4) in each bucket all members are verified
against its most typical member, the head (whose half-keys are the most common); (5) members of heads that then still have
several components are joined by what tells them from the head (_open_pairs), so that no link between components is lost
and no bucket is expanded into all its pairs; (6) components by star contraction.

The fingerprint of a set is two independent 64-bit sums over its shingles' 64-bit hashes and its size: texts of one class
are taken as copies, all other links are confirmed on the sets of shingle hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlab.llm import words as W
from strandlab.llm.common import components, discard, mapped, per_row, stage

ROWS_PER_HALF, HALVES = 2, 14


def _keys(size: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(97))
    return rng.integers(0, 2**63, size, dtype=np.uint64), rng.integers(0, 2**62, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _profiles(width: int, rows: int, halves: int):
    """A function for mapInArrow: doc_id, number of shingles, set fingerprint (two sums), half-keys."""
    seeds, odds = _keys(2 * halves * rows)
    labels = W.mix(np.arange(1, 2 * halves + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, data, offsets in W.texts(batch):
                starts, ends, first = W.spans(data, offsets)
                grams, at = W.shingles(W.word_hashes(data, starts, ends, lower=True), first, width)
                n = b - a
                sizes, f1, f2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                some = np.flatnonzero(np.diff(at) > 0)
                with np.errstate(over="ignore"):
                    for i in some:
                        own = np.unique(grams[at[i] : at[i + 1]])
                        sizes[i] = len(own)
                        f1[i] = own.sum(dtype=np.uint64)
                        f2[i] = (own * own * np.uint64(0xC2B2AE3D27D4EB4F) ^ (own >> np.uint64(17))).sum(dtype=np.uint64)
                    halves_of = np.zeros((n, 2 * halves), np.uint64)
                    if len(some):
                        where = at[:-1][some]
                        for h in range(2 * halves):
                            key = np.full(len(some), labels[h], np.uint64)
                            for k in range(h * rows, (h + 1) * rows):
                                least = np.minimum.reduceat((grams ^ seeds[k]) * odds[k], where)
                                key = W.mix(key * np.uint64(0x9E3779B97F4A7C15) + least)
                            halves_of[some, h] = key
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * 2 * halves, 2 * halves, dtype=np.int32)), pa.array(_signed(halves_of.ravel())))
                yield pa.RecordBatch.from_arrays([ids.slice(a, n), pa.array(sizes), pa.array(_signed(f1)), pa.array(_signed(f2)), keys], names=["doc_id", "n", "f1", "f2", "halves"])

    return run


def _sets(width: int):
    """A function for mapInArrow: doc_id and the hashes of its distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, data, offsets in W.texts(batch):
                starts, ends, first = W.spans(data, offsets)
                grams, at = W.shingles(W.word_hashes(data, starts, ends, lower=True), first, width)
                own = [np.unique(grams[at[i] : at[i + 1]]) for i in range(b - a)]
                ends_of = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                flat = np.concatenate([*own, np.zeros(0, np.uint64)])
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends_of), pa.array(_signed(flat)))], names=["doc_id", "grams"])

    return run


#: Members of one head that meet its shingles in one task.
FAN = 2_000
#: Most ids (8 bytes each) that are sent to all workers; more are joined by a shuffle.
SENT_IDS = 2_000_000


def _sets_of(ids: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """A table of the shingle sets of the documents in ids (rep, unique): rep, grams."""
    few = ids.count() <= SENT_IDS
    own = texts.join(F.broadcast(ids) if few else ids, texts["doc_id"] == ids["rep"], "left_semi")
    return stage(mapped(own, _sets(width), "doc_id long, grams array<long>").withColumnRenamed("doc_id", "rep"), "sets")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (c, rep, ...), a table, with gc and gr, the shingle sets of both. The sets of a head with very many members go
    to several tasks, its members among them."""
    many = pairs.groupBy("c").agg(F.ceil(F.count("*") / FAN).cast("int").alias("parts")).where("parts > 1")
    n_many = many.count()
    many = F.broadcast(many) if n_many <= SENT_IDS // 8 else many  # at most a row for FAN pairs
    # columns are renamed in both, so that both are one plan, and one shuffle serves both joins
    heads, rest = (sets.select(F.col("rep").alias(k), F.col("grams").alias(g)) for k, g in (("c", "gc"), ("r", "gr")))
    if not n_many:
        return pairs.join(rest, pairs["rep"] == rest["r"]).drop("r").join(heads, "c")
    parts = pairs.join(many, "c", "left")
    one = parts.where("parts is null").drop("parts").join(rest, F.col("rep") == F.col("r")).drop("r").join(heads, "c")
    heads = heads.join(many, "c").select("c", "gc", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = parts.where("parts is not null").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).drop("parts")
    return one.unionByName(dealt.join(rest, F.col("rep") == F.col("r")).drop("r").join(heads, ["c", "part"]).drop("part"))


def _links(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """A table of the pairs (u, v) whose full sets have 100 * |intersection| >= per_cent * |union|."""
    common = F.size(F.array_intersect("gc", "gr"))
    link = 100 * common >= per_cent * (F.size("gc") + F.size("gr") - common)
    return stage(_with_sets(stage(pairs, "pairs"), sets).where(link).select(F.least("c", "rep").alias("u"), F.greatest("c", "rep").alias("v")), "links")


def _near(a: str, b: str, per_cent: int):
    """Sets of so different sizes can't be similar enough."""
    return 100 * F.least(a, b) >= per_cent * F.greatest(a, b)


def _open_pairs(spokes: DataFrame, labels: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Pairs (c, rep) of members of one head that may link two components.

    Let D(x) be the symmetric difference of x and the head c, and r = (100 - p) / (100 + p). Sets x and y of similarity p %
    differ in r * (|x| + |y|) shingles at most, and D(x) and D(y) differ in just these; a member outside the head's
    component has |D| > r * (|x| + |c|), as it isn't linked with the head. So of two such members, D(x) and D(y) share
    more than (|D(x)| + r * (|c| - |x|)) / 2 elements, and |D(x)| - |x| * (100 - p) / p at least: what the members don't
    share with the head must agree by half. Sets that share t elements share one of the first |D| - t + 1 in any common
    order; with the rarest first, members that differ from the head in shingles of their own share none. Pairs are those
    that meet in such a first element. These are bounds, not estimates: no link is lost. Of the pairs with one member in
    the head's component, that one gives the same first elements and the other (its partner's D may be small) all that the
    second bound leaves."""
    p, q = per_cent, 100 + per_cent
    named = spokes.join(labels.select(F.col("node").alias("rep"), F.col("label").alias("l")), "rep", "left").withColumn("l", F.coalesce("l", "rep"))
    # whether the head and a member are linked is known: only a head whose other members have several components matters
    own, others = F.when(F.col("rep") == F.col("c"), F.col("l")), F.when(F.col("rep") != F.col("c"), F.col("l"))
    groups = named.groupBy("c").agg(F.min(others).alias("l1"), F.max(others).alias("l2"), F.max(own).alias("lc")).where("l1 < l2").select("c", "lc")
    open_ = stage(named.where("rep <> c").join(groups, "c").select("c", "cn", "rep", "n", "l", (F.col("l") != F.col("lc")).alias("out")), "open")
    apart = _with_sets(open_, sets).select("c", "cn", "rep", "n", "l", "out", F.concat(F.array_except("gr", "gc"), F.array_except("gc", "gr")).alias("d"))
    apart = stage(apart, "apart")
    rows = apart.select("c", "cn", "rep", "n", "l", "out", F.size("d").cast("long").alias("size"), F.explode("d").alias("g"))
    often = rows.groupBy("c", "g").agg(F.count("*").alias("k"), F.min("l").alias("l1"), F.max("l").alias("l2"), F.max("out").alias("some"))
    # what one component alone has can't be where two meet, but counts as a place in the order
    rows = rows.join(often.withColumn("meets", F.col("some") & (F.col("l1") < F.col("l2"))).select("c", "g", "k", "meets"), ["c", "g"])
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("c", "rep").orderBy("k", "g"))).where("meets")
    most = F.expr(f"n * {100 - p} div {p} + 1")
    rows = rows.withColumn("same", F.least(F.expr(f"size - (size * {q} + {100 - p} * (cn - n)) div {2 * q}"), most))
    rows = rows.withColumn("other", F.least(F.expr(f"size + 1 - greatest(1, ((size + 1) * {p} - n * {100 - p}) div {2 * p})"), most))
    rows = stage(rows.where("at <= same or (out and at <= other)").select("c", "g", "rep", "n", "l", "out", (F.col("at") <= F.col("same")).alias("same")), "firsts")
    a = rows.where("out").select("c", "g", *(F.col(x).alias(f"a_{x}") for x in ("rep", "n", "l", "same")))
    b = rows.where("same").select("c", "g", *(F.col(x).alias(f"b_{x}") for x in ("rep", "n", "l", "out")))
    met = a.join(b, ["c", "g"]).where((F.col("a_l") != F.col("b_l")) & (~F.col("b_out") | (F.col("a_same") & (F.col("a_rep") < F.col("b_rep")))) & _near("a_n", "b_n", p))
    return met.select(F.least("a_rep", "b_rep").alias("c"), F.greatest("a_rep", "b_rep").alias("rep")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, per_cent: int = 80, rows: int = ROWS_PER_HALF, halves: int = HALVES) -> DataFrame:
    """doc_id, n_shingles (distinct `width`-word shingles of the text with A-Z lower-cased), component_id (smallest
    doc_id reached by links of similarity per_cent / 100 or more, itself included), kept (doc_id = component_id).

    A text of fewer words than `width` has its whole word sequence as its only shingle. Null and empty texts, and texts
    of white space, have no shingle and are linked with nothing. Texts with one shingle set are linked, whatever their
    number. Rows with a null or repeated doc_id count as documents of their own (see per_row); an empty table gives an
    empty result; other columns are not looked at."""
    return per_row(docs, lambda d: _near_duplicates(d, width, per_cent, rows, halves), ("doc_id", "component_id"))


def _near_duplicates(docs: DataFrame, width: int, per_cent: int, rows: int, halves: int) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    all_docs = stage(mapped(texts, _profiles(width, rows, halves), "doc_id long, n long, f1 long, f2 long, halves array<long>"), "profiles")
    some = all_docs.where("n > 0")
    classes = some.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("halves").alias("halves"))
    half = stage(classes.select("rep", "n", F.posexplode("halves").alias("i", "h")), "halves")
    shared = half.groupBy("h").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.count("*").alias("c")).where("a < b").select("h", "c")
    x, y = (F.collect_list(F.when(side, F.col("h"))) for side in (F.col("i") < halves, F.col("i") >= halves))
    own = half.join(shared, "h").groupBy("rep", "n").agg(x.alias("x"), y.alias("y"), F.sum("c").alias("common"))
    keys = F.explode(F.flatten(F.transform("x", lambda x: F.transform("y", lambda y: F.xxhash64(x, y)))))
    own = stage(own.where((F.size("x") > 0) & (F.size("y") > 0)).withColumns({"x": F.sort_array("x"), "y": F.sort_array("y")}), "own")
    table = stage(own.select("rep", "n", "common", keys.alias("key")), "tables")
    heads = table.groupBy("key").agg(F.max(F.struct("common", -F.col("rep"), F.col("rep"), F.col("n"))).alias("head"), F.count("*").alias("size")).where("size > 1")
    spokes = stage(table.join(heads.select("key", F.col("head.rep").alias("c"), F.col("head.n").alias("cn")), "key").select("c", "cn", "rep", "n").distinct(), "spokes")
    sets = _sets_of(own.select("rep"), texts, width)
    discard(half, own, table)
    links = _links(spokes.where(F.col("rep") != F.col("c")).where(_near("n", "cn", per_cent)).select("c", "rep"), sets, per_cent)
    labels = stage(components(links), "labels")
    more = _links(_open_pairs(spokes, labels, sets, per_cent), sets, per_cent)
    if not more.isEmpty():
        labels = stage(components(links.unionByName(more)), "labels")
    discard(spokes, sets)
    reps = classes.select(F.col("n").alias("cn"), F.col("f1").alias("c1"), F.col("f2").alias("c2"), "rep")
    named = reps.join(labels, reps["rep"] == labels["node"], "left").select("cn", "c1", "c2", F.coalesce("label", "rep").alias("rep"))
    match = (F.col("n") == F.col("cn")) & (F.col("f1") == F.col("c1")) & (F.col("f2") == F.col("c2"))
    out = all_docs.select("doc_id", "n", "f1", "f2").join(named, match, "left")
    component = F.coalesce("rep", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
