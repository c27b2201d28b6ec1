"""Column builders and small DataFrame helpers that several operators use; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tokens(text: Column) -> Column:
    """Lower-cased runs without white space."""
    return F.filter(F.split(F.lower(text), r"[ \t\r\n]+"), lambda x: x != "")


def stable_seed(*parts: Column) -> Column:
    """First eight bytes of SHA-256 of the parts joined by ":", as an unsigned number (decimal(20,0))."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def deletions(word: Column) -> Column:
    """The word and each form with one character taken out."""
    n = F.length(word)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))
    return F.array_distinct(F.concat(F.array(word), cut))


def chunk_starts(n: Column, size: int, most: int) -> Column:
    """Evenly spread starts of at most `most` chunks of `size` out of n; one chunk stands in the middle; none fits: none."""
    k = F.least(F.lit(most), F.floor(n / size)).cast("int")
    spread = F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), lambda i: F.bround(i * (n - size) / F.greatest(k - 1, F.lit(1))).cast("int"))
    return F.when(k < 1, F.array().cast("array<int>")).when(k == 1, F.array(F.floor((n - size) / 2).cast("int"))).otherwise(spread)


def average_rank(by: list[str], value: str) -> Column:
    """Rank from 1 in which ties share their mean."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson's r as an aggregate, null where either is constant (corr() would raise)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def entropy(df: DataFrame, by: list[str], symbol: str, out: str = "bits") -> DataFrame:
    """Shannon entropy in bits of a symbol column for each group."""
    n = df.groupBy(*by, symbol).count()
    total = F.sum("count")
    return n.groupBy(*by).agg((F.log2(total) - F.try_divide(F.sum(F.col("count") * F.log2("count")), total)).alias(out))


def ngrams(df: DataFrame, by: list[str], order: str, symbol: str, n: int) -> DataFrame:
    """df with g, the n symbols from each row on; rows without n are left out. by is the boundary that none crosses."""
    w = Window.partitionBy(*by).orderBy(order)
    parts = [F.col(symbol), *(F.lead(symbol, k).over(w) for k in range(1, n))]
    return df.withColumn("g", F.array(*parts)).where(F.get("g", F.lit(n - 1)).isNotNull())


def permuted(df: DataFrame, by: list[str], seed: str, key: list[str], out: str = "place") -> DataFrame:
    """A pseudo-random order within groups that depends on the seed and the key alone, not on the partitioning."""
    h = F.md5(F.concat_ws(":", F.lit(seed), *key))
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(h, *key)))


def holm(df: DataFrame, p: str, order: list[str], by: list[str] | None = None, out: str = "p_holm") -> DataFrame:
    """Holm's step-down adjustment; ties are taken in the given order. One row for each hypothesis is expected."""
    groups = by or [F.lit(1)]
    w = Window.partitionBy(*groups).orderBy(p, *order)
    m = F.count("*").over(Window.partitionBy(*groups))
    step = df.withColumn("__s", F.col(p) * (m - F.row_number().over(w) + 1))
    return step.withColumn(out, F.least(F.lit(1.0), F.max("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("__s")


def empirical_p(observed: Column, null: Column) -> Column:
    """(1 + number of null values at least as large) / (1 + number of null values), as an aggregate."""
    return (1 + F.count(F.when(null >= observed, 1))) / (1 + F.count(null))
