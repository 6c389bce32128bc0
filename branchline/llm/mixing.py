"""Mixing sources to target weights by Poisson replication (operator 4), in DataFrame expressions alone.

A source with weight w and n rows gets the rate total * w / n, the mean number of copies of its rows. A row's number of
copies inverts the Poisson distribution of that rate at a number in (0, 1) hashed from a seed and the row's id, so it depends
on nothing but these. Rows are exploded by their copies and dealt out by a second hash, which is a global shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, materialize

#: Weights are sizes to this power unless they are given; the seed; sources whose rates may be broadcast; copies of rates beyond that.
TEMPERATURE, SEED, BROADCAST_SOURCES, SALTS = 0.7, 17, 10_000, 32
#: A larger rate is drawn as the sum of several equal ones, each at most this.
STEP = 64.0
#: 2 ** 52: thirteen hexadecimal digits of a hash.
_UNITS = 4503599627370496.0


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) hashed from the parts, written with bars between them; a null part counts as 'null'."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / _UNITS


def rates(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """source, rate for each source of ``docs``.

    ``weights`` has source and weight (sources it lacks, and null weights, count as 0, and it may name others; negative or
    infinite weights and NaN are an error); without it weights are sizes to the power ``temperature``. They are scaled to sum 1 over the sources that occur. ``total`` is the expected
    number of rows, by default as many as there are. A null source is a source of its own.
    """
    sizes = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        weighed = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(temperature))))
    else:
        if weights.where(~F.coalesce((F.col("weight") >= 0) & (F.col("weight") < float("inf")), F.col("weight").isNull())).limit(1).count():
            raise ValueError("weights must be finite numbers and not negative")
        given = weights.groupBy(F.col("source").alias("_given")).agg(F.sum("weight").alias("w"))
        weighed = sizes.join(given, sizes["source"].eqNullSafe(given["_given"]), "left").select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    sums = weighed.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    # one row beside one row per source
    goal = F.col("all_n") if total is None else F.lit(float(total))
    rate = F.when(F.col("all_w") > 0, goal * F.col("w") / F.col("all_w") / F.col("n")).otherwise(F.lit(0.0))
    return weighed.join(F.broadcast(sums), F.lit(True)).select("source", rate.alias("rate"))


def tables(rate: Column) -> tuple[Column, Column]:
    """(draws, cdf): how many equal draws a rate is the sum of, and the cumulative probabilities of one of them."""
    draws = F.greatest(F.lit(1), F.ceil(rate / STEP).cast("int"))
    step = rate / draws
    upto = F.ceil(step + 12 * F.sqrt(step) + 20).cast("int")
    first = F.exp(-step)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("cdf"))

    def add(acc: Column, k: Column) -> Column:
        p = acc["p"] * step / k
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(acc["cdf"], F.array(c)).alias("cdf"))

    return draws, F.aggregate(F.sequence(F.lit(1), upto), start, add, lambda acc: acc["cdf"])


def mix(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None, temperature: float = TEMPERATURE, seed: int = SEED, names: tuple[str, str] = ("copy", "shuffle_key")) -> DataFrame:
    """The rows of ``docs`` repeated by their Poisson counts, with ``copy`` (from 1) and ``shuffle_key``, in shuffled order.

    Rows of equal doc_id have equal counts, and each is repeated; null ids and null sources count as the text 'null' and as a
    source. Texts are not looked at. ``names`` are those of the two columns; columns of ``docs`` of these names are replaced,
    others of any name are kept. Partitions follow the key,
    and rows are sorted by it within them. Empty in, empty out.
    """
    spark = docs.sparkSession
    copy, shuffle_key = names
    docs = docs.drop(*names)
    source, n_draws, table, salt, salt_of, u, count = free_names([*docs.columns, *names], "source", "draws", "cdf", "salt", "of", "u", "count")
    draws, cdf = tables(F.col("rate"))
    by_source = materialize(rates(docs, weights, total, temperature).select(F.col("source").alias(source), draws.alias(n_draws), cdf.alias(table)))
    ids = docs["doc_id"]
    if by_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(by_source), docs["source"].eqNullSafe(by_source[source]))
    else:
        # every rate goes to each salt, so that a source with very many rows is spread
        salted = by_source.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        with_salt = docs.withColumn(salt_of, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        joined = with_salt.join(salted, with_salt["source"].eqNullSafe(salted[source]) & (with_salt[salt_of] == salted[salt]))
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col(n_draws)),
        F.lit(0),
        lambda acc, k: acc + F.size(F.filter(F.col(table), lambda c: c <= uniform(F.lit(seed), ids, k))),
    )
    one = F.size(F.filter(F.col(table), lambda c: c <= F.col(u)))
    counted = joined.withColumn(u, uniform(F.lit(seed), ids, F.lit(1)))
    counted = counted.withColumn(count, F.when(F.col(n_draws) == 1, one).otherwise(drawn)).where(F.col(count) > 0)
    out = counted.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(count))))
    key = F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}:order"), F.coalesce(ids.cast("string"), F.lit("null")), F.col(copy).cast("string"))), 1, 16)
    out = out.select(*(docs[c] for c in docs.columns), copy, key.alias(shuffle_key))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the key is uniform: equal ranges of it are equal shares, without sampling for a range partitioning
    share = F.floor(F.conv(F.substring(shuffle_key, 1, 8), 16, 10).cast("double") / 4294967296.0 * n).cast("int")
    return out.repartitionById(n, share).sortWithinPartitions(shuffle_key)
