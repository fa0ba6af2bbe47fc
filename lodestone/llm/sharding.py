"""Deterministic shuffle into shards: a Feistel permutation of global row numbers.

Rows get gapless numbers 0..N-1 that depend on their contents only, a keyed
Feistel network over Z_a x Z_b (a*b >= N, a*b - N < a + b) permutes them, and
cycle walking brings the few values at or above N back into range.  The place p
of a row gives its shard (p mod k) and slot (p div k) by arithmetic, and the
inverse is as cheap, so a reader can locate any row without a lookup table.

Law ``rows``: shard counts differ by at most one, slots are gapless from 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hash buckets that number rows independently; each holds about N / BUCKETS rows.
BUCKETS = 4096
#: Rows that one expansion step makes from a run of identical rows.
RUN = 8192
ROUNDS = 6


def _round(value: Column, number: int, key: int, modulus: int) -> Column:
    return F.pmod(F.xxhash64(value, F.lit(number), F.lit(key).cast("long")), F.lit(modulus).cast("long"))


def _half_step(number: int, a: int, b: int, key: int) -> Callable[[Column], Column]:
    if number % 2 == 0:
        return lambda s: F.struct(F.pmod(s["l"] + _round(s["r"], number, key, a), F.lit(a).cast("long")).alias("l"), s["r"].alias("r"))
    return lambda s: F.struct(s["l"].alias("l"), F.pmod(s["r"] + _round(s["l"], number, key, b), F.lit(b).cast("long")).alias("r"))


def _feistel(x: Column, a: int, b: int, key: int) -> Column:
    """One pass over Z_a x Z_b, as one expression; halves change in turn, so each round can be undone."""
    left, right = F.floor(x / F.lit(b)).cast("long"), F.pmod(x, F.lit(b).cast("long"))
    halves = F.struct(left.alias("l"), right.alias("r"))
    for number in range(ROUNDS):
        halves = F.element_at(F.transform(F.array(halves), _half_step(number, a, b, key)), 1)  # a lambda names the state, so that it isn't repeated
    return halves["l"] * F.lit(b).cast("long") + halves["r"]


def domain(n: int) -> tuple[int, int]:
    """The sides of the smallest near-square grid that holds ``n`` values."""
    a = max(1, math.isqrt(max(n, 1)))
    return a, -(-max(n, 1) // a)


def walk_length(spark, n: int, key: int) -> int:
    """Passes that the longest walk takes; only the fewer than a + b values from ``n`` on are walked, on the cluster."""
    a, b = domain(n)
    outside = spark.range(n, a * b).select(F.col("id").alias("x"))
    steps = 1
    while outside.limit(1).count():
        outside = outside.select(_feistel(F.col("x"), a, b, key).alias("x")).where(F.col("x") >= n)
        steps += 1
    return steps


def permute(x: Column, n: int, key: int, steps: int) -> Column:
    """The place of row number ``x`` among ``n``."""
    a, b = domain(n)
    place = _feistel(x, a, b, key)
    if steps > 1:
        place = F.aggregate(F.sequence(F.lit(2), F.lit(steps)), place, lambda at, _: F.when(at < n, at).otherwise(_feistel(at, a, b, key)))
    return place


def number_rows(df: DataFrame, name: str = "row_number", buckets: int = BUCKETS) -> DataFrame:
    """Add gapless global row numbers that depend on the rows' contents only, not on files or partitions.

    Identical rows are counted before any shuffle, so a row with very many
    copies is one entry until its numbers are dealt out again in short runs.
    """
    cols = df.columns
    counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n")).withColumn("__h", F.xxhash64(*cols)).withColumn("__bucket", F.pmod(F.col("__h"), F.lit(buckets)).cast("int"))
    sizes = counted.groupBy("__bucket").agg(F.sum("__n").alias("__size"))
    offsets = sizes.select("__bucket", (F.sum("__size").over(Window.orderBy("__bucket")) - F.col("__size")).alias("__offset"))  # at most `buckets` rows
    before = Window.partitionBy("__bucket").orderBy("__h", *cols).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    placed = placed.join(F.broadcast(offsets), "__bucket").withColumn("__first", F.col("__first") + F.col("__offset"))
    runs = placed.withColumn("__run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / RUN).cast("long"))))
    runs = runs.withColumn("__at", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(RUN - 1).cast("long"), F.col("__n") - 1 - F.col("__run") * RUN))))
    return runs.select(*cols, (F.col("__first") + F.col("__run") * RUN + F.col("__at")).alias(name))


def shard_rows(df: DataFrame, n_shards: int = 8, key: int = 20_261_126, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Add ``shard`` and ``slot`` to every row of ``df``; law ``rows``.

    Nulls in any column, empty tables and repeated rows are ordinary: rows that
    are alike in all columns get different slots.  Columns named like the new
    ones are replaced.  Columns must be of orderable types.
    """
    kept = df.drop(shard, slot)
    numbered = number_rows(kept, "__number")
    n = kept.count()
    steps = walk_length(df.sparkSession, n, key) if n else 1
    place = numbered.withColumn("__place", permute(F.col("__number"), n, key, steps))
    return place.select(*kept.columns, F.pmod("__place", F.lit(n_shards)).cast("int").alias(shard), F.floor(F.col("__place") / n_shards).cast("long").alias(slot))
