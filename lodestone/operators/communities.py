"""Communities of the entity graph by weighted modularity, in parallel at every size.

Communities grow by merging.  In a round every community names the merge that
raises modularity most; where two name each other they merge, and what names
one of the two merges with them too, if it still gains were all that do so merged
before it.  Equal gains go by a hash of the pair, so that chains of equal weights
merge everywhere at once.  When no merge gains, single nodes move to a
neighbouring community that gains more, half of them in a round, as long as
modularity rises.  Every step is a keyed aggregate or join over the edges; rounds
are few, for communities shrink in number by a factor in each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import idf
from lodestone.session import kept

# Fixed value: the gain below which nothing merges or moves.
EPSILON = 1e-12
#: Decimals to which gains are compared, and rounds in which nodes may move.
DECIMALS, MOVES = 9, 4


def edge_weights(entities: DataFrame, co_occurrences: DataFrame, chunk_count: int) -> DataFrame:
    """src_id, dst_id, weight: shared chunks, more for rare entities."""
    told = entities.select("entity_id", F.sqrt(idf(F.lit(float(max(chunk_count, 1))), F.col("mention_count"))).alias("w"))
    a, b = told.select(F.col("entity_id").alias("src_id"), F.col("w").alias("wa")), told.select(F.col("entity_id").alias("dst_id"), F.col("w").alias("wb"))
    return co_occurrences.join(a, "src_id").join(b, "dst_id").select("src_id", "dst_id", (F.col("source_count") * F.col("wa") * F.col("wb")).alias("weight"))


def _ends(pairs: DataFrame, *more: str) -> DataFrame:
    """Rows (n, other, ...) of both ends of each pair (a, b, ...)."""
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.col("b").alias("other")), F.struct(F.col("b").alias("n"), F.col("a").alias("other")))).alias("e"), *more).select("e.n", "e.other", *more)


def _named(map_: DataFrame, side: str) -> DataFrame:
    return map_.select(F.col("n").alias(side), F.col("into").alias(f"{side}_into"))


def _gain(w: Column, d: Column, other: Column, total: float) -> Column:
    return w - d * other / F.lit(total)


def _merges(pairs: DataFrame, degrees: DataFrame, total: float) -> DataFrame:
    """n, into: the communities that merge in this round, and with which."""
    a, b = degrees.select(F.col("n").alias("a"), F.col("d").alias("d_a")), degrees.select(F.col("n").alias("b"), F.col("d").alias("d_b"))
    scored = pairs.join(a, "a").join(b, "b").withColumn("g", F.round(_gain(F.col("w"), F.col("d_a"), F.col("d_b"), total), DECIMALS)).where(F.col("g") > EPSILON)
    order = F.struct((-F.col("g")).alias("g"), F.xxhash64("a", "b").alias("h"), "a", "b", "w", "d_a", "d_b")
    best = scored.select(order.alias("o"), "a", "b").select(F.explode(F.array("a", "b")).alias("n"), "o").groupBy("n").agg(F.min("o").alias("o"))
    best = kept(best.select("n", F.col("o.a").alias("a"), F.col("o.b").alias("b"), F.col("o.w").alias("w"), F.when(F.col("n") == F.col("o.a"), F.col("o.d_a")).otherwise(F.col("o.d_b")).alias("d")), "communities")
    mutual = best.groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"), F.sum("d").alias("d")).where("k = 2").select(F.col("a").alias("into"), "b", F.col("d").alias("pair_d"))
    member = mutual.select(F.explode(F.array("into", "b")).alias("m"), "into", "pair_d")
    suitors = best.withColumn("m", F.when(F.col("n") == F.col("a"), F.col("b")).otherwise(F.col("a"))).join(member, "m").join(member.select(F.col("m").alias("n"), F.lit(True).alias("paired")), "n", "left").where("paired is null")
    weights = suitors.groupBy("into").agg(F.sum("d").alias("all_d"))
    joined = suitors.join(weights, "into").where(_gain(F.col("w"), F.col("d"), F.col("pair_d") + F.col("all_d") - F.col("d"), total) > EPSILON).select("n", "into")
    return mutual.select(F.col("b").alias("n"), "into").unionByName(joined)


def _contracted(pairs: DataFrame, merges: DataFrame) -> DataFrame:
    moved = pairs.join(_named(merges, "a"), "a", "left").join(_named(merges, "b"), "b", "left").select(F.coalesce("a_into", "a").alias("x"), F.coalesce("b_into", "b").alias("y"), "w")
    return moved.where("x <> y").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("w"))


def _moved(labels: DataFrame, pairs: DataFrame, degrees: DataFrame, total: float, number: int) -> DataFrame:
    """Labels after one round in which half of the nodes may move to the neighbouring community of most gain."""
    sums = labels.join(degrees, "n").groupBy("c").agg(F.sum("d").alias("c_d"))
    votes = _ends(pairs, "w").join(labels.select(F.col("n").alias("other"), "c"), "other").groupBy("n", "c").agg(F.sum("w").alias("w"))
    own = labels.select("n", F.col("c").alias("own")).join(degrees, "n")
    scored = votes.join(own, "n").join(sums, "c").withColumn("g", F.round(F.col("w") - F.col("d") * (F.col("c_d") - F.when(F.col("c") == F.col("own"), F.col("d")).otherwise(0.0)) / F.lit(total), DECIMALS))
    best = scored.groupBy("n").agg(F.min(F.struct((-F.col("g")).alias("g"), "c")).alias("best"), F.max(F.when(F.col("c") == F.col("own"), F.col("g"))).alias("stay"), F.first("d").alias("d"), F.first("own").alias("own"))
    stay = F.coalesce("stay", F.lit(0.0))
    moves = best.where((F.pmod(F.xxhash64("n", F.lit(number)), F.lit(2)) == 0) & (-F.col("best.g") > stay + EPSILON)).select("n", F.col("best.c").alias("into"))
    return labels.join(moves, "n", "left").select("n", F.coalesce("into", "c").alias("c"))


def communities(entities: DataFrame, weighted: DataFrame, moves: int = MOVES) -> DataFrame:
    """entity_id, community_id (the smallest member's id) for every entity; one without edges is a community of its own.

    ``weighted`` has src_id, dst_id, weight; weights of zero or less, and edges
    to no entity, count nothing.
    """
    nodes = entities.select(F.col("entity_id").alias("n")).distinct()
    known = weighted.where("weight > 0").join(nodes.select(F.col("n").alias("src_id")), "src_id", "left_semi").join(nodes.select(F.col("n").alias("dst_id")), "dst_id", "left_semi")
    every = kept(known.groupBy(F.least("src_id", "dst_id").alias("a"), F.greatest("src_id", "dst_id").alias("b")).agg(F.sum("weight").alias("w")), "communities")
    degrees = kept(every.select(F.explode(F.array("a", "b")).alias("n"), "w").groupBy("n").agg(F.sum("w").alias("d")), "communities")
    total = degrees.agg(F.sum("d")).first()[0] or 0.0
    labels = nodes.withColumn("c", F.col("n"))
    pairs, sums = every.where("a <> b"), degrees
    while total:
        merges = kept(_merges(pairs, sums, total), "communities")
        if merges.isEmpty():
            break
        labels = kept(labels.join(merges.select(F.col("n").alias("c"), "into"), "c", "left").select("n", F.coalesce("into", "c").alias("c")), "communities")
        pairs = kept(_contracted(pairs, merges), "communities")
        sums = kept(sums.join(merges, "n", "left").groupBy(F.coalesce("into", "n").alias("n")).agg(F.sum("d").alias("d")), "communities")
    if total and moves:
        best = modularity(_as_communities(labels), known)
        for number in range(moves):
            after = kept(_moved(labels, every.where("a <> b"), degrees, total, number), "communities")
            found = modularity(_as_communities(after), known)
            if found <= best + EPSILON:
                break
            labels, best = after, found
    return _as_communities(labels)


def _as_communities(labels: DataFrame) -> DataFrame:
    least = labels.groupBy("c").agg(F.min("n").alias("community_id"))
    return labels.join(least, "c").select(F.col("n").alias("entity_id"), "community_id")


def modularity(communities: DataFrame, weighted: DataFrame) -> float:
    """Of a partition, between -0.5 and 1."""
    a = communities.select(F.col("entity_id").alias("src_id"), F.col("community_id").alias("ca"))
    b = communities.select(F.col("entity_id").alias("dst_id"), F.col("community_id").alias("cb"))
    known = weighted.join(a, "src_id").join(b, "dst_id")
    by_pair = known.groupBy("ca", "cb").agg(F.sum("weight").alias("w"))
    ends = by_pair.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0).alias("inside")), F.struct(F.col("cb").alias("c"), F.lit(0.0).alias("inside")))).alias("e"), "w")
    sums = ends.groupBy("e.c").agg(F.sum("w").alias("d"), F.sum("e.inside").alias("inside"))
    inside, both, squares = sums.agg(F.sum("inside"), F.sum("d"), F.sum(F.col("d") * F.col("d"))).first()
    return 2 * inside / both - squares / both**2 if both else 0.0
