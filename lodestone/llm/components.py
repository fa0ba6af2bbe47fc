"""Connected components of a graph whose links don't fit into one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import discard, materialize


def _forest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one batch of links at a time: each node with the smallest node it reaches there."""
    for part in parts:
        ends = np.column_stack([part.column(0).to_numpy(), part.column(1).to_numpy()])
        nodes, at = np.unique(ends, return_inverse=True)
        parent = list(range(len(nodes)))
        for a, b in at.reshape(ends.shape).tolist():
            while parent[a] != a:
                parent[a] = a = parent[parent[a]]
            while parent[b] != b:
                parent[b] = b = parent[parent[b]]
            if a != b:
                parent[max(a, b)] = min(a, b)
        for i in range(len(parent)):  # parents come first, so one pass flattens
            parent[i] = parent[parent[i]]
        roots = nodes[parent] if len(nodes) else nodes
        far = roots != nodes
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(roots[far])], names=["a", "b"])


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node it reaches) for every node of a link.

    Large-star and small-star steps, each a keyed aggregate and join, so a hub
    is aggregated before the shuffle and split after it; a union-find over each
    batch thins the links first.  Every step is written to the shared folder.
    """
    pairs = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    stars = materialize(pairs.mapInArrow(_forest, "a long, b long").distinct(), "links")
    while True:
        both = stars.unionAll(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: neighbours above a node go to the least of its neighbourhood
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, "large")
        # small star: neighbours below a node, and itself, go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        after = materialize(small, "links")
        settled = after.count() == stars.count() and not after.join(stars, ["a", "b"], "left_anti").limit(1).count()
        discard(large)
        discard(stars)
        stars = after
        if settled:
            break
    roots = stars.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
