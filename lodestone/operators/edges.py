"""The correlation graph: shared chunks, near contexts and near times."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestone.functions.text import edge_strength, temporal_strength
from lodestone.functions.vectors import mean_vectors, nearest_neighbours
from lodestone.session import shared_dir

# Defaults that decide which edges there are.
SEMANTIC_K, SEMANTIC_MIN_SIM = 6, 0.3
TEMPORAL_WINDOW_SECS, TEMPORAL_TAU_SECS = 14 * 86400, 7 * 86400
#: Entities of one chunk above which its pairs are formed in several tasks.
WIDE_CHUNK = 256


def co_occurrence(mentions: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """src_id, dst_id, rel, weight, source_count: how many chunks mention both, src_id < dst_id.

    Each chunk's entities are made distinct and gathered once, one shuffle for
    both sides of the pairs; a chunk with very many is dealt over tasks by its
    first entity.  ``of`` (entity_id) keeps the pairs that touch given entities.
    """
    own = mentions.select("chunk_id", "entity_id").where("chunk_id is not null and entity_id is not null").distinct()
    sets = own.groupBy("chunk_id").agg(F.array_sort(F.collect_list("entity_id")).alias("e")).where(F.size("e") > 1)
    parts = F.sequence(F.lit(0), F.floor((F.size("e") - 1) / WIDE_CHUNK).cast("int"))
    split = sets.select("e", F.explode(parts).alias("part"))
    firsts = split.select("e", F.posexplode(F.slice("e", F.col("part") * WIDE_CHUNK + 1, F.lit(WIDE_CHUNK))).alias("pos", "src_id"), "part")
    pairs = firsts.select("src_id", F.explode(F.slice("e", F.col("part") * WIDE_CHUNK + F.col("pos") + 2, F.greatest(F.size("e") - F.col("part") * WIDE_CHUNK - F.col("pos") - 1, F.lit(0)))).alias("dst_id"))
    if of is not None:
        touched = of.select(F.col("entity_id").alias("t")).distinct()
        pairs = pairs.join(touched, pairs["src_id"] == touched["t"], "left").withColumnRenamed("t", "__a")
        pairs = pairs.join(touched, pairs["dst_id"] == touched["t"], "left").where("__a is not null or t is not null").select("src_id", "dst_id")
    counted = pairs.groupBy("src_id", "dst_id").agg(F.count(F.lit(1)).alias("source_count"))
    return counted.select("src_id", "dst_id", F.lit("co_occurs").alias("rel"), F.col("source_count").cast("double").alias("weight"), "source_count")


def entity_embeddings(mentions: DataFrame, chunk_embeddings: DataFrame) -> DataFrame:
    """entity_id, embedding: the mean over an entity's mentions; two in a chunk count twice."""
    return mean_vectors(mentions.select("entity_id", "chunk_id").join(chunk_embeddings.select("chunk_id", "embedding"), "chunk_id"), ["entity_id"], "embedding", "embedding")


def _undirected(pairs: DataFrame, rel: str, weight: str) -> DataFrame:
    ends = pairs.select(F.least("id", "neighbour").alias("src_id"), F.greatest("id", "neighbour").alias("dst_id"), F.col(weight).alias("weight"))
    return ends.groupBy("src_id", "dst_id").agg(F.max("weight").alias("weight")).select("src_id", "dst_id", F.lit(rel).alias("rel"), "weight", F.lit(0).cast("long").alias("source_count"))


def similar(embeddings: DataFrame, k: int = SEMANTIC_K, min_sim: float = SEMANTIC_MIN_SIM, id_col: str = "entity_id", of: DataFrame | None = None) -> DataFrame:
    """Each entity's k nearest by cosine first, then those of at least ``min_sim``, in either direction; of all entities, or of those that ``of`` (id) has."""
    near = nearest_neighbours(embeddings, k, id_col, of=of).withColumn("sim", 1 - F.col("distance")).where(F.col("sim") >= min_sim)
    return _undirected(near, "similar", "sim")


def upserted(edges: DataFrame, fresh: DataFrame) -> DataFrame:
    """Edges with the fresh ones added; where both have a pair and kind the fresh weight holds, and none is taken away."""
    keys = ["src_id", "dst_id", "rel"]
    return edges.join(fresh.select(*keys), keys, "left_anti").select(*edges.columns).unionByName(fresh.select(*edges.columns))


def similar_added(edges: DataFrame, embeddings: DataFrame, entities: DataFrame, k: int = SEMANTIC_K, min_sim: float = SEMANTIC_MIN_SIM) -> DataFrame:
    """The incremental form of ``similar``: only ``entities`` (entity_id), whose vectors are new or changed, look for their nearest."""
    return upserted(edges, similar(embeddings, k, min_sim, of=entities.select(F.col("entity_id").alias("id"))))


def _recent(state: list[tuple[int, object]], time: int, ids: list, most: int) -> list[tuple[int, object]]:
    """The ``most`` entities that were seen last (time, id; the latest first, then by id), after a time with these ids in order."""
    ids = ids[:most]
    return ([(time, x) for x in ids] + [s for s in state if s[1] not in ids])[:most]


def _by_time(rows: list[tuple]) -> Iterator[tuple[int, list]]:
    for time, group in groupby(rows, key=lambda r: r[0]):
        yield time, [x for _, x in group]


def temporal_pairs(times: DataFrame, window_secs: float, k: int = SEMANTIC_K, of: DataFrame | None = None) -> DataFrame:
    """id, neighbour, delta_secs: the k entities nearest in time to each entity, within the window; ties go by id.

    ``times`` has entity_id and event_time; ``of`` (entity_id) asks for some
    entities only.  An entity's k nearest are among the k nearest of one of its
    events, and those are among the k + 1 entities seen last before it and next
    after it.  So events are sorted by time into ranges and swept once in either
    direction with a state of k + 1 entities; the states at the ends of the ranges,
    2 k + 2 short rows for each, go from one range to the next.  Work and
    memory don't depend on the window's width.
    """
    spark = times.sparkSession
    shared_dir(spark)
    kind = times.schema["entity_id"].dataType.simpleString()
    micros = F.unix_micros(F.col("event_time").cast("timestamp"))
    own = times.where("event_time is not null and entity_id is not null").select(micros.alias("t"), F.col("entity_id").alias("id")).distinct()
    ranged = own.repartitionByRange("t").sortWithinPartitions("t", "id").checkpoint()
    width, most = int(window_secs * 1_000_000), k + 1
    ends_kind, pairs_kind = f"part int, last boolean, t long, id {kind}", f"id {kind}, neighbour {kind}, d long"
    ends_schema, pairs_schema = (to_arrow_schema(T._parse_datatype_string(x)) for x in (ends_kind, pairs_kind))

    def rows_of(parts: Iterator[pa.RecordBatch]) -> list[tuple]:
        return [row for part in parts for row in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]

    def ends(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = rows_of(parts)
        last: list = []
        for time, ids in _by_time(rows):
            last = _recent(last, time, ids, most)
        first: list = []
        for time, ids in reversed(list(_by_time(rows))):
            first = _recent(first, time, ids, most)
        place = TaskContext.get().partitionId()
        both = [(place, True, *x) for x in last] + [(place, False, *x) for x in first]
        cols = list(zip(*both, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_pydict({"part": cols[0], "last": cols[1], "t": cols[2], "id": cols[3]}, ends_schema)

    states: dict[tuple[int, bool], list] = {}
    for part, last, t, x in ranged.mapInArrow(ends, ends_kind).orderBy("part").collect():  # 2 k + 2 rows for each range
        states.setdefault((part, last), []).append((t, x))
    order = sorted({part for part, _ in states})

    def carried(parts: list[int], last: bool) -> dict[int, list]:
        found, state = {}, []
        for part in parts:
            found[part] = state
            own_ = sorted(states[part, last], key=lambda s: (-s[0] if last else s[0], s[1]))
            names = {x for _, x in own_}
            state = (own_ + [s for s in state if s[1] not in names])[:most]
        return found

    before, after = carried(order, True), carried(order[::-1], False)

    def sweep(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, place = rows_of(parts), TaskContext.get().partitionId()
        best: dict[tuple, int] = {}
        groups = list(_by_time(rows))
        for state, run, same in ((before.get(place, []), groups, True), (after.get(place, []), reversed(groups), False)):
            for time, ids in run:
                head = ids[:most] if same else []
                others = [(0, y) for y in head] + [(abs(time - s), y) for s, y in state if y not in head]
                for x in ids:
                    near = [o for o in others if o[1] != x]
                    for d, y in near[:k]:
                        if d <= width and d < best.get((x, y), width + 1):
                            best[x, y] = d
                state = _recent(state, time, ids, most)
        yield pa.RecordBatch.from_pydict({"id": [a for a, _ in best], "neighbour": [b for _, b in best], "d": list(best.values())}, pairs_schema)

    nearest = ranged.mapInArrow(sweep, pairs_kind).groupBy("id", "neighbour").agg((F.min("d") / F.lit(1e6)).alias("delta_secs"))
    if of is not None:
        nearest = nearest.join(of.select(F.col("entity_id").alias("id")).distinct(), "id", "left_semi")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("delta_secs", "neighbour"))
    return nearest.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def temporal(times: DataFrame, window_secs: float = TEMPORAL_WINDOW_SECS, tau_secs: float = TEMPORAL_TAU_SECS, k: int = SEMANTIC_K, of: DataFrame | None = None) -> DataFrame:
    """Each entity's k nearest in time, in either direction; strength falls off with ``tau_secs``."""
    near = temporal_pairs(times, window_secs, k, of).withColumn("strength", temporal_strength(F.col("delta_secs"), tau_secs))
    return _undirected(near, "temporal", "strength")


def temporal_added(edges: DataFrame, times: DataFrame, entities: DataFrame, window_secs: float = TEMPORAL_WINDOW_SECS, tau_secs: float = TEMPORAL_TAU_SECS, k: int = SEMANTIC_K) -> DataFrame:
    """The incremental form of ``temporal``: only ``entities`` (entity_id) look for their nearest."""
    return upserted(edges, temporal(times, window_secs, tau_secs, k, entities))


def with_strength(edges: DataFrame) -> DataFrame:
    return edges.withColumn("strength", edge_strength(F.col("rel"), F.col("source_count"), F.col("weight")))
