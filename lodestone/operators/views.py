"""Lookups, counts and detail views over the knowledge base's tables, and the histories beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import excerpt
from lodestone.operators import clusters as cluster_ops
from lodestone.operators import entities as entity_ops
from lodestone.operators import graph, insights
from lodestone.operators.edges import with_strength
from lodestone.schema import checked_dimension

# Rows of a detail view, tries in a window of time, and jobs that may wait.
NEIGHBOURS, DOCUMENTS, MEMBERS, HISTORY = 50, 50, 100, 50
LOGIN_TRIES, LOGIN_WINDOW_SECS = 10, 60
MOST_QUEUED = 200_000


def by_id(df: DataFrame, id_col: str, value: object) -> DataFrame:
    """The row of one id, or none."""
    return df.where(F.col(id_col) == F.lit(value)).limit(1)


def chunks_of(chunks: DataFrame, document: object) -> DataFrame:
    """A document's chunks in order."""
    return chunks.where(F.col("document_id") == F.lit(document)).orderBy("seq")


def cluster_of(members: DataFrame, chunk: object) -> DataFrame:
    """cluster_id of a chunk, which is in one cluster at most."""
    return members.where(F.col("chunk_id") == F.lit(chunk)).select("cluster_id").limit(1)


# vectors


def vector_of(embeddings: DataFrame, chunk: object, space: int) -> DataFrame:
    return embeddings.where((F.col("chunk_id") == F.lit(chunk)) & (F.col("space_id") == space)).select("embedding").limit(1)


def vectors_in(embeddings: DataFrame, space: int) -> DataFrame:
    """chunk_id, embedding of a space, by chunk."""
    return embeddings.where(F.col("space_id") == space).select("chunk_id", "embedding").orderBy("chunk_id")


def missing(chunks: DataFrame, embeddings: DataFrame, space: int, limit: int = 1000) -> DataFrame:
    """Chunks without a vector in a space, by id."""
    there = embeddings.where(F.col("space_id") == space).select("chunk_id")
    return chunks.join(there, "chunk_id", "left_anti").orderBy("chunk_id").limit(limit)


def inserted(embeddings: DataFrame, fresh: DataFrame, dim: int) -> DataFrame:
    """Embeddings with those of ``fresh`` (chunk_id, space_id, embedding) that have none yet; another dimension than ``dim`` is an error, repeated keys are one."""
    keys = ["chunk_id", "space_id"]
    new = checked_dimension(fresh, dim).dropDuplicates(keys).join(embeddings.select(*keys), keys, "left_anti")
    return embeddings.unionByName(new.select(*embeddings.columns))


# counts


def member_arrays(members: DataFrame) -> DataFrame:
    """cluster_id, chunk_ids: the members of each cluster in order."""
    return members.groupBy("cluster_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))


def counts(entities: DataFrame, chunks: DataFrame, embeddings: DataFrame, jobs: DataFrame, space: int, kind: str | None = None) -> DataFrame:
    """One row: entities (of a kind), embedded chunks of a space, chunks (one at least, as scores divide by it) and queued jobs."""
    some = entities if kind is None else entities.where(F.col("kind") == kind)
    parts = [
        some.agg(F.count(F.lit(1)).alias("n_entities")),
        embeddings.agg(F.count_if(F.col("space_id") == space).alias("n_embedded")),
        chunks.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n_chunks")),
        jobs.agg(F.count_if(F.col("state") == "queued").alias("n_queued")),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.crossJoin(part)  # one row each
    return whole


# details


def entity_detail(entities: DataFrame, edges: DataFrame, mentions: DataFrame, documents: DataFrame, entity: object) -> dict[str, DataFrame]:
    one = F.lit(entity)
    return {"entity": by_id(entities, "entity_id", entity), "neighbours": graph.neighborhood(entities, edges, one, NEIGHBOURS), "documents": entity_ops.documents_of(mentions, documents, one, DOCUMENTS)}


def cluster_detail(clusters: DataFrame, members: DataFrame, chunks: DataFrame, cluster: object) -> dict[str, DataFrame]:
    """The cluster and its first members with excerpts of 200 characters."""
    own = cluster_ops.members_of(members, F.lit(cluster), MEMBERS)
    texts = chunks.join(F.broadcast(own.select("chunk_id", "similarity")), "chunk_id")
    return {"cluster": by_id(clusters, "cluster_id", cluster), "members": texts.select("chunk_id", "similarity", excerpt(F.col("text"), 200).alias("excerpt")).orderBy(F.desc("similarity"), "chunk_id")}


def insight_detail(found: DataFrame, evidence: DataFrame, chunks: DataFrame, insight: object) -> dict[str, DataFrame]:
    return {"insight": by_id(found, "insight_id", insight), "evidence": insights.evidence_of(evidence, chunks, F.lit(insight))}


def filtered_graph(nodes: DataFrame, edges: DataFrame, least_strength: float = 0.0, kinds: list[str] | None = None) -> dict[str, DataFrame]:
    """The nodes of some kinds and the edges among them that are strong enough."""
    shown = nodes if kinds is None else nodes.where(F.col("kind").isin(*kinds))
    ids = shown.select("entity_id")
    strong = (edges if "strength" in edges.columns else with_strength(edges)).where(F.col("strength") >= least_strength)
    both = strong.join(ids.withColumnRenamed("entity_id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("entity_id", "dst_id"), "dst_id", "left_semi")
    return {"nodes": shown, "edges": both}


def neighbours_in(edges: DataFrame, entity: object) -> DataFrame:
    """neighbour, strength of a shown graph's edges at a node, the strongest first."""
    found = graph.links_of(edges.drop("strength"), F.lit(entity))
    return found.select("neighbour", "rel", "strength").orderBy(F.desc("strength"), "neighbour", "rel")


# histories


def asked(history: DataFrame | None, answers: DataFrame, now: Column) -> DataFrame:
    """The history of questions with new ones (question_id, principal, question, answer) at its end."""
    fresh = answers.withColumn("created_at", now.cast("timestamp"))
    return fresh if history is None else history.unionByName(fresh.select(*history.columns))


def ask_history(history: DataFrame, principal: str | None = None, limit: int = HISTORY) -> DataFrame:
    """The newest first, of one principal or of all."""
    own = history if principal is None else history.where(F.col("principal") == principal)
    return own.orderBy(F.desc("created_at"), F.desc("question_id")).limit(limit)


def over_rate(tries: DataFrame, most: int = LOGIN_TRIES, window_secs: int = LOGIN_WINDOW_SECS) -> DataFrame:
    """key, window, n, allowed: tries (key, at) in fixed windows, and whether each window kept to the limit."""
    start = F.window("at", f"{window_secs} seconds")["start"]
    return tries.groupBy("key", start.alias("window")).agg(F.count(F.lit(1)).alias("n")).withColumn("allowed", F.col("n") <= most)


# work that waits


def debounced(jobs: DataFrame, fresh: DataFrame) -> DataFrame:
    """Jobs with the fresh ones whose ``dedupe_key`` is not already queued or running; of fresh ones with one key the first by run_at counts."""
    busy = jobs.where(F.col("state").isin("queued", "running") & F.col("dedupe_key").isNotNull()).select("dedupe_key").distinct()
    place = F.row_number().over(Window.partitionBy("dedupe_key").orderBy("run_at", "job_id"))
    first = fresh.withColumn("__r", F.when(F.col("dedupe_key").isNull(), F.lit(1)).otherwise(place)).where("__r = 1").drop("__r")
    return jobs.unionByName(first.join(busy, "dedupe_key", "left_anti").select(*jobs.columns))


def next_jobs(jobs: DataFrame, now: Column, limit: int = 1) -> DataFrame:
    """The queued jobs whose time has come: by priority, then by time, then by id."""
    return jobs.where((F.col("state") == "queued") & (F.col("run_at") <= now)).orderBy(F.desc("priority"), "run_at", "job_id").limit(limit)


def accepts(jobs: DataFrame, most: int = MOST_QUEUED) -> DataFrame:
    """n_queued, accepts: whether new work is taken."""
    return jobs.agg(F.count_if(F.col("state") == "queued").alias("n_queued")).withColumn("accepts", F.col("n_queued") <= most)
