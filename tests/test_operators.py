"""The graph, communities, clusters, search, insights and the streaming stages."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import clusters, communities, edges, entities, graph, insights, search
from lodestone.schema import entity_id
from lodestone.sources.ingest import admit
from lodestone.streaming import knowledge

TRIANGLES = [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (3, 4, 1.0), (4, 5, 1.0), (3, 5, 1.0)]


def grouped(spark, n, links):
    nodes = spark.range(n).select(F.col("id").alias("entity_id"))
    weighted = spark.createDataFrame(links, "src_id long, dst_id long, weight double")
    return {r["entity_id"]: r["community_id"] for r in communities.communities(nodes, weighted).collect()}


@pytest.mark.parametrize(
    ("n", "links", "labels"),
    [
        (6, [*TRIANGLES, (2, 3, 0.1)], [0, 0, 0, 3, 3, 3]),
        (0, [], []),
        (3, [], [0, 1, 2]),
        (2, [(0, 1, 1.0)], [0, 0]),
        (3, [(0, 1, 0.0), (1, 2, -1.0), (0, 0, 5.0)], [0, 1, 2]),
        (3, [(0, 1, 1.0), (1, 0, 1.0), (0, 9, 4.0), (2, 2, 1.0)], [0, 0, 2]),
    ],
)
def test_communities_of_small_graphs(spark, n, links, labels):
    assert grouped(spark, n, links) == dict(enumerate(labels))


def test_a_weak_hub_joins_no_two_groups(spark):
    found = grouped(spark, 7, [*TRIANGLES, *[(i, 6, 0.1) for i in range(6)]])
    assert len({found[i] for i in range(3)}) == len({found[i] for i in range(3, 6)}) == 1 and found[0] != found[3]


def test_hubs_chains_and_planted_groups(spark):
    assert set(grouped(spark, 400, [(0, i, 1.0) for i in range(1, 400)]).values()) == {0}
    rng = np.random.default_rng(2)
    links = [(a, b, 1.0) for a in range(120) for b in range(a + 1, 120) if rng.random() < (0.5 if a % 4 == b % 4 else 0.02)]
    found = grouped(spark, 120, links)
    assert all(found[i] == i % 4 for i in range(120))
    chain = grouped(spark, 300, [(i, i + 1, 1.0) for i in range(299)])
    df = spark.createDataFrame(list(chain.items()), "entity_id long, community_id long")
    weighted = spark.createDataFrame([(i, i + 1, 1.0) for i in range(299)], "src_id long, dst_id long, weight double")
    assert communities.modularity(df, weighted) > 0.85


@pytest.fixture(scope="module")
def small_graph(spark):
    nodes = spark.createDataFrame([(i, "ip", f"v{i}", 1 + i) for i in range(8)], "entity_id long, kind string, value string, mention_count long")
    links = spark.createDataFrame([(a, b, "co_occurs", w, 1) for a, b, w in TRIANGLES] + [(2, 3, "similar", 0.5, 0), (0, 3, "temporal", 0.9, 0), (0, 1, "similar", 0.4, 0)], "src_id long, dst_id long, rel string, weight double, source_count long")
    return nodes, links


def test_communities_and_bridges(spark, small_graph):
    nodes, links = small_graph
    weighted = communities.edge_weights(nodes, links.where("rel = 'co_occurs'"), 10)
    found = communities.communities(nodes, weighted)
    labels = {r["entity_id"]: r["community_id"] for r in found.collect()}
    assert labels == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7}
    assert communities.modularity(found, weighted) == pytest.approx(0.468, abs=0.001)
    assert [(r["src_id"], r["dst_id"]) for r in graph.bridges(nodes, links, found).collect()] == [(2, 3)]


def test_graph_views(small_graph):
    nodes, links = small_graph
    top = graph.nodes(nodes, links, limit=2).collect()
    assert [(r["entity_id"], r["degree"]) for r in top] == [(3, 4), (0, 4)]
    assert graph.nodes(nodes, links, kind="email").count() == 0
    whole = graph.graph(nodes, links)
    assert whole["total"].first()[0] == 8 and [r["strength"] for r in whole["edges"].collect()][0] == 0.9
    assert [(r["method"], round(r["strength"], 2)) for r in graph.pair_links(links, 1, 0).collect()] == [("co_occurs", 0.68), ("similar", 0.4)]
    near = graph.neighborhood(nodes, links, F.lit(0)).collect()
    assert [(r["entity_id"], r["rel"]) for r in near] == [(3, "temporal"), (1, "co_occurs"), (2, "co_occurs"), (1, "similar")]
    common = graph.common_neighbors(nodes, links, 0, 2).collect()
    assert [(r["entity_id"], r["a_method"], r["b_method"]) for r in common] == [(3, "temporal", "similar"), (1, "co_occurs", "co_occurs")]


def test_pairs_of_shared_chunks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(int(c), int(e)) for c, e in zip(rng.integers(0, 12, 400), rng.integers(0, 40, 400), strict=True)] + [(None, 1), (1, None)]
    df = spark.createDataFrame(rows, "chunk_id long, entity_id long")
    want: dict = {}
    for c in range(12):
        own = sorted({e for x, e in rows if x == c and e is not None})
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                want[a, b] = want.get((a, b), 0) + 1
    for wide in (256, 3):
        monkeypatch.setattr(edges, "WIDE_CHUNK", wide)
        assert {(r["src_id"], r["dst_id"]): r["source_count"] for r in edges.co_occurrence(df).collect()} == want
    of = df.where("entity_id = 5").select("entity_id")
    assert {(r["src_id"], r["dst_id"]) for r in edges.co_occurrence(df, of).collect()} == {p for p in want if 5 in p}
    assert edges.co_occurrence(df.limit(0)).count() == 0


def test_near_times(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [(e, start + datetime.timedelta(seconds=s)) for e, s in [(1, 0), (1, 100), (2, 40), (3, 161), (4, 1000), (5, None or 60), (1, 0)]] + [(6, None)]
    df = spark.createDataFrame(rows, "entity_id long, event_time timestamp")
    pairs = {(r["id"], r["neighbour"]): r["delta_secs"] for r in edges.temporal_pairs(df, 61).collect()}
    assert pairs == {(a, b): d for x, y, d in [(1, 2, 40.0), (1, 3, 61.0), (1, 5, 40.0), (2, 5, 20.0)] for a, b in [(x, y), (y, x)]}
    found = {(r["src_id"], r["dst_id"]): r["weight"] for r in edges.temporal(df, 61, 10.0, 1).collect()}
    assert set(found) == {(1, 2), (2, 5), (1, 3)} and found[2, 5] == pytest.approx(np.exp(-2))


def test_means_count_mentions(spark):
    mentions = spark.createDataFrame([("e", 1), ("e", 1), ("e", 2), ("f", 3)], "entity_id string, chunk_id long")
    vectors = spark.createDataFrame([(1, [0.0, 3.0]), (2, [3.0, 0.0])], "chunk_id long, embedding array<float>")
    assert [tuple(r) for r in edges.entity_embeddings(mentions, vectors).collect()] == [("e", [1.0, 2.0])]
    near = edges.similar(spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [-1.0, 0.0])], "entity_id long, embedding array<float>"), k=2)
    assert [(r["src_id"], r["dst_id"]) for r in near.collect()] == [(1, 2)]


def blobs(n=60, seed=1):
    rng = np.random.default_rng(seed)
    centers = np.eye(6)[:3] * 5
    return [(i, [float(x) for x in centers[i % 3] + rng.normal(0, 0.05, 6)]) for i in range(n)]


def test_density_clusters_are_the_blobs(spark):
    rows = blobs()
    df = spark.createDataFrame([*rows, (99, [-1.0, -1.0, -1.0, 0.3, 0.2, 0.9])], "chunk_id long, embedding array<float>")
    found = {r["chunk_id"]: r["label"] for r in clusters.density_clusters(df, 5).collect()}
    assert 99 not in found and len(set(found.values())) == 3
    assert all(len({found[i] for i in range(k, 60, 3) if i in found}) == 1 for k in range(3))
    assert {r["chunk_id"]: r["label"] for r in clusters.density_clusters(df, 5, block_bytes=1500).collect()} == found
    assert clusters.density_clusters(df.limit(1), 2).count() == 0 and clusters.density_clusters(df.limit(0), 2).count() == 0


def test_spanning_trees_look_further_only_where_lists_end(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = np.concatenate([rng.normal(0, 0.05, (60, 6)) + 5 * np.eye(6)[i % 3] for i in range(3)])
    rows[[10, 70, 130]] = rows[[11, 71, 131]]  # exact copies
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "id long, v array<double>").cache()
    asked, against_all = [], clusters.against_all
    monkeypatch.setattr(clusters, "against_all", lambda a, *rest: asked.append(a.count()) or against_all(a, *rest))
    few = {tuple(r) for r in clusters.spanning_tree(df, 5).collect()}
    assert len(few) == 179 and sum(asked) <= 3 * 180  # the last rounds look for all, those before for few
    monkeypatch.setattr(clusters, "LISTED", 1)
    assert {tuple(r) for r in clusters.spanning_tree(df, 5, 3000).collect()} == few


def test_spanning_trees_are_the_lightest(spark):
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(70, 4))
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    far = np.sqrt(2 * np.maximum(np.round(1 - unit @ unit.T, 9), 0))
    core = np.sort(far, axis=1)[:, 3]
    reach = np.maximum(np.maximum(far, core[:, None]), core[None, :])
    parent, weight = list(range(70)), 0.0

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, a, b in sorted((reach[a, b], a, b) for a in range(70) for b in range(a + 1, 70)):
        if top(a) != top(b):
            parent[top(a)] = top(b)
            weight += d
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "id long, v array<double>")
    for block in (None, 900):
        tree = clusters.spanning_tree(df, 4, block).collect()
        assert len(tree) == 69 and sum(r["d"] for r in tree) == pytest.approx(weight, abs=1e-4)


def test_ids_stay_with_most_members(spark):
    groups = spark.createDataFrame([(i, 0) for i in range(6)] + [(i, 1) for i in range(6, 9)] + [(9, 2)], "chunk_id long, label int")
    old = spark.createDataFrame([(i, "A") for i in range(5)] + [(5, "B"), (6, "A"), (7, "B"), (8, "B")], "chunk_id long, cluster_id string")
    assert {r["label"]: (r["cluster_id"], r["changed"]) for r in clusters.stable_ids(groups, old).collect()} == {0: ("A", True), 1: ("B", True), 2: ("new-9", True)}
    same = clusters.stable_ids(groups, groups.select("chunk_id", F.concat(F.lit("c"), F.col("label").cast("string")).alias("cluster_id")))
    assert not any(r["changed"] for r in same.collect())


def test_assignment_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([*blobs(), (77, None)], "chunk_id long, embedding array<float>")
    found = {r["chunk_id"]: r["cluster_id"] for r in clusters.assign(df.repartition(7), ["chunk_id"]).collect()}
    assert found == {i: str(i % 3) for i in range(60)}
    first = clusters.assign(df.where("chunk_id < 30"), ["chunk_id"])
    made = clusters.centroids(first, df.where("embedding is not null"))
    later = clusters.assign(df.where("chunk_id >= 30"), ["chunk_id"], made)
    assert {r["cluster_id"] for r in later.collect()} == {"0", "1", "2"}
    counted = clusters.dirtied(made.withColumn("dirty_count", F.lit(0).cast("long")), later)
    assert clusters.due(counted).count() == 3
    assert clusters.representatives(first, df, made, 2).count() == 6
    members, again = clusters.recluster(df.where("embedding is not null"), first.select("cluster_id", "chunk_id"), 5)
    assert {r["cluster_id"] for r in again.collect()} == {"0", "1", "2"}


def test_batches_are_assigned_in_order(spark):
    df = spark.createDataFrame(blobs(90), "chunk_id long, embedding array<float>")
    for batch in (7, 30, 1000):
        found = {r["chunk_id"]: r["cluster_id"] for r in clusters.assign(df, ["chunk_id"], batch=batch).collect()}
        assert found == {i: str(i % 3) for i in range(90)}
    again = clusters.assign(df, ["chunk_id"], members=df.where("chunk_id < 80").select("chunk_id"))
    assert {r["chunk_id"] for r in again.collect()} == set(range(80, 90))
    assert clusters.assign(df.limit(0), ["chunk_id"]).count() == 0


def test_claims_of_old_ids_in_turn(spark):
    rng = np.random.default_rng(9)
    rows = [(i, int(rng.integers(0, 14)), f"c{rng.integers(0, 12)}") for i in range(300)]
    groups = spark.createDataFrame([(i, g) for i, g, _ in rows], "chunk_id long, label int")
    old = spark.createDataFrame([(i, c) for i, _, c in rows], "chunk_id long, cluster_id string")
    members = {g: [(i, c) for i, h, c in rows if h == g] for g in {g for _, g, _ in rows}}
    free, want = {c for _, _, c in rows}, {}
    for g in sorted(members, key=lambda g: (-len(members[g]), min(i for i, _ in members[g]))):
        counts = {c: sum(x == c for _, x in members[g]) for c in free & {c for _, c in members[g]}}
        best = max(counts, key=lambda c: (counts[c], c), default=None)
        want[g] = best or f"new-{min(i for i, _ in members[g])}"
        free.discard(best)
    assert {r["label"]: r["cluster_id"] for r in clusters.stable_ids(groups, old).collect()} == want


def test_nearest_neighbours_in_blocks(spark):
    from lodestone.functions import vectors

    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(80, 5)))] + [(80, None)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    whole = sorted(map(str, vectors.nearest_neighbours(df, 4).collect()))
    assert sorted(map(str, vectors.nearest_neighbours(df, 4, block_bytes=700).collect())) == whole and len(whole) == 320
    some = vectors.nearest_neighbours(df, 4, of=df.where("id < 3").select("id"))
    assert sorted(map(str, some.collect())) == [r for r in whole if r.startswith(("Row(id=0,", "Row(id=1,", "Row(id=2,"))]
    left, right = df.where("id < 50").select("id", F.col("embedding").alias("v")), df.where("id between 50 and 79").select(F.col("id").cast("string").alias("id"), F.col("embedding").alias("v"))
    assert sorted(map(str, vectors.nearest_of(left, right).collect())) == sorted(map(str, vectors.nearest_of(left, right, 500).collect()))


def test_times_are_swept_as_all_pairs_would_be(spark):
    rng = np.random.default_rng(7)
    start = datetime.datetime(2024, 1, 1)
    rows = [(int(e), start + datetime.timedelta(seconds=int(s))) for e, s in zip(rng.integers(0, 30, 500), rng.integers(0, 400, 500), strict=True)]
    df = spark.createDataFrame(rows, "entity_id long, event_time timestamp")
    for window, k in ((3, 2), (50, 6), (10**6, 4)):
        near = {}
        for a, t in set(rows):
            for b, u in set(rows):
                d = abs((t - u).total_seconds())
                if a != b and d <= window:
                    near[a, b] = min(near.get((a, b), d), d)
        want = {(a, b, d) for a in range(30) for d, b in sorted((d, b) for (x, b), d in near.items() if x == a)[:k]}
        found = edges.temporal_pairs(df.repartition(5), window, k).collect()
        assert {(r["id"], r["neighbour"], r["delta_secs"]) for r in found} == want
    assert edges.temporal_pairs(df.limit(0), 5).count() == 0


def test_edges_are_added_for_some_entities(spark):
    rng = np.random.default_rng(8)
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(40, 3)))], "entity_id long, embedding array<float>")
    whole = edges.similar(vectors)
    first = edges.similar(vectors.where("entity_id < 30"))
    grown = edges.similar_added(first, vectors, vectors.where("entity_id >= 30").select("entity_id"))
    pairs = lambda df: {(r["src_id"], r["dst_id"]) for r in df.collect()}
    assert pairs(first) <= pairs(grown) and {p for p in pairs(whole) if max(p) >= 30 and p not in pairs(grown)} == {p for p in pairs(whole) if max(p) >= 30} - pairs(grown)
    asked = edges.similar(vectors, of=vectors.where("entity_id >= 30").select(F.col("entity_id").alias("id")))
    assert pairs(grown) == pairs(first) | pairs(asked)
    again = edges.similar_added(grown, vectors, vectors.select("entity_id"))
    assert pairs(whole) <= pairs(again) and again.count() == again.select("src_id", "dst_id", "rel").distinct().count()


def test_self_collected_clusters(spark):
    members = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "cluster_id string, chunk_id long")
    chunks = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "chunk_id long, document_id string")
    docs = spark.createDataFrame([("x", '{"collected": 1}'), ("y", None)], "document_id string, meta string")
    assert {r["cluster_id"]: r["collected"] for r in clusters.self_collected(members, chunks, docs).collect()} == {"a": True, "b": False}


HITS = "chunk_id long, document_id string, text string, title string, score double, semantic boolean, keyword boolean, distance double"


@pytest.mark.parametrize(
    ("rows", "kept"),
    [([(1, 0.40, False), (2, 0.54, False), (3, 0.6, False)], [1, 2]), ([(1, 0.46, False), (2, 0.5, False)], []), ([(1, 0.9, True), (2, 0.5, False), (3, 0.8, False)], [1, 2]), ([(1, None, True)], [1]), ([], [])],
)
def test_only_what_is_on_topic_is_cited(spark, rows, kept):
    df = spark.createDataFrame([(i, "d", "t", None, 1.0 / i, d is not None, k, d) for i, d, k in rows], HITS)
    assert sorted(r["chunk_id"] for r in search.on_topic(df).collect()) == kept


def test_answers_keep_citations_that_resolve(spark):
    df = spark.createDataFrame([(1, "d", "first " * 100, "T", 0.9, True, True, 0.1), (2, "d", "second", None, 0.8, True, True, 0.2)], HITS)
    asked = []
    found = search.ask("why?", df, lambda p: asked.append(p) or "Because [C2]. Also [C7] and [c2].")
    assert [(c["marker"], c["chunk_id"]) for c in found["citations"]] == [("C2", 2)] and found["context_used"] == 2
    assert "[C1] T: first" in asked[0] and "[C2] untitled: second" in asked[0]
    assert search.ask("why?", df.limit(0), lambda p: "x") == {"answer": search.NO_EVIDENCE, "citations": [], "context_used": 0}


def test_search_modes(spark):
    from lodestone.functions import fts

    chunks = spark.createDataFrame([(1, "red apples"), (2, "green apples and pears"), (3, "blue sky")], "chunk_id long, text string")
    index = fts.postings(chunks)
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1])], "chunk_id long, embedding array<float>")
    embed = lambda t: [1.0, 0.0]
    assert search.search("  ", "hybrid", 5, vectors, index, embed) is None
    both = {r["chunk_id"]: r for r in search.search("apples", "nonsense", 5, vectors, index, embed).collect()}
    assert both[1]["score"] == pytest.approx(2 / 61) and both[1]["semantic"] and both[1]["keyword"] and not both[3]["keyword"]
    assert [r["chunk_id"] for r in search.search("apples", "vector", 2, vectors, index, embed).collect()] == [1, 3]
    assert {r["chunk_id"] for r in search.search("apples", "vector", 2, None, index).collect()} == {1, 2}
    assert (search.pool_size(1), search.pool_size(20), search.pool_size(100)) == (10, 80, 200)


def test_insights(spark):
    chunks = [{"chunk_id": i, "title": f"T{i}", "text": "x" * 2000} for i in range(3)]
    made = insights.synthesize(chunks, [("ip", "1.2.3.4")], False)
    assert made["severity"] == "info" and made["evidence"] == [0, 1, 2]
    replies = iter(["no json", 'so: {"title": " t ", "narrative": "x [E9]", "severity": "critical", "confidence": 7}'])
    made = insights.synthesize(chunks, [("CVE", "CVE-2024-1")], True, lambda p, s: next(replies))
    assert (made["title"], made["severity"], made["confidence"], made["evidence"]) == ("t", "critical", 1.0, [0])
    for bad in (["x", "y"], ["}{", "}"]):
        with pytest.raises(ValueError):
            insights.generate_object(lambda p, s, it=iter(bad): next(it), "p", "s")
    assert insights.cited("[E1] [e3] [E9]", 3) == [1, 3]
    when = [datetime.datetime(2024, 1, d) for d in (1, 2, 3)]
    rows = [("a", "c1", "info", "new", "h1", when[0]), ("b", "c1", "high", "dismissed", "h2", when[1]), ("d", "c2", "high", "superseded", "h3", when[2]), ("e", "c2", "low", "useful", "h4", when[0])]
    df = spark.createDataFrame(rows, "insight_id string, cluster_id string, severity string, status string, input_hash string, created_at timestamp")
    assert [r["insight_id"] for r in insights.listed(df).collect()] == ["d", "b", "e", "a"]
    assert {r["cluster_id"]: r["live_hash"] for r in insights.live_hashes(df).collect()} == {"c1": "h2", "c2": "h4"}
    signature = spark.createDataFrame([("c1", "h2"), ("c2", "h9"), ("c3", "h0")], "cluster_id string, input_hash string")
    assert {r["cluster_id"] for r in insights.stale(signature, df).collect()} == {"c2", "c3"}
    after = insights.superseded(df, spark.createDataFrame([("c1",)], "cluster_id string"))
    assert {r["insight_id"]: r["status"] for r in after.collect()} == {"a": "superseded", "b": "dismissed", "d": "superseded", "e": "useful"}
    assert insights.feedback(df, F.lit("a"), "useful").where("status = 'useful'").count() == 2
    with pytest.raises(ValueError):
        insights.feedback(df, F.lit("a"), "new")


def test_entities(spark):
    rows = [("ip", "1.2.3.4", "1.2.3.4", 2), ("ip", "1.2.3.4", "1[.]2.3.4", 1), ("email", "A_b@x.org", "A_b@x.org", 1)]
    found = entities.rollup(spark.createDataFrame(rows, "kind string, value string, raw_surface string, at long"), ["at"])
    assert {r["value"]: (r["display_value"], r["mention_count"]) for r in found.collect()} == {"1.2.3.4": ("1[.]2.3.4", 2), "A_b@x.org": ("A_b@x.org", 1)}
    assert entities.lookup(found, "a_B@X.ORG").count() == 1
    assert [r["value"] for r in entities.listed(found, text="a%b").collect()] == ["A_b@x.org"]
    mentions = spark.createDataFrame([("ip", "1.2.3.4")], "kind string, value string").select(entity_id(F.col("kind"), F.col("value")).alias("entity_id"))
    assert {r["mention_count"] for r in entities.recounted(found, mentions).collect()} == {0, 1}


CORPUS = [
    "Campaign one beaconed to 198.51.100.7 via AS64511 on 2024-03-01.", "The kit at 198.51.100.7 used CVE-2024-1111.", "AS64511 also hosts 203.0.113.5, seen 2024-03-02.", "203.0.113.5 mailed from ops@evil-corp.net using CVE-2024-2222.",
    "Unrelated prose without any indicator at all.", "Campaign one beaconed to 198.51.100.7 via AS64511 on 2024-03-01.", "", "a,b\n1,192.0.2.1\n2,192.0.2.2",
]


def test_centroids_on_the_driver_and_in_tables_assign_alike(spark, monkeypatch):
    import numpy as np

    from lodestone.functions import vectors

    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(size=4)]) for i in range(160)]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    read = []
    monkeypatch.setattr(clusters, "nearest_of", lambda a, b: read.append(1) or vectors.nearest_of(a, b, 2**26))
    found = {}
    for room in (vectors.BLOCK_BYTES, 600, 1):  # centroids stay with the driver, leave it after some batches, or after the first one
        monkeypatch.setattr(vectors, "BLOCK_BYTES", room)
        read.clear()
        made = {r["chunk_id"]: (r["cluster_id"], round(r["similarity"], 9)) for r in clusters.assign(df, ["chunk_id"], batch=40).collect()}
        found[room] = made, len(read)
    (held, none), (_, some), (_, most) = found.values()
    assert none == 0 and most == 3 and some >= 1 and all(made == held for made, _ in found.values())
    known = spark.createDataFrame([("old", rows[0][1], 3)], "cluster_id string, centroid array<double>, size long")
    assert clusters.assign(df.where("chunk_id = 0"), ["chunk_id"], known).first()["cluster_id"] == "old"


def test_documents_are_taken_apart_once_where_tables_are_kept(spark):
    from lodestone.session import kept
    from lodestone.sources import ingest
    from lodestone.streaming import knowledge

    items = ingest.admit(spark.createDataFrame([(1, bytearray(b"mail a@example.com")), (2, bytearray(b"# Head\n\nwords"))], "item long, raw binary"))
    names = []
    made = knowledge.process(items, lambda df, name: names.append(name) or kept(df, name))
    assert names == ["normalized"] and "MapInPandas" not in made["chunks"]._jdf.queryExecution().toString()
    assert made["documents"].count() == made["chunks"].count() == 2 and made["mentions"].count() == 2


def test_streams_make_what_batches_make(spark, tmp_path):
    items = spark.createDataFrame([(i, bytearray(t.encode())) for i, t in enumerate(CORPUS)], "item long, raw binary")
    batch = knowledge.process(admit(items))
    for i in range(len(CORPUS)):
        items.where(F.col("item") == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 3).parquet(f"{tmp_path}/in")
    knowledge.stream(source, f"file://{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    stream = knowledge.tables(spark, f"file://{tmp_path}/out")
    for name, columns in {"documents": ["document_id", "label", "status", "event_time"], "chunks": ["document_id", "seq", "text"], "mentions": ["entity_id", "chunk_id", "kind", "value"]}.items():
        assert sorted(map(str, stream[name].select(*columns).collect())) == sorted(map(str, batch[name].select(*columns).collect())), name
    a, b = knowledge.graph(stream["mentions"]), knowledge.graph(batch["mentions"])
    assert sorted(map(str, a["edges"].collect())) == sorted(map(str, b["edges"].collect()))
    assert {r["kind"]: r["n"] for r in b["entities"].groupBy("kind").agg(F.count("*").alias("n")).collect()} == {"ip": 4, "asn": 1, "cve": 2, "email": 1, "domain": 1}
    assert batch["documents"].where("event_time is not null").count() == 2


ODD_TEXTS = [
    "plain words", "", "Auge\nAugen\nund", "{\"a\": 1", "[1, 2]\n[3, 4]", "<html><body>x</body></html>", "BM", "%PDF is a format", "a, b\n- c, d\n", "# Head\nwords", 'a,"b\nc,d' + "e" * 140_000, "a,b\rc\nd,e",
]


def test_streamed_documents_are_those_of_the_statement(spark, tmp_path):
    import duckdb

    from lodestone.plans import registry

    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)]
    # items that repeat, alone or with their number, and the same texts under other numbers
    spark.createDataFrame(rows + rows[:4] * 3 + [(100 + i, t) for i, t in rows], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["stream_equivalence"](spark, str(tmp_path)).collect()
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    db.execute("create view pages as select 0 as page_id, '' as html where false")
    db.execute("create view events as select 0 as event_id, '' as props where false")
    cursor = db.execute(registry.oracle_sql()["stream_equivalence"])
    assert [c[0] for c in cursor.description] == ["content_hash", "label", "status"]
    assert sorted(map(tuple, got)) == sorted(cursor.fetchall())


def test_of_items_that_repeat_one_is_accepted(spark):
    items = spark.createDataFrame([(1, bytearray(b"a")), (1, bytearray(b"a")), (2, bytearray(b"a")), (3, bytearray(b"")), (3, None)], "item long, raw binary")
    assert sorted(r["outcome"] for r in admit(items).collect()) == ["accepted", "deduped", "deduped", "failed", "failed"]
    assert sorted(r["outcome"] for r in admit(items, empty=True).collect()) == ["accepted", "accepted", "deduped", "deduped", "failed"]
    assert knowledge.process(admit(items))["documents"].count() == 1


def test_core_queries_match_their_sql(spark):
    import duckdb

    from lodestone.plans import registry

    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        db.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    wrong = []
    statements = registry.oracle_sql()
    for name, query in registry.queries().items():
        if name not in statements:
            continue
        rows = query(spark, folder)
        cursor = db.execute(statements[name])
        names = [c[0] for c in cursor.description]
        columns = sorted(names)
        place = [names.index(c) for c in columns]
        plain = lambda v: f"{v:.5f}" if isinstance(v, float) else str(v)
        want = sorted(tuple(plain(r[i]) for i in place) for r in cursor.fetchall())
        got = sorted(tuple(plain(v) for v in r) for r in rows.select(*columns).collect())
        if sorted(rows.columns) != columns or got != want:
            wrong.append(name)
    assert wrong == []


def test_the_entry_point_stands_without_the_optional_parts(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parents[1]
    shutil.copytree(top / "lodestone", tmp_path / "lodestone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'graph_edges' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, timeout=60).returncode == 0
