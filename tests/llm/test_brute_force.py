"""Shards and toxicity scores against plain Python that follows the definitions."""

import math
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import registry, sharding, toxicity


def spark_hash(*values):
    """Spark's xxhash64: every value is hashed with the hash before it as the seed; ints have four bytes, longs eight."""
    seed = 42
    for kind, value in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<i" if kind == "int" else "<q", value), seed)
    return seed - 2**64 if seed >= 2**63 else seed


def brute_place(x, n, key):
    a = max(1, math.isqrt(n))
    b = -(-n // a)
    while True:
        left, right = divmod(x, b)
        for number in range(6):
            if number % 2 == 0:
                left = (left + spark_hash(("long", right), ("int", number), ("long", key)) % a) % a
            else:
                right = (right + spark_hash(("long", left), ("int", number), ("long", key)) % b) % b
        x = left * b + right
        if x < n:
            return x


def test_shards_of_the_small_table(spark, small):
    found = registry.queries()["op3_shard"](spark, small)
    rows = found.select("doc_id", "size", "text_crc32", "shard", "slot", F.xxhash64("doc_id", "size", "text_crc32").alias("h")).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    order = sorted(rows, key=lambda r: (r["h"] % sharding.BUCKETS, r["h"], r["doc_id"]))
    for number, r in enumerate(order):
        place = brute_place(number, len(rows), 20_261_126)
        assert (r["shard"], r["slot"]) == (place % 8, place // 8)
        assert r["size"] == len((docs[r["doc_id"]] or "").encode()) + 1
    assert Counter(r["doc_id"] for r in rows) == Counter(list(docs))


def test_very_long_and_equal_rows_are_sharded(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("doc_id"), F.repeat(F.lit("long "), 20_000).alias("text"))
    found = sharding.shard_rows(df, 8).collect()
    assert sorted((r["shard"], r["slot"]) for r in found) == sorted((p % 8, p // 8) for p in range(500))


def brute_scores(texts, labels, curve):
    """Scores of the definition: counts of five characters by class, continuation counts over all texts, discount and shared backoff."""
    order, discount, prior = toxicity.ORDER, toxicity.DISCOUNT, toxicity.PRIOR

    def grams(word):
        marked = "\x02" * (order - 1) + word + "\x03"
        return [marked[i : i + order] for i in range(len(marked) - order + 1)]

    def words(text):
        return [w for w in (t.strip(toxicity.EDGE) for t in (text or "").lower().split()) if w]

    counts = [Counter(g for d, c in labels.items() if c == k for w in words(texts[d]) for g in grams(w)) for k in (0, 1)]
    kinds = {g for t in texts.values() for w in words(t) for g in grams(w)}
    before = defaultdict(set)  # the characters found before each shorter sequence
    for g in kinds:
        for size in range(1, order):
            before[g[order - size :]].add(g[order - size - 1])
    model = set(counts[0]) | set(counts[1])

    def low(s):
        if not s:
            return 1e-3
        rest = low(s[1:])
        follow = {t: len(b) for t, b in before.items() if len(t) == len(s) and t[:-1] == s[:-1]}
        total = sum(follow.values())
        return rest if not total else (max(follow.get(s, 0) - discount, 0) + discount * len(follow) * rest) / total

    def probability(k, s):
        own = {g: n for g, n in counts[k].items() if g[:-1] == s[:-1]}
        total = sum(own.values())
        return max(own.get(s, 0) - discount, 0) / (total + prior) + (discount * len(own) + prior) / (total + prior) * low(s[1:])

    memory = {}

    def ratio(g):
        if g not in memory:
            if g in model:
                memory[g] = math.log(probability(1, g) / probability(0, g))
            else:
                weights = [(discount * len(own) + prior) / (sum(own.values()) + prior) for own in ({h: n for h, n in counts[k].items() if h[:-1] == g[:-1]} for k in (0, 1))]
                memory[g] = math.log(weights[1] / weights[0])
        return memory[g]

    def score(text):
        parts = [(sum(ratio(g) for g in grams(w)), len(w) + 1) for w in words(text)]
        whole = sum(r for r, _ in parts) / sum(n for _, n in parts) if parts else 0.0
        most = max((r / n for r, n in parts), default=0.0)
        return 1 / (1 + math.exp(-(curve[0] * whole + curve[1] * most + curve[2])))

    return {d: score(t) for d, t in texts.items()}


def test_scores_are_those_of_the_definition(spark):
    ordinary, vile = "the sun is on a fine old hill and all is well".split(), "you vile scum are a rotten fool".split()
    texts = {i: " ".join((ordinary if i % 3 else vile + ordinary)[(i * 7) % 5 :]) + f" word{i}!" for i in range(60)}
    texts |= {100: None, 101: "", 102: "unseen words of another kind", 103: "scumbag, foolish?"}
    labels = {i: int(i % 3 == 0) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    used = {i: c for i, c in labels.items() if zlib.crc32(str(i).encode()) % 5}
    found = {r["doc_id"]: r["toxicity"] for r in toxicity.add_scores(docs, model).collect()}
    want = brute_scores(texts, used, model.curve)
    assert found == {d: pytest.approx(s, abs=1e-9) for d, s in want.items()}
    assert found[103] > found[102]
