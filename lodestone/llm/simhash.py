"""SimHash near-duplicates by the general pigeonhole principle.

Fingerprints have 64 bits, one majority vote per bit over the XXH64 hashes of
word shingles.  Distinct fingerprints within ``radius`` bits are linked:

1. bits that vary together (measured over all fingerprints) go into the same of
   ``parts`` groups, so that a skewed pattern spoils one group and not all;
2. if the thresholds t of the groups sum to radius - parts + 1, two fingerprints
   within the radius differ in at most t bits of some group; for each
   fingerprint a dynamic programme takes the thresholds of least estimated cost
   (candidates by per-group distance histograms over all fingerprints, plus the
   keys to probe); -1 leaves a group out;
3. each fingerprint probes the keys within t bits of its own in every group, and
   what meets there is verified over all 64 bits.

A key that more than ``heavy`` fingerprints share would give all their pairs.
Its fingerprints take another exact way: two of them are within two bits if and
only if they share a midpoint within one bit of both, and a midpoint has at most
65 distinct fingerprints, so each is linked to the least one at its midpoints.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import combinations
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import bits_between, give_back, materialize, slices, with_columns
from lodestone.llm.components import connected_components

BITS = 64
#: Groups of bits, and fingerprints that may share a key before its midpoints are used.
PARTS, HEAVY = 3, 64
#: Cost of probing one key, in candidates verified.
PROBE_COST = 2.0
BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of a text: A-Z lowered, shingles with repeats; fewer words are one shingle, no words give 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - k + 1].tolist()
    stops = (ends[k - 1 :] - 1).tolist()
    digest, votes = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for lo in range(0, len(starts), BLOCK):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[lo : lo + BLOCK], stops[lo : lo + BLOCK], strict=True)], "<u8")
        votes += np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(starts), bitorder="little").view("<u8")[0])


def add_fingerprints(df: DataFrame, text_col: str = "text", name: str = "simhash", shingle: int = 3) -> DataFrame:
    """Add the fingerprint as a signed long; null and empty texts have 0."""

    def run(texts: pa.Array) -> Iterator[pa.Array]:
        yield pa.array(np.array([fingerprint(t, shingle) for t in texts.to_pylist()], "u8").view("i8"))

    return with_columns(df, [text_col], {name: "long"}, run)


def _words(part: pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    """Fingerprints of a batch as rows of unsigned words."""
    return np.column_stack([part.column(c).to_numpy().view("u8") for c in names]) if part.num_rows else np.zeros((0, len(names)), "u8")


def _bits(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words, "<u8").view("u1").reshape(len(words), -1), axis=1, bitorder="little")


def together(prints: DataFrame, names: tuple[str, ...] = ("fp",)) -> tuple[int, np.ndarray]:
    """The number of fingerprints and, for every two bits, how many have both; bits squared sums whatever the input."""
    size = BITS * len(names)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((size, size), np.int64), 0
        for part in parts:
            bits = _bits(_words(part, names)).astype(np.float32)
            total += np.rint(bits.T @ bits).astype(np.int64)
            seen += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(range(size * size + 1), pa.int32()), pa.array([*total.ravel().tolist(), seen])], names=["at", "n"])

    sums = prints.select(*names).mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
    flat = np.zeros(size * size + 1, np.int64)
    for at, n in sums.collect():
        flat[at] = n
    return int(flat[-1]), flat[:-1].reshape(size, size)


def group_bits(n: int, both: np.ndarray, parts: int = PARTS) -> list[list[int]]:
    """Bits in groups of near-equal size, the most correlated ones in the same group."""
    if not n:
        return [list(range(i, len(both), parts)) for i in range(parts)]
    share = np.diag(both) / n
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    alike = np.abs(both / n - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(alike, 0)
    free, groups = set(range(len(both))), []
    for k in range(parts):
        size = -(-len(free) // (parts - k))
        order = sorted(free)
        group = [max(order, key=lambda b: (alike[b, order].sum(), -b))]
        free.discard(group[0])
        while len(group) < size:
            best = max(sorted(free), key=lambda b: (alike[b, group].sum(), -b))
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def _pieces(group: list[int]) -> list[list[int]]:
    """Parts of a group of at most 8 bits, whose histograms together estimate the group's."""
    n = -(-len(group) // 8)
    return [group[i::n] for i in range(n)]


def _project(words: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(words), "u8")
    for i, b in enumerate(bits):
        out |= (words[:, b // BITS] >> np.uint64(b % BITS) & np.uint64(1)) << np.uint64(i)
    return out


def histograms(prints: DataFrame, groups: list[list[int]], radius: int, names: tuple[str, ...] = ("fp",)) -> list[list[np.ndarray]]:
    """Per group and piece: for each piece value, the share of fingerprints at distance 0..radius from it."""
    pieces = [p for g in groups for p in _pieces(g)]

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(1 << len(p), np.int64) for p in pieces]
        for part in parts:
            words = _words(part, names)
            for total, p in zip(totals, pieces, strict=True):
                total += np.bincount(_project(words, p).astype(np.int64), minlength=len(total))
        flat = np.concatenate(totals)
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype("i4")), pa.array(flat[at])], names=["at", "n"])

    flat = np.zeros(sum(1 << len(p) for p in pieces), np.float64)
    for at, n in prints.select(*names).mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        flat[at] = n
    found, at = [], 0
    for p in pieces:
        counts = flat[at : at + (1 << len(p))]
        at += 1 << len(p)
        values = np.arange(1 << len(p), dtype="u8")
        apart = np.bitwise_count(values[:, None] ^ values[None, :])
        found.append(np.stack([(apart == d) @ counts for d in range(radius + 1)], axis=1) / max(counts.sum(), 1))
    out, k = [], 0
    for g in groups:
        out.append(found[k : k + len(_pieces(g))])
        k += len(_pieces(g))
    return out


def allocate(words: np.ndarray, n: int, groups: list[list[int]], shares: list[list[np.ndarray]], radius: int, total: int | None = None) -> np.ndarray:
    """Thresholds (rows x groups, from -1 to ``radius``) of least estimated cost; plus one each they sum to ``total``.

    By default that is radius + 1, so that thresholds sum to radius - groups + 1.
    """
    rows, top = len(words), radius + 1 if total is None else total
    cost = np.full((len(groups), top + 1, rows), np.inf)
    cost[:, 0] = 0
    for g, group in enumerate(groups):
        near = np.zeros((radius + 1, rows))
        near[0] = 1
        for piece, share in zip(_pieces(group), shares[g], strict=True):
            own = share[_project(words, piece).astype(np.int64)].T
            near = np.stack([sum(near[i] * own[d - i] for i in range(d + 1)) for d in range(radius + 1)])
        ball, size = 0, 1
        for t in range(radius + 1):
            ball += size
            size = size * (len(group) - t) // (t + 1)
            if t + 1 <= top:
                cost[g, t + 1] = n * near[: t + 1].sum(axis=0) + PROBE_COST * ball
    best = np.full((len(groups) + 1, top + 1, rows), np.inf)
    best[0, 0] = 0
    took = np.zeros((len(groups), top + 1, rows), np.int8)
    for g in range(len(groups)):
        for s in range(top + 1):
            for u in range(min(s, radius + 1) + 1):
                c = best[g, s - u] + cost[g, u]
                better = c < best[g + 1, s]
                best[g + 1, s] = np.where(better, c, best[g + 1, s])
                took[g, s] = np.where(better, u, took[g, s])
    out, left = np.zeros((rows, len(groups)), np.int8), np.full(rows, top)
    for g in range(len(groups) - 1, -1, -1):
        out[:, g] = took[g, left, np.arange(rows)]
        left = left - out[:, g]
    return out - 1


def _keys(prints: DataFrame, groups: list[list[int]], n: int, shares: list[list[np.ndarray]], radius: int) -> tuple[DataFrame, DataFrame]:
    """Rows (k, fp, rep): the key of every fingerprint in every group, and the keys that it probes."""
    flips = [[np.uint64(sum(1 << i for i in c)) for t in range(radius + 1) for c in combinations(range(len(g)), t)] for g in groups]
    within = [[sum(1 for m in f if int(m).bit_count() <= t) for t in range(radius + 1)] for f in flips]

    def rows(k: np.ndarray, g: int, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array((k | np.uint64(g << 40)).view("i8")), pa.array(fp), pa.array(rep)], names=["k", "fp", "rep"])

    def own(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            fp, rep = part.column(0).to_numpy(), part.column(1).to_numpy()
            for g, group in enumerate(groups):
                yield rows(_project(fp.view("u8")[:, None], group), g, fp, rep)

    def probe(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            fp, rep = part.column(0).to_numpy(), part.column(1).to_numpy()
            chosen = allocate(fp.view("u8")[:, None], n, groups, shares, radius)
            for g, group in enumerate(groups):
                key = _project(fp.view("u8")[:, None], group)
                for t in range(radius + 1):
                    at = np.flatnonzero(chosen[:, g] == t)
                    for mask in flips[g][: within[g][t]] if len(at) else []:
                        yield rows(key[at] ^ mask, g, fp[at], rep[at])

    pair = prints.select("fp", "rep")
    return pair.mapInArrow(own, "k long, fp long, rep long"), pair.mapInArrow(probe, "k long, fp long, rep long")


def links(prints: DataFrame, radius: int = 2, parts: int = PARTS, heavy: int = HEAVY) -> DataFrame:
    """Links (a, b: reps) among distinct fingerprints (fp, rep) within ``radius`` bits, at most 2.

    All links outside heavy keys; within heavy keys enough of them to keep
    everything connected that is.  ``prints`` should be materialized.
    """
    if radius > 2:
        raise ValueError("midpoints settle heavy keys up to two bits only")
    n, both = together(prints)
    groups = group_bits(n, both, parts)
    own, probe = _keys(prints, groups, n, histograms(prints, groups, radius), radius)
    crowded = materialize(own.groupBy("k").count().where(F.col("count") > heavy).select("k"), "crowded")
    hot = crowded.limit(1).count() > 0
    if hot:
        midpoints = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
        dense = own.unionAll(probe).join(crowded, "k", "left_semi").select("fp", "rep").distinct()
        balls = dense.select("rep", F.explode(midpoints).alias("mid"))
        stars = balls.withColumn("a", F.min("rep").over(Window.partitionBy("mid"))).where("a <> rep").select("a", F.col("rep").alias("b")).distinct()
        own, probe = own.join(crowded, "k", "left_anti"), probe.join(crowded, "k", "left_anti")
    left, right = own.alias("o"), probe.select("k", F.col("fp").alias("pf"), F.col("rep").alias("pr")).alias("p")
    met = left.join(right, (F.col("o.k") == F.col("p.k")) & (F.col("o.fp") != F.col("p.pf")) & (bits_between(F.col("o.fp"), F.col("p.pf")) <= radius))
    found = met.select(F.least("rep", "pr").alias("a"), F.greatest("rep", "pr").alias("b")).distinct()
    return found.unionAll(stars).distinct() if hot else found


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = 3) -> DataFrame:
    """doc_id, simhash (signed long), component_id: the smallest id reachable over links of at most ``radius`` bits.

    Null and empty texts have fingerprint 0 and are linked like any other;
    repeated rows stay; a null id has the component of its fingerprint.  The
    texts are read once and not shuffled; what moves are fingerprints.
    """
    marked = add_fingerprints(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__text")), "__text", "simhash", shingle).select("doc_id", "simhash")
    marked = materialize(marked, "fingerprints")
    prints = materialize(marked.groupBy(F.col("simhash").alias("fp")).agg(F.min("doc_id").alias("rep")).where("rep is not null"), "distinct")
    found = materialize(links(prints, radius), "near")
    component = connected_components(found)
    by_print = prints.join(component, prints["rep"] == component["node"], "left").select(F.col("fp").alias("simhash"), F.coalesce("component", "rep").alias("component_id"))
    return marked.join(by_print, "simhash", "left").select("doc_id", "simhash", "component_id")


# similar texts

#: Words in a shingle; least hashes of them in a sketch; rounds of comparisons with the middle of a group before the rest is compared.
SHINGLE, SKETCH, ROUNDS = 5, 256, 2
#: Texts up to which the ids of those that are compared (8 bytes each) are broadcast.
BROADCAST_ROWS = 1_000_000
#: First size of each class of sets; a class ends at 1.25 times that, so sets alike by 0.8 are in one class or in neighbours.
STARTS = [1]
while STARTS[-1] < 2**40:
    STARTS.append(STARTS[-1] * 5 // 4 + 1)
GOLDEN = 0x9E3779B97F4A7C15


def wide_fingerprint(text: str | None, shingle: int = SHINGLE) -> tuple[int, int, int, bytes]:
    """128 bits as two words, one vote per distinct shingle; the number of those; the least 32-bit hashes of them, in order."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0, 0, 0, b""
    k = min(shingle, len(words))
    digest = xxhash.xxh3_128_digest
    found = np.frombuffer(b"".join({digest(b" ".join(words[i : i + k])) for i in range(len(words) - k + 1)}), "u1").reshape(-1, 16)
    votes = np.zeros(2 * BITS, np.int64)
    for lo in range(0, len(found), BLOCK):
        votes += np.unpackbits(found[lo : lo + BLOCK], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    lo, hi = np.packbits(2 * votes > len(found), bitorder="little").view("<u8").tolist()
    return lo, hi, len(found), np.unique(np.ascontiguousarray(found[:, :4]).view("<u4"))[:SKETCH].tobytes()


def similarity(a: bytes, b: bytes, n_a: int, n_b: int) -> float:
    """Of two texts' shingles: exact if both sketches are whole, else estimated from the least hashes of the union."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    union = np.union1d(x, y)
    if max(n_a, n_b) > SKETCH:
        union = union[:SKETCH]
    if not len(union):
        return 1.0
    return float(np.searchsorted(np.intersect1d(x, y, assume_unique=True), union[-1], "right") / len(union))


def shingles(text: str | None) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles, in order; fewer words are one shingle, no words none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, "u8")
    k, digest = min(SHINGLE, len(words)), xxhash.xxh3_64_intdigest
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - k + 1].tolist()
    stops = (ends[k - 1 :] - 1).tolist()
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts, stops, strict=True)], "u8"))


def _digest(found: np.ndarray) -> int:
    return _signed(xxhash.xxh3_64_intdigest(found.tobytes())) if len(found) else 0


def _signed(n: int) -> int:
    return n - 2**64 if n >= 2**63 else n


def size_class(n: int) -> int:
    return bisect_right(STARTS, n) - 1


def _part(found: np.ndarray, of: int, level: int) -> np.ndarray:
    """The part of each hash; parts are ranges of hashes, for class ``of`` somewhat more than 2/9 of its largest size, doubled ``level`` times."""
    top = STARTS[of] * 5 // 4
    parts = 2 * top // 9 + 1 + isqrt(top) << level
    if parts >= 2**32:
        raise ValueError("hashes too alike to be told apart by parts")
    return (found >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


def level_of(found: np.ndarray) -> int:
    """The least level at which more than 2/9 as many parts as hashes have any."""
    level, of = 0, size_class(len(found))
    while 9 * (1 + np.count_nonzero(np.diff(_part(found, of, level)))) <= 2 * len(found):
        level += 1
    return level


def part_keys(found: np.ndarray, of: int, level: int) -> np.ndarray:
    """A hash of the hashes in each part that has any."""
    part = _part(found, of, level)
    return np.add.reduceat(found, np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))) + np.uint64(of * GOLDEN % 2**64)


def spare_keys(keys: int, n: int, of: int) -> int:
    """How many more keys than one of class ``of`` a set of n hashes shares, at least, with any that is alike; sizes of the class end at 1.25 times its first."""
    largest = min(5 * n // 4, max(STARTS[of] * 5 // 4, n))
    return max(keys - (n + largest) // 9 - 1, 0)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets in order have 0.8 of their union in common."""
    common = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
    return 9 * common >= 4 * (len(a) + len(b))


def _keyed(texts: DataFrame, levels: dict[int, int]) -> DataFrame:
    """Rows (k, digest, n): the keys of every set in its own class and, as the smaller one of a pair, in the next.

    Above the 32 bits of its size, n has a bit for the class and how many more keys
    than one a set shares with any that is alike: of its parts, at most as many differ as hashes are in one of the two only.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of one task: copies give their keys once
        for part in (x for whole in parts for x in slices(whole)):
            keys, digests, sizes = [], [], []
            for text in part.column(0).to_pylist():
                found = shingles(text)
                digest = _digest(found)
                if not len(found) or digest in seen:
                    continue
                seen.add(digest)
                own = size_class(len(found))
                for of in (own, own + 1):
                    if of in levels:
                        keys.append(part_keys(found, of, levels[of]))
                        digests.append(np.full(len(keys[-1]), digest, np.int64))
                        sizes.append(np.full(len(keys[-1]), len(found) | (of - own) << 32 | spare_keys(len(keys[-1]), len(found), of) << 33, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view("i8")), pa.array(np.concatenate(digests)), pa.array(np.concatenate(sizes))], names=["k", "digest", "n"])
        give_back()

    return texts.select("text").mapInArrow(run, "k long, digest long, n long")


def parity(found: np.ndarray) -> bytes:
    """A bit for each of at least four times as many places as hashes: whether an odd number of them falls there."""
    bits = 1 << max(6, (4 * len(found) - 1).bit_length())
    return np.packbits(np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """At most the number of hashes that are in one of two sets only, by their parities."""
    x, y = np.frombuffer(a, "u8"), np.frombuffer(b, "u8")
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _shared(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (k, digest, n) sorted by key and digest: every set of a key that several share, with the key's first; the first with itself."""
    held = np.zeros((0, 3), np.int64)  # the first row of the last key, and its last
    for part in parts:
        rows = np.concatenate([held, np.column_stack([c.to_numpy().astype(np.int64) for c in part.columns])])
        if not len(rows):
            continue
        key, digest = rows[:, 0], rows[:, 1]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(rows)), 0))
        other = np.flatnonzero(~fresh & (digest != np.concatenate([digest[:1], digest[:-1]])))
        other = other[other >= len(held)]
        second = other[digest[other - 1] == digest[start[other]]]
        at, first = np.concatenate([other, start[second]]), np.concatenate([start[other], start[second]])
        columns = [key[at], digest[first], rows[first, 2], digest[at], rows[at, 2]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["k", "a", "n_a", "b", "n_b"])
        held = rows[sorted({int(start[-1]), len(rows) - 1})]


def _likely(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """The pairs (a, b: digests) whose parities, some bytes for a word, don't tell them apart."""

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for whole in parts for x in slices(whole)):
            most = (part.column(2).to_numpy() + part.column(3).to_numpy()).tolist()
            kept = pa.array([9 * apart(x, y) <= n for x, y, n in zip(part.column(4).to_pylist(), part.column(5).to_pylist(), most, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(0).filter(kept), part.column(1).filter(kept)], names=["a", "b"])

    for side in "ab":
        pairs = pairs.join(prints.select(F.col("digest").alias(side), F.col("n").alias(f"n_{side}"), F.col("parity").alias(f"parity_{side}")), side)
    return pairs.select("a", "b", "n_a", "n_b", "parity_a", "parity_b").mapInArrow(compare, "a long, b long")


def _sets(texts: DataFrame, wanted: DataFrame, prints: DataFrame) -> DataFrame:
    """digest, shingles (the hashes in order, 8 bytes each) of the wanted digests; up to BROADCAST_ROWS of them are sent to the texts, else texts are joined."""

    def sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for whole in parts for x in slices(whole)):
            found = [shingles(t) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(f) for f in found], pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())], names=["digest", "shingles"])
        give_back()

    ids = materialize(prints.join(wanted, "digest").select(F.col("rep").alias("id")).distinct(), "wanted")
    few = ids.count() <= BROADCAST_ROWS
    whole = texts.join(F.broadcast(ids) if few else ids, "id", "left_semi").select("text").mapInArrow(sets, "digest long, shingles binary")
    return materialize(whole.join(wanted, "digest", "left_semi").dropDuplicates(["digest"]), "sets")


def _verified(pairs: DataFrame, texts: DataFrame, prints: DataFrame) -> DataFrame:
    """The pairs (a, b: digests) that are alike, by all the shingles of those that parities leave."""

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for whole in parts for x in slices(whole)):
            x, y = (part.column(i).to_pylist() for i in (2, 3))
            kept = pa.array([alike(np.frombuffer(v, "u8"), np.frombuffer(w, "u8")) for v, w in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(0).filter(kept), part.column(1).filter(kept)], names=["a", "b"])

    pairs = materialize(_likely(pairs, prints), "likely")
    sets = _sets(texts, pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct(), prints)
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("digest").alias(side), F.col("shingles").alias(f"shingles_{side}")), side)
    return materialize(pairs.select("a", "b", "shingles_a", "shingles_b").mapInArrow(compare, "a long, b long"), "near")


def _possible(n_a: Column, n_b: Column, at_a: Column | None = None, at_b: Column | None = None) -> Column:
    """Whether sets of these sizes can be alike, if what is before these places in either is not in the other."""
    if at_a is None:
        return 5 * F.least(n_a, n_b) >= 4 * F.greatest(n_a, n_b)
    return 9 * F.least(n_a - at_a, n_b - at_b) >= 4 * (n_a + n_b)


def _rarest(sets: DataFrame, members: DataFrame) -> DataFrame:
    """Rows (s, d, n, at): each member's rarest shingles that others have too, a fifth of its n and one more, with their places in order of rarity.

    Any two sets alike by 0.8 have one of these in common.  A text's own edits are
    its rarest shingles, and texts with many have no room for what all share.
    """

    def spread(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for whole in parts for x in slices(whole)):
            found = [np.frombuffer(v, "i8") for v in part.column(1).to_pylist()]
            sizes = [len(f) for f in found]
            digests = np.repeat(part.column(0).to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found or [np.zeros(0, "i8")])), pa.array(digests), pa.array(np.repeat(sizes, sizes).astype("i4"))], names=["s", "d", "n"])

    rows = materialize(sets.join(members.select(F.col("d").alias("digest")).distinct(), "digest", "left_semi").select("digest", "shingles").mapInArrow(spread, "s long, d long, n int"), "spread")
    common = rows.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    each = rows.join(common, "s").groupBy("d", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("f"))  # at most the shingles of one text
    own = F.col("n") - F.size("f")
    room = F.greatest(F.floor(F.col("n") / 5).cast("int") + 1 - own, F.lit(0))
    placed = each.select("d", "n", own.alias("own"), F.posexplode(F.slice("f", F.lit(1), room)).alias("pos", "x"))
    return materialize(placed.select("x.s", "d", "n", (F.col("own") + F.col("pos")).alias("at")), "rarest")


def _joined(found: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` with the component c that the links found so far put each in."""
    component = connected_components(found)
    return members.drop("c").join(component, F.col("d") == F.col("node"), "left").withColumn("c", F.coalesce("component", "d")).drop("node", "component")


def _open(members: DataFrame, key: str) -> DataFrame:
    """The rows of keys whose members are in several components."""
    several = members.groupBy(key).agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select(key)
    return members.join(several, key)


def _simhash_pairs(prints: DataFrame) -> DataFrame:
    """Pairs (a, b: digests) of texts whose fingerprints are equal (with the first of them) or linked within two bits, and whose sizes allow it."""
    rows = prints.where("n > 0").select("digest", "n", F.col("simhash").alias("fp"))
    first = materialize(rows.groupBy("fp").agg(F.min(F.struct("digest", "n")).alias("f")).select("fp", F.col("f.digest").alias("rep"), F.col("f.n").alias("m")), "prints")
    equal = rows.join(first, "fp").where((F.col("digest") != F.col("rep")) & _possible(F.col("n"), F.col("m"))).select(F.col("rep").alias("a"), F.col("digest").alias("b"))
    sizes = first.select("rep", "m")
    near = links(first.select("fp", "rep"))
    near = near.join(sizes.select(F.col("rep").alias("a"), F.col("m").alias("n_a")), "a").join(sizes.select(F.col("rep").alias("b"), F.col("m").alias("n_b")), "b")
    return materialize(equal.unionAll(near.where(_possible(F.col("n_a"), F.col("n_b"))).select("a", "b")).distinct(), "simhash")


def _shared_by(part: Column, m: DataFrame, shared: DataFrame, members: DataFrame) -> DataFrame:
    """The members of keys without those that the rest of a set's keys make up for.

    A set that must share ``less`` + 1 keys of a class with any that is alike does
    without the ``less`` most frequent of its shared ones: of the keys that two alike sets share, the rarest is left in both.
    """
    wanted = members.select(F.col("d").alias("b")).distinct()
    rows = shared.join(wanted, "b", "left_semi").join(m, "k").select("k", F.col("b").alias("d"), "m", part.alias("part"))
    place = F.row_number().over(Window.partitionBy("d", F.col("part").bitwiseAND(1)).orderBy(F.desc("m"), F.desc("k")))
    needed = rows.withColumn("place", place).where(F.col("place") > F.shiftright("part", 1)).select("k", "d")
    return members.join(needed, ["k", "d"], "left_semi")


def similar_links(texts: DataFrame, prints: DataFrame, levels: dict[int, int]) -> DataFrame:
    """Links (a, b: digests) between sets of shingles alike by 0.8, enough of them to connect all that are connected.

    SimHash fingerprints within two bits by the general pigeonhole principle
    (``links``) are compared first, by all their shingles.  They can't find all that is
    alike by 0.8, so the same principle goes on with the sets themselves:
    sets of a and b shingles are alike if and only if at most (a + b) / 9 are in
    one of them only.  The hashes are cut into parts, by the larger set's class,
    so that it has shingles in more parts than that: some part then has the same
    shingles, one at least, in both, and they share its key.  First every set is
    compared with the first of each of its keys.  Alike sets share more keys than one,
    so each does without its most frequent ones (``_shared_by``).  Of the sets of a key that this
    leaves in different components, up to HEAVY are compared two by two.  Those of larger
    keys go on: two of them can be alike only if they share
    one of their rarest shingles, and so late in either that few are before it.
    Of each such shingle, every set is compared with the one that has the least
    of its own, the middle of a group of near copies, ``ROUNDS`` times; then
    those that still are in no component with it are compared with all others.
    """
    rows = _keyed(texts.where("id is not null"), levels)
    shared = rows.repartition("k").sortWithinPartitions("k", "digest").mapInArrow(_shared, "k long, a long, n_a long, b long, n_b long")
    size = lambda c: F.col(c).bitwiseAND(F.lit(2**32 - 1)).alias(c)
    shared = materialize(shared.select("k", "a", size("n_a"), "b", size("n_b"), F.shiftright("n_b", 32).alias("part")), "shared-keys")
    first = shared.where((F.col("a") != F.col("b")) & _possible(F.col("n_a"), F.col("n_b"))).select("a", "b").distinct()
    found = _verified(_simhash_pairs(prints).unionAll(first).distinct(), texts, prints)

    counts = shared.groupBy("k").agg(F.count(F.lit(1)).alias("m"))
    held = counts.where("m > 2")
    members = materialize(_open(_joined(found, shared.select("k", F.col("b").alias("d"), F.col("n_b").alias("n"))).join(held, "k"), "k"), "members")
    if members.limit(1).count():
        members = materialize(_open(_shared_by(F.col("part"), counts, shared, members), "k"), "members")
    light = members.where(F.col("m") <= HEAVY)
    x = light.select("k", F.col("d").alias("a"), F.col("n").alias("n_a"), F.col("c").alias("c_a"))
    y = light.select("k", F.col("d").alias("b"), F.col("n").alias("n_b"), F.col("c").alias("c_b"))
    pairs = x.join(y, "k").where((F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b")) & _possible(F.col("n_a"), F.col("n_b"))).select("a", "b").distinct()
    found = found.unionAll(_verified(pairs, texts, prints))

    crowded = members.where(F.col("m") > HEAVY).select("d").distinct()
    if not crowded.limit(1).count():
        return found
    rarest, more = _rarest(_sets(texts, crowded.withColumnRenamed("d", "digest"), prints), crowded), None
    for last in [*[False] * ROUNDS, True]:
        if more is None or more.limit(1).count():
            placed = materialize(_open(_joined(found, rarest), "s"), "placed")
        middle = placed.groupBy("s").agg(F.min(F.struct("at", "d", "n", "c")).alias("m"))
        outside = placed.join(middle, "s").where(F.col("c") != F.col("m.c")).select("s", F.col("d").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"), F.col("c").alias("c_a"), "m")
        if last:
            others = placed.select(F.col("s").alias("t"), F.col("d").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"), F.col("c").alias("c_b"))
            met = outside.join(others, (F.col("s") == F.col("t")) & (F.col("c_a") != F.col("c_b")) & _possible(F.col("n_a"), F.col("n_b"), F.col("at_a"), F.col("at_b")))
        else:
            met = outside.withColumns({"b": F.col("m.d"), "n_b": F.col("m.n"), "at_b": F.col("m.at")}).where(_possible(F.col("n_a"), F.col("n_b"), F.col("at_a"), F.col("at_b")))
        more = _verified(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), texts, prints)
        found = found.unionAll(more)
    return found


def similar_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id over links between texts whose five-word shingles are alike by 0.8 or more.

    Null and empty texts are alike; a null id has the component of its text.
    """

    def run(texts: pa.Array) -> Iterator[pa.Array]:
        found = [shingles(t) for t in texts.to_pylist()]
        yield pa.array([_digest(f) for f in found], pa.int64())
        yield pa.array([len(f) for f in found], pa.int64())
        yield pa.array([size_class(len(f)) for f in found], pa.int32())
        yield pa.array([level_of(f) if len(f) else 0 for f in found], pa.int32())
        yield pa.array([parity(f) for f in found], pa.binary())
        yield pa.array(np.array([fingerprint(t) for t in texts.to_pylist()], "u8").view("i8"))

    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    marked = with_columns(texts, ["text"], {"digest": "long", "n": "long", "size_class": "int", "level": "int", "parity": "binary", "simhash": "long"}, run).drop("text")
    marked = materialize(marked, "digests")
    levels = {r[0]: r[1] for r in marked.where("n > 0").groupBy("size_class").agg(F.max("level")).collect()}  # some hundred classes at most
    prints = materialize(marked.groupBy("digest").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.first("parity").alias("parity"), F.first("simhash").alias("simhash")).where("rep is not null"), "distinct")
    component = connected_components(similar_links(texts, prints, levels))
    named = prints.join(component, prints["digest"] == component["node"], "left").select("digest", "rep", F.coalesce("component", "digest").alias("root"))
    named = materialize(named, "named")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_print = named.join(least, "root").select("digest", "component_id")
    return marked.join(by_print, "digest", "left").select(F.col("id").alias("doc_id"), "component_id")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep, of every group of similar texts, the rows with the smallest id; rows without an id are kept."""
    gone = similar_documents(df, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return df.join(gone, id_col, "left_anti")
