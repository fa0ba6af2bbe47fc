"""Toxicity by class-conditional Kneser-Ney models over the characters of words.

Two models, toxic and ordinary, are trained on labelled documents.  Each
discounts its own counts of ``ORDER`` characters and backs off to lower orders
that both share: continuation counts over *all* documents, labelled or not.  A
rare expression therefore gets much the same probability from both models, and
one that shares its beginnings with toxic words gets a share of theirs.

A document's two features are length-normalised log-likelihood ratios: that of
all its words together, and the largest of any single word, which finds one
insult in a long text.  A logistic curve over them, fitted to documents that the
models had not seen (two halves score each other), gives the score.

The class counts and the curve come from at most ``SAMPLE`` labelled documents,
the ones with the smallest hashes of their ids; this bounds the model, which is
broadcast.  Shared counts cover every document and are kept for the model's
sequences only: elsewhere they cancel out of the ratio.
"""

from __future__ import annotations

import gc
import math
import pickle
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import discard, fold, give_back, materialize, slices, unused

#: Characters per sequence; labelled documents used; discount; weight of the shared backoff in each class.
ORDER, SAMPLE, DISCOUNT, PRIOR = 5, 20_000, 0.75, 5.0
#: Words that a worker remembers at once.
CACHE = 150_000
#: Sequences' beginnings up to which those of the model (some 20 bytes each) are broadcast; beyond it they are joined.
BROADCAST_ROWS = 1_000_000
EDGE = ".,;:!?|*$%&#<>\"'()[]{}"
#: Marks of a word's start and end: control characters, which words don't have at their edges.
BEGIN, FINISH = "\x02" * (ORDER - 1), "\x03"


def sequences(word: str) -> list[str]:
    marked = BEGIN + word + FINISH
    return [marked[i : i + ORDER] for i in range(len(marked) - ORDER + 1)]


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


class KneserNey:
    """The two models over shared lower orders; used to make a table of ratios, not to score."""

    def __init__(self, counts: list[dict[str, int]], shared: list[dict[str, int]]):
        self.counts, self.shared = counts, shared
        self.total, self.kinds = [defaultdict(int), defaultdict(int)], [defaultdict(int), defaultdict(int)]
        for c in (0, 1):
            for s, n in counts[c].items():
                self.total[c][s[:-1]] += n
                self.kinds[c][s[:-1]] += 1
        self.low_total, self.low_kinds = [defaultdict(int) for _ in range(ORDER)], [defaultdict(int) for _ in range(ORDER)]
        for order in range(1, ORDER):
            for s, n in shared[order].items():
                self.low_total[order][s[:-1]] += n
                self.low_kinds[order][s[:-1]] += 1
        self.low: dict[str, float] = {"": 1e-3}

    def backoff(self, s: str) -> float:
        found = self.low.get(s)
        if found is None:
            order, shorter = len(s), self.backoff(s[1:])
            n = self.low_total[order].get(s[:-1], 0)
            found = shorter if not n else (max(self.shared[order].get(s, 0) - DISCOUNT, 0) + DISCOUNT * self.low_kinds[order][s[:-1]] * shorter) / n
            self.low[s] = found
        return found

    def backoff_weight(self, c: int, before: str) -> float:
        return (DISCOUNT * self.kinds[c].get(before, 0) + PRIOR) / (self.total[c].get(before, 0) + PRIOR)

    def probability(self, c: int, s: str) -> float:
        before, n = s[:-1], self.counts[c].get(s, 0)
        return max(n - DISCOUNT, 0) / (self.total[c].get(before, 0) + PRIOR) + self.backoff_weight(c, before) * self.backoff(s[1:])

    def ratios(self) -> Ratios:
        """Log-likelihood ratios: of each sequence that a class has, and of all others by their first characters, for the backoff cancels there."""
        seen = {s: math.log(self.probability(1, s) / self.probability(0, s)) for c in (0, 1) for s in self.counts[c]}
        other = {h: math.log(self.backoff_weight(1, h) / self.backoff_weight(0, h)) for h in {*self.total[0], *self.total[1]}}
        return Ratios(seen, other)


class _Sequences(dict):
    """Ratios of known sequences; ``other`` has those of unknown ones by their first characters."""

    other: dict[str, float]

    def __missing__(self, s: str) -> float:
        return self.other.get(s[:-1], 0.0)


class _Words(dict):
    """Ratio and length of tokens, without punctuation at their edges; (0, 0) if nothing is left."""

    def __init__(self, of_sequence: _Sequences):
        super().__init__()
        self.of_sequence = of_sequence.__getitem__

    def __missing__(self, token: str) -> tuple[float, int]:
        word = token.strip(EDGE)
        found = (sum(map(self.of_sequence, sequences(word))), len(word) + 1) if word else (0.0, 0)
        if len(self) >= CACHE:
            self.clear()
        if len(token) <= 64:
            self[token] = found
        return found


class Ratios:
    """Scores texts; ``words`` remembers tokens and lives as long as a task, the table as long as the broadcast."""

    def __init__(self, seen: dict[str, float], other: dict[str, float]):
        self.table = _Sequences(seen)
        self.table.other = other

    def words(self) -> _Words:
        return _Words(self.table)


def features(words: _Words, text: str | None) -> tuple[float, float]:
    """The ratio per character of the whole text, and the largest of its words."""
    parts = [x for x in map(words.__getitem__, words_of(text)) if x[1]]
    if not parts:
        return 0.0, 0.0
    return sum([r for r, _ in parts]) / sum([n for _, n in parts]), max([r / n for r, n in parts])


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a light ridge, by Newton steps: weights, then the intercept."""
    full = np.column_stack([x, np.ones(len(x))])
    at = np.zeros(full.shape[1])
    ridge = np.diag([1e-3] * x.shape[1] + [1e-9])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(full @ at, -35, 35)))
        step = np.linalg.solve((full * (p * (1 - p) + 1e-9)[:, None]).T @ full + ridge, full.T @ (y - p) - ridge @ at)
        at += step
        if np.abs(step).max() < 1e-9:
            break
    return at


class Model:
    """What scoring needs: the pickled table of ratios and the curve, or one score for all where a class has no documents."""

    def __init__(self, ratios: bytes | None, curve: np.ndarray | None, prior: float):
        self.ratios, self.curve, self.prior = ratios, curve, prior

    def scorer(self) -> Callable[[str | None], float]:
        """A function from texts to scores, with a memory of its own."""
        if self.ratios is None:
            return lambda text: self.prior
        words = pickle.loads(self.ratios).words()

        def score(text: str | None) -> float:
            whole, most = features(words, text)
            z = self.curve[0] * whole + self.curve[1] * most + self.curve[2]
            return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))

        return score


def _sequence_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, s, n: how often each sequence is in the rows' texts, per value of the (small) key columns."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[tuple, Counter] = defaultdict(Counter)

        def full() -> Iterator[pa.RecordBatch]:
            for key, seen in words.items():
                grams: Counter = Counter()
                for token, n in seen.items():
                    if word := token.strip(EDGE):
                        for s in sequences(word):
                            grams[s] += n
                yield pa.RecordBatch.from_arrays([*(pa.array([k] * len(grams), pa.int32()) for k in key), pa.array(list(grams)), pa.array(list(grams.values()), pa.int64())], names=[*keys, "s", "n"])
            words.clear()

        for part in (x for whole in parts for x in slices(whole)):
            for *key, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                words[tuple(key)].update(words_of(text))
            if sum(map(len, words.values())) > CACHE:
                yield from full()
        yield from full()
        give_back()

    schema = ", ".join([*(f"{k} int" for k in keys), "s string", "n long"])
    return df.select(*keys, "text").mapInArrow(count, schema).groupBy(*keys, "s").agg(F.sum("n").alias("n"))


def _all_sequences(docs: DataFrame) -> DataFrame:
    """s: every sequence of the texts once."""

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        found: set[str] = set()

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], names=["s"])

        for part in (x for whole in parts for x in slices(whole)):
            new = set().union(*map(words_of, part.column(0).to_pylist())) - seen
            for token in new:
                if word := token.strip(EDGE):
                    found.update(sequences(word))
            if len(seen) > CACHE:
                seen.clear()
            seen |= new
            if len(found) > 2 * CACHE:
                yield full()
                found.clear()
        yield full()
        seen.clear()
        found.clear()
        give_back()

    return docs.select("text").mapInArrow(find, "s string").distinct()


def _shared_counts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """s, n for sequences below ORDER: in how many contexts each wanted one is found over all documents."""
    everywhere = materialize(_all_sequences(docs), "sequences")
    levels = None
    for order in range(1, ORDER):
        one = everywhere.select(F.substring("s", ORDER - order, order + 1).alias("s")).distinct().groupBy(F.substring("s", 2, order).alias("s")).agg(F.count(F.lit(1)).alias("n"))
        levels = one if levels is None else levels.unionAll(one)
    suffixes = wanted.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(ORDER - 1)), lambda k: F.substr("s", F.lit(ORDER) - k + 1))).alias("s")).distinct()
    # contexts' totals need every continuation of a context that the model has
    contexts = materialize(suffixes.select(F.expr("substring(s, 1, length(s) - 1)").alias("h")).distinct(), "contexts")
    held = F.broadcast(contexts) if contexts.count() <= BROADCAST_ROWS else contexts
    kept = materialize(levels.withColumn("h", F.expr("substring(s, 1, length(s) - 1)")).join(held, "h", "left_semi").select("s", "n"), "shared-counts")
    discard(everywhere)
    discard(contexts)
    return kept


#: Documents by their halves that each of the three models is made from.
HALVES = {"first": (0,), "second": (1,), "whole": (0, 1)}


def _models(grams: DataFrame, shared: DataFrame) -> dict[str, bytes]:
    """The pickled ratios of HALVES, made in a task from the sample's counts and the shared ones; the driver gets some MB."""

    def build(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[tuple[int, int], list] = defaultdict(list)
        low: list[dict[str, int]] = [{} for _ in range(ORDER)]
        for part in parts:
            for c, half, s, n in zip(*(x.to_pylist() for x in part.columns), strict=True):
                if c < 0:
                    low[len(s)][s] = n
                else:
                    own[c, half].append((s, n))
        for name, halves in HALVES.items():
            counts: list[dict[str, int]] = [defaultdict(int), defaultdict(int)]
            for (c, half), rows in own.items():
                if half in halves:
                    for s, n in rows:
                        counts[c][s] += n
            data = pickle.dumps(KneserNey(counts, low).ratios())
            del counts
            gc.collect()
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary())], names=["name", "data"])
        own.clear()
        give_back()

    none = F.lit(-1).alias("c"), F.lit(-1).alias("half")
    rows = grams.select("c", "half", "s", "n").unionByName(shared.select(*none, "s", "n"))
    return {r["name"]: bytes(r["data"]) for r in rows.coalesce(1).mapInArrow(build, "name string, data binary").collect()}


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the labelled documents outside fold 0; a document labelled twice is toxic if either label says so.

    Rows without id or label are no labels.  With one class or none, every score is that class's share.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("c"))
    half = F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 5) % 2
    chosen = usable.withColumn("half", half.cast("int")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.join(F.broadcast(chosen), "doc_id").select("c", "half", "text")
    grams = materialize(_sequence_counts(rows, ["c", "half"]), "grams")
    present = sorted(r[0] for r in grams.select("c").distinct().collect())
    if present != [0, 1]:
        discard(grams)
        return Model(None, None, float(present[0]) if present else 0.0)
    shared = _shared_counts(docs.select("text"), grams.select("s").distinct())
    made = _models(grams, shared)
    discard(grams)
    discard(shared)
    halves = docs.sparkSession.sparkContext.broadcast((made["second"], made["first"]))  # each half is scored by the other

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [pickle.loads(half).words() for half in halves.value]
        for part in (x for whole in parts for x in slices(whole)):
            label, half, text = (c.to_pylist() for c in part.columns)
            found = [features(words[h], t) for h, t in zip(half, text, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found]), pa.array([f[1] for f in found]), pa.array(label, pa.int32())], names=["whole", "most", "c"])
        del words
        give_back()

    seen = rows.mapInArrow(score, "whole double, most double, c int").toPandas()  # at most `sample` rows
    halves.destroy()
    return Model(made["whole"], fit_curve(seen[["whole", "most"]].to_numpy(), seen["c"].to_numpy(float)), 0.0)


def add_scores(df: DataFrame, model: Model, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """Add each whole text's score from 0 to 1; null and empty texts are texts without words."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in df.columns if c != name]
    fed = df.select(*kept, *([text_col] if text_col == name else []))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.scorer()
        for part in (x for whole in parts for x in slices(whole)):
            scores = pa.array([score(t) for t in part.column(text_col).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), scores], names=[*kept, name])
        del score
        give_back()

    return fed.mapInArrow(run, T.StructType([*(df.schema[c] for c in kept), T.StructField(name, T.DoubleType())]))


def reject_toxic(df: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose text scores below the threshold, unchanged."""
    [name] = unused(df, "toxicity")
    return add_scores(df, model, text_col, name).where(F.col(name) < threshold).drop(name)
