"""Quality rules: a decision list learned from labelled documents, run as Spark conditions.

``add_statistics`` measures each whole text.  ``learn`` grows rules by
sequential covering (in the manner of IREP): on two thirds of the rows still
uncovered a conjunction of thresholds is grown by information gain, on the other
third its last conditions are pruned away while that helps, and the rows that it
covers are set aside.  Rules single out the rarer class; what no rule covers is
the other class.  ``verdict`` emits the list as one ordered ``CASE WHEN``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import with_columns

#: Words in a repeated window; labelled documents that rules are learned from, those with the smallest hashes of their ids.
WINDOW, SAMPLE = 8, 20_000
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_chars_all", "n_lines", "n_distinct_words", "n_upper", "n_digits")


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words that lie in a window of ``size`` words which the text has twice or more; the first occurrence counts too."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) == len(words):
        return 0
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h = h * np.uint64(0xBF58476D1CE4E5B9) + mixed[j : j + n]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)  # windows of equal hash, compared word by word
    _, back, counts = np.unique(ids[at[:, None] + np.arange(size)], axis=0, return_inverse=True, return_counts=True)
    starts = at[counts[back.ravel()] > 1]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """STATISTICS, then MORE."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    seen: set[bytes] = set()
    dup = lines = 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        dup,
        repeated_words(words),
        len(text),
        lines,
        len(set(words)),
        _changed_by_lowering(text),
        sum(map(text.count, "0123456789")),
    )


def _changed_by_lowering(text: str) -> int:
    low = text.lower()
    if len(low) != len(text):
        return sum(c != c.lower() for c in text)
    return int((np.frombuffer(text.encode("utf-32-le"), "<u4") != np.frombuffer(low.encode("utf-32-le"), "<u4")).sum())


def add_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add STATISTICS and MORE as longs; null and empty texts have zeros, namesakes are replaced."""

    def run(texts: pa.Array) -> Iterator[pa.Array]:
        found = np.array([measure(t) for t in texts.to_pylist()], np.int64).reshape(len(texts), -1)
        for i in range(found.shape[1]):
            yield pa.array(found[:, i])

    return with_columns(df, [text_col], dict.fromkeys((*STATISTICS, *MORE), "long"), run)


#: What rules may ask about: a statistic, or one in proportion to another.
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "repeated_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "words_per_line": ("n_words", "n_lines"),
    "upper_share": ("n_upper", "n_chars_all"),
    "digit_share": ("n_digits", "n_chars_all"),
}
FEATURES = ("n_words", *RATIOS)


def add_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns({name: F.col(a) / F.greatest(F.col(b), F.lit(1)) for name, (a, b) in RATIOS.items()})


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def holds(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        x = rows[self.feature]
        return x > self.threshold if self.above else x <= self.threshold


@dataclass(frozen=True)
class Rules:
    """Conjunctions in order, the class that they stand for, and the class of what none covers."""

    rules: tuple[tuple[Condition, ...], ...]
    covered: int
    rest: int

    def __str__(self) -> str:
        lines = [f"{self.covered} if " + " and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:.6g}" for c in rule) for rule in self.rules]
        return "\n".join([*lines, f"otherwise {self.rest}"])


def _covers(rule: list[Condition], rows: dict[str, np.ndarray], n: int) -> np.ndarray:
    found = np.ones(n, bool)
    for c in rule:
        found &= c.holds(rows)
    return found


def _information(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(p, 1e-9) / np.maximum(p + n, 1e-9))


def _best_condition(rows: dict[str, np.ndarray], hit: np.ndarray) -> Condition | None:
    """The threshold with the largest FOIL gain; of equal ones the one in the widest gap between values."""
    best, chosen = (1e-9, 0.0), None
    p0, n0 = hit.sum(), (~hit).sum()
    base = _information(np.array(float(p0)), np.array(float(n0)))
    for feature in FEATURES:
        x = rows[feature]
        order = np.argsort(x, kind="stable")
        v, h = x[order], hit[order]
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        p_low, n_low = np.cumsum(h)[cut].astype(float), np.cumsum(~h)[cut].astype(float)
        gap = (v[cut + 1] - v[cut]) / max(v[-1] - v[0], 1e-12)
        for above in (False, True):
            p, n = (p0 - p_low, n0 - n_low) if above else (p_low, n_low)
            gain = np.round(p * (_information(p, n) - base), 9)
            top = gain.max()
            at = max(np.flatnonzero(gain == top), key=lambda i: gap[i])
            if (top, gap[at]) > best:
                best, chosen = (top, gap[at]), Condition(feature, above, float((v[cut[at]] + v[cut[at] + 1]) / 2))
    return chosen


def cover(rows: dict[str, np.ndarray], y: np.ndarray, most_rules: int = 24, most_conditions: int = 4, seed: int = 7) -> Rules:
    """Sequential covering with grow and prune; ``y`` has 0 and 1."""
    n = len(y)
    rare = int(y.sum() * 2 < n)
    target, rules = y == rare, []
    side = np.random.default_rng(seed).random(n) < 2 / 3
    left = np.ones(n, bool)
    while n and len(rules) < most_rules and (target & left & side).any():
        grow, prune = np.flatnonzero(left & side), np.flatnonzero(left & ~side)
        pick = lambda at: {f: rows[f][at] for f in FEATURES}
        rule: list[Condition] = []
        inside, hit = pick(grow), target[grow]
        while len(rule) < most_conditions and not hit.all() and (c := _best_condition(inside, hit)):
            rule.append(c)
            keep = c.holds(inside)
            inside, hit = {f: x[keep] for f, x in inside.items()}, hit[keep]
        if not rule:
            break
        outside, is_target = pick(prune), target[prune]

        def worth(k: int) -> float:
            got = _covers(rule[:k], outside, len(prune))
            return (is_target[got].sum() - (~is_target[got]).sum()) / max(got.sum(), 1)

        size = max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))
        if worth(size) <= 0:
            break
        rules.append(tuple(rule[:size]))
        left &= ~_covers(rule[:size], rows, n)
    return Rules(tuple(rules), rare, 1 - rare)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality") -> Rules:
    """Rules from at most ``sample`` labelled documents; without labels everything is class 1.

    Rows without id or label are no labels; a document labelled twice has the lower label.
    """
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most `sample` rows
    rows = add_ratios(add_statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))).select("doc_id", "y", *FEATURES)
    found = rows.toPandas().sort_values(["doc_id", *FEATURES])
    if found["y"].nunique() < 2:
        return Rules((), 0, int(found["y"].iloc[0]) if len(found) else 1)
    return cover({f: found[f].to_numpy(float) for f in FEATURES}, found["y"].to_numpy(int))


def verdict(rules: Rules) -> Column:
    """The decision list over the columns of ``add_ratios``: the first rule that holds decides."""
    found = F.lit(rules.rest)
    for rule in reversed(rules.rules):
        holds = rule[0].column()
        for c in rule[1:]:
            holds = holds & c.column()
        found = F.when(holds, rules.covered).otherwise(found)
    return found
