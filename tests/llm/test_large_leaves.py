"""Line templates in leaves of more distinct lines than are compared at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import line_dedup
from test_filters import brute_lines


def test_a_leaf_of_many_unrelated_lines_loses_no_template(spark):
    rng = np.random.default_rng(3)
    texts, opening = {}, ["the", "same", "four", "words"]
    for i in range(2 * line_dedup.LEAF):
        texts[i] = " ".join([*opening, *(f"w{chr(97 + a)}{chr(97 + b)}" for a, b in rng.integers(0, 26, (16, 2)))])
    for i in range(0, 2 * line_dedup.LEAF, 10):  # one word differs, the fifth or a later one
        words = texts[i].split(" ")
        words[4 + i % 16] = "other"
        texts[10**6 - i] = " ".join(words)
    gone = brute_lines(texts.items())
    assert len(gone) == len(range(0, 2 * line_dedup.LEAF, 10))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate_lines(df).collect()}
    assert {(d, 0) for d, text in found.items() if text == ""} == gone


def test_bands_of_any_length():
    size = line_dedup.MARK
    for width in range(7, 1200):
        short = bytes(size * line_dedup.DEPTH) + b"".join(i.to_bytes(size, "little") for i in range(1, width - line_dedup.DEPTH + 1))
        found = line_dedup.bands(short)
        assert len(set(found)) == len(found) and b"".join(b[2:] for b in found) == short[size * line_dedup.DEPTH :]
        assert len(found) > width - next(n for n in range(width + 1) if n >= line_dedup.ALIKE * width - 1e-9)


def brute_templates(lines):
    """The first line of each line's template (lines are lists of words, in order), by all templates and both rules."""
    bank, found = [], []
    for words in lines:
        n, best = len(words), None
        alike = [(sum(a == b for a, b in zip(t, words, strict=True)), -i) for i, (t, _) in enumerate(bank)]
        if alike and max(alike)[0] >= 0.85 * n - 1e-9:
            best = -max(alike)[1]
            bank[best][1].difference_update(i for i in range(n) if bank[best][0][i] != words[i])
        else:
            cuts = [4 + (n - 4) * i // (int(0.15 * n + 1e-9) + 1) for i in range(int(0.15 * n + 1e-9) + 2)]
            fits = [
                (len(left), -i)
                for i, (t, left) in enumerate(bank)
                if 0.7 * n - 1e-9 <= len(left) < 0.85 * n - 1e-9 and any(left.issuperset(range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)) and all(t[j] == words[j] for j in left)
            ]
            if fits:
                best = -max(fits)[1]
        if best is None:
            best = len(bank)
            bank.append((words, set(range(n))))
        found.append(bank[best][0])
    return found


@pytest.mark.parametrize("leaf", [7, 512, 10**9])
def test_templates_are_those_of_all_comparisons_whatever_the_leaf_holds(monkeypatch, leaf):
    rng = np.random.default_rng(8)
    mark = line_dedup._Marks().__getitem__
    lines = set()
    for base in range(150):
        words = ["the", "same", "four", "words", *(f"w{x}" for x in rng.integers(0, 40, 16))]
        for _ in range(6):
            edited = list(words)
            for at in rng.integers(4, 11 if base % 3 else 20, int(rng.integers(0, 5))):
                edited[at] = f"x{rng.integers(0, 10**6)}"
            lines.add(tuple(edited))
    rows = sorted((b"".join(mark(w.encode()) for w in words), words) for words in lines)
    monkeypatch.setattr(line_dedup, "LEAF", leaf)
    found = list(line_dedup.cluster([(i, short) for i, (short, _) in enumerate(rows)]))
    want = brute_templates([list(words) for _, words in rows])
    assert [list(rows[h][1]) for _, h in found] == want
    plain = sum(sum(a == b for a, b in zip(rows[i][1], rows[h][1], strict=True)) < 17 for i, h in found)
    assert plain > 0  # some lines are found by the constant places alone


def test_variable_fields_are_generalised():
    mark = line_dedup._Marks().__getitem__
    base = "user anna opened the file report from the disk of the server in the old hall at noon today".split()
    lines = [list(base) for _ in range(4)]
    lines[1][13:15] = ["two", "three"]
    lines[2][15], lines[2][17] = "four", "five"
    lines[3][13:16], lines[3][17] = ["six", "seven", "eight"], "nine"  # 14 of 18 places as in the first: below ALIKE
    shorts = [b"".join(mark(w.encode()) for w in words) for words in lines]
    assert list(line_dedup.cluster(enumerate(shorts))) == [(0, 0), (1, 0), (2, 0), (3, 0)]
    assert list(line_dedup.cluster([(0, shorts[0]), (3, shorts[3])])) == [(0, 0), (3, 3)]


def test_a_leaf_of_very_many_pairs_joins_them_all(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(10_000):
        words = ["one", "and", "the", "same", *(f"v{x}" for x in rng.integers(0, 500, 16))]
        rows.append((2 * i, " ".join(words)))
        words[4] = f"other{chr(97 + i % 26)}"
        rows.append((2 * i + 1, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    letters = df.withColumn("text", F.translate("text", "0123456789", "abcdefghij"))
    found = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate_lines(letters).select("doc_id", "text").collect()}
    assert all(found[2 * i] and not found[2 * i + 1] for i in range(10_000))


def test_columns_with_clashing_names_stay(spark):
    rows = [(i, "the very same line of words", "k", "g", "l") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __key string, __GONE string, __lines string")
    found = line_dedup.deduplicate_lines(df, counts=True).collect()
    assert sorted((r["doc_id"], r["text"], r["__key"], r["__GONE"], r["__lines"], r["n_dropped"]) for r in found) == [(0, rows[0][1], "k", "g", "l", 0), (1, "", "k", "g", "l", 1), (2, "", "k", "g", "l", 1)]
