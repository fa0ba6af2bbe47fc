"""Line deduplication by a log-template tree.

Every line goes down a tree of fixed depth: its number of words, then its first
``DEPTH`` words, where a word with a digit is a variable field.  In the leaf it
joins the most similar template whose first line agrees with it in at least
``ALIKE`` of all places.  The places where a template's lines differ are variable
fields too: a line that is like no first line joins the template that it agrees
with in every other place, if these constant places are ``CONSTANT`` of all or
more and fill one band.  A template that lines of two or more documents share
recurs; its first line (smallest document id, then line number) stays and all
others are dropped.

Identical lines are counted together before any shuffle, and leaves get one entry
per distinct line, with three bytes of each word's hash: words that differ are
taken for equal once in 16 million comparisons.  The places of a line are cut into one
band more than may differ from a first line, so a line shares a band with the first
line of any template that it can join.  By the
bands a line finds its template among any number, and a leaf of more than ``LEAF``
distinct lines is dealt into the parts that shared bands connect, which have no
template in common: results are those of the leaf as a whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, slices, unused
from lodestone.llm.components import connected_components

#: Leading words that the tree compares; share of places that agree with a template's first line; share of places that its variable fields must leave; words that a line needs.
DEPTH, ALIKE, CONSTANT, LEAST_WORDS = 4, 0.85, 0.7, 4
#: Lines of a leaf, and templates, from which bands are used; leaves up to which those with several lines are broadcast (8 bytes each).
LEAF, BROADCAST_ROWS = 512, 1_000_000
#: Bytes of a word's mark.
MARK = 3
#: Words that a worker remembers.
CACHE = 150_000
DIGIT = re.compile(rb"[0-9]")
#: Stands for a variable field; a zero byte that is a word by itself counts as one too.
FIELD = b"\0"


class _Marks(dict):
    """Three bytes for a word: of its checksum, or zeros for a variable field."""

    def __missing__(self, word: bytes) -> bytes:
        mark = bytes(MARK) if word == FIELD else (zlib.crc32(word) % (256**MARK - 1) + 1).to_bytes(MARK, "little")
        if len(self) >= CACHE:
            self.clear()
        if len(word) <= 64:
            self[word] = mark
        return mark


def _signed(data: bytes, seed: int = 0) -> int:
    n = xxhash.xxh64_intdigest(data, seed)
    return n - 2**64 if n >= 2**63 else n


def lines_of(text: str | None) -> Iterator[tuple[int, list[bytes]]]:
    """Number and words of each line with enough words, variable fields as FIELD; white space is the ASCII kind."""
    raw = (text or "").encode()
    digits = DIGIT.search(raw) is not None
    for number, line in enumerate(raw.split(b"\n")):
        words = line.split()
        if len(words) >= LEAST_WORDS:
            if digits and DIGIT.search(line):
                words = [FIELD if DIGIT.search(w) else w for w in words]
            yield number, words


def row_key(id_col: str, text_col: str) -> Column:
    """Tells documents apart where ids are missing or repeated; rows alike in both share their fate."""
    return F.xxhash64(id_col, text_col)


def _lines(rows: DataFrame, places: bool) -> DataFrame:
    """doc_id, key, number, line (hash) and, with ``places``, leaf and the words' marks where a template could vary."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = _Marks().__getitem__
        least = next(n for n in range(1, 1000) if int((1 - ALIKE) * n + 1e-9))
        for part in (x for whole in parts for x in slices(whole)):
            found: list[tuple] = []
            for doc_id, key, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                for number, words in lines_of(text):
                    line = _signed(b" ".join(words))
                    if places:
                        short = b"".join(map(mark, words)) if len(words) >= least else b""
                        found.append((doc_id, key, number, line, _signed(b" ".join(words[:DEPTH]), len(words)), short))
                    else:
                        found.append((doc_id, key, number, line))
            columns = list(zip(*found, strict=True)) or [()] * (6 if places else 4)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "key", "number", "line", "leaf", "short"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=names[: len(columns)])

    schema = "doc_id long, key long, number int, line long" + (", leaf long, short binary" if places else "")
    return rows.select("doc_id", "key", "text").mapInArrow(run, schema)


def _ends(width: int) -> list[int]:
    """Where the bands of a line of so many words end, after the tree's places."""
    n = int((1 - ALIKE) * width + 1e-9) + 1
    return [DEPTH + (width - DEPTH) * i // n for i in range(n + 1)]


def bands(short: bytes) -> list[bytes]:
    """The places beyond the tree's in one run more than places that may differ, each with its number."""
    ends = _ends(len(short) // MARK)
    return [bytes((i % 256, i // 256)) + short[MARK * a : MARK * b] for i, (a, b) in enumerate(pairwise(ends))]


def _places(short: bytes) -> np.ndarray:
    parts = np.frombuffer(short, "u1").reshape(-1, MARK).astype(np.uint32)
    return parts[:, 0] | parts[:, 1] << 8 | parts[:, 2] << 16


def _longer(rows: np.ndarray, width: int) -> np.ndarray:
    """With room for twice as many rows."""
    rows = rows.reshape(-1, width)
    return np.concatenate([rows, np.zeros((max(16, len(rows)), width), rows.dtype)])


def cluster(lines: Iterable[tuple[int, bytes]]) -> Iterator[tuple[int, int]]:
    """Lines of one leaf, of one length, in order: each line's hash with that of the line that its template began with."""
    heads: list[int] = []
    shorts: list[bytes] = []
    index: dict[bytes, list[int]] = {}  # by band, once there are more than LEAF templates
    begun, constant = np.zeros((0, 0), np.uint32), np.zeros((0, 0), bool)
    general: set[int] = set()  # templates that lines unlike their first one can join
    for line, short in lines:
        places = _places(short)
        width = len(places)
        near = np.arange(len(heads)) if len(heads) <= LEAF else np.array(sorted({i for b in bands(short) for i in index.get(b, ())}), np.int64)
        at = -1
        if len(near):
            same = begun[near] == places
            equal = same.sum(axis=1)
            best = int(equal.argmax())
            if equal[best] >= ALIKE * width - 1e-9:
                at = int(near[best])
                lost = constant[at] & ~same[best]
                if lost.any():
                    constant[at] &= same[best]
                    left, filled = int(constant[at].sum()), any(constant[at, a:b].all() for a, b in pairwise(_ends(width)))
                    (general.add if filled and left >= CONSTANT * width - 1e-9 and left < ALIKE * width - 1e-9 else general.discard)(at)
            elif general:
                open_ = [i for i, h in enumerate(near) if int(h) in general]
                fits = [i for i in open_ if (same[i] | ~constant[near[i]]).all()]
                if fits:
                    at = int(near[max(fits, key=lambda i: (int(constant[near[i]].sum()), -i))])
        if at >= 0:
            yield line, heads[at]
            continue
        if len(heads) == len(begun):
            begun, constant = _longer(begun, width), _longer(constant, width)
        begun[len(heads)], constant[len(heads)] = places, True
        heads.append(line)
        shorts.append(short)
        if len(heads) > LEAF:
            for i in range(len(heads) - 1 if index else 0, len(heads)):
                for b in bands(shorts[i]):
                    index.setdefault(b, []).append(i)
        yield line, line


def _clustered(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (leaf, part, line, short) sorted by leaf and part: line, template."""

    def rows() -> Iterator[tuple]:
        for part in parts:
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

    def emit(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([t for _, t in found], pa.int64())], names=["line", "template"])

    done: list[tuple[int, int]] = []
    for _, leaf in groupby(rows(), key=lambda r: (r[0], r[1], len(r[3]))):
        for pair in cluster((line, short) for _, _, line, short in leaf):
            done.append(pair)
            if len(done) >= 10_000:
                yield emit(done)
                done = []
    yield emit(done)


def _banded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (leaf, line, short): line and a hash of leaf and band, for every band."""
    for part in (x for whole in parts for x in slices(whole)):
        found = [(line, _signed(band, leaf % 2**64)) for leaf, line, short in zip(*(c.to_pylist() for c in part.columns), strict=True) for band in bands(short)]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["line", "band"])


def _parts(large: DataFrame) -> DataFrame:
    """leaf, part, line, short: the lines that share bands, directly or through others, are a part; lines that share none are left out."""
    banded = materialize(large.select("leaf", "line", "short").mapInArrow(_banded, "line long, band long"), "bands")
    least = banded.groupBy("band").agg(F.min("line").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "least")
    stars = banded.join(least, "band").where("line <> least").select("line", "least").distinct()
    component = connected_components(stars, "line", "least")
    return large.join(component, large["line"] == component["node"]).select("leaf", F.col("component").alias("part"), "line", "short")


def _in_leaves(rows: DataFrame) -> DataFrame:
    """line, template, from rows with leaf, part, line, short."""
    dealt = rows.select("leaf", "part", "line", "short").repartition("leaf", "part").sortWithinPartitions("leaf", "part", "short", "line")
    return dealt.mapInArrow(_clustered, "line long, template long")


def templates(rows: DataFrame) -> DataFrame:
    """line, template first line's place (doc_id, key, number) for every line whose template recurs."""
    place = F.struct("doc_id", "key", "number")
    lines = _lines(rows, places=True).groupBy("leaf", "line").agg(F.min(place).alias("first"), F.min("key").alias("low"), F.max("key").alias("high"), F.first("short").alias("short"))
    lines = materialize(lines.select("leaf", "line", "first", (F.col("low") != F.col("high")).alias("several"), "short"), "lines")
    leaves = materialize(lines.where(F.length("short") > 0).groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "leaves")
    known = F.broadcast(leaves) if leaves.count() <= BROADCAST_ROWS else leaves
    crowded = lines.select("leaf", "line", "short").where(F.length("short") > 0).join(known, "leaf")
    dealt = crowded.where(F.col("n") <= LEAF).select("leaf", F.lit(0).cast("long").alias("part"), "line", "short")
    if leaves.where(F.col("n") > LEAF).limit(1).count():
        dealt = dealt.unionAll(_parts(crowded.where(F.col("n") > LEAF)))
    joined = _in_leaves(dealt)
    varied = materialize(joined.where("line <> template"), "varied")
    marked = lines.select("line", "first", "several").join(varied, "line", "left").withColumn("template", F.coalesce("template", "line"))
    marked = materialize(marked, "marked")
    recurring = marked.groupBy("template").agg(F.min("first").alias("first"), F.max("several").alias("several"), F.min("first.key").alias("low"), F.max("first.key").alias("high")).where("several or low <> high").select("template", "first")
    return marked.select("line", "template").join(recurring, "template").select("line", "first")


def dropped_lines(rows: DataFrame) -> DataFrame:
    """doc_id, key, numbers: the lines to drop from each document, numbered from 0."""
    lines = _lines(rows, places=False)
    gone = lines.join(templates(rows), "line").where(F.struct("doc_id", "key", "number") != F.col("first"))
    return gone.groupBy("doc_id", "key").agg(F.collect_set("number").alias("numbers"))  # at most the lines of one text


def deduplicate_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """Drop recurring lines from every text; all rows and columns stay, ``counts`` adds n_lines and n_dropped.

    Lines of fewer than ``LEAST_WORDS`` words, blank ones too, stay.  Null texts
    stay null; a text of which all lines go is empty.  A null id counts as the
    smallest.  Rows alike in id and text are one document, told by the id and a
    hash of both.
    """
    key, gone, whole = unused(df, "key", "gone", "lines")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key"))
    found = dropped_lines(rows).select(F.struct(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), "key").alias(key), F.col("numbers").alias(gone))
    number = F.col(id_col).cast("long")
    keyed = df.withColumn(key, F.struct(F.coalesce(number, F.lit(0)).alias("id"), number.isNull().alias("none"), row_key(id_col, text_col).alias("key")))
    joined = keyed.join(found.hint("shuffle_hash"), key, "left")

    lines = F.split(text_col, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    rewritten = F.array_join(F.transform(kept, lambda i: F.get(F.col(whole), i)), "\n")
    found = joined.withColumn(whole, F.when(F.col(gone).isNotNull(), lines))
    if counts:
        found = found.withColumn("n_lines", F.coalesce(F.size(lines).cast("long"), F.lit(0))).withColumn("n_dropped", F.coalesce(F.size(gone), F.lit(0)).cast("long"))
    found = found.withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(rewritten))
    return found.select(*df.columns, *(c for c in ("n_lines", "n_dropped") if counts and c not in df.columns))
