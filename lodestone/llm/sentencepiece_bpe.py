"""Exact SentencePiece BPE encoding by backtracking, and decoding.

A piece sequence is the BPE encoding of a text exactly if every two neighbours
stay apart when the text of the two is merged on its own.  So the encoder takes,
from an Aho-Corasick pass over the text, the longest piece at each position,
checks it against its left neighbour (the check is cached), falls back to the
next shorter piece, and steps back where none fits; a bitfield keeps the
positions from which the rest cannot be encoded, so no work is done twice.

No piece has a word mark after another character, so merges never cross from one
word to the next and words are encoded one by one, through a bounded cache.
Pieces of word marks alone tie in score, where neighbours don't decide; words
that begin with several marks are merged the plain way.

Only the model's data come from the library (pieces, scores, kinds); texts are
encoded and decoded here.
"""

from __future__ import annotations

import codecs
import math
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from lodestone.llm.common import with_columns

MARK = "▁"
#: Words, and pairs of pieces, that each worker remembers; a full cache is emptied.
CACHE = 200_000
#: Characters up to which a text is merged by looking at all its pairs.
SHORT = 64


def _each_invalid_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("lodestone_each_byte", _each_invalid_byte)


class _Words(dict):
    """Ids of words, made on first use; a full table is emptied."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        encoder = self.encoder
        joined = encoder.joined
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in joined]
        if cuts:
            ids = b"".join([self[word[a:b]] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)])
        else:
            ids = encoder.word_ids(word)
        if len(word) <= 40:
            if len(self) >= CACHE:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Encodes and decodes as the library does with the model in ``path``."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.eos = model.eos_id()
        special = [i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)]
        self.byte_id = {int(model.id_to_piece(i)[1:-1], 16): i for i in special if model.is_byte(i)}
        hidden = set(special)
        self.id = {model.id_to_piece(i): i for i in range(size) if i not in hidden}
        self.score = {piece: model.get_score(i) for piece, i in self.id.items()}
        if any(MARK in piece.lstrip(MARK) for piece in self.id):
            raise ValueError("pieces cross words: this model needs whole texts as one word")
        # the library's own checks of these settings
        if model.normalize("A  é ") != f"{MARK}A{MARK}{MARK}é{MARK}":
            raise ValueError("only models without text normalisation, with a dummy prefix, are supported")
        self.size = size
        self.find = ahocorasick.Automaton()
        for piece, i in self.id.items():
            self.find.add_word(piece, (len(piece), i))
        self.find.make_automaton()
        #: Neighbouring characters that some piece holds; words are cut between all others, where nothing can merge.
        self.joined = {piece[i : i + 2] for piece in self.id for i in range(len(piece) - 1)}
        self.bytes = [b""] * size
        for piece, i in self.id.items():
            self.bytes[i] = piece.replace(MARK, " ").encode()
        for byte, i in self.byte_id.items():
            self.bytes[i] = bytes([byte])
        self.bytes[model.unk_id()] = " ⁇ ".encode()
        self.marked = {i for piece, i in self.id.items() if piece.startswith(MARK)}
        self.control = {i for i in special if model.is_control(i)}
        self.chars = {piece for piece in self.id if len(piece) == 1}
        self.char_id: dict[str, int] = {}  # characters without a piece, numbered from `size` on
        self.pairs: dict[int, bool] = {}
        self.words = _Words(self)
        self.runs = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.line_end = np.array([self.byte_id[10]], "<i4").tobytes() if not any("\n" in piece for piece in self.id) else None

    def merge(self, text: str) -> list[str]:
        """Plain BPE: again and again the best-scored pair, the leftmost of equals; a long text by a heap of pairs."""
        if len(text) > SHORT:
            return self._merge_long(text)
        parts, score = list(text), self.score
        if len(parts) < 2:
            return parts
        none = -math.inf
        pair = [score.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pair and (best := max(pair)) != none:
            at = pair.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pair[at]
            if at:
                pair[at - 1] = score.get(parts[at - 1] + parts[at], none)
            if at < len(pair):
                pair[at] = score.get(parts[at] + parts[at + 1], none)
        return parts

    def _merge_long(self, text: str) -> list[str]:
        """The same in time n log n: parts know their neighbours, and pairs of parts that have changed since are passed over."""
        parts: list[str | None] = list(text)
        n, score = len(parts), self.score
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(-score[p], i, p) for i, p in enumerate(map("".join, zip(parts, parts[1:]))) if p in score]
        heapify(heap)
        while heap:
            _, at, whole = heappop(heap)
            second = after[at]
            if parts[at] is None or second >= n or parts[at] + parts[second] != whole:
                continue
            parts[at], parts[second] = whole, None
            after[at] = after[second]
            if after[at] < n:
                before[after[at]] = at
            for left in (before[at], at):
                if left >= 0 and after[left] < n:
                    joined = parts[left] + parts[after[left]]
                    if joined in score:
                        heappush(heap, (-score[joined], left, joined))
        return [p for p in parts if p is not None]

    def number(self, part: str) -> int:
        i = self.id.get(part)
        if i is None:
            i = self.char_id.setdefault(part, self.size + len(self.char_id))
        return i

    def stays_apart(self, left: str, right: str) -> bool:
        return self.merge(left + right) == ([left, right] if left else [right])

    def pieces(self, word: str) -> list[int]:
        """Numbers of the pieces of a word; a character without a piece is a part of its own."""
        n = len(word)
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # the pieces from each position, shortest first
        for end, found in self.find.iter(word):
            at[end - found[0] + 1].append(found)  # ends come in order, so these ascend
        if not self.chars.issuperset(word):
            for i, c in enumerate(word):
                if c not in self.chars:
                    at[i].insert(0, (1, self.number(c)))
        can = bytearray(b"\x01") * (n + 1)
        chosen: list[int] = []  # the piece taken at each start, as a place among those of its position
        starts: list[int] = []
        taken: list[int] = []
        pairs, stays_apart = self.pairs, self.stays_apart
        pos, last = 0, -1
        here = at[0]
        k = len(here) - 1
        while True:
            while k >= 0:
                size, i = here[k]
                if can[pos + size]:
                    pair = last << 32 | i
                    apart = pairs.get(pair)
                    if apart is None:
                        if len(pairs) >= CACHE:
                            pairs.clear()
                        apart = pairs[pair] = stays_apart(word[starts[-1] : pos] if starts else "", word[pos : pos + size])
                    if apart:
                        break
                k -= 1
            if k >= 0:
                starts.append(pos)
                chosen.append(k)
                taken.append(i)
                pos += size
                if pos == n:
                    return taken
                last, here = i, at[pos]
                k = len(here) - 1
            else:
                can[pos] = 0
                if not starts:
                    raise ValueError(f"no encoding of {word!r}")
                pos, k = starts.pop(), chosen.pop() - 1
                taken.pop()
                last, here = taken[-1] if taken else -1, at[pos]

    def word_ids(self, word: str) -> bytes:
        ids = [self.number(p) for p in self.merge(word)] if word.startswith(MARK * 2) else self.pieces(word)
        if max(ids) >= self.size:
            chars = {i: c for c, i in self.char_id.items()}
            ids = [x for i in ids for x in ([i] if i < self.size else [self.byte_id[b] for b in chars[i].encode()])]
        return array("i", ids).tobytes()

    def encode_bytes(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a whole text, without an end id."""
        if not text:
            return b""
        look, out = self.words.__getitem__, []
        lines = (" " + text.replace(MARK, " ")).split("\n") if self.line_end else [" " + text.replace(MARK, " ")]
        for line in lines:
            first, *rest = line.split(" ")
            if "" in rest:
                out.append(b"".join(map(look, self.runs.findall(line.replace(" ", MARK)))))
            else:
                out.append((look(first) if first else b"") + b"".join([look(MARK + w) for w in rest]))
        return (self.line_end or b"").join(out)

    def encode(self, text: str, eos: bool = True) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<i4").tolist() + [self.eos] * eos

    def decode(self, ids: list[int]) -> str:
        """What the ids stand for; control ids are nothing, invalid bytes U+FFFD each, and the dummy prefix goes."""
        table = self.bytes
        if self.control.isdisjoint(ids):
            found = b"".join(map(table.__getitem__, ids)).decode("utf-8", "lodestone_each_byte")
        else:
            runs: list[list[bytes]] = [[]]
            for i in ids:  # bytes on the two sides of a control id are no character
                runs.append([]) if i in self.control else runs[-1].append(table[i])
            found = "".join([b"".join(r).decode("utf-8", "lodestone_each_byte") for r in runs])
        first = next((i for i in ids if i not in self.control), None)
        return found[1:] if first in self.marked else found


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def _encoded(enc: Encoder, texts: pa.Array, eos: bool) -> pa.ListArray:
    end = np.array([enc.eos] * eos, "<i4").tobytes()
    parts = [enc.encode_bytes(t or "") + end for t in texts.to_pylist()]
    offsets = np.cumsum([0, *(len(p) // 4 for p in parts)]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def _decoded(enc: Encoder, ids: pa.ListArray) -> pa.Array:
    values, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
    lists = (values[a : b - (b > a and values[b - 1] == enc.eos)].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True))  # the end id is nothing
    return pa.array([enc.decode(x) for x in lists], pa.string())


def encode(df: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", eos: bool = True) -> DataFrame:
    """Add the ids of each whole text; a null text is an empty one, which has the end id alone.

    A row at a time, without a shuffle; a column named ``ids_col`` is replaced.
    """

    def run(texts: pa.Array) -> Iterator[pa.Array]:
        yield _encoded(encoder(model_path), texts, eos)

    return with_columns(df, [text_col], {ids_col: "array<int>"}, run)


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Add the text that each id list stands for; a null list is an empty one."""

    def run(ids: pa.Array) -> Iterator[pa.Array]:
        yield _decoded(encoder(model_path), ids)

    return with_columns(df, [ids_col], {text_col: "string"}, run)


def round_trip(df: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded", eos: bool = True) -> DataFrame:
    """Add the ids and the text that they stand for, in one pass and one worker."""

    def run(texts: pa.Array) -> Iterator[pa.Array]:
        enc = encoder(model_path)
        ids = _encoded(enc, texts, eos)
        yield ids
        yield _decoded(enc, ids)

    return with_columns(df, [text_col], {ids_col: "array<int>", decoded_col: "string"}, run)
