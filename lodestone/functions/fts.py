"""English full-text search: lexemes with positions, queries, and cover density."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Characters of a text that are indexed, weight of a plain lexeme, words that aren't indexed, and the stemmer's tables.
INDEXED_CHARS, WEIGHT = 100_000, 0.1
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
SETTLED = frozenset({"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"})
STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 start."""
    starts = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)

    def after(at: int) -> int:
        for i in range(at + 1, len(word)):
            if word[i] not in VOWELS and word[i - 1] in VOWELS:
                return i + 1
        return len(word)

    r1 = starts if starts is not None else after(0)
    return r1, after(r1)


def _short_syllable(word: str, end: int) -> bool:
    """Whether the part before ``end`` ends in a short syllable."""
    if end == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return end > 2 and word[end - 1] not in VOWELS + "wxY" and word[end - 2] in VOWELS and word[end - 3] not in VOWELS


def stem(word: str) -> str:
    """The stem of a lower-case English word by the second Porter algorithm."""
    if len(word) <= 2:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    w = word.lstrip("'")
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in VOWELS) else c for i, c in enumerate(w))
    r1, r2 = _regions(w)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in SETTLED:
        return w
    # past and progressive forms
    if w.endswith(("eed", "eedly")):
        at = len(w) - (3 if w.endswith("eed") else 5)
        if at >= r1:
            w = w[:at] + "ee"
    else:
        for s in ("ingly", "edly", "ing", "ed"):
            if w.endswith(s):
                if any(c in VOWELS for c in w[: -len(s)]):
                    w = w[: -len(s)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(DOUBLES):
                        w = w[:-1]
                    elif r1 >= len(w) and _short_syllable(w, len(w)):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    # derivations
    for s in sorted([*STEP2, "ogi", "li"], key=len, reverse=True):
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r1:
                if s == "ogi":
                    w = w[:-1] if w[at - 1 : at] == "l" else w
                elif s == "li":
                    w = w[:-2] if w[at - 1 : at] and w[at - 1] in LI_ENDINGS else w
                else:
                    w = w[:at] + STEP2[s]
            break
    for s in sorted([*STEP3, "ative"], key=len, reverse=True):
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r1:
                w = (w[:at] if at >= r2 else w) if s == "ative" else w[:at] + STEP3[s]
            break
    for s in sorted([*STEP4, "ion"], key=len, reverse=True):
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r2 and (s != "ion" or w[at - 1] in "st"):
                w = w[:at]
            break
    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or at >= r1 and not _short_syllable(w, at):
            w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2] == "l":
        w = w[:-1]
    return w.replace("Y", "y")


#: Words whose stems a worker remembers.
CACHE = 200_000
TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?")


class _Stems(dict):
    """Stems of words, None for stop words, made on first use; a full table is emptied."""

    def __missing__(self, word: str) -> str | None:
        lowered = word.lower()
        found = None if lowered in STOP_WORDS else stem(lowered)
        if len(self) >= CACHE:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


_stems = _Stems()


def lexemes(text: str) -> list[tuple[str, int]]:
    """Stems with their word positions from 1; stop words have a position but no lexeme."""
    found = map(_stems.__getitem__, TOKEN.findall((text or "")[:INDEXED_CHARS]))
    return [(s, i) for i, s in enumerate(found, 1) if s is not None]


#: A query is an OR of ANDs; a part is a phrase of (lexeme, offset) and whether it must be absent.
Query = list[list[tuple[list[tuple[str, int]], bool]]]


def parse_query(text: str) -> Query:
    """Words are ANDed; "phrases", OR between words, and -word for absence, as a web search reads them."""
    query: Query = [[]]
    for m in re.finditer(r'(-?)"([^"]*)"?|(\S+)', text):
        if m[3] and m[3].lower() == "or":
            if query[-1]:
                query.append([])
            continue
        raw = m[2] if m[3] is None else m[3].lstrip("-")
        negative = bool(m[1]) if m[3] is None else m[3].startswith("-")
        found = lexemes(raw)
        if found:
            first = found[0][1]
            query[-1].append(([(w, i - first) for w, i in found], negative))
    return [part for part in query if part]


def _phrase_at(phrase: list[tuple[str, int]], places: dict[str, list[int]]) -> list[int]:
    """Positions where a phrase starts."""
    starts = places.get(phrase[0][0], [])
    return [p for p in starts if all(p + off in places.get(w, ()) for w, off in phrase[1:])]


def matches(query: Query, places: dict[str, list[int]]) -> bool:
    return any(all(bool(_phrase_at(p, places)) != negative for p, negative in part) for part in query)


def cover_density(query: Query, places: dict[str, list[int]]) -> float:
    """Sum over the shortest covers of the query, the fewer words between its lexemes the more."""
    wanted = {w for part in query for phrase, negative in part if not negative for w, _ in phrase}
    spots = sorted((p, w) for w in wanted for p in places.get(w, ()))
    total, begin = 0.0, 0
    while begin < len(spots):
        held: dict[str, list[int]] = {}
        end = None
        for i in range(begin, len(spots)):
            held.setdefault(spots[i][1], []).append(spots[i][0])
            if matches([[x for x in part if not x[1]] for part in query], held):
                end = i
                break
        if end is None:
            break
        held, start = {}, begin
        for i in range(end, begin - 1, -1):
            held.setdefault(spots[i][1], []).append(spots[i][0])
            if matches([[x for x in part if not x[1]] for part in query], {w: sorted(p) for w, p in held.items()}):
                start = i
                break
        n = end - start + 1
        noise = spots[end][0] - spots[start][0] - (end - start)
        total += WEIGHT / (1 + (noise if noise >= 0 else (end - start) // 2)) if n else 0.0
        begin = start + 1
    return total


def _places(text: str) -> dict[str, list[int]]:
    found: dict[str, list[int]] = {}
    for w, i in lexemes(text):
        found.setdefault(w, []).append(i)
    return found


def postings(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """lexeme, chunk_id, positions: an inverted index to be kept, partitioned by lexeme."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(w, c, p) for c, t in part.itertuples(index=False) for w, p in _places(t).items()]
            yield pd.DataFrame(rows, columns=["lexeme", "chunk_id", "positions"])

    kind = chunks.schema[id_col].dataType.simpleString()
    return chunks.select(F.col(id_col).alias("chunk_id"), F.col(text_col).alias("text")).mapInPandas(run, f"lexeme string, chunk_id {kind}, positions array<int>")


def _wanted(query: Query) -> list[str]:
    return sorted({w for part in query for phrase, _ in part for w, _ in phrase})


def matched(chunks: DataFrame, text: str, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """chunk_id, rank of the chunks that match, from their texts: one pass without a shuffle, where no index is kept."""
    query = parse_query(text)
    wanted = frozenset(_wanted(query))
    kind = chunks.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, ranks = [], []
            for chunk, said in zip(part.column(0), part.column(1).to_pylist(), strict=True):
                places: dict[str, list[int]] = {}
                for w, i in lexemes(said):
                    if w in wanted:
                        places.setdefault(w, []).append(i)
                if matches(query, places):
                    ids.append(chunk.as_py())
                    ranks.append(cover_density(query, places))
            yield pa.RecordBatch.from_arrays([pa.array(ids, part.schema.field(0).type), pa.array(ranks, pa.float64())], names=["chunk_id", "rank"])

    return chunks.select(F.col(id_col).alias("chunk_id"), F.col(text_col).alias("text")).mapInArrow(run, f"chunk_id {kind}, rank double")


def ranked(index: DataFrame, text: str) -> DataFrame:
    """chunk_id, rank of the chunks that match; only the query's lexemes are read from the index."""
    query = parse_query(text)
    wanted = _wanted(query)
    held = index.where(F.col("lexeme").isin(*wanted)) if wanted else index.limit(0)
    by_chunk = held.groupBy("chunk_id").agg(F.collect_list(F.struct("lexeme", "positions")).alias("p"))  # at most the query's lexemes
    kind = index.schema["chunk_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for c, p in part.itertuples(index=False):
                places = {x["lexeme"]: list(x["positions"]) for x in p}
                if matches(query, places):
                    rows.append((c, cover_density(query, places)))
            yield pd.DataFrame(rows, columns=["chunk_id", "rank"])

    return by_chunk.mapInPandas(run, f"chunk_id {kind}, rank double")
