"""The corpus pipeline: each stage on odd rows, and the whole against plain Python."""

import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import toxicity
from test_filters import brute_lines
from test_similar import brute

ODD = [
    (1, "a common line of several words\nfirst text of its own with many words in it", "en", "a", 1),
    (2, "a common line of several words\nsecond text that is not like any other one", "en", "a", 2),
    (2, "a common line of several words\nsecond text that is not like any other one", "en", "a", 2),
    (3, None, None, None, None),
    (4, "", "de", "b", 0),
    (5, " \n\t", "de", "b", 3),
    (None, "a text without an id that nothing else is like", "fr", "c", None),
    (6, "word " * 60_000, "fr", "c", 300_000),
    (7, "Ünïcödé 😀 ␛ ▁ \u0000", None, "c", 9),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, COLUMNS)
    return rows.withColumns({n: F.lit("clash") for n in ("key", "__key", "__toxicity", "digest", "component_id", "line", "__gone", "ids")})


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES[:-1], ids=lambda x: x if isinstance(x, str) else "")
def test_stages_keep_odd_rows(spark, small, odd, name, stage):
    found = stage(spark, odd, small)
    assert found.columns == odd.columns
    rows = found.collect()
    assert all(r["key"] == r["__key"] == r["__toxicity"] == r["digest"] == r["__gone"] == r["ids"] == "clash" for r in rows)
    ids = Counter(r["doc_id"] for r in rows)
    texts = {r["doc_id"]: r["text"] for r in rows}
    if name == "simhash_dedup":  # null, empty and blank texts are alike
        assert ids == Counter([1, 2, 2, 3, None, 6, 7])
    else:
        assert ids == Counter([r[0] for r in ODD])
        assert texts[3] is None and texts[4] == "" and texts[7] == ODD[-1][1]
    if name == "line_dedup":
        assert texts[1] == ODD[0][1] and texts[2] == "second text that is not like any other one" and {r["n_chars"] for r in rows if r["doc_id"] == 2} == {len(texts[2])}
    else:
        assert texts[2] == ODD[1][1]


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES, ids=lambda x: x if isinstance(x, str) else "")
def test_stages_take_empty_tables(spark, small, odd, name, stage):
    assert stage(spark, odd.limit(0), small).count() == 0


def test_the_last_stage_encodes_odd_rows(spark, small, odd):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = corpus_pipeline.tokenize(spark, odd, small).collect()
    assert Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"])) for r in found) == Counter((d, len(e) + 1, (*e, 2)) for d, e in ((r[0], library.encode(r[1] or "")) for r in ODD))


def test_the_whole_pipeline_is_what_its_steps_give(spark, small):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] for r in toxicity.add_scores(docs, model).collect() if r["toxicity"] < 0.5}
    gone = brute_lines(texts.items())
    texts = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in texts.items()}
    least = brute(texts)
    texts = {d: t for d, t in texts.items() if least[d] == d}
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    windows = defaultdict(set)
    for item, text in spark.read.parquet(f"{small}/benchmark.parquet").collect():
        w = words(text)
        for i in range(len(w) - 7):
            windows[tuple(w[i : i + 8])].add((item, i))
    for d, t in list(texts.items()):
        w, seen = words(t), defaultdict(set)
        for i in range(len(w) - 7):
            for item, at in windows.get(tuple(w[i : i + 8]), ()):
                seen[item].add(at)
        if any(len(at) >= 5 for at in seen.values()):
            del texts[d]
    want = {d: (*library.encode(t), 2) for d, t in texts.items()}
    found = corpus_pipeline.run(spark, small).collect()
    assert {r["doc_id"]: tuple(r["ids"]) for r in found} == want and len(found) == len(want)
    assert all(r["n_tokens"] == len(r["ids"]) and r["round_trip"] == (library.decode(list(r["ids"][:-1])) == texts[r["doc_id"]]) for r in found)
