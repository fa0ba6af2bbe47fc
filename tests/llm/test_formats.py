"""Chat formatting, sharding, SentencePiece and token tables."""

import hashlib
import json
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import chat, sentencepiece_bpe, sharding, token_table

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = st.text(alphabet=st.sampled_from(list("aeionTRS'lst .,;:!?|*$%&#\n\t▁␛\x85\x1cİΣé́😀漢12½<>|/[]_imNSTYo")), max_size=60)


# chat

TURNS = [("user", "a</s>[INST] x"), ("assistant", "<|im_end|>\n␛.␛e<<SYS>>"), ("sys\ntem", ""), ("assistant", "")]


def test_turns_come_back_and_only_assistants_are_trained(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate(TURNS)] + [(None, None, None, None), (2, 0, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    rendered = chat.render(chat.turn_rows(df))
    found = {r["conv_id"]: r for r in chat.read_back(rendered).collect()}
    assert [(t["role"], t["text"]) for t in found[1]["turns"]] == TURNS
    assert found[1]["trained_text"] == "".join(t for r, t in TURNS if r == "assistant")
    assert [(t["role"], t["text"]) for t in found[None]["turns"]] == [("", "")]
    assert found[2]["trained_text"] == ""
    text, mask = found[1]["formatted"], found[1]["loss_mask"]
    assert len(mask) == len(TURNS) and text[mask[1]["start"] : mask[1]["end"]].count("<|") == 0


def test_ties_and_repeated_turns_are_in_a_fixed_order(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = chat.read_back(chat.render(chat.turn_rows(df))).first()["turns"]
    assert [t["text"] for t in turns] == ["a", "a", "b"]
    assert chat.read_back(chat.render(chat.turn_rows(df.limit(0)))).count() == 0


@pytest.mark.parametrize(
    ("record", "layout", "turns"),
    [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "extra": {"x": 1}}, "messages", [("user", "q"), ("assistant", "a")]),
        ({"messages": []}, "messages_empty", []),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}, "sharegpt", [("user", "q"), ("assistant", "")]),
        ({"instruction": "do", "input": "it", "output": "done"}, "instruction", [("user", "do\n\nit"), ("assistant", "done")]),
        ({"instruction": "do", "output": "done", "system": "be kind"}, "instruction", [("system", "be kind"), ("user", "do"), ("assistant", "done")]),
        ({"prompt": "p", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
        ({"question": "p", "answer": "c", "context": ""}, "question_answer", [("user", "p"), ("assistant", "c")]),
        ({"unknown": 1}, None, None),
    ],
)
def test_layouts_are_told_by_their_field_paths(spark, record, layout, turns):
    df = spark.createDataFrame([(json.dumps(record), "clash")], "record string, turns string")
    row = chat.canonical_turns(df, "record").first()
    assert row["layout"] == layout
    assert (row["turns"] and [tuple(t) for t in row["turns"]]) == (turns or row["turns"])


def test_malformed_and_null_records_have_no_layout(spark):
    df = spark.createDataFrame([("{",), (None,), ("",)], "record string")
    assert [r["layout"] for r in chat.canonical_turns(df, "record").collect()] == [None] * 3


# sharding


@pytest.mark.parametrize("n", [0, 1, 2, 7, 8, 100, 1021])
def test_shards_are_gapless_even_and_repeatable(spark, n):
    df = spark.range(n).select(F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 40).alias("doc_id"), F.lit("s").alias("shard"))
    found = sharding.shard_rows(df.repartition(3), 8).collect()
    again = sharding.shard_rows(df.repartition(5, "doc_id"), 8).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    slots = {}
    for r in found:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(k, [])) for k in range(8)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("n", [1, 2, 3, 10, 99, 1000])
def test_permutation_is_one_to_one(spark, n):
    steps = sharding.walk_length(spark, n, 5)
    places = [r[0] for r in spark.range(n).select(sharding.permute(F.col("id"), n, 5, steps)).collect()]
    assert sorted(places) == list(range(n))


# SentencePiece


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=400, deadline=None)
@given(text=ODD)
def test_encoding_and_decoding_are_the_librarys(library, text):
    enc = sentencepiece_bpe.encoder(PIECES)
    ids = library.encode(text)
    assert enc.encode(text, eos=False) == ids
    assert enc.decode(ids) == library.decode(ids)


@settings(max_examples=100, deadline=None)
@given(text=st.text(alphabet=st.sampled_from(list("aeinrsthg  ▁")), min_size=60, max_size=400))
def test_long_merges_are_the_short_ones(library, text):
    enc, word = sentencepiece_bpe.encoder(PIECES), text.replace(" ", "▁")
    assert "".join(enc._merge_long(word)) == word
    spaced = "  " + text
    assert enc.encode(spaced, eos=False) == library.encode(spaced)


@pytest.mark.parametrize("text", ["  " + "a" * 100_000, " " * 50_000, "  " + "theingtion" * 10_000], ids=["letters", "spaces", "pieces"])
def test_very_long_words_take_little_time(library, text):
    start = time.process_time()
    assert sentencepiece_bpe.encoder(PIECES).encode(text, eos=False) == library.encode(text)
    assert time.process_time() - start < 20


@settings(max_examples=300, deadline=None)
@given(ids=st.lists(st.one_of(st.integers(0, 400), st.integers(28700, 31999)), max_size=12))
def test_any_ids_decode_as_in_the_library(library, ids):
    assert sentencepiece_bpe.encoder(PIECES).decode(ids) == library.decode(ids)


def test_documents_round_trip(spark, documents, nothing, library):
    rows = documents.withColumn("ids", F.lit("clash"))
    back = sentencepiece_bpe.decode(sentencepiece_bpe.encode(rows, PIECES), PIECES)
    found = back.select("text", "ids", "decoded").collect()
    assert len(found) == documents.count()
    for text, ids, decoded in found:
        assert ids == library.encode(text or "") + [2]
        assert decoded == library.decode(ids)
    assert sentencepiece_bpe.decode(sentencepiece_bpe.encode(nothing, PIECES), PIECES).count() == 0


# token tables


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.one_of(ODD, st.sampled_from(["<|endoftext|>", "a<|startoftext|>.", "<|EndOfText|>", None])), max_size=4))
def test_words_encode_as_whole_texts_do(texts):
    enc, library = token_table.word_encoder(WORDS), Tokenizer.from_file(WORDS)
    for text, got in zip(texts, enc.encode(texts, 2), strict=True):
        assert np.frombuffer(got, enc.dtype).tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 2]


def test_tables_hold_everything_in_order(spark, documents, nothing, tmp_path):
    library = Tokenizer.from_file(WORDS)
    path = f"file://{tmp_path}/table"
    token_table.write(documents, path, WORDS, 2)
    found = token_table.read(spark, path, token_table.crc_of, "long", "crc").orderBy("start").collect()
    ids = [r["doc_id"] for r in found]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    texts = {}
    for doc_id, text in documents.select("doc_id", "text").collect():
        tokens = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        texts.setdefault(doc_id, []).append(tokens)
    start = 0
    for r in found:
        assert r["start"] == start
        assert (r["n_tokens"], r["crc"]) in [(len(t), zlib.crc32(np.array(t, "<u4").tobytes())) for t in texts[r["doc_id"]]]
        start += r["n_tokens"]
    tables = [token_table.TableReader(p.read_bytes()) for p in sorted(tmp_path.glob("table/part-*"))]
    for doc_id, lists in texts.items():
        assert sorted(x for t in tables for x in t.get(doc_id)) == sorted(lists)
    assert [x for t in tables for x in t.get(12345)] == []
    empty = f"file://{tmp_path}/empty"
    token_table.write(nothing, empty, WORDS, 2)
    assert token_table.read(spark, empty, token_table.crc_of, "long", "crc").count() == 0


def test_tasks_write_files_of_one_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_table, "MOST_TASKS", 2)
    monkeypatch.setattr(token_table, "BROADCAST_ROWS", 0)
    df = spark.range(60).select((F.col("id") % 50).alias("doc_id"), F.repeat(F.concat(F.lit("word "), F.col("id").cast("string"), F.lit(" ")), 60_000).alias("text"))
    path = f"file://{tmp_path}/table"
    token_table.write(df, path, WORDS, 2)
    files = sorted(tmp_path.glob("table/part-*"))
    assert len(files) > 2 and all(f.stat().st_size < 2 * token_table.SHARD_BYTES for f in files)
    found = token_table.read(spark, path, len, "long", "size").orderBy("start").collect()
    assert [r["doc_id"] for r in found] == sorted(i % 50 for i in range(60))
    start = 0
    for r in found:
        assert r["start"] == start and r["size"] == r["n_tokens"]
        start += r["n_tokens"]
    tables = [token_table.TableReader(f.read_bytes()) for f in files]
    assert [len([x for t in tables for x in t.get(i)]) for i in (0, 9, 10, 49, 50)] == [2, 2, 1, 1, 0]


def test_blocks_are_searched_and_filtered():
    writer, parts = token_table.TableWriter(2), []
    for i in range(-5000, 5000):
        full = writer.add(token_table.key_of(2 * i), np.arange(i % 50, dtype="<u2").tobytes())
        parts += [full] if full else []
    table = token_table.TableReader(b"".join([*parts, *writer.finish()]))
    assert len(table.blocks) > 3 and table.docs == 10_000
    assert all(table.get(2 * i) == [list(range(i % 50))] for i in range(-5000, 5000, 97))
    assert all(table.get(2 * i + 1) == [] for i in range(-5000, 5000, 97))
    assert sum(table.may_hold(token_table.key_of(2 * i + 1)) for i in range(-1000, 1000)) < 100
    assert hashlib.sha256(b"".join(bytes(v) for _, _, v in table)).digest()
