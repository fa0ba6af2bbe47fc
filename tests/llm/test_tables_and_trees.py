"""Layouts of tables, and the site style tree on pages that are large, deep or left open."""

import time

import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat, html_extract


def said(spark, df):
    return {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.read_back(chat.render(chat.turn_rows(df))).collect()}


def test_the_schemas_fingerprint_selects_the_tables_mapping(spark):
    want = {1: [("user", "q"), ("assistant", "a")], 2: [("user", "")]}
    rows = spark.createDataFrame([(1, 1, "assistant", "a", "x"), (1, 0, "user", "q", "y"), (2, 0, "user", None, "z")], "conv_id long, turn long, role string, text string, content string")
    assert said(spark, rows) == want
    named = rows.select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("message_index"), "role", F.col("text").alias("content"), F.lit("clash").alias("n"))
    assert said(spark, named) == want
    lists = spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")]), (2, [("user", None)]), (3, []), (4, None)], "conv_id long, turns array<struct<role:string,text:string>>")
    assert said(spark, lists) == want
    messages = spark.createDataFrame([(1, [("user", "q", 1), ("assistant", "a", 2)]), (2, [("user", None, 3)])], "conversation_id long, messages array<struct<role:string,content:string,extra:int>>")
    assert said(spark, messages) == want


@pytest.mark.parametrize("schema", ["conv_id long, turn long, role string", "conv_id long, turns array<string>", "a int", "conv_id long, turns array<struct<role:string>>"])
def test_unknown_tables_are_refused(spark, schema):
    with pytest.raises(ValueError, match="no layout"):
        chat.turn_rows(spark.createDataFrame([], schema))


def test_every_table_has_a_fingerprint_of_its_own():
    assert len(chat.TABLE_OF) == len(chat.TABLES)
    layout = chat.TABLES[2]
    assert chat.schema_paths(chat.T._parse_datatype_string("conv_id long, turns array<struct<role:string,text:string>>, x struct<y:int>")) == {*layout.paths, "x", "x.y"}


def test_a_very_long_conversation_is_formatted_whole(spark):
    df = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("<s>"), F.repeat(F.col("id").cast("string"), 50)).alias("text"))
    row = chat.read_back(chat.render(chat.turn_rows(df))).first()
    assert [t["text"] for t in row["turns"]] == ["<s>" + str(i) * 50 for i in range(3000)]
    assert row["trained_text"] == "".join("<s>" + str(i) * 50 for i in range(1, 3000, 2))


DEEP = 50_000


@pytest.mark.parametrize(
    "html",
    [
        "<a " * 350_000, "<![CDATA[" * 120_000, "<!--" * 250_000, "< " * 500_000, '<a title="' * 100_000 + ">x", "<p " + "x" * 10**6, "<script>" + "</script " * 100_000,
        "<div>" * DEEP + "x", "<b>x" * DEEP, "<p><table><tr><td>" + "<div>" * DEEP + "x" + "</i>" * DEEP, "<ul>" + "<li><div>" * DEEP, "<p>" + "<span>" * DEEP + "<div>x" * 1000,
    ],
    ids=lambda h: h[:12],
)
def test_open_and_deep_pages_take_time_in_proportion(html):
    start = time.process_time()
    html_extract.Page(html).kept(set())
    assert time.process_time() - start < 10


def test_what_is_left_open_ends_with_the_page():
    kept = lambda html: html_extract.Page(html).kept(set())
    assert kept("<p>a</p><a href") == "a"
    assert kept("<p>a <![CDATA[b<c]]> d</p><![CDATA[e") == "a b<c d"
    assert kept('<p>a</p><p title="x>b</p><p>c</p>') == "a b c"


def page(i):
    """Furniture without any label, also inside the article; labelled furniture; a text of its own."""
    words = " ".join(f"w{i}x{k}" for k in range(30))
    return f"<body><nav>menu {i}</nav><div class=strip><b>Read our other offers now</b></div><article><h1>Title {i}</h1><p>{words}</p><div><i>All rights are with the house</i></div></article><footer>foot {i}</footer></body>"


@pytest.fixture(scope="module")
def site(spark):
    rows = [(i, f"https://h.example.com/{i}", page(i)) for i in range(40)] + [(99, "https://few.example.com/", page(99))]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_importance_cuts_unlabelled_furniture(spark, site):
    with_tree = {r["page_id"]: r["text"] for r in html_extract.extract(site).collect()}
    without = {r["page_id"]: html_extract.Page(r["html"]).kept(set()) for r in site.collect()}
    assert all(with_tree[i] == without[i].replace(" All rights are with the house", "") != without[i] for i in range(40))
    assert with_tree[99] == without[99]


def test_every_branch_is_scored(spark, site):
    found = html_extract.branches(site.select(F.lit("h").alias("host"), "html")).collect()
    low = [r for r in found if r["importance"] < html_extract.THRESHOLD]
    assert len(found) == 6 and len(low) == 4
    assert sorted(r["prior"] for r in low) == [html_extract.FURNITURE, html_extract.FURNITURE, html_extract.UNLABELLED, html_extract.ARTICLE]
    assert all(r["m"] == 41 for r in found)


def test_copies_of_pages_keep_their_text(spark):
    rows = [(i, "https://h.example.com/", page(7)) for i in range(30)]
    found = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in found} == {html_extract.Page(page(7)).kept(set())}
