"""Items of a benchmark that are mostly numbers and names."""

import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontaminate

ITEMS = [
    (1, "Compute 12 + 7 - 3 * 4 / 2"),
    (2, "the Tale Of Two Old Cities And One River"),
    (3, "sum 1 2 3 4 5 6 7 8 9 10 11 12 13 14"),
    (4, "how many apples are left in the basket"),
]


@pytest.mark.parametrize("item", range(len(ITEMS)))
def test_verbatim_copies_of_every_item_are_found(spark, item):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(1, ITEMS[item][1]), (2, f"before it, {ITEMS[item][1]}. and after it"), (3, "compute 9 8 7 6 1 or something else"), (4, "sum 2 4 6 8 10 12 14 16 18 20 22")]
    found = decontaminate.leaking_documents(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert {(r["doc_id"], r["item_id"], r["same_values"]) for r in found.collect()} == {(d, ITEMS[item][0], True) for d in (1, 2)}


def test_items_that_templates_tell_are_not_matched_by_words(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert {r["item"] for r in decontaminate.benchmark_windows(bench).where(F.col("exact")).collect()} == {1, 2, 3}
