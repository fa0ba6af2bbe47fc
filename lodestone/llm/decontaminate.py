"""Benchmark decontamination by templates, with columns and joins only.

Texts become templates: a number is one kind of placeholder, a unit after a
number another, a capitalised word inside a sentence (a name) a third; letters
are lowered and punctuation goes.  Windows of ``WINDOW`` template words are
hashed and joined with the benchmark's.  A match is an alignment of a document
with an item; it counts only if its placeholders agree one to one (each value of
the item stands for the same value of the document throughout), so that the same
question with other numbers and names is found, and an accidental likeness of
shapes is not.  An item of which every window is mostly placeholders is told by
its words, values included.  A document leaks an item if the windows of its consistent
alignments reach ``needed`` of the item's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, unused

#: Template words in a window, words that an item needs, placeholders that a window may have.
WINDOW, LEAST_WORDS, MOST_SLOTS = 8, 5, 4
#: Windows that a leak needs: this share of the item's, but no more than the second number (12 words in a row).
SHARE, ENOUGH = 0.3, 5
#: Benchmark windows up to this many (some 20 bytes each) are broadcast; beyond it they are joined by hash.
BROADCAST_ROWS = 500_000

#: Units of measure, money and time, as they follow a number.
UNITS = (
    "km|cm|mm|m|kg|mg|g|lb|lbs|oz|l|ml|ft|in|mi|mph|kmh|h|hr|hrs|min|mins|s|sec|secs|ms|hz|khz|mhz|ghz|w|kw|v|pa|kpa|j|kj|cal|kcal|mol|"
    "meters?|metres?|kilometers?|kilometres?|centimeters?|centimetres?|miles?|feet|foot|inch|inches|yards?|acres?|grams?|kilograms?|pounds?|ounces?|tons?|tonnes?|"
    "liters?|litres?|gallons?|hours?|minutes?|seconds?|days?|weeks?|months?|years?|dollars?|cents?|euros?|usd|eur|gbp|percent|degrees?"
)
NUMBER, UNIT, NAME = "\ue000", "\ue001", "\ue002"
MARKS = f"[{NUMBER}{UNIT}{NAME}]"


def templates(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``words``, lowered, without punctuation, a placeholder's mark before its value, and ``template``, without the values.

    Both are words joined by spaces.  Each step is a column of its own, so that
    nothing is worked out twice, and the rarer ones run where a text needs them.
    Null is no words.
    """
    t = F.col("__t")
    odd = F.contains(t, F.lit(NUMBER)) | F.contains(t, F.lit(UNIT)) | F.contains(t, F.lit(NAME))
    found = rows.withColumn("__t", F.coalesce(text_col, F.lit("")))
    found = found.withColumn("__t", F.when(odd, F.translate(t, NUMBER + UNIT + NAME, "   ")).otherwise(t))
    found = found.withColumn("__t", F.when(t.rlike(r"\p{Nd}[.,:]\p{Nd}"), F.regexp_replace(t, r"(?<=\p{Nd})[.,:](?=\p{Nd})", "")).otherwise(t))
    named = F.regexp_replace(t, r"([\p{Ll}\p{N},;:] )(?=\p{Lu}\p{Ll})", f"$1{NAME}")
    found = found.withColumn("__t", F.trim(F.regexp_replace(F.lower(named), rf"[^\p{{L}}\p{{M}}\p{{N}}{NUMBER}{UNIT}{NAME}]+", " ")))
    counted = F.regexp_replace(t, r"(?<![^ ])(?=\p{Nd}+(?![^ ]))", NUMBER)
    counted = F.regexp_replace(counted, rf"(?<={NUMBER}\p{{Nd}}{{1,18}} )(?=(?:{UNITS})(?![^ ]))", UNIT)
    found = found.withColumn("words", F.when(t.rlike(r"\p{Nd}"), counted).otherwise(t)).drop("__t")
    return found.withColumn("template", F.when(F.col("words").rlike(MARKS), F.regexp_replace("words", f"({MARKS})[^ ]*", "$1")).otherwise(F.col("words")))


def _split(words: str) -> Column:
    return F.when(F.col(words) == "", F.array().cast("array<string>")).otherwise(F.split(words, " "))


def _windows(hashes: Column, size: int) -> Column:
    """Hash and place of every window of ``size`` words, from the words' hashes."""
    last = F.size(hashes) - size
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.xxhash64(F.slice(hashes, i + 1, F.lit(size))).alias("hash"), i.alias("at")))
    return F.when(last >= 0, each).otherwise(F.array().cast("array<struct<hash:bigint,at:int>>"))


def _hashes(template: str) -> Column:
    return F.transform(_split(template), lambda w: F.xxhash64(w))


def _plain_hashes() -> Column:
    """Of the words without marks, as a name's depends on the word before it."""
    return F.transform(_split("words"), lambda w: F.xxhash64(F.translate(w, NUMBER + UNIT + NAME, "")))


def _values(words: Column, at: Column, size: Column) -> Column:
    """The values of the placeholders in a window."""
    return F.filter(F.slice(words, at + 1, size), lambda w: w.rlike(f"^{MARKS}"))


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, size, needed, exact, hash, at, values: the windows that can tell an item; items shorter than a window are one window.

    Where none can by its template, all of them do by their words (``exact``),
    and have no values to compare.  Items alike in words and values are one, under their smallest id; items
    without enough words are none.
    """
    texts = templates(benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))).groupBy("words", "template").agg(F.min("item").alias("item"))
    items = texts.select("item", _split("words").alias("words"), _hashes("template").alias("hashes"), _plain_hashes().alias("exact_hashes"))
    items = items.where(F.size("words") >= LEAST_WORDS).withColumn("size", F.least(F.lit(WINDOW), F.size("words")))

    def windows(hashes: str) -> DataFrame:
        each = F.coalesce(*[F.when(F.col("size") == k, _windows(F.col(hashes), k)) for k in range(LEAST_WORDS, WINDOW + 1)])
        return items.withColumn("w", F.explode(each)).select("item", "size", "w.hash", "w.at", _values(F.col("words"), F.col("w.at"), F.col("size")).alias("values"))

    telling = windows("hashes").where(F.size("values") <= F.least(F.lit(MOST_SLOTS), F.floor(F.col("size") / 2))).withColumn("exact", F.lit(False))
    exact = windows("exact_hashes").join(telling.select("item").distinct(), "item", "left_anti").withColumn("values", F.array().cast("array<string>")).withColumn("exact", F.lit(True))
    telling = telling.unionByName(exact)
    counts = telling.groupBy("item").agg(F.least(F.lit(ENOUGH), F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * SHARE))).cast("int").alias("needed"))
    return telling.join(counts, "item")


def text_key(text: str) -> Column:
    """Tells texts apart: two hashes of 64 bits."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """key, item, windows, needed, same_values: the items that each text (key: its hashes) leaks.

    Texts are hashed once, copies of a text are one; what is shuffled are the
    few windows that the benchmark has, and the texts that have any.
    """
    items = materialize(benchmark_windows(benchmark), "benchmark-windows")
    hashes = items.select("hash").distinct()
    n = hashes.count()
    sizes = sorted((r[0], r[1]) for r in items.select("size", "exact").distinct().collect())  # 2 (WINDOW - LEAST_WORDS + 1) at most
    texts = docs.select(text_key("text").alias("key"), "text")
    exact = [_plain_hashes().alias("exact_hashes")] if any(e for _, e in sizes) else []
    prepared = templates(texts).select("key", _hashes("template").alias("hashes"), *exact)
    every = F.concat(*[_windows(F.col("exact_hashes" if e else "hashes"), k) for k, e in sizes]) if sizes else F.array().cast("array<struct<hash:bigint,at:int>>")
    # not explode(): Spark would filter by the array's size first and, doing so, work the hashes out again for every window
    windows = prepared.select("key", F.explode_outer(every).alias("w")).select("key", "w.hash", "w.at")
    met = materialize(windows.join(F.broadcast(hashes) if n <= BROADCAST_ROWS else hashes, "hash", "left_semi").distinct(), "met-windows")
    # candidates with too few windows for any alignment go before texts are read again
    pairs = met.join(items.withColumnRenamed("at", "item_at").withColumnRenamed("values", "item_values"), "hash")
    aligned = pairs.groupBy("key", "item", "needed", "size", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.collect_set(F.struct("at", "item_at", "item_values")).alias("w"))  # at most an item's windows
    total = aligned.groupBy("key", "item").agg(F.sum(F.size("w")).alias("n"))
    aligned = materialize(aligned.join(total, ["key", "item"]).where("n >= needed").drop("n"), "aligned")
    slots = F.exists("w", lambda x: F.size(x["item_values"]) > 0)
    plain = aligned.where(~slots).select("key", "item", "needed", F.size("w").alias("windows"), F.lit(True).alias("same"))
    held = aligned.where(slots)
    by_text = held.groupBy("key").agg(F.collect_list(F.struct("item", "needed", "size", "w")).alias("a"))
    owners = texts.join(by_text.select("key"), "key", "left_semi").dropDuplicates(["key"])
    owners = templates(owners).select("key", _split("words").alias("words"))
    filled = owners.join(by_text, "key").select(
        "key",
        F.explode(
            F.transform(
                "a",
                lambda a: F.struct(
                    a["item"].alias("item"),
                    a["needed"].alias("needed"),
                    F.size(a["w"]).alias("windows"),
                    F.array_distinct(F.flatten(F.transform(a["w"], lambda x: F.arrays_zip(x["item_values"].alias("b"), _values(F.col("words"), x["at"], a["size"]).alias("d"))))).alias("slots"),
                ),
            )
        ).alias("x"),
    ).select("key", "x.*")
    n_pairs, n_from, n_to = F.size("slots"), F.size(F.array_distinct(F.col("slots.b"))), F.size(F.array_distinct(F.col("slots.d")))
    one_to_one = filled.where((n_pairs == n_from) & (n_pairs == n_to)).select("key", "item", "needed", "windows", F.forall("slots", lambda s: s["b"] == s["d"]).alias("same"))
    found = plain.unionAll(one_to_one).groupBy("key", "item", "needed").agg(F.sum("windows").alias("windows"), F.bool_and("same").alias("same_values"))
    return found.where("windows >= needed").select("key", "item", "windows", "needed", "same_values")


def leaking_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, item_id, windows, needed, same_values for every document and item that it leaks.

    Null and empty texts leak nothing; repeated rows are reported as often as
    they are there; documents without an id are reported with a null one.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    found = materialize(leaks(rows, benchmark), "leaks")
    keyed = rows.select(F.col("__id").alias(id_col), text_key("text").alias("key"))
    return keyed.join(found, "key").select(id_col, F.col("item").alias("item_id"), "windows", "needed", "same_values")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text leaks no item, unchanged."""
    found = materialize(leaks(docs.select(F.col(text_col).alias("text")), benchmark).select("key").distinct(), "leaking")
    [key] = unused(docs, "key")
    return docs.withColumn(key, text_key(text_col)).join(found.withColumnRenamed("key", key), key, "left_anti").drop(key)
