"""SimHash, line dedup, HTML extraction, quality rules, toxicity and decontamination."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, html_extract, line_dedup, quality, registry, simhash, toxicity
from lodestone.llm.components import connected_components

WORD = r"[^\x20\x09-\x0D]+"

# components and SimHash


def groups(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("links", [[], [(1, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 200)], [(5, 5), (7, 3), (3, 7)]])
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long").repartition(4)
    found = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert found == groups([x for x in links if x[0] != x[1]])


def slow_fingerprint(text):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "a", "A b", "a b c", "É A b c\x85d", "x " * 300 + "y"])
def test_fingerprints(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def brute_components(prints):
    distinct = sorted(set(prints.values()))
    near = [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (a ^ b).bit_count() <= 2]
    found = groups(near)
    least = {}
    for doc, p in prints.items():
        least[found.get(p, p)] = min(least.get(found.get(p, p), doc), doc)
    return {doc: least[found.get(p, p)] for doc, p in prints.items()}


@pytest.mark.parametrize("heavy", [simhash.HEAVY, 3])
def test_links_connect_what_brute_force_connects(spark, heavy):
    rng = np.random.default_rng(3)
    prints = {}
    for c in range(40):
        base = int(rng.integers(0, 2**63))
        for _ in range(25 if c < 4 else 3):
            p = base
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                p ^= 1 << int(b)
            prints[len(prints)] = p
    rows = {}
    for doc, p in prints.items():
        rows.setdefault(p, doc)
    df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p, d) for p, d in rows.items()], "fp long, rep long")
    links = [(r["a"], r["b"]) for r in simhash.links(df, heavy=heavy).collect()]
    assert all((prints[a] ^ prints[b]).bit_count() <= 2 for a, b in links)
    found = groups(links)
    want = brute_components({d: prints[d] for d in rows.values()})
    assert {d: found.get(d, d) for d in rows.values()} == want


def test_thresholds_sum_as_the_principle_asks(spark):
    values = np.random.default_rng(1).integers(0, 2**63, 500).astype("u8")
    df = spark.createDataFrame([(int(v), i) for i, v in enumerate(values)], "fp long, rep long")
    n, both = simhash.together(df)
    bank = simhash.group_bits(n, both)
    assert sorted(b for g in bank for b in g) == list(range(64))
    chosen = simhash.allocate(values[:, None], n, bank, simhash.histograms(df, bank, 2), 2)
    assert (chosen.sum(axis=1) == 2 - len(bank) + 1).all() and chosen.min() >= -1


def test_near_duplicates_of_odd_rows(spark, documents, nothing):
    found = simhash.near_duplicates(documents).collect()
    prints = [(r["doc_id"], slow_fingerprint(r["text"])) for r in documents.select("doc_id", "text").collect()]
    assert Counter((r["doc_id"], r["simhash"] % 2**64) for r in found) == Counter(prints)
    empty = {r["component_id"] for r in found if r["simhash"] == 0}
    assert empty == {3}
    assert simhash.near_duplicates(nothing).count() == 0


def test_near_duplicates_of_the_small_table(spark, small):
    found = {r["doc_id"]: r for r in registry.queries()["op1_simhash_dedup"](spark, small).collect()}
    prints = {d: slow_fingerprint(t) for d, t in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    assert {d: r["fingerprint"] for d, r in found.items()} == {d: format(p, "016x") for d, p in prints.items()}
    assert {d: r["component_id"] for d, r in found.items()} == brute_components(prints)


# lines


def brute_lines(docs):
    """Sequential template tree over unhashed words, leaves in order of their marks."""
    leaves = defaultdict(dict)
    for d, text in docs:
        for k, line in enumerate((text or "").split("\n")):
            words = tuple("<*>" if re.search("[0-9]", w) else w for w in re.findall(WORD, line))
            if len(words) >= 4:
                leaves[len(words), words[:4]].setdefault(words, []).append((d, k))
    gone = set()
    for (n, _), lines in leaves.items():
        bank = []
        for words in sorted(lines):
            alike = [(sum(a == b for a, b in zip(t, words)), -i) for i, (t, _) in enumerate(bank)]
            best = max((x for x in alike if x[0] >= 0.85 * n - 1e-9), default=None)
            if best:
                bank[-best[1]][1].extend(lines[words])
            else:
                bank.append((words, list(lines[words])))
        for _, seen in bank:
            if len({d for d, _ in seen}) > 1:
                gone |= set(seen) - {min(seen)}
    return gone


def test_lines_of_the_small_table(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    gone = brute_lines(docs)
    want = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in docs}
    found = registry.queries()["op4_line_dedup"](spark, small).collect()
    assert {r["doc_id"]: r["text"] for r in found} == want
    assert sum(r["n_dropped"] for r in found) == len(gone)


def test_templates_generalise_variable_fields(spark):
    long = [f"w{c}" for c in "abcdefghijklmnopqrst"]
    varied = [*long[:10], "other", *long[11:]]
    rows = [(1, " ".join(long)), (2, " ".join(varied) + "\nkeep this line of mine here"), (3, "page 7 of the report was read\nshort one"), (4, "page 12 of the report was read\nshort one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate_lines(df).collect()}
    assert found == {1: rows[0][1], 2: "keep this line of mine here", 3: rows[2][1], 4: "short one"}


def test_lines_of_odd_rows(spark, documents, nothing):
    found = line_dedup.deduplicate_lines(documents, counts=True)
    assert found.columns == [*documents.columns, "n_lines", "n_dropped"]
    rows = found.collect()
    assert len(rows) == documents.count()
    texts = {r["doc_id"]: r["text"] for r in rows}
    assert texts[3] is None and texts[4] == "" and texts[2] == "Another line that is its own and long enough."
    assert line_dedup.deduplicate_lines(nothing).count() == 0


# HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><p>Top</p></header>
<nav><ul><li>Menu</ul></nav><div class="cookie-notice">We use cookies</div><div class="layout with-sidebar"><article><header><h1>Head&shy;ing &amp; more</h1></header>
<p>One <b>b</b>old&nbsp;&#8212; text<p>Two<br>lines<script>var t="</p>";</script><table><tr><td>a<td>b</table><aside>aside</aside><form>form</form>
<div class="ad">buy</div><!-- no <p>comment</p> --><section id="comments"><article class="comment">first!</article></section><footer>foot</footer></article></div>
<div id="sidebar">side</div><footer>end</footer></body></html>"""


def test_main_text_of_one_page():
    assert html_extract.Page(PAGE).kept(set()) == "Head­ing & more One bold — text Two lines a b"


@pytest.mark.parametrize(
    ("html", "text"),
    [(None, ""), ("", ""), ("just words", "just words"), ("<p>a<p>b", "a b"), ("<article><p>x &lt; y < z</article>", "x < y < z"), ("<div>a<div class=ad>no", "a"), ("<p>a</p><!-- open", "a"), ("<p title='>'>q</p>", "q"), ("<main>m<article>x</article></main>", "x")],
)
def test_odd_pages(html, text):
    assert html_extract.Page(html).kept(set()) == text


def test_branches_alike_on_a_hosts_pages_are_cut(spark):
    def page(i):
        return f"<body><div class=strip><b>Read our other offers now</b></div><div class=body><p>Text number {i} {'x' * i}</p><p>More of {i * 7}</p></div></body>"

    rows = [(i, f"https://h.example.com/{i}", page(i)) for i in range(12)] + [(99, "https://other.example.com/", page(1)), (100, None, page(2)), (101, "http://h.example.com", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    found = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert found[3] == "Text number 3 xxx More of 21"
    assert found[99] == "Read our other offers now Text number 1 x More of 7"
    assert found[101] == "" and len(found) == len(rows)
    assert html_extract.extract(df.limit(0)).count() == 0


def test_pages_of_the_small_table(spark, small):
    import html as entities

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in registry.queries()["op6_html_extract"](spark, small).collect():
        main = re.search("<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        plain = re.sub("<[^>]+>", "", re.sub("</?(p|h1|br)[^>]*>", "\0", main))
        want = " ".join(x for x in (" ".join(entities.unescape(y).split()) for y in plain.split("\0")) if x)
        assert r["text"] == want and r["n_chars"] == len(want)


# quality


def slow_statistics(text):
    words, seen, dup = re.findall(WORD, text), set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@pytest.mark.parametrize("text", ["", " ", "a b\na b\n\n\n", "x " * 40, "a b c d e f g h " * 3 + "i", "é #$ |<>", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8"])
def test_statistics(text):
    assert quality.measure(text)[:5] == slow_statistics(text)
    assert quality.measure(None) == quality.measure("")


def test_rules_are_found_and_read():
    rng = np.random.default_rng(0)
    rows = {f: rng.random(3000) for f in quality.FEATURES}
    y = 1 - ((rows["upper_share"] > 0.8) | ((rows["symbols_per_word"] > 0.7) & (rows["digit_share"] <= 0.4))).astype(int)
    rules = quality.cover(rows, y)
    hit = np.zeros(3000, bool)
    for rule in rules.rules:
        hit |= quality._covers(list(rule), rows, 3000)
    assert rules.covered == 0 and (hit == (y == 0)).mean() > 0.98
    assert re.search(r"upper_share > 0\.(79|80)", str(rules))


def test_quality_of_odd_rows(spark, documents, nothing):
    docs = quality.add_ratios(quality.add_statistics(documents))
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (4, None)], "doc_id long, quality int")
    rules = quality.learn(documents, labels)
    assert docs.select(quality.verdict(rules).alias("v")).where("v is null").count() == 0
    assert quality.learn(documents, labels.limit(0)) == quality.Rules((), 0, 1)
    assert quality.add_statistics(nothing).count() == 0


def accuracy(spark, folder, query, column, label):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in registry.queries()[query](spark, folder).collect() if r["doc_id"] in labels and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    return sum(int(r[column]) == labels[r["doc_id"]] for r in rows) / len(rows)


def test_quality_of_held_out_documents(spark):
    assert accuracy(spark, "/root/testdata/sf0.1", "op7_quality_rules", "kept", "quality") > 0.93


# toxicity


def test_toxicity_of_held_out_documents(spark):
    assert accuracy(spark, "/root/testdata/sf0.1", "op8_toxicity", "predicted", "toxic") > 0.95


def test_probabilities_sum_to_one():
    words = [Counter({"abba": 3, "cab": 2}), Counter({"bad": 4, "abba": 1})]
    counts, kinds = [], set()
    for c in words:
        seen = Counter()
        for w, n in c.items():
            for s in toxicity.sequences(w):
                seen[s] += n
        counts.append(dict(seen))
        kinds |= set(seen)
    shared = [{} for _ in range(toxicity.ORDER)]
    for order in range(toxicity.ORDER - 1, 0, -1):
        shared[order] = dict(Counter(s[1:] for s in kinds))
        kinds = set(shared[order])
    model = toxicity.KneserNey(counts, shared)
    letters = {s[-1] for c in counts for s in c}
    model.low[""] = 1 / len(letters)
    for before in {s[:-1] for c in counts for s in c}:
        for c in (0, 1):
            assert sum(model.probability(c, before + x) for x in letters) == pytest.approx(1)


def test_toxicity_of_odd_rows(spark, documents, nothing):
    one_class = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    scores = [r["toxicity"] for r in toxicity.add_scores(documents, toxicity.train(documents, one_class)).collect()]
    assert scores == [0.0] * documents.count()
    labels = spark.createDataFrame([(i, int(i > 50)) for i in range(100)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, f"word{i} this is {'vile scum' if i > 50 else 'a fine day'}") for i in range(100)] + [(200, None), (201, "")], "doc_id long, text string")
    model = toxicity.train(docs, labels)
    found = {r["doc_id"]: r["toxicity"] for r in toxicity.add_scores(docs, model).collect()}
    assert all((found[i] >= 0.5) == (i > 50) for i in range(100)) and found[200] == found[201]
    assert toxicity.reject_toxic(docs, model).columns == docs.columns
    assert toxicity.add_scores(nothing, toxicity.train(nothing, labels)).count() == 0


# decontamination

ASKED = "On Friday, the baker Maria sold 12 cakes to the old school, and then she sold 30 kg of bread to Peter for 45 dollars before she went home with Maria."
REPHRASED = "On Friday, the baker Anna sold 17 cakes to the old school, and then she sold 21 kg of bread to Oscar for 99 dollars before she went home with Anna."
MIXED = REPHRASED.replace("with Anna", "with Oscar")


def test_other_numbers_and_names_are_found_if_they_agree(spark):
    bench = spark.createDataFrame([(1, ASKED), (2, None), (3, ""), (4, "too short a one")], "item_id long, text string")
    rows = [(1, f"Intro. {REPHRASED} More."), (2, MIXED), (3, ASKED.upper().lower()), (4, None), (5, ""), (None, ASKED), (6, ASKED), (6, ASKED), (7, "too short a one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash"))
    found = decontaminate.leaking_documents(docs, bench).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"], r["same_values"]) for r in found if r["doc_id"] != 3) == [(0, 1, True), (1, 1, False), (6, 1, True), (6, 1, True)]
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {2, 4, 5, 7} <= {r["doc_id"] for r in kept.collect()}
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(rows)


def test_leaks_of_the_small_table(spark, small):
    def words(text):
        return re.findall(r"[^\W_]+", text.lower())

    windows = {}
    for item, text in spark.read.parquet(f"{small}/benchmark.parquet").collect():
        w = words(text)
        for i in range(len(w) - 7):
            windows.setdefault(tuple(w[i : i + 8]), set()).add((item, i))
    want = set()
    for doc, text in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect():
        w, seen = words(text), defaultdict(set)
        for i in range(len(w) - 7):
            for item, at in windows.get(tuple(w[i : i + 8]), ()):
                seen[item].add(at)
        want |= {(doc, item) for item, at in seen.items() if len(at) >= 5}
    found = {(r["doc_id"], r["item_id"]) for r in registry.queries()["op9_decontaminate"](spark, small).collect()}
    assert found == want


def test_pipeline(spark, small):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_dedup", "decontaminate", "sentencepiece"]
    rows = corpus_pipeline.run(spark, small).collect()
    assert 0 < len(rows) <= 200 and all(r["round_trip"] and r["ids"][-1] == 2 for r in rows)


def shingles(text):
    words = (text or "").lower().split()
    k = min(5, len(words))
    return {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def test_similar_texts_are_grouped_and_others_are_not(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = {}
    for base in range(40):
        words = list(rng.choice(vocabulary, int(rng.integers(60, 700))))
        texts[len(texts)] = " ".join(words)
        for copy in range(30 if base == 0 else 2):
            edited = list(words)
            for _ in range(1 + copy % 4 if len(words) > 150 else 1):
                edited[int(rng.integers(0, len(words)))] = "changed"
            texts[len(texts)] = " ".join(edited)
    texts |= {1000: None, 1001: "", 1002: "a b", 1003: "a b", 1004: texts[0]}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("lo", F.lit("clash"))
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df).collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    alike = {(a, b): len(sets[a] & sets[b]) / max(len(sets[a] | sets[b]), 1) for a in texts for b in texts if a < b}
    near = groups([p for p, j in alike.items() if j >= 0.8])
    missed = sum(found[a] != found[b] for (a, b), j in alike.items() if j >= 0.8)
    assert missed <= 0.05 * sum(j >= 0.8 for j in alike.values())
    assert all(found[a] != found[b] for (a, b), j in alike.items() if j < 0.3 and sets[a] and near.get(a) != near.get(b))
    assert found[1001] == 1000 and found[1003] == 1002 and found[1004] == 0
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == set(found.values())
    assert simhash.similar_documents(df.limit(0)).count() == 0
    whole, part = simhash.wide_fingerprint(texts[0]), simhash.wide_fingerprint(texts[1])
    assert abs(simhash.similarity(whole[3], part[3], whole[2], part[2]) - alike[0, 1]) < 0.1


def test_large_leaves_are_dealt_and_matched_again(spark, monkeypatch):
    words = [f"w{i:c}" for i in range(ord("a"), ord("z"))] * 2
    rows = []
    for i in range(40):
        edited = list(words)
        edited[8 + i] = "edited"
        rows.append((i, " ".join(edited)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(line_dedup, "LEAF", 7)
    found = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate_lines(df).collect()}
    assert found == {0: rows[0][1]} | {i: "" for i in range(1, 40)}
