"""Texts, dates, indicators, vectors and full-text search."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import schema
from lodestone.functions import fts, indicators, providers, text, vectors


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return df.select(column).first()[0]


@pytest.mark.parametrize(("raw", "clean"), [("a\0b", "ab"), ("a\tb\nc", "a\tb\nc"), ("a\r\nb", "a\nb"), ("a\x07b\x85\x7f", "ab"), ("é", "é"), (None, None)])
def test_control_characters_go(spark, raw, clean):
    assert one(spark, text.clean_text(F.col("x")), x=raw) == clean


@pytest.mark.parametrize(("raw", "least"), [("", 0), ("one two three four five", 5), ("x" * 40, 10)])
def test_tokens_are_words_or_quarters_of_characters(spark, raw, least):
    assert one(spark, text.approx_tokens(F.col("x")), x=raw) == least


@pytest.mark.parametrize(
    ("raw", "found"),
    [
        ("seen on 2026-07-09 in the logs", "2026-07-09 00:00:00"), ("2026-07-09, 2025-01-02 and 2027-03-04", "2025-01-02 00:00:00"), ("at 2026-07-09T10:30:00+02:00 sharp", "2026-07-09 10:30:00"),
        ("at 2026-07-09 10:30 today", "2026-07-09 10:30:00"), ("time 10:30, version 1.2.3", None), ("2026-13-45 and 1969-12-31 and 2101-01-01", None), (None, None),
    ],
)
def test_earliest_date(spark, raw, found):
    got = one(spark, text.earliest_date(F.col("x")), x=raw)
    assert (got and got.strftime("%Y-%m-%d %H:%M:%S")) == found


@pytest.mark.parametrize(("raw", "plain"), [("hxxps://evil[.]example[.]com/a", "https://evil.example.com/a"), ("10.1.2.3", "10.1.2.3"), ("bob[at]mail[dot]org", "bob@mail.org"), ("a(dot)b{dot}c[:]1 x(at)y", "a.b.c:1 x@y")])
def test_defanged_text_is_restored(spark, raw, plain):
    assert one(spark, text.refang(F.col("x")), x=raw) == plain


REPORT = "Traffic to 203[.]0[.]113[.]9 and hxxps://bad[.]evil-site[.]com:8080/x?q=1#f, mail ops[@]evil-site[.]com, hash " + "AB" * 32 + ", CVE-2024-12345 via AS64500."


def test_a_report_has_one_of_each():
    found = {}
    for kind, value, *_ in indicators.extract(REPORT):
        found.setdefault(kind, set()).add(value)
    assert found == {"ip": {"203.0.113.9"}, "url": {"https://bad.evil-site.com/x?q=1"}, "email": {"ops@evil-site.com"}, "domain": {"evil-site.com"}, "sha256": {"ab" * 32}, "cve": {"CVE-2024-12345"}, "asn": {"AS64500"}}


@pytest.mark.parametrize(
    ("raw", "kinds"),
    [("a" * 32 + " " + "b" * 40, {"md5", "sha1"}), ("see file.unknowntld at 10:30:15", set()), ("std::vector", {"ipv6"}), ("01.2.3.4", set()), ("cve-2024-1234 as123", set()), ("00-1A-2b-3C-4d-5E", {"mac"}), ("2001:DB8::1", {"ipv6"}), ("https://a.b/", {"url"})],
)
def test_kinds(raw, kinds):
    assert {k for k, *_ in indicators.extract(raw)} == kinds


def test_spans_are_bytes_of_the_refanged_text():
    (kind, value, raw, start, end), *_ = [m for m in indicators.extract("é 1[.]2.3.4") if m[0] == "ip"]
    assert (kind, value, raw) == ("ip", "1.2.3.4", "1.2.3.4") and (start, end) == (3, 10)


def test_native_mentions_agree(spark):
    texts = [REPORT, "a.b.co.uk and x.github.io, co.uk alone", "00-1A-2b-3C-4d-5E " + "c" * 40, None, "", "1.2.3.4 1.2.3.4"]
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    kinds = ("email", "sha256", "sha1", "md5", "cve", "mac", "asn", "ip", "domain")
    native = sorted((r["chunk_id"], r["kind"], r["value"]) for r in indicators.native_mentions(df, kinds=kinds).collect())
    assert native == sorted((i, m[0], m[1]) for i, t in enumerate(texts) if t for m in indicators.extract(t) if m[0] in kinds)
    rows = indicators.mentions(df.withColumn("document_id", F.col("chunk_id")))
    assert rows.schema.simpleString() == schema.struct_of(schema.MENTIONS).simpleString()
    assert rows.where("kind = 'ip' and chunk_id = 5").count() == 2


@pytest.mark.parametrize(("address", "internal"), [("10.0.0.1", True), ("127.0.0.1", True), ("169.254.1.1", True), ("100.64.0.1", True), ("::1", True), ("fe80::1", True), ("::ffff:10.0.0.1", True), ("8.8.8.8", False), ("2606:4700::1", False), ("nonsense", True)])
def test_internal_addresses(address, internal):
    assert indicators.is_internal(address) == internal


@pytest.mark.parametrize(("said", "most", "numbers"), [("[C1] x [C3] y [C9] z [Cx] [c1]", 3, [1, 3]), ("none", 3, []), ("[C0][C2]", 2, [2]), (None, 3, None)])
def test_markers(spark, said, most, numbers):
    assert one(spark, text.markers(F.col("x"), "C", F.lit(most)), x=said) == numbers


@pytest.mark.parametrize(("claimed", "cve", "severity"), [("critical", False, "info"), ("high", None, "info"), ("high", True, "high"), ("nonsense", True, "low")])
def test_severity_needs_evidence(spark, claimed, cve, severity):
    assert one(spark, text.gated_severity(F.col("x"), F.lit(cve).cast("boolean")), x=claimed) == severity


def test_scores(spark):
    strength = lambda rel, n, w: one(spark, text.edge_strength(F.lit(rel), F.lit(n), F.lit(w)), x=1)
    assert strength("co_occurs", 1, 1.0) == pytest.approx(0.68)
    assert strength("co_occurs", 9, 9.0) == 1.0
    assert strength("similar", 0, 1.7) == 1.0 and strength("temporal", 0, -0.2) == 0.0
    assert [one(spark, text.retry_delay(F.col("x")), x=n) for n in (0, 1, 2, 5, 8, 99)] == [5, 5, 10, 80, 600, 600]
    assert one(spark, text.temporal_strength(F.col("x"), 10.0), x=10.0) == pytest.approx(np.exp(-1))
    assert one(spark, text.idf(F.lit(10.0), F.col("x")), x=0) == pytest.approx(np.log(11))
    a, b = F.lit(datetime.datetime(2024, 1, 1)), F.lit(datetime.datetime(2024, 1, 1, 0, 0, 0, 500_000))
    assert one(spark, text.seconds_between(a, b), x=1) == 0.5


def test_wrong_dimensions_fail(spark):
    good = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0])], "chunk_id long, embedding array<float>")
    assert schema.checked_dimension(good, 4).count() == 1
    with pytest.raises(Exception, match="dimension"):
        schema.checked_dimension(good, 3).collect()
    with pytest.raises(Exception, match="status"):
        schema.checked_values(spark.createDataFrame([("gone",)], "status string"), "status", schema.STATUSES).collect()


def test_neighbours_in_blocks_are_those_of_one(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(60)] + [(60, [0.0] * 5), (61, None)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    whole = sorted(tuple(r) for r in vectors.nearest_neighbours(df, 4).collect() if r["id"] != 60)
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 900)
    assert sorted(tuple(r) for r in vectors.nearest_neighbours(df, 4).collect() if r["id"] != 60) == whole
    table = np.array([r[1] for r in rows[:60]], np.float32).astype(float)
    table /= np.linalg.norm(table, axis=1, keepdims=True)
    far = 1 - table @ table.T
    np.fill_diagonal(far, np.inf)
    assert {x for i, x, _ in whole if i == 7} == set(np.argsort(np.append(far[7], 1.0))[:4].tolist())
    assert vectors.nearest_neighbours(df.limit(0), 4).count() == 0


def test_approximate_pairs_are_near(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(20, 8))
    rows = [(i, [float(x) for x in base[i // 2] + 0.01 * (i % 2)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    found = {(r["a"], r["b"]) for r in vectors.approximate_pairs(df, 0.01).collect()}
    assert len([p for p in found if p[0] // 2 == p[1] // 2]) >= 18


@pytest.mark.parametrize(
    ("word", "stemmed"),
    [("running", "run"), ("runs", "run"), ("connection", "connect"), ("connections", "connect"), ("relational", "relat"), ("hopping", "hop"), ("hoping", "hope"), ("happy", "happi"), ("skies", "sky"), ("generously", "generous"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("agreed", "agre"), ("feed", "feed"), ("national", "nation"), ("controlled", "control"), ("rate", "rate"), ("probate", "probat"), ("analogies", "analog"), ("news", "news"), ("inning", "inning"), ("by", "by"), ("say", "say")],
)
def test_stems(word, stemmed):
    assert fts.stem(word) == stemmed


def test_queries_and_ranks(spark):
    docs = [(1, "The attacker scanned the mail servers at night"), (2, "Mail servers were scanned; the attackers left"), (3, "A mail about weather"), (4, "server mail"), (5, None)]
    index = fts.postings(spark.createDataFrame(docs, "chunk_id long, text string"))

    def hits(query):
        return [r["chunk_id"] for r in fts.ranked(index, query).orderBy(F.desc("rank"), "chunk_id").collect()]

    assert set(hits("mail servers")) == {1, 2, 4}
    assert set(hits('"mail server"')) == {1, 2}
    assert set(hits("weather or night")) == {1, 3}
    assert set(hits("mail -scanning")) == {3, 4}
    assert hits("the of") == [] and hits("") == []
    assert hits("attacker mail")[0] == 1 or hits("attacker mail")[0] == 2
    places = {"mail": [3], "server": [4, 9]}
    assert fts.cover_density(fts.parse_query("mail server"), places) == pytest.approx(0.1)


def test_stand_ins(spark):
    embedder = providers.HashingEmbedder(32)
    chunks = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "")], "chunk_id long, text string")
    rows = {r["chunk_id"]: r["embedding"] for r in providers.embed_chunks(chunks, embedder).collect()}
    assert rows[1] == rows[2] and sum(x * x for x in rows[1]) == pytest.approx(1) and set(rows[3]) == {0.0}
    spaces = providers.ensure_space(providers.ensure_space([], "a", 4), "b", 8)
    assert providers.ensure_space(spaces, "a", 99) == spaces and [s["id"] for s in spaces] == [1, 2]
    assert [s["active"] for s in providers.activate_space(spaces, "b")] == [False, True]

    def broken(prompt, system):
        raise OSError("down")

    assert providers.chain(broken, lambda p, s: "up")("p", "s") == "up"
    with pytest.raises(OSError):
        providers.chain(broken, broken)("p", "s")


def test_kinds_are_left_out_only_where_their_patterns_find_nothing():
    import random

    from lodestone.functions import indicators

    r, tried = random.Random(3), dict.fromkeys(indicators.PATTERNS, 0)
    parts = ["http://a.b/c", "a@b.co", "f" * 64, "0" * 40, "e" * 32, "CVE-2024-12345", "aa:bb:cc:dd:ee:ff", "AS64500", "10.0.0.1", "fe80::1", "::", "x.org", "a1.b2.de", "\u0663.\u0663", ".", ":", "@", "-", " ", "a", "1", "AS", "CVE-", "://", "\u00e9"]
    for _ in range(20_000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 6)))
        for kind, pattern in indicators.COMPILED.items():
            if pattern.search(text):
                tried[kind] += 1
                assert indicators.NEEDS[kind](text), (kind, text)
    assert min(tried.values()) > 100
