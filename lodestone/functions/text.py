"""Text, date and scoring expressions; everything here runs inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, replacements, limits and defaults that results depend on.
CONTROL = r"[\x00-\x08\x0B-\x1F\x7F-\x9F]"
DEFANGED = (
    ("hxxps", "https"), ("hxxp", "http"), ("[.]", "."), ("(.)", "."), ("[dot]", "."), ("(dot)", "."), ("{dot}", "."),
    ("[:]", ":"), ("[://]", "://"), ("[@]", "@"), ("(at)", "@"), ("[at]", "@"),
)
ISO_DATE = r"\b([0-9]{4})-([0-9]{2})-([0-9]{2})(?:[T ]([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?\b"
DATE_CHUNKS = 8
RETRY_BASE_SECS, RETRY_CAP_SECS, RETRY_ATTEMPTS = 5, 600, 5
STRUCTURED = ("json", "ndjson", "csv")


def clean_text(text: Column) -> Column:
    """Without control characters other than newline and tab."""
    return F.regexp_replace(text, CONTROL, "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def approx_tokens(text: Column) -> Column:
    """The larger of the word count and a quarter of the characters."""
    return F.greatest(F.size(words(text)), F.floor(F.length(text) / 4).cast("int"))


def excerpt(text: Column, chars: int = 300) -> Column:
    return F.substring(text, 1, chars)


def refang(text: Column) -> Column:
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), DEFANGED, text)


def earliest_date(text: Column) -> Column:
    """The earliest valid ISO date or date-time from 1970 to 2100 in a text; a zone is read but not applied."""
    found = F.regexp_extract_all(text, F.lit(ISO_DATE), F.lit(0))

    def stamp(m: Column) -> Column:
        def part(start: int, size: int) -> Column:
            return F.substring(m, start, size).try_cast("int")

        has_time = F.length(m) >= 16
        has_seconds = (F.length(m) >= 19) & (F.substring(m, 17, 1) == ":")
        zero = F.lit(0)
        return F.try_make_timestamp(part(1, 4), part(6, 2), part(9, 2), F.when(has_time, part(12, 2)).otherwise(zero), F.when(has_time, part(15, 2)).otherwise(zero), F.when(has_seconds, part(18, 2)).otherwise(zero).cast("decimal(8,6)"))

    plain = F.filter(F.transform(found, stamp), lambda t: t.isNotNull() & F.year(t).between(1970, 2100))
    valid_seconds = F.transform(found, lambda m: F.when((F.length(m) >= 19) & (F.substring(m, 17, 1) == ":"), F.substring(m, 18, 2).cast("int") < 60).otherwise(True))
    kept = F.when(F.forall(valid_seconds, lambda x: x), plain).otherwise(F.filter(F.zip_with(found, valid_seconds, lambda m, ok: F.when(ok, stamp(m))), lambda t: t.isNotNull() & F.year(t).between(1970, 2100)))
    return F.array_min(kept)


def set_if_absent(existing: Column, new: Column) -> Column:
    return F.coalesce(existing, new)


def content_hash(content: Column) -> Column:
    """Identity of a document's bytes, as hex."""
    return F.sha2(content, 256)


def is_structured(label: Column) -> Column:
    """Records of these labels are searched by words but never embedded."""
    return label.isin(*STRUCTURED)


def markers(text: Column, letter: str, most: Column) -> Column:
    """Distinct citation numbers such as [C3] between 1 and ``most``, ascending; case doesn't matter."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(rf"\[[{letter.upper()}{letter.lower()}]([0-9]+)\]"), F.lit(1)), lambda n: n.try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: n.isNotNull() & n.between(1, most))))


def retry_delay(attempts: Column) -> Column:
    """Seconds before a failed job runs again: doubling from five, at most ten minutes."""
    n = F.least(F.greatest(attempts, F.lit(1)), F.lit(20))
    return F.least(F.lit(RETRY_BASE_SECS) * F.pow(F.lit(2), F.least(n - 1, F.lit(12))), F.lit(RETRY_CAP_SECS)).cast("long")


def severity_rank(severity: Column) -> Column:
    ranks = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
    return reduce(lambda c, x: c.when(severity == x[0], x[1]), list(ranks.items())[1:], F.when(severity == "critical", 0))


def gated_severity(claimed: Column, has_cve: Column) -> Column:
    """A claim counts only where a vulnerability is among the entities."""
    return F.when(~F.coalesce(has_cve, F.lit(False)), "info").when(claimed.isin("critical", "high", "medium", "low", "info"), claimed).otherwise("low")


def input_signature(cluster: Column, chunk_ids: Column, entities: Column) -> Column:
    """Digest of what an insight is made from, to tell whether it changed; ``entities`` are kind:value strings."""
    parts = [cluster.cast("string"), F.array_join(F.array_sort(chunk_ids), ","), F.array_join(F.array_sort(entities), ",")]
    return F.sha2(F.concat_ws("|", *parts), 256)


def edge_strength(rel: Column, source_count: Column, weight: Column) -> Column:
    """One scale from 0 to 1 for all kinds of edges."""
    shared = F.least(F.lit(1.0), F.lit(0.6) + F.lit(0.08) * source_count)
    return F.when(rel == "co_occurs", shared).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight)))


def idf(total: Column, mentions: Column) -> Column:
    """``total`` counts chunks, ``mentions`` an entity's mentions."""
    return F.log(1 + total / F.greatest(mentions, F.lit(1)))


def temporal_strength(delta_secs: Column, tau_secs: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(-delta_secs / F.lit(float(tau_secs)))))


def seconds_between(a: Column, b: Column) -> Column:
    return F.abs(F.unix_micros(a) - F.unix_micros(b)) / F.lit(1e6)
