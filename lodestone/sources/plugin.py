"""Extractor plugins: a program gets a document's bytes and prints events, one JSON object a line."""

from __future__ import annotations

import json
import os
import resource
import signal
import subprocess
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.chunking import chunks
from lodestone.sources.normalize import record_chunks, record_text

EVENTS = frozenset({"meta", "text", "record", "entity", "warn"})


@dataclass(frozen=True)
class Plugin:
    """The defaults of the limits."""

    name: str
    command: tuple[str, ...]
    media_types: tuple[str, ...] = ()
    timeout_secs: int = 30
    max_output_bytes: int = 16 * 2**20
    max_memory_bytes: int = 2**30


def _limits(plugin: Plugin) -> None:
    resource.setrlimit(resource.RLIMIT_CPU, (plugin.timeout_secs + 1, plugin.timeout_secs + 1))
    resource.setrlimit(resource.RLIMIT_AS, (plugin.max_memory_bytes, plugin.max_memory_bytes))
    resource.setrlimit(resource.RLIMIT_FSIZE, (0, 0))
    resource.setrlimit(resource.RLIMIT_NOFILE, (64, 64))


def parse_events(output: str) -> list[dict]:
    """Events in order; a line that is none is a warning."""
    events = []
    for line in filter(None, map(str.strip, output.splitlines())):
        try:
            event = json.loads(line)
            ok = isinstance(event, dict) and event.get("event") in EVENTS
        except ValueError:
            ok = False
        if ok and event["event"] == "entity":
            event.setdefault("confidence", 1.0)
        events.append(event if ok else {"event": "warn", "message": "the plugin printed a line that is no event"})
    return events


def run(plugin: Plugin, content: bytes) -> list[dict]:
    """Run in an empty folder without environment, under limits; the whole process group goes at the timeout."""
    with tempfile.TemporaryDirectory() as scratch:
        child = subprocess.Popen(plugin.command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, cwd=scratch, env={}, start_new_session=True, preexec_fn=lambda: _limits(plugin))
        try:
            output, _ = child.communicate(content, timeout=plugin.timeout_secs)
        except subprocess.TimeoutExpired:
            os.killpg(child.pid, signal.SIGKILL)
            child.communicate()
            raise TimeoutError(f"plugin {plugin.name} timed out") from None
    if len(output) > plugin.max_output_bytes:
        raise ValueError(f"plugin {plugin.name} printed too much")
    if child.returncode:
        raise RuntimeError(f"plugin {plugin.name} ended with {child.returncode}")
    return parse_events(output.decode("utf-8", "replace"))


def events_to_prepared(events: list[dict]) -> tuple[str | None, list[str]]:
    """The first title, and chunks of texts and records; entities and warnings make none."""
    title, texts = None, []
    for e in events:
        if e["event"] == "meta":
            title = title or e.get("title")
        elif e["event"] == "text":
            texts += chunks(e.get("text") or "")
        elif e["event"] == "record":
            texts += record_chunks(record_text(e.get("data", e.get("record"))))
    return title, texts


def extract(documents: DataFrame, plugin: Plugin, id_col: str = "document_id", raw_col: str = "raw") -> DataFrame:
    """document_id, title, texts, error for each document; a plugin that fails fails its document only."""

    def each(content: bytes) -> tuple[str | None, list[str], str | None]:
        try:
            return *events_to_prepared(run(plugin, content)), None
        except (OSError, RuntimeError, ValueError, TimeoutError) as e:
            return None, [], str(e)

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([(d, *each(bytes(raw or b""))) for d, raw in part.itertuples(index=False)], columns=["document_id", "title", "texts", "error"])

    rows = documents.select(F.col(id_col).cast("string").alias("d"), F.col(raw_col).alias("r"))
    return rows.mapInPandas(batches, "document_id string, title string, texts array<string>, error string")
