"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 2**20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares for checkpoints; a local one where none is set, on a local master as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that ``df`` does not have, whatever the case."""
    there = {c.lower() for c in df.columns}
    found = []
    for name in names:
        mark = "__" + name
        while mark in there:
            mark = "_" + mark
        there.add(mark)
        found.append(mark)
    return found


_written: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._lodestone_path = path
    return found


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``, once nothing reads it any more."""
    path = getattr(df, "_lodestone_path", None)
    if path:
        _delete(df.sparkSession, path)
        _written.remove(path)


def written() -> set[str]:
    """The tables that ``materialize`` wrote and nothing has deleted."""
    return set(_written)


def sweep(spark: SparkSession, paths: set[str]) -> None:
    """Delete tables that ``materialize`` wrote: for a caller that has written every result that reads them."""
    for path in paths & written():
        _delete(spark, path)
        _written.remove(path)


def bits_between(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def fold(doc_id: Column) -> Column:
    """0 for held-out documents, 1 to 4 for the rest; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def give_back() -> None:
    """Return freed memory to the system; Spark keeps Python workers, and what they hold, from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(part: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about ``most`` bytes, one row at least, so that Python holds little at once."""
    if part.num_rows:
        step = max(1, most * part.num_rows // max(1, part.nbytes))
        yield from (part.slice(lo, step) for lo in range(0, part.num_rows, step))


def with_columns(df: DataFrame, inputs: list[str], outputs: dict[str, str], run: Callable[..., Iterator[pa.Array]]) -> DataFrame:
    """Add columns that ``run`` makes, an Arrow batch at a time, from the input columns; namesakes are replaced.

    ``run`` gets one array per input and yields one array per output.
    """
    kept = [c for c in df.columns if c not in outputs]
    names = [*kept, *outputs]
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(n, T._parse_datatype_string(kind)) for n, kind in outputs.items())])
    missing = [c for c in inputs if c not in kept]
    fed = df.select(*kept, *missing)
    kinds = {"string": pa.string(), "binary": pa.binary()}

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for whole in parts for x in slices(whole)):
            made = list(run(*[part.column(c) for c in inputs]))
            made = [m.cast(kinds[outputs[n]]) if outputs[n] in kinds else m for m, n in zip(made, outputs, strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *made], names=names)
        give_back()

    return fed.mapInArrow(batches, schema)
