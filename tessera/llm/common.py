"""Shared plumbing: reading tables, shared-folder tables, Arrow text mapping."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Without one a local session (tests) gets a temporary folder;
    on a cluster that is an error, as executors elsewhere couldn't read it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stash(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends there, and a lost executor
    costs no recomputation. The file schema is passed on, so empty tables keep their columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessera/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def part_of(stashed: DataFrame, *columns: str) -> DataFrame:
    """Some columns of a stashed table; to free them is to free the table."""
    out = stashed.select(*columns)
    out._tessera_path = stashed._tessera_path
    return out


def free(*stashed: DataFrame) -> None:
    """Delete stashed tables that nothing will read any more."""
    for df in stashed:
        path = getattr(df, "_tessera_path", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def give_back() -> None:
    """Return freed memory to the system: workers are reused by later tasks, and would else keep the peak of this one."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: int | str, most: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Consecutive slices of about `most` bytes of text each (at least one row), with their texts, null as empty.
    Texts become Python strings one slice at a time, and free memory goes back to the system at both ends: before,
    what the worker's last task left after its own end."""
    give_back()
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
        start = 0
        while start < len(size):
            end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + most, "right")))
            part = batch.slice(start, end - start)
            yield part, [t or "" for t in part.column(column).to_pylist()]
            start = end
    give_back()


def map_texts(
    df: DataFrame, make: Callable[[], Callable[[list, list[str]], dict]], schema: str, key: str = "doc_id", most: int = 2 << 20
) -> DataFrame:
    """Arrow map over (key, text): make() runs once per task and returns f(keys, texts) -> columns.
    Null texts arrive as empty strings; slices are balanced by characters so memory stays bounded."""
    kind = _parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kind)
        f = make()
        for part, texts in slices(batches, 1, most):
            out = f(part.column(0).to_pylist(), texts)
            yield pa.RecordBatch.from_arrays([pa.array(out[x.name], x.type) for x in arrow], schema=arrow)

    return df.select(key, "text").mapInArrow(run, kind)


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch, list[str]], pa.RecordBatch]], most: int = 2 << 20) -> DataFrame:
    """Arrow map over whole rows: f(rows, texts) gives rows of the same schema; slices balanced as in map_texts."""
    kind, at = df.schema, df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for part, texts in slices(batches, at, most):
            yield f(part, texts)

    return df.mapInArrow(run, kind)


#: Ids sent to all executors at most (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 4_000_000


def without(docs: DataFrame, dropped: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs less the rows whose key is in dropped, without moving texts as long as dropped is of bounded size."""
    dropped = stash(dropped.select(key).distinct())
    few = dropped.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(dropped) if few else dropped, key, "left_anti").select(*docs.columns)


def keep_decided(docs: DataFrame, decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs less the rows that decide(docs) (doc_id, kept) doesn't keep. Rows of a null or repeated doc_id are
    decided one by one, under numbers above all ids; only for them are the rows written once more."""
    odd = stash(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("doc_id IS NULL OR n > 1").select("doc_id"))
    n = odd.count()
    if not n:
        return without(docs, decide(docs).filter("not kept"))
    again = odd.filter("doc_id IS NOT NULL").withColumn("_again", F.lit(True))
    above = (docs.agg(F.max("doc_id").alias("m")).first()["m"] or 0) + 1
    rows = docs.join(F.broadcast(again) if n <= BROADCAST_IDS else again, "doc_id", "left")
    own = F.when(F.col("doc_id").isNull() | F.col("_again"), F.monotonically_increasing_id() + above).otherwise(F.col("doc_id"))
    rows = stash(rows.withColumn("_row", own).select(*docs.columns, "_row"))
    marked = decide(rows.select(F.col("_row").alias("doc_id"), "text")).filter("not kept")
    return without(rows, marked.select(F.col("doc_id").alias("_row")), "_row").select(*docs.columns)
