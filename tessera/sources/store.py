"""Tables of documents and chunks: registration, replacement, deletion, logs. Each step is a plan that gives the
new version of a table; the caller writes it (partition overwrite, or a new snapshot)."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

PROGRESS = {"queued": 0, "parsing": 5, "parsed": 50, "splitting": 55, "chunked": 70, "vectorizing": 75, "indexed": 100}
RUNNING = ("parsing", "parsed", "splitting", "chunked", "vectorizing")


def register(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of incoming (file_hash, knowledge_base, ...) that known lacks, once each, as queued jobs."""
    new = incoming.join(known.select("file_hash", "knowledge_base"), ["file_hash", "knowledge_base"], "left_anti")
    return new.dropDuplicates(["file_hash", "knowledge_base"]).withColumns({"status": F.lit("queued"), "progress": F.lit(0)})


def replace_rows(table: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """table with all rows of new's keys replaced."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_documents(gone: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """Every table less the rows of the gone documents: documents, chunks, postings and vectors in one snapshot."""
    return {n: t.join(gone.select("document_id").distinct(), "document_id", "left_anti") for n, t in tables.items()}


def set_enabled(chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """chunks with enabled from the latest change (chunk_id, enabled, at)."""
    last = changes.groupBy("chunk_id").agg(F.max_by("enabled", "at").alias("_on"))
    return chunks.join(last, "chunk_id", "left").withColumn("enabled", F.coalesce("_on", "enabled")).drop("_on")


def recover(documents: DataFrame) -> DataFrame:
    """After a stop: running documents whose source exists are queued again, the others fail with a reason."""
    running = F.col("status").isin(*RUNNING, "queued")
    return documents.withColumns({
        "reason": F.when(running & ~F.col("has_source"), "source file is missing").otherwise(F.col("reason")),
        "status": F.when(running & F.col("has_source"), "queued").when(running, "failed").otherwise(F.col("status")),
    })


def log_hits(hits: DataFrame, most: int = 400) -> DataFrame:
    """hits with their text cut as logs keep it."""
    return hits.withColumn("text", F.substring("text", 1, most))


def parse_report(sections: DataFrame) -> DataFrame:
    return sections.groupBy("path").agg(F.first("parser").alias("parser"), F.count("*").alias("section_count"), F.array_sort(F.collect_set("title")).alias("titles"), F.array_sort(F.collect_set("warning")).alias("warnings"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars")).withColumn("status", F.when(F.col("chars") == 0, "failed").otherwise("parsed"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; without one a local session gets a temporary folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/tessera/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_table(df: DataFrame, name: str, partition: str | None = None) -> None:
    """Create the table if it's missing; an existing one gets the rows, its columns are never altered."""
    spark = df.sparkSession
    if spark.catalog.tableExists(name):
        df.select(*[c for c in spark.table(name).columns]).write.mode("append").saveAsTable(name)
    else:
        w = df.write.format("parquet")
        (w.partitionBy(partition) if partition else w).saveAsTable(name)


def vector_rows(chunks: DataFrame, dim: int, text_most: int = 8000, name_most: int = 256) -> DataFrame:
    """Rows for the vector table: chunk_id is the row's id; texts and names cut to the store's widths; a vector of
    another length fails the job."""
    size = F.size("embedding")
    checked = F.when(size == dim, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit(f"vector length is not {dim}: "), size.cast("string"))))
    return chunks.withColumns({"embedding": checked, "content": F.substring("content", 1, text_most), "filename": F.substring("filename", 1, name_most)})


def missing_fields(expected: list[str], table: DataFrame) -> list[str]:
    return [c for c in expected if c not in table.columns]


def health(vectors: DataFrame | None) -> tuple[bool, int, str]:
    """(works, count, reason); a failure is an answer, not an error."""
    try:
        return True, vectors.count() if vectors is not None else 0, ""
    except Exception as e:
        return False, 0, type(e).__name__


def page_of(table: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page of a listing in a stated order."""
    return table.orderBy(*order).offset(offset).limit(limit)


def list_chunks(chunks: DataFrame, document_id=None, offset: int = 0, limit: int = 100) -> DataFrame:
    rows = chunks if document_id is None else chunks.filter(F.col("document_id") == document_id)
    return page_of(rows, ["document_id", "chunk_index"], offset, limit)


def latest_documents(documents: DataFrame, most: int = 200) -> DataFrame:
    return page_of(documents, [F.desc("updated_at"), "document_id"], 0, most)


def requeue(documents: DataFrame, jobs: DataFrame, chunks: DataFrame) -> DataFrame:
    """documents after jobs (document_id, job): rechunk and retry start again; reindex embeds what has chunks and
    fails without."""
    has = chunks.select("document_id").distinct().withColumn("_has", F.lit(True))
    j = documents.join(jobs.select("document_id", "job"), "document_id", "left").join(has, "document_id", "left")
    again, embed = F.col("job").isin("rechunk", "retry"), F.col("job") == "reindex"
    status = F.when(again, "queued").when(embed & F.col("_has"), "vectorizing").when(embed, "failed").otherwise(F.col("status"))
    reason = F.when(embed & F.col("_has").isNull(), "no chunks to index").when(again | embed, F.lit(None)).otherwise(F.col("reason"))
    return j.withColumns({"status": status, "reason": reason}).select(*documents.columns)


def summary(stats: DataFrame) -> DataFrame:
    """One line per document of chunk_stats."""
    return stats.select("doc_id", F.format_string("%d chunks, %d characters on average, %d at most, %.1f %% broken", "chunk_count", "avg_length", "max_length", F.col("broken_ratio") * 100).alias("summary"))
