"""The ingestion run: files to parsed rows, chunks, vectors, a store and the catalog.

Every step is a DataFrame over all files at once; only what is due is parsed, and each result is written back to the
catalog, so that a run that is repeated does nothing for files that haven't changed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.text import uuid5
from inkwell.operators import catalog, chunking, metadata, store
from inkwell.sources import providers, readers

BUDGET = 8192
CATALOG = (
    "document_id string, source_path string, file_name string, checksum string, filesize_bytes bigint, mime_type string, status string, needs_reingest boolean, "
    "last_ingested_at timestamp, vector_synced_at timestamp, lexical_synced_at timestamp, chunk_count int, created_at timestamp, updated_at timestamp"
)
TASKS = (
    "task_id string, document_id string, trigger_type string, status string, retry_count int, started_at timestamp, finished_at timestamp, error_message string, "
    "chunk_count int, vector_sync_at timestamp, lexical_sync_at timestamp"
)


def cut(parsed: DataFrame, key: str, budget: int = BUDGET) -> DataFrame:
    """(key, chunker, chunk_id, chunk_index, total_chunks, content, chunk_size) of parsed rows with content and items.

    Rows with items are cut by their structure, the others are one chunk; rows with neither have none.  An id is made from
    the key, the place and the content, so a run that is repeated gives the same ids.
    """
    routed = parsed.select(F.col(key).alias("_key"), "content", "items", metadata.chunker(F.col("items")).alias("chunker"))
    parts = chunking.structural(routed.where(F.col("chunker") == "structural"), "_key", "items", budget, cut=True)
    whole = chunking.whole(routed.where(F.col("chunker") != "structural"), "_key", "content")
    columns = ["_key", "chunker", "chunk_index", "total_chunks", "content", "chunk_size"]
    both = parts.select(F.col("result_id").alias("_key"), F.lit("structural").alias("chunker"), *columns[2:]).unionByName(
        whole.select(F.col("doc_id").alias("_key"), F.lit("pass-through").alias("chunker"), *columns[2:])
    )
    name = F.concat_ws("|", F.col("_key").cast("string"), F.col("chunk_index").cast("string"), "content")
    return both.select(F.col("_key").alias(key), "chunker", uuid5(name).alias("chunk_id"), *columns[2:])


def _table(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    return store.current(spark, f"{root}/{name}") if store.exists(spark, f"{root}/{name}") else spark.createDataFrame([], schema)


def run(spark: SparkSession, paths: str | list[str], root: str, provider: providers.Embedder, trigger: str = "manual", file_type: str | None = None, force: bool = False, budget: int = BUDGET, parsers=None) -> DataFrame:
    """Ingests the files under ``paths`` into the tables ``chunks``, ``catalog`` and ``tasks`` under ``root``; (document_id, source_path, chunk_count, error) of what was due.

    New and changed files are due, and all if forced; ``file_type`` takes one kind of file alone.  The chunks of a file
    replace those that it had.  A file that can't be parsed is marked as failed and is due again.
    """
    suffix, now = metadata.suffix(F.col("source_path")), F.current_timestamp()
    seen = readers.checksums(spark, paths)
    if file_type is not None:
        seen = seen.where(metadata.looked_up(suffix, metadata.LOADERS, "error") == file_type)
    old = _table(spark, root, "catalog", CATALOG)
    registered = catalog.register(old, seen, force).where(F.col("change").isin("new", "changed", "forced") | (F.col("change") == "unchanged") & F.col("needs_reingest")).join(seen.select("source_path", "filesize_bytes"), "source_path")
    before = old.select("source_path", F.col("created_at").alias("_created"))
    columns = [c.split()[0] for c in CATALOG.split(", ")]
    fresh = registered.join(before, "source_path", "left").select(
        uuid5(F.col("source_path")).alias("document_id"), "source_path", F.regexp_extract("source_path", "([^/]+)$", 1).alias("file_name"), "checksum", "filesize_bytes",
        metadata.looked_up(suffix, metadata.MIMES, "application/octet-stream").alias("mime_type"), F.lit("pending").alias("status"), F.lit(True).alias("needs_reingest"),
        *(F.lit(None).cast("timestamp").alias(c) for c in columns[8:11]), F.lit(None).cast("int").alias("chunk_count"), F.coalesce("_created", now).alias("created_at"), now.alias("updated_at"),
    )
    store.swap(store.upsert(old, fresh, "document_id"), f"{root}/catalog")
    documents = store.current(spark, f"{root}/catalog")
    due = catalog.due(documents).join(seen.select("source_path"), "source_path", "left_semi")
    began = spark.range(1).select(now).first()[0]
    new = catalog.started(due, trigger, F.lit(began)).withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in TASKS.split(", ")[6:]})
    store.swap(_table(spark, root, "tasks", TASKS).unionByName(new), f"{root}/tasks")

    wanted = due.select(F.col("source_path").alias("path"), "document_id", "file_name", "mime_type")
    parsed = readers.files(spark, paths, parsers).join(wanted, "path")
    run_id = uuid.uuid4().hex
    parsed.select("document_id", "path", "file_name", "title", "author", "content", "items", "error").write.parquet(f"{root}/parsed-{run_id}")
    parsed = spark.read.parquet(f"{root}/parsed-{run_id}")
    chunks = cut(parsed, "document_id", budget).join(parsed.select("document_id", "path", "file_name", "title", "author"), "document_id")
    vectors = providers.encode(chunks, "content", provider)
    stored = f"{root}/chunks"
    kept = store.current(spark, stored).join(due.select("document_id"), "document_id", "left_anti") if store.exists(spark, stored) else vectors.limit(0)
    store.swap(kept.unionByName(vectors), stored)

    numbers = store.current(spark, stored).groupBy("document_id").agg(F.count("*").cast("int").alias("chunk_count"))
    error = F.when(F.col("content").isNull(), F.coalesce("error", F.lit("no content")))
    results = parsed.select("document_id", F.col("path").alias("source_path"), error.alias("error")).join(numbers, "document_id", "left").select("document_id", "source_path", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "error")
    store.swap(catalog.finished(store.current(spark, f"{root}/tasks"), results, now), f"{root}/tasks")
    store.swap(catalog.written_back(documents, results, now), f"{root}/catalog")
    return results
