"""The catalog of ingested files and its tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions.text import uuid5
from inkwell.operators.store import ConflictError, latest


def register(catalog: DataFrame, incoming: DataFrame, force: bool = False) -> DataFrame:
    """(source_path, checksum, status, needs_reingest, change) after files with checksums were seen.

    A new or changed file is pending; an unchanged one is left alone unless forced.  Catalog rows that were not
    seen are left alone too ('absent').
    """
    old = catalog.select("source_path", F.col("checksum").alias("_old"), F.col("status").alias("_status"), F.col("needs_reingest").alias("_needs"))
    both = old.join(incoming.select("source_path", F.col("checksum").alias("_new")), "source_path", "full_outer")
    change = (
        F.when(F.col("_new").isNull(), "absent").when(F.col("_status").isNull() & F.col("_old").isNull(), "new")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "changed").otherwise("forced" if force else "unchanged")
    )
    again = F.col("change").isin("new", "changed", "forced")
    return both.withColumn("change", change).select(
        "source_path", F.coalesce("_new", "_old").alias("checksum"), F.when(again, "pending").otherwise(F.col("_status")).alias("status"),
        F.when(again, F.lit(True)).otherwise(F.col("_needs")).alias("needs_reingest"), "change",
    )


def due(catalog: DataFrame) -> DataFrame:
    """Files that must run: all but those ingested and not marked."""
    return catalog.where(~((F.col("status") == "ingested") & ~F.col("needs_reingest")) | F.col("status").isNull() | F.col("needs_reingest").isNull())


def tasks_once(tasks: DataFrame) -> DataFrame:
    """One row per task, the one that arrived last."""
    return latest(tasks, ["task_id"], ["updated_at", "created_at"])


def outcomes(catalog: DataFrame, tasks: DataFrame) -> DataFrame:
    """(document_id, status, needs_reingest, attempts, failures, last_status) written back from the tasks.

    The last finished task decides; a document without one keeps its status.
    """
    once = tasks_once(tasks)
    done = once.where(F.col("finished_at").isNotNull())
    last = done.groupBy("document_id").agg(F.max_by("status", F.struct("finished_at", "task_id")).alias("last_status"))
    counts = once.groupBy("document_id").agg(F.count("*").alias("attempts"), F.count(F.when(F.col("status") == "failed", 1)).alias("failures"))
    status = F.when(F.col("last_status") == "success", "ingested").when(F.col("last_status") == "failed", "failed").otherwise(F.col("status"))
    needs = F.when(F.col("last_status") == "success", F.lit(False)).when(F.col("last_status") == "failed", F.lit(True)).otherwise(F.col("needs_reingest"))
    return catalog.join(counts, "document_id", "left").join(last, "document_id", "left").select(
        "document_id", status.alias("status"), needs.alias("needs_reingest"),
        F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("failures", F.lit(0)).alias("failures"), "last_status",
    )


def retries(tasks: DataFrame) -> DataFrame:
    """(task_id, document_id, retry): how many tasks of the document began before; a document's tasks are few."""
    order = Window.partitionBy("document_id").orderBy(F.col("started_at").asc_nulls_last(), "task_id")
    return tasks_once(tasks).select("task_id", "document_id", (F.row_number().over(order) - 1).alias("retry"))


def started(documents: DataFrame, trigger: str | None, now: Column) -> DataFrame:
    """New tasks (task_id, document_id, trigger_type, status, retry_count, started_at) of documents that are due, running from ``now``."""
    name = uuid5(F.concat_ws("|", "document_id", now.cast("string")))
    return due(documents).select(
        name.alias("task_id"), "document_id", F.lit(trigger).cast("string").alias("trigger_type"), F.lit("running").alias("status"), F.lit(0).alias("retry_count"), now.alias("started_at")
    )


def finished(tasks: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Running tasks after their results (document_id, chunk_count, error) came in; others are left alone.

    Without an error a task is a success with its chunks and sync times, else it failed, with the error and one retry more.
    """
    own = results.select(F.col("document_id").alias("_document"), F.col("chunk_count").alias("_chunks"), F.col("error").alias("_error"))
    both = tasks.join(own, (F.col("document_id") == F.col("_document")) & (F.col("status") == "running"), "left")
    done, failed = F.col("_document").isNotNull(), F.col("_error").isNotNull()
    good = done & ~failed
    return both.withColumns({
        "status": F.when(good, "success").when(done, "failed").otherwise(F.col("status")), "chunk_count": F.when(good, F.col("_chunks")).otherwise(F.col("chunk_count")),
        "finished_at": F.when(done, now).otherwise(F.col("finished_at")), "vector_sync_at": F.when(good, now).otherwise(F.col("vector_sync_at")),
        "lexical_sync_at": F.when(good, now).otherwise(F.col("lexical_sync_at")), "error_message": F.when(done & failed, F.col("_error")).otherwise(F.col("error_message")),
        "retry_count": F.when(done & failed, F.coalesce("retry_count", F.lit(0)) + 1).otherwise(F.col("retry_count")),
    }).select(*tasks.columns)


def written_back(documents: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Documents after their results (document_id, chunk_count, error): ingested with sync times, or failed and to be done again."""
    own = results.select(F.col("document_id").alias("_document"), F.col("chunk_count").alias("_chunks"), F.col("error").alias("_error"))
    both = documents.join(own, F.col("document_id") == F.col("_document"), "left")
    done, failed = F.col("_document").isNotNull(), F.col("_error").isNotNull()
    good = done & ~failed
    return both.withColumns({
        "status": F.when(good, "ingested").when(done, "failed").otherwise(F.col("status")), "needs_reingest": F.when(done, failed).otherwise(F.col("needs_reingest")),
        "chunk_count": F.when(good, F.col("_chunks")).otherwise(F.col("chunk_count")),
        **{name: F.when(good, now).otherwise(F.col(name)) for name in ("last_ingested_at", "vector_synced_at", "lexical_synced_at")},
    }).select(*documents.columns)


def lookup(documents: DataFrame, source_path: str) -> DataFrame:
    """The row of one path: an equality that reaches the scan; an error if the path, which must be unique, is there twice."""
    found = documents.where(F.col("source_path") == source_path)
    if len(found.select("source_path").take(2)) > 1:
        raise ConflictError(f"{source_path} is in the catalog twice")
    return found
