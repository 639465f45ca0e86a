"""Ingestion as a stream: chunks that arrive as files become snapshots of the store.

An extension: the same operators as in batch run on each micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from inkwell.operators import store


def arrivals(spark: SparkSession, path: str, schema) -> DataFrame:
    """New rows as they arrive, however late; what comes twice is made one by the store."""
    return spark.readStream.schema(schema).parquet(path)


def into_store(rows: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Upserts each micro-batch into the snapshot store under ``root``, the latest arrival of an id winning.

    A store that exists is kept, also when the checkpoint is new.  A batch that is run again gives the same
    snapshot, so a lost executor or driver does no harm.
    """

    def merge(batch: DataFrame, _: int) -> None:
        once = store.latest(batch, ["id"], ["ingested_at"])
        if store.exists(batch.sparkSession, root):
            old = store.current(batch.sparkSession, root)
            both = store.latest(old.unionByName(once), ["id"], ["ingested_at"])
        else:
            both = once
        store.swap(both, root)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
