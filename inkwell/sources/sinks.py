"""Report sink: scores as CSV and what they were made from as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators.evaluate import means, sound


def run_stamp(prefix: str) -> str:
    """A name for one run: the prefix and the UTC time to the second."""
    from datetime import datetime, timezone

    return f"{prefix}_{datetime.now(timezone.utc):%Y%m%d_%H%M%S}"


def flat_rows(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Rows as a CSV can hold them: metrics without NaN and infinities, lists and structs as JSON text."""
    plain = lambda f: F.to_json(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name)
    return rows.select(*((sound(F.col(f.name)) if f.name in metrics else plain(f)).alias(f.name) for f in rows.schema))


def report(rows: DataFrame, metrics: list[str], by: str, root: str, name: str) -> tuple[str, str]:
    """Writes ``<root>/<name>_results`` (CSV) and ``<root>/<name>_meta`` (JSON, a row per group and one for all); returns both paths."""
    results, meta = f"{root}/{name}_results", f"{root}/{name}_meta"
    flat_rows(rows, metrics).write.option("header", True).option("escape", '"').csv(results)
    every = means(rows, metrics, []).select(F.lit(None).cast("string").alias(by), "*")
    means(rows, metrics, [by]).withColumn("overall", F.lit(False)).unionByName(every.withColumn("overall", F.lit(True))).coalesce(1).write.json(meta)
    return results, meta
