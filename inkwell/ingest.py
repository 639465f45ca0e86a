"""Ingests files from the command line: python -m inkwell.ingest PATH... --root TABLES; ends with 1 if some file failed."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from inkwell.operators import ingestion
from inkwell.sources.providers import Embedder, HashEmbedder


def main(argv: list[str], spark: SparkSession | None = None, provider: Embedder | None = None) -> int:
    parser = argparse.ArgumentParser(prog="inkwell.ingest")
    parser.add_argument("path", nargs="+")
    parser.add_argument("--root", required=True, help="folder of the tables chunks, catalog and tasks")
    parser.add_argument("--trigger", default="manual")
    parser.add_argument("--file-type", default=None, help="take files of one kind alone, as markdown or docx")
    parser.add_argument("--force-reingest", action="store_true")
    given = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("ingest").getOrCreate()
    results = ingestion.run(spark, given.path, given.root, provider or HashEmbedder(), given.trigger, given.file_type, given.force_reingest)
    return 0 if results.where("error is not null").isEmpty() else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
