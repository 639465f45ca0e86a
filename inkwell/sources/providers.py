"""Plug-ins for models: vectors of texts, recognition of pages.  Tasks call them; retries are inside."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import cache_key, strip
from inkwell.operators import geometry


class EmbeddingError(RuntimeError):
    """A provider failed as often as it was tried."""


class Embedder(Protocol):
    name: str
    dim: int

    def encode(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Vectors of unit length from hashed words; needs no model, so it serves tests."""

    def __init__(self, dim: int = 8):
        self.name, self.dim = f"hash-{dim}", dim

    def encode(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            for word in text.split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(size == 0, 1, size)).tolist()


def tried(call: Callable[[list[str]], list[list[float]]], texts: list[str], tries: int = 3, wait: float = 0.0) -> list[list[float]]:
    """Calls again after an error, ``tries`` times at most, waiting ``wait`` seconds and then twice as long each time."""
    for k in range(tries):
        try:
            return call(texts)
        except Exception as ex:
            if k == tries - 1:
                raise EmbeddingError(str(ex)) from ex
            time.sleep(wait * 2**k)
    return []


def first_of(*calls: Callable) -> Callable:
    """A plug-in that hands on to the next one where one fails, as from a better to a plainer recogniser; the last error is raised."""

    def call(*given):
        for k, one in enumerate(calls):
            try:
                return one(*given)
            except Exception:
                if k == len(calls) - 1:
                    raise
        raise ValueError("no plug-in was given")

    return call


def encode(rows: DataFrame, text: str, provider: Embedder, tries: int = 3, wait: float = 0.0) -> DataFrame:
    """Adds ``embedding`` in batches; blank and null texts get null.  A vector of another width than the provider's is an error."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, embedding array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            there = batch[text].map(lambda t: bool(t and t.strip()))
            vectors: list = [None] * len(batch)
            for place, v in zip(np.flatnonzero(there), tried(provider.encode, batch[text][there].tolist(), tries, wait) if there.any() else []):
                if len(v) != provider.dim:
                    raise EmbeddingError(f"{provider.name} gave {len(v)} values instead of {provider.dim}")
                vectors[place] = [float(x) for x in v]
            yield batch.assign(embedding=vectors)

    return rows.mapInPandas(run, schema)


def encode_cached(rows: DataFrame, text: str, provider: Embedder, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with vectors, and new cache entries (cache_key, value): only distinct texts that the cache lacks are encoded, blank ones never."""
    keyed = rows.withColumn("cache_key", cache_key(provider.name, F.col(text)))
    missing = keyed.where(strip(F.col(text)) != "").select("cache_key", F.col(text).alias("_text")).dropDuplicates(["cache_key"]).join(cache.select("cache_key"), "cache_key", "left_anti")
    fresh = encode(missing, "_text", provider).select("cache_key", F.col("embedding").alias("value"))
    known = cache.select("cache_key", "value").unionByName(fresh)
    return keyed.join(known, "cache_key", "left").withColumnRenamed("value", "embedding"), fresh


def recognise(pages: DataFrame, detect: Callable[[bytes], list[dict]], read: Callable[[bytes, dict], tuple[str, float]]) -> DataFrame:
    """(filename, page, det_no, x_min, y_min, x_max, y_max, text, score) from page images by two plug-ins."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, page, image in zip(batch["filename"], batch["page"], batch["pixels"]):
                for n, box in enumerate(detect(image)):
                    text, score = read(image, box) or ("", 0.0)
                    out.append((name, page, n, box["x_min"], box["y_min"], box["x_max"], box["y_max"], text, score))
            yield pd.DataFrame(out, columns=["filename", "page", "det_no", "x_min", "y_min", "x_max", "y_max", "text", "score"])

    return pages.select("filename", "page", "pixels").mapInPandas(run, "filename string, page int, det_no int, x_min int, y_min int, x_max int, y_max int, text string, score double")


def read_pages(pages: DataFrame, detect: Callable[[bytes], list[dict]], read: Callable[[bytes, dict], tuple[str, float]], least: float = 0.0) -> DataFrame:
    """(filename, page, content, groups): pages detected, read and grouped; readings below ``least`` are left out.

    ``groups`` lists (box, contents, counts) in reading order, ``content`` joins their texts by line breaks.  A page without readings has no row.
    """
    found = recognise(pages, detect, read).where(F.col("score") >= least).withColumn("_page", F.struct("filename", "page"))
    groups = geometry.reading_groups(found, "_page", "det_no", "text")
    ordered = F.sort_array(F.collect_list(F.struct("group_no", "box", "contents", "counts")))
    one = groups.groupBy("page").agg(ordered.alias("groups"))
    return one.select("page.filename", "page.page", F.array_join(F.transform("groups", lambda g: g["contents"]), "\n").alias("content"), "groups")
