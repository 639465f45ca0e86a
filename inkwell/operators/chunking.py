"""Chunks of documents: whole, packed from lines, and packed from structured items under their headings."""

from __future__ import annotations

import re
from functools import reduce
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from inkwell.functions import tokens
from inkwell.functions.text import strip, uuid5


def ranks(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Adds ``rank`` from 0 and ``total`` within each group, which may hold a third of all rows.

    The rows are sorted over all tasks and numbered where they lie; what each task holds of a group is counted, and the
    counts of the tasks before are added.  The sorted rows are kept, as both steps must see the same places.  Nulls in
    ``group`` are a group.
    """
    placed = rows.repartitionByRange(*(F.col(c) for c in group), *order).sortWithinPartitions(*(F.col(c) for c in group), *order).withColumn("_at", F.monotonically_increasing_id()).persist()
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(*group, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    own = Window.partitionBy(*group)
    before = own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*(F.col(c).alias(f"_{c}") for c in group), "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(own).alias("total"))
    same = (part == F.col("_part")) & reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group))
    return placed.join(offsets, same).select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias("rank"), "total")


def whole(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One chunk per document that is not blank: (doc_id, chunk_id, content, chunk_index, total_chunks, chunk_size)."""
    content = documents.select(F.col(doc_id).alias("doc_id"), strip(F.col(text)).alias("content")).where(F.col("content") != "")
    return content.select(
        "doc_id", uuid5(F.concat_ws("|", F.col("doc_id").cast("string"), "content")).alias("chunk_id"), "content",
        F.lit(0).alias("chunk_index"), F.lit(1).alias("total_chunks"), F.length("content").alias("chunk_size"),
    )


def bounded(parts: Column, budget: int) -> Column:
    """The texts with each one above ``budget`` cut: after the last sentence that fits, else the last blank, else by characters.

    The pieces of a text joined give it again.  Those that fit one budget together are one, so packing doesn't
    put a line break where there was none.
    """
    less = budget - 1
    cut = f"(?s)(.{{1,{budget}}}\\z|.{{0,{less}}}(?:[。！？]|[.!?](?=\\s))|.{{0,{less}}}\\s|.{{1,{budget}}})"
    pieces = lambda p: _folded(F.regexp_extract_all(p, F.lit(cut), F.lit(1)), budget)
    return F.flatten(F.transform(parts, lambda p: F.when(F.length(p) > budget, pieces(p)).otherwise(F.array(p))))


def _folded(parts: Column, budget: int) -> Column:
    """Greedy packs of the pieces of one text, joined as they are; no more than a long line has."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(state: Column, part: Column) -> Column:
        fits = state["open"].isNotNull() & (F.length(state["open"]) + F.length(part) <= budget)
        closed = F.when(state["open"].isNull(), state["done"]).otherwise(F.concat(state["done"], F.array(state["open"])))
        return F.struct(F.when(fits, state["done"]).otherwise(closed).alias("done"), F.when(fits, F.concat(state["open"], part)).otherwise(part).alias("open"))

    return F.aggregate(parts, empty, step, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def _starts(sizes: np.ndarray, budget: int, joint: int) -> list[int]:
    """Where the greedy packs of parts of these sizes begin."""
    starts, room = [], -1
    for i, size in enumerate(sizes.tolist()):
        room -= joint + size
        if room < 0 or not starts:
            starts.append(i)
            room = budget - size
    return starts


def packed(parts: Column, budget: int) -> Column:
    """Greedy packs of an array of texts, joined by line breaks, each of at most ``budget`` characters.

    A text above the budget is a pack of its own.  Works inside one row, in one pass over its parts, so there is no
    shuffle and a long text takes time in proportion.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def joined(all_parts: pd.Series) -> pd.Series:
        def one(own) -> list[str] | None:
            if own is None:
                return None
            starts = [*_starts(np.fromiter(map(len, own), np.int64, len(own)), budget, 1), len(own)]
            return ["\n".join(own[a:b]) for a, b in zip(starts, starts[1:])]

        return all_parts.map(one)

    return joined(parts)


def packed_lines(documents: DataFrame, doc_id: str, text: str, budget: int, cut: bool = False) -> DataFrame:
    """(doc_id, chunk_index, total_chunks, content, chunk_size) from the lines that are not blank; ``cut``: none above the budget."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), strip), lambda line: line != "")
    lines = bounded(lines, budget) if cut else lines
    chunks = documents.select(F.col(doc_id).alias("doc_id"), packed(lines, budget).alias("_packs"))
    one = chunks.select("doc_id", F.size("_packs").alias("total_chunks"), F.posexplode("_packs").alias("chunk_index", "content"))
    return one.select("doc_id", "chunk_index", "total_chunks", "content", F.length("content").alias("chunk_size"))


def under_headings(results: DataFrame, result_id: str, items: str) -> DataFrame:
    """(result_id, item_no, label, heading, text): each item with the last title or heading before it.

    Rows of one result meet in one window; a result's items are bounded by its document.
    """
    rows = results.select(F.col(result_id).alias("result_id"), F.inline(items))
    own = F.when(F.col("label").isin("title", "section_header"), F.col("text"))
    before = Window.partitionBy("result_id").orderBy("item_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("result_id", "item_no", "label", F.last(own, ignorenulls=True).over(before).alias("heading"), "text")


def structural(results: DataFrame, result_id: str, items: str, budget: int, cut: bool = False) -> DataFrame:
    """(result_id, heading_no, heading, chunk_index, total_chunks, content, chunk_size).

    Neighbouring items under the same heading share chunks up to the budget; list items stay apart from
    paragraphs.  Headings are not content.  ``cut``: no chunk is above the budget.
    """
    grouped = _grouped(results, result_id, items)
    packs = grouped.withColumn("_packs", packed(bounded(F.col("_texts"), budget) if cut else F.col("_texts"), budget))
    return _numbered(packs.select("result_id", "heading_no", "heading", F.posexplode("_packs").alias("_no", "content")))


def _grouped(results: DataFrame, result_id: str, items: str) -> DataFrame:
    """(result_id, heading_no, heading, _texts): the texts of neighbouring items of a kind under the same heading."""
    rows = under_headings(results, result_id, items).where(~F.col("label").isin("title", "section_header") & (strip(F.col("text")) != ""))
    kind = F.when(F.col("label") == "list_item", "list").otherwise("text")
    order = Window.partitionBy("result_id").orderBy("item_no")
    fresh = (~F.lag("heading").over(order).eqNullSafe(F.col("heading"))) | (F.lag("_kind").over(order) != F.col("_kind"))
    marked = rows.withColumn("_kind", kind).withColumn("_fresh", F.coalesce(fresh, F.lit(True)).cast("int"))
    grouped = marked.withColumn("heading_no", F.sum("_fresh").over(order)).groupBy("result_id", "heading_no").agg(
        F.first("heading").alias("heading"), F.sort_array(F.collect_list(F.struct("item_no", "text"))).alias("_items")
    )
    return grouped.select("result_id", "heading_no", "heading", F.transform("_items", lambda i: i["text"]).alias("_texts"))


def _numbered(one: DataFrame, *more: str) -> DataFrame:
    whole_ = Window.partitionBy("result_id")
    index = F.row_number().over(whole_.orderBy("heading_no", "_no")) - 1
    return one.select(
        "result_id", "heading_no", "heading", index.alias("chunk_index"), F.count("*").over(whole_).cast("int").alias("total_chunks"), "content", F.length("content").alias("chunk_size"), *more
    )


_CUTS = (re.compile(r"(?<=[。！？])|(?<=[.!?])(?=\s)"), re.compile(r"(?<=\s)"))


def _by_tokens(texts: list[str], budget: int, tokenizer: str) -> list[tuple[str, int]]:
    """(content, tokens) of chunks within the budget: texts above it are cut at sentences, then blanks, then characters; neighbours are merged again."""

    def pieces(text: str, depth: int) -> list[str]:
        if tokens.token_count(text, tokenizer) <= budget or len(text) < 2:
            return [text]
        cut = [p for p in _CUTS[depth].split(text) if p] if depth < len(_CUTS) else [text[: len(text) // 2], text[len(text) // 2 :]]
        return merged([p for part in cut for p in (pieces(part, depth + (len(cut) == 1)) if len(cut) > 1 else pieces(part, depth + 1))], "")

    def merged(parts: list[str], joint: str) -> list[str]:
        out: list[str] = []
        for part in parts:
            if out and tokens.token_count(out[-1] + joint + part, tokenizer) <= budget:
                out[-1] += joint + part
            else:
                out.append(part)
        return out

    return [(chunk, tokens.token_count(chunk, tokenizer)) for chunk in merged([p for text in texts for p in pieces(text, 0)], "\n")]


def structural_tokens(results: DataFrame, result_id: str, items: str, budget: int, tokenizer: str | Path = tokens.DEFAULT) -> DataFrame:
    """(result_id, heading_no, heading, chunk_index, total_chunks, content, chunk_size, chunk_tokens) within a budget of tokens.

    As ``structural``: items above the budget are cut as plain text, neighbours under the same heading are merged
    while they fit.  Only a single character of more tokens than the budget is above it.
    """
    name = tokens.vocabulary_file(results.sparkSession, tokenizer)

    @F.pandas_udf(T.ArrayType(T.StructType().add("content", T.StringType()).add("tokens", T.IntegerType())))
    def cut(all_texts: pd.Series) -> pd.Series:
        return all_texts.map(lambda texts: [{"content": c, "tokens": n} for c, n in _by_tokens(list(texts), budget, name)])

    return _numbered(_grouped(results, result_id, items).withColumn("_packs", cut("_texts")).select("result_id", "heading_no", "heading", F.posexplode("_packs").alias("_no", "_c")).select(
        "result_id", "heading_no", "heading", "_no", "_c.content", F.col("_c.tokens").alias("chunk_tokens")
    ), "chunk_tokens")


def markdown(results: DataFrame, result_id: str, items: str) -> DataFrame:
    """(result_id, content): items as markdown, in order: headings with signs of their level, list items with a dash, a blank line between blocks.

    A title has one sign, a header without a level two.  Items are ordered inside the row, so there is no shuffle.
    """
    level = lambda i: F.when(i["label"] == "title", 1).otherwise(F.least(F.coalesce(i["level"] + 1, F.lit(2)), F.lit(6)))
    line = lambda i: F.when(i["label"].isin("title", "section_header"), F.concat(F.repeat(F.lit("#"), level(i)), F.lit(" "), i["text"])).when(i["label"] == "list_item", F.concat(F.lit("- "), i["text"])).otherwise(i["text"])
    kept = F.filter(F.array_sort(items), lambda i: strip(F.coalesce(i["text"], F.lit(""))) != "")
    rows = results.where(F.col(items).isNotNull()).select(F.col(result_id).alias("result_id"), kept.alias("_kept"))
    # list items that follow each other stay together: the list's label is looked up in the column, which is made once
    gap = lambda k, i: F.when(k == 0, "").when((F.get("_kept", k - 1)["label"] == "list_item") & (F.get("_kept", k)["label"] == "list_item"), "\n").otherwise("\n\n")
    return rows.select("result_id", F.array_join(F.transform("_kept", lambda i, k: F.concat(gap(k, i), line(i))), "").alias("content"))


def table_columns(tables: DataFrame, table_id: str, names: list[str], rows: str, batch: int) -> DataFrame:
    """(table_id, part, json): tables as JSON by columns, ``batch`` columns a part.

    ``rows`` is an array of structs with the fields ``names``, all text.  Plain numbers as names of rows and columns would be
    read as values, so both are named row000, col000 and so on; the names that were go into a first column 'row_name' and a
    first row 'column_name'.  One table is one row, as a sheet's limits bound it.
    """
    quoted = lambda c: F.coalesce(F.to_json(F.array(c)), F.lit("[null]"))
    bare = lambda c: F.regexp_replace(quoted(c), r"^\[|\]$", "")
    label = lambda kind, i: F.format_string(f'"{kind}%03d"', i)
    cells = lambda name, value: F.concat(F.lit('    "column_name":'), bare(F.lit(name)), F.array_join(F.transform(F.col(rows), lambda r, i: F.concat(F.lit(",\n    "), label("row", i), F.lit(":"), bare(value(r, i)))), ""))
    columns = [("row_name", lambda r, i: i.cast("string"))] + [(name, lambda r, i, name=name: r[name]) for name in names]
    written = [F.concat(F.lit(f'  "col{k:03d}":{{\n'), cells(name, value), F.lit("\n  }")) for k, (name, value) in enumerate(columns)]
    parts = F.array(*(F.concat(F.lit("{\n"), F.concat_ws(",\n", *written[k : k + batch]), F.lit("\n}")) for k in range(0, len(written), batch)))
    one = tables.select(F.col(table_id).alias("table_id"), F.posexplode(parts).alias("n", "json"))
    return one.select("table_id", F.format_string("Table Part %03d", F.col("n") + 1).alias("part"), "json")


def table_parts(rows: DataFrame, order: str, label: str, columns: list[str], batch: int) -> DataFrame:
    """(part, row_label, json): rows in batches of a table, each row labelled by its first column and as JSON.

    ``order`` numbers the rows from 0 without gaps.
    """
    name = F.when(F.coalesce(F.col(label).cast("string"), F.lit("")) != "", F.col(label).cast("string")).otherwise(F.concat(F.lit("row"), F.format_string("%03d", F.col(order))))
    part = F.concat(F.lit("Table Part "), F.format_string("%03d", F.floor(F.col(order) / batch) + 1))
    return rows.select(part.alias("part"), name.alias("row_label"), F.to_json(F.struct(*columns)).alias("json"))
