"""Hybrid retrieval: one vector list, one list for each keyword, joined keep-first without mixing scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_first(hits: DataFrame, keys: list[str], item: str) -> DataFrame:
    """(keys, item, list_no, rank, position): each item once, where it comes first; position from 1.

    Lists are short (k per list), so a query's items meet in one window.
    """
    from pyspark.sql.window import Window

    first = hits.groupBy(*keys, item).agg(F.min(F.struct("list_no", "rank")).alias("_first"))
    order = Window.partitionBy(*keys).orderBy("list_no", "rank", item)
    return first.select(*keys, item, "_first.list_no", "_first.rank").withColumn("position", F.row_number().over(order))


#: What each mode of retrieval searches by: list 0 is the vector's, the others are the keywords'.
MODES = ("embedding", "keywords", "mix")


class EmptyModeError(ValueError):
    """A mode of retrieval found nothing for any question."""


def by_mode(hits: DataFrame, keys: list[str], item: str) -> DataFrame:
    """(keys, eval_type, item, position): the hits of each mode kept first within it.

    Mode 'embedding' takes list 0, 'keywords' the other lists, 'mix' all of them.
    """
    modes = F.array(F.when(F.col("list_no") == 0, F.lit("embedding")).otherwise(F.lit("keywords")), F.lit("mix"))
    return keep_first(hits.withColumn("eval_type", F.explode(modes)), [*keys, "eval_type"], item).select(*keys, "eval_type", item, "position")


def require_modes(found: DataFrame, asked: DataFrame, modes: tuple[str, ...] = MODES) -> DataFrame:
    """The same rows; an error if a mode found nothing at all though something was asked."""
    if asked.isEmpty():
        return found
    there = {r["eval_type"] for r in found.select("eval_type").distinct().collect()}
    missing = [m for m in modes if m not in there]
    if missing:
        raise EmptyModeError(f"mode {missing[0]} retrieved nothing")
    return found


def render(hits: DataFrame, keys: list[str], order: str, content: str) -> DataFrame:
    """(keys, text): a count, then a block for each hit in order."""
    blocks = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(content), F.lit("")).alias("c"))))
    text = F.concat(
        F.lit("Found "), F.count("*").cast("string"), F.lit(" documents\n\n"),
        F.array_join(F.transform(blocks, lambda b: F.concat(F.lit("["), b["o"].cast("string"), F.lit("] "), b["c"])), "\n\n"),
    )
    return hits.groupBy(*keys).agg(text.alias("text"))


# The texts in which hits are handed on.
NO_HITS = "未找到相關文件。"
SOME_HITS = ("找到 ", " 個相關文件：")
INFORMATION, CONTENT = "文件資訊: ", "內文: "


def described(asked: DataFrame, hits: DataFrame, keys: list[str], order: str, file_name: str, information: str, content: str) -> DataFrame:
    """(keys, text) for every row of ``asked``: how many hits, then file name, information and content of each in order.

    A row without hits gets the text that says so; nulls are empty.
    """
    empty = lambda name: F.coalesce(F.col(name), F.lit(""))
    block = F.concat(empty(file_name), F.lit("\n" + INFORMATION), empty(information), F.lit("\n" + CONTENT), empty(content), F.lit("\n"))
    texts = hits.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b")))).alias("_blocks"))
    head = F.concat(F.lit(SOME_HITS[0]), F.size("_blocks").cast("string"), F.lit(SOME_HITS[1]))
    text = F.when(F.col("_blocks").isNull(), F.lit(NO_HITS)).otherwise(F.array_join(F.concat(F.array(head), F.transform("_blocks", lambda x: x["b"])), "\n"))
    return asked.select(*keys).distinct().join(texts, keys, "left").select(*keys, text.alias("text"))


def drawn(queries: DataFrame, query_id: str, rows: DataFrame, row_id: str) -> DataFrame:
    """(query_id, and the columns of rows): for each query one row, drawn from all rows by the hash of the query's id.

    Rows are numbered in the order of their ids' hashes, counted in 4,096 parts by its first digits, so that no
    window holds them all; ids must be distinct.
    """
    from pyspark.sql.window import Window

    split = rows.withColumn("_hash", F.md5(F.col(row_id).cast("string"))).withColumn("_part", F.substring("_hash", 1, 3))
    counts = split.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("_hash", row_id)) - 1
    numbered = split.withColumn("_within", within).join(F.broadcast(offsets), "_part").withColumn("_number", F.col("_before") + F.col("_within"))
    total = counts.agg(F.sum("_n").alias("_total"))
    place = F.conv(F.substring(F.md5(F.col(query_id).cast("string")), 1, 15), 16, 10).cast("long") % F.col("_total")
    asked = queries.select(query_id).join(F.broadcast(total)).select(query_id, place.alias("_number"))
    return numbered.join(asked, "_number").select(query_id, *rows.columns)
