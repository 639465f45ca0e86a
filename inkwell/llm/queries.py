"""The queries of the numbered problems, by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import languages, leaks, pack, pairs, scans, sentences, split, tokens, unify
from inkwell.llm.sql import SQL
from inkwell.llm.tables import contents, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defects(table(spark, sf_dir, "eval_rows"))


def p2_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, field, rec_key, entry, text, unified, changed, guessed) of all texts that problem 2 names."""
    gold = table(spark, sf_dir, "jp_reference")
    line = F.col("line_no").cast("string").alias("rec_key")
    texts = (
        table(spark, sf_dir, "chunks").select(F.lit("chunks").alias("tbl"), F.lit("content").alias("field"), F.col("id").alias("rec_key"), F.lit(0).alias("entry"), F.col("content").alias("text"))
        .unionByName(gold.select(F.lit("jp_reference").alias("tbl"), F.lit("query").alias("field"), line, F.lit(0).alias("entry"), F.col("query").alias("text")))
        .unionByName(gold.select(F.lit("jp_reference").alias("tbl"), F.lit("keywords").alias("field"), line, F.posexplode("keywords").alias("entry", "text")))
    )
    return unify.unify(texts, ["tbl", "field", "rec_key", "entry"], "text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_texts(spark, sf_dir).where("changed").select("tbl", "field", "rec_key").distinct()


def _scanned(spark: SparkSession, sf_dir: str):
    """The scanned texts and the model of the others."""
    texts = contents(spark, sf_dir)
    scanned = (
        texts.where(F.col("file_type").isin("pdf", "image") & F.col("content").isNotNull())
        .withColumn("file", F.coalesce("file_name", F.concat_ws(":", "tbl", "rec_key")))
    )
    plain = texts.where(F.col("content").isNotNull() & F.col("file_type").isin("markdown", "docx", "string", "xlsx"))
    titles = texts.where(F.col("title").isNotNull()).select(F.col("title").alias("content")).distinct()
    return scanned, scans.language_model(plain.select("content").unionByName(titles))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.traces(*_scanned(spark, sf_dir))


def p3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repaired(*_scanned(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends are found before repeated keys are dropped, so that contents are never shuffled."""
    texts = contents(spark, sf_dir).where(F.col("file_type").isin("markdown", "docx", "string"))
    ends = texts.select("tbl", "rec_key", sentences.sentence_ends(F.col("content")).alias("ends"))
    return ends.groupBy("tbl", "rec_key").agg(F.max("ends").alias("ends")).select("tbl", "rec_key", F.explode("ends").alias("end_pos"))


def _limited(spark: SparkSession, sf_dir: str) -> tuple:
    return contents(spark, sf_dir), ["tbl", "rec_key"], "content", "file_type", table(spark, sf_dir, "split_limits")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.oversized(*_limited(spark, sf_dir)).select("tbl", "rec_key", "cut")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.pieces(*_limited(spark, sf_dir), tokens.DEFAULT)


def p5_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, rec_key, chars, within, overlapping, numbered): of each divided text whether its pieces keep the limit, repeat the
    overlap, are numbered rightly, and the characters that they give back without what they repeat."""
    limits = F.broadcast(table(spark, sf_dir, "split_limits"))
    types = contents(spark, sf_dir).select("tbl", "rec_key", "file_type").dropDuplicates(["tbl", "rec_key"])
    pieces = p5_pieces(spark, sf_dir).select("tbl", "rec_key", F.length("piece").alias("n"), "start_pos", "end_pos", "chunk_info").join(types, ["tbl", "rec_key"]).join(limits, "file_type")
    last = F.max_by("end_pos", "chunk_info.chunk_index")
    starts = F.sort_array(F.collect_list("start_pos"))
    ends = F.sort_array(F.collect_list("end_pos"))
    overlap = F.first("overlap_chars")
    repeated = F.forall(F.zip_with(F.slice(starts, F.lit(2), F.greatest(F.count("*").cast("int") - 1, F.lit(0))), ends, lambda s, e: s.isNull() | (s == F.greatest(e - overlap, F.lit(0)))), lambda x: x)
    return pieces.groupBy("tbl", "rec_key").agg(
        last.alias("chars"), (F.max("n") <= F.first("max_chars")).alias("within"), repeated.alias("overlapping"),
        ((F.count("*") == F.first("chunk_info.total_chunks")) & (F.max("chunk_info.chunk_index") + 1 == F.count("*")) & (F.sum(F.col("chunk_info.chunk_size") - F.col("n")) == 0)).alias("numbered"),
    )


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", tokens.count_tokens(spark, F.col("text"), tokens.DEFAULT).alias("n_tokens"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pack_name, doc_id, piece, size, container): the container of every document for each capacity.

    The lengths are counted once and kept, as each capacity reads them several times.
    """
    sized = _sized(spark, sf_dir).persist()
    capacities = {r["pack_name"]: r["capacity_tokens"] for r in table(spark, sf_dir, "pack_sizes").collect()}
    packed = [pack.pack(spark, sized, capacity).select(F.lit(name).alias("pack_name"), "*") for name, capacity in sorted(capacities.items())]
    return reduce(DataFrame.unionByName, packed)


def p6_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pack_name, containers, capacity, used, unused_share): how full the containers are."""
    sizes = table(spark, sf_dir, "pack_sizes")
    used = p6_containers(spark, sf_dir).where(F.col("container") >= 0).groupBy("pack_name").agg((F.max("container") + 1).alias("containers"), F.sum("size").alias("used"))
    share = 1 - F.col("used") / (F.col("containers") * F.col("capacity_tokens"))
    return used.join(F.broadcast(sizes), "pack_name").select("pack_name", "containers", F.col("capacity_tokens").alias("capacity"), "used", F.round(share, 6).alias("unused_share"))


def p6_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pack_name, documents, divided, overfull, pieces_twice): that each document has its place, only those above the capacity are divided, and no container is overfull."""
    sizes = F.broadcast(table(spark, sf_dir, "pack_sizes"))
    packed = p6_containers(spark, sf_dir)
    loads = packed.where(F.col("container") >= 0).groupBy("pack_name", "container").agg(F.sum("size").alias("load")).join(sizes, "pack_name")
    overfull = loads.groupBy("pack_name").agg(F.count(F.when(F.col("load") > F.col("capacity_tokens"), 1)).alias("overfull"))
    each = packed.groupBy("pack_name", "doc_id").agg(F.count("*").alias("n"), F.sum("size").alias("tokens"), F.max("piece").alias("last")).join(sizes, "pack_name")
    wrong = (F.col("n") > 1) & (F.col("tokens") <= F.col("capacity_tokens"))
    placed = each.groupBy("pack_name").agg(F.count("*").alias("documents"), F.count(F.when(wrong, 1)).alias("divided"), F.count(F.when(F.col("n") != F.col("last") + 1, 1)).alias("pieces_twice"))
    return placed.join(overfull, "pack_name", "left").select("pack_name", "documents", "divided", F.coalesce("overfull", F.lit(0)).alias("overfull"), "pieces_twice")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "test_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return languages.segments(documents, languages.fit(documents))


def p8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.document_languages(p8_segments(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.unnamed_languages(table(spark, sf_dir, "documents"), p8_segments(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p2_found": p2_found, "p2_texts": p2_texts, "p3_found": p3_found, "p3_paragraphs": p3_paragraphs, "p4_found": p4_found, "p5_found": p5_found, "p5_pieces": p5_pieces, "p5_checked": p5_checked, "p6_containers": p6_containers, "p6_unused": p6_unused, "p6_checked": p6_checked, "p7_found": p7_found, "p7_leaks": p7_leaks, "p8_found": p8_found, "p8_segments": p8_segments, "p8_documents": p8_documents}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
