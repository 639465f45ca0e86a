"""Queries of vector search, keyword search and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.text import terms
from inkwell.functions.vectors import cosine, l2
from inkwell.operators import knn, lexical, metadata, retrieve
from inkwell.plans.registry import query, table
from inkwell.plans.texts import SQL_SHOWN

K = 5
WIDE = "\\x{3040}-\\x{30ff}\\x{31f0}-\\x{31ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}\\x{3005}\\x{0e01}-\\x{0e5b}"


def sql_terms(text: str) -> str:
    """The terms of a text, as DuckDB says it."""
    low = f"lower({text})"
    words = f"regexp_extract_all(regexp_replace({low}, '[{WIDE}]+', ' ', 'g'), '[\\p{{L}}\\p{{N}}]+')"
    runs = f"regexp_extract_all({low}, '[{WIDE}]+')"
    return f"list_concat({words}, flatten(list_transform({runs}, lambda r: list_transform(range(1, greatest(length(r), 2)), lambda i: substring(r, i, 2)))))"


def _queries_where(rows: DataFrame, key: str) -> DataFrame:
    """The stated query set: every row whose id is divisible by 100."""
    return rows.where(F.col(key) % 100 == 0)


def _sql_knn(score: str, order: str, where: str = "true") -> str:
    return f"""
with q as (select vec_id as query_id, embedding::double[] as v from embeddings where vec_id % 100 = 0),
s as (select query_id, e.vec_id as id, round({score}, 6) as score from q, embeddings e where {where}),
r as (select *, row_number() over (partition by query_id order by {order}, id) as rank from s)
select query_id, id, score, rank from r where rank <= {K}"""


@query(_sql_knn("list_distance(e.embedding::double[], v)", "score"))
def knn_l2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return knn.knn(rows, "vec_id", _queries_where(rows, "vec_id"), "vec_id", "embedding", K)


@query(_sql_knn("list_cosine_similarity(e.embedding::double[], v)", "score desc"))
def knn_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return knn.knn(rows, "vec_id", _queries_where(rows, "vec_id"), "vec_id", "embedding", K, "cosine")


@query(_sql_knn("list_cosine_similarity(e.embedding::double[], v)", "score desc", "e.label in (1, 3, 5)"))
def knn_cosine_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter comes before the ranking."""
    rows = table(spark, sf_dir, "embeddings")
    kept = rows.where(metadata.condition(rows, {"bool": {"filter": [{"terms": {"label": [1, 3, 5]}}]}}))
    return knn.knn(kept, "vec_id", _queries_where(rows, "vec_id"), "vec_id", "embedding", K, "cosine")


@query("""
with c as (select id, any_value(embedding::double[]) as embedding from chunks where len(embedding) = 8 group by id)
select id, len(embedding) as width, round(sqrt(list_dot_product(embedding, embedding)), 6) as norm from c""")
def chunk_vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, width, norm) of the chunks with a usable vector, once per id."""
    from inkwell.functions.vectors import norm

    rows = table(spark, sf_dir, "chunks").where(F.size("embedding") == 8).dropDuplicates(["id"])
    return rows.select("id", F.size("embedding").alias("width"), F.round(norm(F.col("embedding")), 6).alias("norm"))


@query("""
select id, case when embedding is null then 'missing' when len(embedding) = 0 then 'empty' when len(embedding) <> 8 then 'width'
  when len(list_filter(embedding, lambda x: x is null)) > 0 then 'null value' else 'ok' end as verdict, count(*) as rows
from chunks group by all""")
def embedding_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    verdict = (
        F.when(e.isNull(), "missing").when(F.size(e) == 0, "empty").when(F.size(e) != 8, "width")
        .when(F.exists(e, lambda x: x.isNull()), "null value").otherwise("ok")
    )
    return table(spark, sf_dir, "chunks").select("id", verdict.alias("verdict")).groupBy("id", "verdict").agg(F.count("*").alias("rows"))


@query("""
with p as (select a.vec_id as a, b.vec_id as b, a.embedding::double[] as x, b.embedding::double[] as y from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)
select a, b, round(list_cosine_similarity(x, y), 6) as cosine, round(list_distance(x, y), 6) as distance from p""")
def pairwise_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine and distance of each vector and the next one."""
    a = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    b = table(spark, sf_dir, "embeddings").select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, "a").select("a", "b", F.round(cosine(F.col("x"), F.col("y")), 6).alias("cosine"), F.round(l2(F.col("x"), F.col("y")), 6).alias("distance"))


@query("""
with q as (select vec_id as query_id, label, embedding::double[] as v from embeddings where vec_id % 100 = 0),
s as (select query_id, e.vec_id as id, round(list_cosine_similarity(e.embedding::double[], v), 6) as score from q join embeddings e on e.label = q.label and e.vec_id <> query_id),
r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s)
select query_id, id, score from r where rank = 1""")
def most_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each query the nearest other vector of its own label; labels never meet in one task."""
    rows = table(spark, sf_dir, "embeddings")
    return knn.knn(rows, "vec_id", _queries_where(rows, "vec_id"), "vec_id", "embedding", 1, "cosine", group="label").select("query_id", "id", "score")


@query()
def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the index of codes against exact search, per query; every row is in the index, an eighth of the bytes is read."""
    rows = table(spark, sf_dir, "embeddings")
    asked = _queries_where(rows, "vec_id")
    codes = knn.fit_codes(rows, "embedding")
    found = knn.search(knn.index(rows, "vec_id", "embedding", codes), rows, "vec_id", asked, "vec_id", "embedding", codes, 10, 50)
    return knn.recall(found, knn.knn(rows, "vec_id", asked, "vec_id", "embedding", 10))


@query(f"select doc_id, len({sql_terms('text')}) as terms, len(list_distinct({sql_terms('text')})) as distinct_terms from documents where text is not null")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = terms(F.col("text"))
    return table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", F.size(words).alias("terms"), F.size(F.array_distinct(words)).alias("distinct_terms"))


@query(f"""
with t as (select doc_id, {sql_terms('text')} as w from documents)
select doc_id, term, len as length, count(*) as tf from (select doc_id, unnest(w) as term, len(w) as len from t) group by all""")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.postings(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""
with t as (select doc_id, source, len({sql_terms('text')}) as n from documents)
select source, count(*) as documents, round(avg(n), 6) as mean_length from t where n > 0 group by source""")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with terms and their mean length, by source."""
    rows = table(spark, sf_dir, "documents").select("source", F.size(terms(F.col("text"))).alias("n")).where(F.col("n") > 0)
    return rows.groupBy("source").agg(F.count("*").alias("documents"), F.round(F.avg("n"), 6).alias("mean_length"))


def _sql_bm25(k1: float = 1.2, b: float = 0.75, where: str = "true", asked: str = "select line_no as query_id, query as q from jp_reference where line_no % 100 = 0", k: int = K, rows: str = "documents") -> str:
    return f"""
with d as (select doc_id, {sql_terms('text')} as w from {rows} where {where}),
n as (select doc_id, len(w) as length from d where len(w) > 0),
s as (select count(*) as documents, avg(length) as mean_length from n),
a as (select distinct query_id, unnest({sql_terms('q')}) as term from ({asked})),
p as (select doc_id, term, len as length, count(*) as tf from (select doc_id, unnest(w) as term, len(w) as len from d) where term in (select term from a) group by all),
f as (select term, count(*) as df from p group by term),
x as (select query_id, doc_id, round(sum(ln(1 + (documents - df + 0.5) / (df + 0.5)) * (tf * {k1 + 1} / (tf + {k1} * (1 - {b} + {b} * length / mean_length)))), 6) as score
  from a join p using (term) join f using (term), s group by query_id, doc_id),
r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from x)
select query_id, doc_id, score, rank from r where rank <= {k}"""


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries_where(table(spark, sf_dir, "jp_reference"), "line_no")


@query(_sql_bm25())
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", _gold(spark, sf_dir), "line_no", "query", K)


@query(_sql_bm25(where="source = 'nihongo_soushuuhen'"))
def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    kept = rows.where(metadata.condition(rows, {"term": {"source": "nihongo_soushuuhen"}}))
    return lexical.bm25(kept, "doc_id", "text", _gold(spark, sf_dir), "line_no", "query", K)


@query(_sql_bm25(2.0, 0.3))
def bm25_tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", _gold(spark, sf_dir), "line_no", "query", K, 2.0, 0.3)


_KEYWORDS = "select line_no * 1000 + pos as query_id, kw as q from (select line_no, unnest(keywords) as kw, generate_subscripts(keywords, 1) as pos from jp_reference where line_no % 100 = 0)"


def _keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gold(spark, sf_dir).select("line_no", F.posexplode("keywords").alias("pos", "keyword")).withColumn("query_id", F.col("line_no").cast("long") * 1000 + F.col("pos") + 1)


@query(_sql_bm25(asked=_KEYWORDS, k=3))
def keyword_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranked list for each keyword of each gold row asked."""
    return lexical.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", _keywords(spark, sf_dir), "query_id", "keyword", 3)


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, item, list_no, rank): list 0 by vector, lists 1.. by keyword.

    A document's vector is the one of its number; a question's is picked by its line, as the tables have none.
    """
    documents, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    own = documents.select("doc_id").join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    asked = _gold(spark, sf_dir).select(F.col("line_no").cast("long").alias("query_id"), (F.col("line_no") % 500).cast("long").alias("vec_id")).join(vectors, "vec_id")
    near = knn.knn(own, "doc_id", asked, "query_id", "embedding", 3).select("query_id", F.col("id").alias("item"), F.lit(0).cast("long").alias("list_no"), "rank")
    words = keyword_batch_topk(spark, sf_dir)
    found = words.select(F.floor(F.col("query_id") / 1000).alias("query_id"), F.col("doc_id").alias("item"), (F.col("query_id") % 1000).alias("list_no"), "rank")
    return near.unionByName(found)


_SQL_HITS = f"""
v as (select line_no as query_id, e.embedding::double[] as x from jp_reference join embeddings e on e.vec_id = line_no % 500 where line_no % 100 = 0),
near as (select query_id, doc_id as item, 0 as list_no, row_number() over (partition by query_id order by round(list_distance(embedding::double[], x), 6), doc_id) as rank
  from v, documents join embeddings on vec_id = doc_id),
words as ({_sql_bm25(asked=_KEYWORDS, k=3)}),
hits as (select query_id, item, list_no, rank from near where rank <= 3 union all select query_id // 1000, doc_id, query_id % 1000, rank from words),
firsts as (select query_id, item, min((list_no, rank)) as f from hits group by all),
placed as (select query_id, item, row_number() over (partition by query_id order by f, item) as position from firsts)"""


@query(f"with {_SQL_HITS} select query_id, item, position from placed")
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.keep_first(_hits(spark, sf_dir), ["query_id"], "item").select("query_id", "item", "position")


@query(f"with {_SQL_HITS} select query_id, 'Found ' || count(*) || ' documents\n\n' || string_agg('[' || position || '] ' || coalesce(text, ''), '\n\n' order by position) as text from placed join documents on doc_id = item group by query_id")
def render_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents are joined only after the hits are few."""
    few = hybrid_retrieve(spark, sf_dir)
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.col("text").alias("content"))
    return retrieve.render(few.join(texts, "item"), ["query_id"], "position", "content")


def _once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").where(F.col("id").isNotNull())


def _chunk_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, item, list_no, rank) over all chunks, once per id: list 0 by their own vectors, lists 1.. by content.

    A question has the vector of a chunk drawn by the hash of its line, as the tables have none of its own.
    """
    rows, e = _once(spark, sf_dir), F.col("embedding")
    usable = rows.where((F.size(e) == 8) & ~F.exists(e, lambda x: x.isNull())).select("id", "embedding").dropDuplicates(["id"])
    lines = _gold(spark, sf_dir).select(F.col("line_no").cast("long").alias("query_id")).distinct()
    near = knn.knn(usable, "id", retrieve.drawn(lines, "query_id", usable, "id"), "query_id", "embedding", 3)
    texts = rows.select("id", "content").dropDuplicates(["id"])
    words = lexical.bm25(texts, "id", "content", _keywords(spark, sf_dir), "query_id", "keyword", 3)
    found = words.select(F.floor(F.col("query_id") / 1000).alias("query_id"), F.col("doc_id").alias("item"), (F.col("query_id") % 1000).alias("list_no"), "rank")
    return near.select("query_id", F.col("id").alias("item"), F.lit(0).cast("long").alias("list_no"), "rank").unionByName(found)


def _hundredth(rows: DataFrame) -> DataFrame:
    """The stated query set where ids are text: every row whose hashed id is divisible by 100."""
    return rows.where(F.conv(F.substring(F.md5("id"), 1, 15), 16, 10).cast("long") % 100 == 0)


def _sql_chunk_knn(score: str, order: str, where: str = "true") -> str:
    return f"""
with c as (select id, any_value(embedding::double[]) as x, any_value(metadata.file_type) as file_type from chunks where id is not null and len(embedding) = 8 and len(list_filter(embedding, lambda x: x is null)) = 0 group by id),
q as (select id as query_id, x as v from c where ('0x' || substring(md5(id), 1, 15))::bigint % 100 = 0),
s as (select query_id, c.id as id, round({score}, 6) as score from q, c where {where}),
r as (select *, row_number() over (partition by query_id order by {order}, id) as rank from s)
select query_id, id, score, rank from r where rank <= {K}"""


def _chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir).where(F.size("embedding") == 8).select("id", "embedding", F.col("metadata.file_type").alias("file_type")).dropDuplicates(["id"])


@query(_sql_chunk_knn("list_distance(c.x, v)", "score"))
def knn_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks nearest to every chunk whose hashed id is divisible by 100."""
    rows = _chunk_vectors(spark, sf_dir)
    return knn.knn(rows, "id", _hundredth(rows), "id", "embedding", K, width=8)


@query(_sql_chunk_knn("list_cosine_similarity(c.x, v)", "score desc", "c.file_type in ('pdf', 'image')"))
def knn_chunks_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by cosine among scanned chunks; the filter comes before the ranking."""
    rows = _chunk_vectors(spark, sf_dir)
    kept = rows.where(metadata.condition(rows, {"terms": {"file_type": ["pdf", "image"]}}))
    return knn.knn(kept, "id", _hundredth(rows), "id", "embedding", K, "cosine", width=8)


_SQL_CHUNKS = "(select id as doc_id, any_value(content) as text from chunks where id is not null group by id)"
_SQL_CHUNK_HITS = f"""
usable as (select id, any_value(embedding::double[]) as x from chunks where id is not null and len(embedding) = 8 and len(list_filter(embedding, lambda x: x is null)) = 0 group by id),
own as (select id, x, row_number() over (order by md5(id), id) - 1 as n from usable),
v as (select line_no as query_id, x from (select distinct line_no from jp_reference where line_no % 100 = 0) join own on n = ('0x' || substring(md5(line_no::varchar), 1, 15))::bigint % (select count(*) from own)),
near as (select query_id, id as item, 0 as list_no, row_number() over (partition by query_id order by round(list_distance(own.x, v.x), 6), id) as rank from v, own),
words as ({_sql_bm25(asked=_KEYWORDS, k=3, rows=_SQL_CHUNKS)}),
hits as (select query_id, item, list_no, rank from near where rank <= 3 union all select query_id // 1000, doc_id, query_id % 1000, rank from words),
firsts as (select query_id, item, min((list_no, rank)) as f from hits group by all),
placed as (select query_id, item, row_number() over (partition by query_id order by f, item) as position from firsts)"""


@query(_sql_bm25(rows=_SQL_CHUNKS))
def bm25_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chunks for each question asked, over all contents, once per id."""
    texts = _once(spark, sf_dir).select("id", "content").dropDuplicates(["id"])
    return lexical.bm25(texts, "id", "content", _gold(spark, sf_dir), "line_no", "query", K)


@query(f"""with {_SQL_CHUNK_HITS},
moded as (select query_id, eval_type, item, min((list_no, rank)) as f from (select *, case when list_no = 0 then 'embedding' else 'keywords' end as eval_type from hits union all select *, 'mix' from hits) group by all)
select query_id, eval_type, item, row_number() over (partition by query_id, eval_type order by f, item) as position from moded""")
def mode_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each question finds by its vector, by its keywords and by both; an error if a mode finds nothing at all."""
    return retrieve.require_modes(retrieve.by_mode(_chunk_hits(spark, sf_dir), ["query_id"], "item").persist(), _gold(spark, sf_dir))


@query(f"""with {_SQL_CHUNK_HITS},
c as (select id, any_value(content) as content, any_value(metadata) as m from chunks where id in (select item from placed) group by id),
b as (select query_id, count(*) as n, string_agg(coalesce(m.file_name, '') || chr(10) || '文件資訊: ' || {SQL_SHOWN} || chr(10) || '內文: ' || coalesce(content, '') || chr(10), chr(10) order by position) as t from placed join c on id = item group by query_id)
select line_no as query_id, case when t is null then '未找到相關文件。' else '找到 ' || n || ' 個相關文件：' || chr(10) || t end as text from (select distinct line_no from jp_reference where line_no % 100 = 0) left join b on query_id = line_no""")
def describe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of each question as a text with file names and metadata, or the text that there are none."""
    few = hybrid_chunks(spark, sf_dir)
    rows = _once(spark, sf_dir).select(F.col("id").alias("item"), "content", F.col("metadata.file_name").alias("file_name"), metadata.shown(metadata.flatten("metadata")).alias("information"))
    hits = few.join(rows, "item").dropDuplicates(["query_id", "item"])
    return retrieve.described(_gold(spark, sf_dir).select(F.col("line_no").cast("long").alias("query_id")), hits, ["query_id"], "position", "file_name", "information", "content")


@query(f"with {_SQL_CHUNK_HITS} select query_id, item, position from placed")
def hybrid_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval over the whole corpus of chunks."""
    return retrieve.keep_first(_chunk_hits(spark, sf_dir), ["query_id"], "item").select("query_id", "item", "position")


@query(f"with {_SQL_CHUNK_HITS} select query_id, 'Found ' || count(*) || ' documents\n\n' || string_agg('[' || position || '] ' || coalesce(text, ''), '\n\n' order by position) as text from placed join {_SQL_CHUNKS} on doc_id = item group by query_id")
def render_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents are joined, and made one per id, only after the hits are few."""
    few = hybrid_chunks(spark, sf_dir)
    texts = _once(spark, sf_dir).select(F.col("id").alias("item"), "content")
    return retrieve.render(few.join(texts, "item").dropDuplicates(["query_id", "item"]), ["query_id"], "position", "content")
