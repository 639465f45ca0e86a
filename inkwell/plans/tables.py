"""Queries of the catalog, the store and the cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import cache, catalog, store
from inkwell.plans.registry import query, table


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as they were seen: those of the catalog whose id hashes to an odd digit changed, and new ones."""
    old = table(spark, sf_dir, "catalog_files").where(F.col("chunk_count").isNull() | (F.col("chunk_count") % 5 != 4))
    seen = old.select("source_path", F.when(F.substring("checksum", 1, 1) < "4", F.sha2(F.col("checksum"), 256)).otherwise(F.col("checksum")).alias("checksum"))
    fresh = table(spark, sf_dir, "loader_results").select(F.concat(F.lit("/new/"), F.col("metadata.file_name")).alias("source_path"), F.sha2(F.col("metadata.file_name"), 256).alias("checksum"))
    return seen.unionByName(fresh.where(F.col("source_path").isNotNull()).distinct())


_SQL_INCOMING = """
incoming as (select source_path, case when substring(checksum, 1, 1) < '4' then sha256(checksum) else checksum end as checksum from catalog_files where chunk_count is null or chunk_count % 5 <> 4
 union all select distinct '/new/' || metadata.file_name, sha256(metadata.file_name) from loader_results where metadata.file_name is not null),
linked as (select source_path, c.checksum as old, c.status as s, c.needs_reingest as needs, i.checksum as new from catalog_files c full outer join incoming i using (source_path)),
named as (select *, case when new is null then 'absent' when s is null and old is null then 'new' when old is distinct from new then 'changed' else '{same}' end as change from linked)
select source_path, coalesce(new, old) as checksum, case when change in ('new', 'changed', 'forced') then 'pending' else s end as status,
 case when change in ('new', 'changed', 'forced') then true else needs end as needs_reingest, change from named"""


@query("with " + _SQL_INCOMING.replace("{same}", "unchanged"))
def catalog_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.register(table(spark, sf_dir, "catalog_files"), _incoming(spark, sf_dir))


@query("with " + _SQL_INCOMING.replace("{same}", "forced"))
def catalog_register_forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.register(table(spark, sf_dir, "catalog_files"), _incoming(spark, sf_dir), force=True)


@query("select document_id, status, needs_reingest from catalog_files where not (status = 'ingested' and not needs_reingest) or status is null or needs_reingest is null")
def catalog_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.due(table(spark, sf_dir, "catalog_files")).select("document_id", "status", "needs_reingest")


@query("""
with o as (select * from ingest_tasks qualify row_number() over (partition by task_id order by updated_at desc nulls last, created_at desc nulls last) = 1),
l as (select document_id, arg_max(status, (finished_at, task_id)) as last_status from o where finished_at is not null and status is not null group by 1),
n as (select document_id, count(*) as attempts, count(*) filter (where status = 'failed') as failures from o group by 1)
select document_id, case last_status when 'success' then 'ingested' when 'failed' then 'failed' else c.status end as status,
 case last_status when 'success' then false when 'failed' then true else needs_reingest end as needs_reingest, coalesce(attempts, 0) as attempts, coalesce(failures, 0) as failures, last_status
from catalog_files c left join n using (document_id) left join l using (document_id)""")
def task_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.outcomes(table(spark, sf_dir, "catalog_files"), table(spark, sf_dir, "ingest_tasks"))


@query("""
with o as (select * from ingest_tasks qualify row_number() over (partition by task_id order by updated_at desc nulls last, created_at desc nulls last) = 1)
select task_id, document_id, row_number() over (partition by document_id order by started_at nulls last, task_id) - 1 as retry from o""")
def task_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.retries(table(spark, sf_dir, "ingest_tasks"))


@query("""
select trigger_type, status, count(*) as tasks, count(started_at) as started, count(finished_at) as finished, sum(chunk_count)::bigint as chunks
from (select * from ingest_tasks qualify row_number() over (partition by task_id order by updated_at desc nulls last, created_at desc nulls last) = 1) group by all""")
def task_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = catalog.tasks_once(table(spark, sf_dir, "ingest_tasks"))
    return once.groupBy("trigger_type", "status").agg(F.count("*").alias("tasks"), F.count("started_at").alias("started"), F.count("finished_at").alias("finished"), F.sum("chunk_count").alias("chunks"))


@query("select task_id, document_id from ingest_tasks where document_id in (select document_id from catalog_files where status is distinct from 'failed') group by all")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that stay when failed documents are deleted; a document without a status stays."""
    kept = store.delete_where(table(spark, sf_dir, "catalog_files"), F.col("status") == "failed")
    return table(spark, sf_dir, "ingest_tasks").join(kept.select("document_id"), "document_id", "left_semi").select("task_id", "document_id").distinct()


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run over all documents gave: chunks of those that have some, an error of the others."""
    n = table(spark, sf_dir, "chunks").groupBy(F.col("metadata.file_name").alias("file_name")).agg(F.count_distinct("id").cast("int").alias("chunk_count"))
    files = table(spark, sf_dir, "catalog_files").select("document_id", "file_name")
    return files.join(n, "file_name", "left").select("document_id", "chunk_count", F.when(F.col("chunk_count").isNull(), "no chunks").alias("error"))


_SQL_RESULTS = """
n as (select metadata.file_name as file_name, count(distinct id)::int as chunks from chunks group by 1),
results as (select document_id, chunks, case when chunks is null then 'no chunks' end as error from catalog_files left join n using (file_name)),
clock as (select max(updated_at) as now from catalog_files)"""


def _now(spark: SparkSession, sf_dir: str):
    return F.lit(table(spark, sf_dir, "catalog_files").agg(F.max("updated_at")).first()[0])


@query("""
with clock as (select max(updated_at) as now from catalog_files)
select document_id, 'manual' as trigger_type, 'running' as status, 0 as retry_count, now::timestamp as started_at from catalog_files, clock where not (status = 'ingested' and not needs_reingest) or status is null or needs_reingest is null""")
def tasks_started(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running task for every document that is due."""
    new = catalog.started(table(spark, sf_dir, "catalog_files"), "manual", _now(spark, sf_dir))
    return new.drop("task_id").withColumn("started_at", F.col("started_at").cast("timestamp_ntz"))


@query(f"""
with {_SQL_RESULTS}, o as (select * from ingest_tasks qualify row_number() over (partition by task_id order by updated_at desc nulls last, created_at desc nulls last) = 1)
select task_id, case when status <> 'running' or r.document_id is null then status when error is null then 'success' else 'failed' end as status,
 case when status = 'running' and r.document_id is not null and error is null then chunks else chunk_count end as chunk_count,
 case when status = 'running' and r.document_id is not null then now else finished_at end::timestamp as finished_at, case when status = 'running' and error is null and r.document_id is not null then now else vector_sync_at end::timestamp as vector_sync_at,
 case when status = 'running' and error is not null then error else error_message end as error_message, case when status = 'running' and error is not null then coalesce(retry_count, 0) + 1 else retry_count end as retry_count
from o left join results r on o.document_id = r.document_id, clock""")
def tasks_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running tasks after the results of their documents came in."""
    done = catalog.finished(catalog.tasks_once(table(spark, sf_dir, "ingest_tasks")), _results(spark, sf_dir), _now(spark, sf_dir))
    times = {name: F.col(name).cast("timestamp_ntz") for name in ("finished_at", "vector_sync_at")}
    return done.select("task_id", "status", "chunk_count", "finished_at", "vector_sync_at", "error_message", "retry_count").withColumns(times)


@query(f"""
with {_SQL_RESULTS}
select c.document_id as document_id, case when error is null then 'ingested' else 'failed' end as status, error is not null as needs_reingest, case when error is null then chunks else chunk_count end as chunk_count,
 case when error is null then now else last_ingested_at end::timestamp as last_ingested_at, case when error is null then now else lexical_synced_at end::timestamp as lexical_synced_at
from catalog_files c join results r on c.document_id = r.document_id, clock""")
def documents_written_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog after a run over all documents."""
    done = catalog.written_back(table(spark, sf_dir, "catalog_files"), _results(spark, sf_dir), _now(spark, sf_dir))
    times = {name: F.col(name).cast("timestamp_ntz") for name in ("last_ingested_at", "lexical_synced_at")}
    return done.select("document_id", "status", "needs_reingest", "chunk_count", "last_ingested_at", "lexical_synced_at").withColumns(times)


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored chunks: each id as it arrived last, with its size."""
    rows = table(spark, sf_dir, "chunks").select("id", "ingested_at", F.col("metadata.file_name").alias("file_name"), F.length("content").alias("size"))
    return rows.groupBy("id").agg(F.max_by(F.struct("file_name", "size"), "ingested_at").alias("m"), F.count("*").alias("arrivals")).select("id", "m.file_name", "m.size", "arrivals")


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch with known and new ids, made from the results."""
    rows = table(spark, sf_dir, "loader_results").select(F.col("metadata.file_name").alias("file_name"), F.length("content").alias("size"))
    fresh = rows.groupBy("file_name").agg(F.max("size").alias("size")).where(F.col("file_name").isNotNull()).select(F.concat(F.lit("new-"), "file_name").alias("id"), "file_name", "size", F.lit(1).cast("long").alias("arrivals"))
    known = _chunks(spark, sf_dir).where(F.substring("id", 1, 1) == "a").withColumn("size", F.col("size") + 1)
    return known.unionByName(fresh)


_SQL_STORE = """
stored as (select id, arg_max({'f': metadata.file_name, 's': length(content)}, ingested_at) as m, count(*) as arrivals from chunks group by id),
old as (select id, m.f as file_name, m.s as size, arrivals from stored),
fresh as (select 'new-' || metadata.file_name as id, metadata.file_name as file_name, max(length(content)) as size, 1 as arrivals from loader_results where metadata.file_name is not null group by 1, 2),
batch as (select id, file_name, size + 1 as size, arrivals from old where substring(id, 1, 1) = 'a' union all select * from fresh)"""


@query(f"with {_SQL_STORE} select * from old")
def store_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir)


@query(f"with {_SQL_STORE} select * from old where id not in (select id from batch) union all select * from batch")
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.upsert(_chunks(spark, sf_dir), _batch(spark, sf_dir), "id")


@query(f"with {_SQL_STORE} select * from old union all select * from batch where id not in (select id from old)")
def store_insert_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.insert_new(_chunks(spark, sf_dir), _batch(spark, sf_dir), "id")


@query(f"with {_SQL_STORE} select id from batch where id in (select id from old)")
def store_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.conflicts(_chunks(spark, sf_dir), _batch(spark, sf_dir), "id")


@query(f"with {_SQL_STORE} select * from old where id not in (select id from batch)")
def store_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.delete(_chunks(spark, sf_dir), _batch(spark, sf_dir), "id")


@query(f"with {_SQL_STORE} select * from old where not coalesce(size > 200, false)")
def store_delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.delete_where(_chunks(spark, sf_dir), F.col("size") > 200)


@query(f"with {_SQL_STORE} select file_name, count(*) as chunks, sum(arrivals)::bigint as arrivals, sum(size)::bigint as characters from old group by file_name")
def store_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).groupBy("file_name").agg(F.count("*").alias("chunks"), F.sum("arrivals").alias("arrivals"), F.sum("size").alias("characters"))


@query("select id, substring(content, 1, 40) as head from chunks where id = (select min(id) from chunks) group by all")
def store_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of one id: an equality that reaches the scan."""
    rows = table(spark, sf_dir, "chunks").select("id", "content")
    wanted = rows.agg(F.min("id")).first()[0]
    return store.get(rows, "id", wanted).select("id", F.substring("content", 1, 40).alias("head")).distinct()


@query("select id, content from chunks where id = (select min(id) from chunks) group by all")
def store_get_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of one id with its whole content."""
    rows = table(spark, sf_dir, "chunks").select("id", "content")
    return store.get(rows, "id", rows.agg(F.min("id")).first()[0]).distinct()


@query("""
select content, min(id) as kept, count(distinct id) as ids from chunks group by content having count(distinct id) > 1""")
def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that came under several ids, with the id that is kept."""
    rows = table(spark, sf_dir, "chunks").select("content", "id").distinct()
    return rows.groupBy("content").agg(F.min("id").alias("kept"), F.count("*").alias("ids")).where(F.col("ids") > 1)




def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache table from the access log: an entry per user and kind of event, which lives a day."""
    log = table(spark, sf_dir, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("cache_key"), F.col("user_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), "value")
    entries = log.groupBy("cache_key", "user_id").agg(F.max("ts").alias("used_at"), F.count("*").alias("size"))
    return entries.withColumn("expires_at", F.col("used_at") + F.expr("interval 1 day"))


_SQL_CACHE = """
entries as (select user_id::varchar || ':' || event_type as cache_key, user_id, max(ts)::timestamp as used_at, count(*) as size, max(ts)::timestamp + interval 1 day as expires_at from events group by 1, 2),
clock as (select max(ts)::timestamp - interval 12 hour as now from events)"""


def _with_clock(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    clock = table(spark, sf_dir, "events").agg((F.max("ts").cast("timestamp_ntz") - F.expr("interval 12 hours")).alias("now"))
    return rows.join(F.broadcast(clock))


@query(f"with {_SQL_CACHE} select cache_key, used_at, size from entries, clock where expires_at > now")
def cache_alive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.alive(_with_clock(spark, sf_dir, _cache(spark, sf_dir)), F.col("now")).select("cache_key", "used_at", "size")


@query(f"""
with {_SQL_CACHE},
asked as (select distinct (user_id + 1)::varchar || ':' || event_type as cache_key from events)
select cache_key, cache_key in (select cache_key from entries, clock where expires_at > now) as hit from asked""")
def cache_hit_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "events").select(F.concat_ws(":", (F.col("user_id") + 1).cast("string"), "event_type").alias("cache_key")).distinct()
    return cache.split(asked, _with_clock(spark, sf_dir, _cache(spark, sf_dir)), "cache_key", F.col("now"))


@query(f"with {_SQL_CACHE} select cache_key, size from entries where cache_key not in (select user_id::varchar || ':' || event_type from events where value > 90)")
def cache_batch_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "events").where(F.col("value") > 90).select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("cache_key"))
    return store.delete(_cache(spark, sf_dir), gone, "cache_key").select("cache_key", "size")


@query(f"""
with {_SQL_CACHE},
named as (select distinct user_id::varchar || ':' || event_type as cache_key from events where value > 50)
select cache_key, case when n.cache_key is not null and expires_at > now then now + interval 31 day else expires_at end as expires_at from entries left join named n using (cache_key), clock""")
def cache_renew(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "events").where(F.col("value") > 50).select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("cache_key"))
    return cache.renew(_with_clock(spark, sf_dir, _cache(spark, sf_dir)), named, "cache_key", F.col("now")).select("cache_key", "expires_at")


@query(f"""
with {_SQL_CACHE},
s as (select *, sum(size) over (partition by user_id order by used_at desc, cache_key rows unbounded preceding) as total from entries)
select cache_key, user_id, size from s where total <= 20""")
def cache_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.evict(_cache(spark, sf_dir), ["user_id"], "used_at", "size", 20, "cache_key").select("cache_key", "user_id", "size")


@query("""
with t as (select document_id, list_distinct(list_concat(['all', file_name], string_split(regexp_replace(lower(file_name), '[^a-z]+', '_', 'g'), '_'))) as tags from catalog_files)
select document_id, len(tags) as tags from t where list_has_any(tags, ['pdf', 'diary', 'lecture'])""")
def tag_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that share a tag with those asked; 'all' and the name are tags of their own."""
    own = F.split(F.regexp_replace(F.lower("file_name"), "[^a-z]+", "_"), "_", -1)
    tags = F.array_distinct(F.concat(F.array(F.lit("all"), F.col("file_name")), own))
    rows = table(spark, sf_dir, "catalog_files").select("document_id", tags.alias("tags"))
    return rows.where(F.arrays_overlap("tags", F.array(*map(F.lit, ("pdf", "diary", "lecture"))))).select("document_id", F.size("tags").alias("tags"))
