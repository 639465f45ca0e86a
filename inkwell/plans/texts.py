"""Queries of chunking, identifiers and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import text as tx
from inkwell.operators import chunking, ingestion, metadata
from inkwell.plans.registry import query, table
from inkwell.sources import providers

_W = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{0b}\\x{1c}-\\x{1f}]"


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^{_W}+|{_W}+$', '', 'g')"


def sql_uuid5(name: str) -> str:
    h = f"sha1(unhex('{tx.DNS}') || encode({name}))"
    byte = f"(('0x' || substring({h}, 17, 2))::int & 63) | 128"
    return f"substring({h},1,8) || '-' || substring({h},9,4) || '-5' || substring({h},14,3) || '-' || lower(hex({byte})) || substring({h},19,2) || '-' || substring({h},21,12)"


@query(f"""
with c as (select doc_id, {sql_strip('text')} as content from documents)
select doc_id, {sql_uuid5("doc_id::varchar || '|' || content")} as chunk_id, content, 0 as chunk_index, 1 as total_chunks, length(content) as chunk_size from c where content <> ''""")
def chunk_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.whole(table(spark, sf_dir, "documents"), "doc_id", "text")


_LINES = f"""
parts as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents),
lines as (select doc_id, {sql_strip('line')} as line, row_number() over (partition by doc_id order by n) as k from parts where {sql_strip('line')} <> '')"""


def _sql_packs(keys: str, budget: int | str) -> str:
    """Greedy packs of ``lines`` (keys, k, line), one line after the other."""
    on = " and ".join(f"l.{key} = p.{key}" for key in keys.split(", "))
    own = ", ".join(f"l.{key}" for key in keys.split(", "))
    return f"""
packs({keys}, k, pack, size) as (select {keys}, k, 0::bigint, length(line)::bigint from lines where k = 1
 union all select {own}, l.k, case when p.size + 1 + length(l.line) <= {budget} then p.pack else p.pack + 1 end, case when p.size + 1 + length(l.line) <= {budget} then p.size + 1 + length(l.line) else length(l.line) end
 from packs p join lines l on {on} and l.k = p.k + 1)"""


@query(f"""with recursive {_LINES}, {_sql_packs('doc_id', 500)},
c as (select doc_id, pack as chunk_index, string_agg(line, chr(10) order by k) as content from packs join lines using (doc_id, k) group by all)
select doc_id, chunk_index, count(*) over (partition by doc_id) as total_chunks, content, length(content) as chunk_size from c""")
def chunk_packed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.packed_lines(table(spark, sf_dir, "documents"), "doc_id", "text", 500)


@query()
def chunk_packed_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines above the budget are cut before they are packed."""
    return chunking.packed_lines(table(spark, sf_dir, "documents"), "doc_id", "text", 500, cut=True)


_SQL_STRUCTURAL = f"""
r as (select result_id, any_value(items) as items from loader_results where items is not null group by result_id),
i as (select result_id, unnest(items, recursive := true) from r),
h as (select result_id, item_no, case label when 'list_item' then 'list' else 'text' end as kind, label, last_value(case when label in ('title', 'section_header') then text end ignore nulls) over (partition by result_id order by item_no rows unbounded preceding) as heading, text from i),
b as (select * from h where label not in ('title', 'section_header') and {sql_strip('text')} <> ''),
m as (select *, case when lag(kind) over w is null or lag(kind) over w <> kind or lag(heading) over w is distinct from heading then 1 else 0 end as fresh from b window w as (partition by result_id order by item_no)),
g as (select *, sum(fresh) over (partition by result_id order by item_no)::bigint as heading_no from m),
lines as (select result_id, heading_no, heading, text as line, row_number() over (partition by result_id, heading_no order by item_no) as k from g),
{_sql_packs('result_id, heading_no', '{budget}')},
c as (select result_id, heading_no, any_value(heading) as heading, pack, string_agg(line, chr(10) order by k) as content from packs join lines using (result_id, heading_no, k) group by result_id, heading_no, pack)"""


@query(f"""with recursive {_SQL_STRUCTURAL.replace('{budget}', '400')}
select result_id, heading_no, heading, row_number() over (partition by result_id order by heading_no, pack) - 1 as chunk_index, count(*) over (partition by result_id) as total_chunks, content, length(content) as chunk_size from c""")
def chunk_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "loader_results").where(F.col("items").isNotNull()).dropDuplicates(["result_id"])
    return chunking.structural(results, "result_id", "items", 400)


@query()
def chunk_structural_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items above the budget are cut before they are packed."""
    results = table(spark, sf_dir, "loader_results").where(F.col("items").isNotNull()).dropDuplicates(["result_id"])
    return chunking.structural(results, "result_id", "items", 400, cut=True)


@query(f"""with recursive {_SQL_STRUCTURAL.replace('{budget}', '8192')},
w as (select result_id, {sql_strip('any_value(content)')} as content from loader_results group by result_id having coalesce(len(any_value(items)), 0) = 0),
a as (select result_id, 'structural' as chunker, row_number() over (partition by result_id order by heading_no, pack) - 1 as chunk_index, count(*) over (partition by result_id) as total_chunks, content from c
 union all select result_id, 'pass-through', 0, 1, content from w where content <> '')
select result_id, chunker, {sql_uuid5("result_id::varchar || '|' || chunk_index::varchar || '|' || content")} as chunk_id, chunk_index, total_chunks, content, length(content) as chunk_size, 8 as vector_width from a""")
def ingest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ingestion run's middle over all parsed results: routed to a chunker, cut, given ids and vectors.

    No group of items is above the budget, so nothing is cut inside an item here.
    """
    parsed = table(spark, sf_dir, "loader_results").dropDuplicates(["result_id"])
    vectors = providers.encode(ingestion.cut(parsed, "result_id"), "content", providers.HashEmbedder(8))
    return vectors.withColumn("vector_width", F.size("embedding")).drop("embedding")


@query()
def chunk_structural_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by structure within a budget of tokens of a public tokenizer, which SQL can't count."""
    results = table(spark, sf_dir, "loader_results").where(F.col("items").isNotNull()).dropDuplicates(["result_id"])
    return chunking.structural_tokens(results, "result_id", "items", 256)


@query(f"""
with i as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents)
select doc_id, line_no, {sql_strip('line')} as line, length({sql_strip('line')}) as size from i where {sql_strip('line')} <> ''""")
def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", tx.strip(F.col("line")).alias("line")).where(F.col("line") != "").withColumn("size", F.length("line"))


@query("""
with c as (select id, any_value(metadata.file_name) as f, any_value(metadata.chunk_info.chunk_index) as i, any_value(content) as t from chunks group by id)
select id, row_number() over (partition by f order by i nulls last, id) - 1 as chunk_index, count(*) over (partition by f) as total_chunks, length(t) as chunk_size from c where f is not null""")
def chunk_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index, total and size of each chunk within its file, made right.

    A file may hold a tenth of all chunks, so its chunks are ranked over many tasks, by ids and sizes alone.
    """
    own = table(spark, sf_dir, "chunks").select("id", F.col("metadata.file_name").alias("f"), F.col("metadata.chunk_info.chunk_index").alias("i"), F.length("content").alias("chunk_size")).dropDuplicates(["id"])
    ranked = chunking.ranks(own.where(F.col("f").isNotNull()), ["f"], [F.col("i").asc_nulls_last(), F.col("id")])
    return ranked.select("id", F.col("rank").alias("chunk_index"), F.col("total").alias("total_chunks"), "chunk_size")


@query("""
with r as (select result_id, any_value(items) as items from loader_results where items is not null group by result_id),
i as (select result_id, unnest(items, recursive := true) from r)
select result_id, item_no, label, last_value(case when label in ('title', 'section_header') then text end ignore nulls) over (partition by result_id order by item_no rows unbounded preceding) as heading, text from i""")
def heading_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "loader_results").where(F.col("items").isNotNull()).dropDuplicates(["result_id"])
    return chunking.under_headings(results, "result_id", "items")


@query("select doc_id, sha256(text) as checksum from documents where text is not null")
def checksum_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", F.sha2(F.col("text"), 256).alias("checksum"))


@query("select id, md5('hash-8|' || content) as cache_key, 'vec:' || md5('hash-8|' || content) as full_key from chunks group by all")
def cache_key_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = tx.cache_key("hash-8", F.col("content"))
    return table(spark, sf_dir, "chunks").select("id", key.alias("cache_key"), tx.namespaced(F.lit("vec"), key).alias("full_key")).distinct()


@query(f"select distinct id, {sql_uuid5('content')} as chunk_uuid from chunks")
def chunk_uuid5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").select("id", tx.uuid5(F.col("content")).alias("chunk_uuid")).distinct()


@query(f"select result_id, {sql_strip('content')} as content, length({sql_strip('content')}) as size, count(*) as rows from loader_results group by all")
def strip_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = tx.strip(F.col("content"))
    return table(spark, sf_dir, "loader_results").select("result_id", content.alias("content"), F.length(content).alias("size")).groupBy("result_id", "content", "size").agg(F.count("*").alias("rows"))


@query("""
with r as (select result_id, any_value(metadata) as m from loader_results group by result_id),
p as (select result_id, unnest(list_concat([
 {'key': 'file_type', 'value': m.file_type}, {'key': 'file_name', 'value': m.file_name}, {'key': 'title', 'value': m.title}, {'key': 'author', 'value': m.author}, {'key': 'subject', 'value': m.subject},
 {'key': 'created_at', 'value': strftime(m.created_at::timestamp, '%Y-%m-%dT%H:%M:%S')}, {'key': 'modified_at', 'value': strftime(m.modified_at::timestamp, '%Y-%m-%dT%H:%M:%S')},
 {'key': 'is_chunk', 'value': case when m.is_chunk then 'true' end}, {'key': 'chunk_info.chunk_index', 'value': m.chunk_info.chunk_index::varchar}, {'key': 'chunk_info.total_chunks', 'value': m.chunk_info.total_chunks::varchar},
 {'key': 'chunk_info.chunk_size', 'value': m.chunk_info.chunk_size::varchar}, {'key': 'chunk_info.chunk_tokens', 'value': m.chunk_info.chunk_tokens::varchar}],
 coalesce(list_transform(map_entries(m.extra), lambda e: {'key': 'extra.' || e.key, 'value': e.value}), []))) as kv from r)
select result_id, kv.key as key, kv.value as value from p where kv.value is not null""")
def metadata_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "loader_results").dropDuplicates(["result_id"])
    return rows.select("result_id", F.explode(metadata.flatten("metadata")).alias("key", "value")).where(~F.col("key").isin(*metadata.VARIANTS))


# A metadata struct m as a list of its keys and values.
SQL_FLAT = """list_filter(list_concat([
 {'key': 'file_type', 'value': m.file_type}, {'key': 'file_name', 'value': m.file_name}, {'key': 'title', 'value': m.title}, {'key': 'author', 'value': m.author}, {'key': 'subject', 'value': m.subject},
 {'key': 'source', 'value': m.source}, {'key': 'producer', 'value': m.producer}, {'key': 'page', 'value': m.page::varchar}, {'key': 'outlines', 'value': to_json(m.outlines)::varchar},
 {'key': 'created_at', 'value': strftime(m.created_at::timestamp, '%Y-%m-%dT%H:%M:%S')}, {'key': 'modified_at', 'value': strftime(m.modified_at::timestamp, '%Y-%m-%dT%H:%M:%S')},
 {'key': 'is_chunk', 'value': case when m.is_chunk then 'true' end}, {'key': 'chunk_info.chunk_index', 'value': m.chunk_info.chunk_index::varchar}, {'key': 'chunk_info.total_chunks', 'value': m.chunk_info.total_chunks::varchar},
 {'key': 'chunk_info.chunk_size', 'value': m.chunk_info.chunk_size::varchar}, {'key': 'chunk_info.chunk_tokens', 'value': m.chunk_info.chunk_tokens::varchar}],
 coalesce(list_transform(map_entries(m.extra), lambda e: {'key': 'extra.' || e.key, 'value': e.value}), [])), lambda x: x.value is not null)"""
SQL_SHOWN = f"array_to_string(list_sort(list_transform({SQL_FLAT}, lambda x: x.key || '=' || x.value)), ', ')"


@query(f"""
with r as (select result_id, any_value(metadata) as m from loader_results group by result_id),
p as (select result_id, unnest({SQL_FLAT}) as kv from r)
select result_id, kv.key as key, kv.value as value from p""")
def metadata_flatten_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the fields of the variants too."""
    rows = table(spark, sf_dir, "loader_results").dropDuplicates(["result_id"])
    return rows.select("result_id", F.explode(metadata.flatten("metadata")).alias("key", "value"))


@query("""
with r as (select result_id, any_value(metadata) as m from loader_results group by result_id)
select result_id, coalesce(m.file_type, 'string') as file_type, coalesce(m.file_name, '') as file_name, m.title as title, date_trunc('second', m.created_at::timestamp) as created_at,
 coalesce(m.is_chunk, false) as is_chunk, m.chunk_info.chunk_size as chunk_size, len(list_filter(coalesce(map_values(m.extra), []), lambda v: v is not null)) as extras from r""")
def metadata_unflatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flattened and made a struct again."""
    rows = table(spark, sf_dir, "loader_results").dropDuplicates(["result_id"])
    m = rows.select("result_id", metadata.unflatten(metadata.flatten("metadata")).alias("m"))
    return m.select("result_id", "m.file_type", "m.file_name", "m.title", F.col("m.created_at").cast("timestamp_ntz").alias("created_at"), "m.is_chunk", "m.chunk_info.chunk_size", F.size("m.extra").alias("extras"))


@query("""
with r as (select result_id, any_value(metadata) as m from loader_results group by result_id)
select result_id, coalesce(m.file_type, 'string') as file_type, coalesce(m.file_name, '') as file_name, m.title as title, m.author as author, m.subject as subject, m.source as source, m.producer as producer, m.page as page, m.outlines as outlines,
 date_trunc('second', m.created_at::timestamp) as created_at, date_trunc('second', m.modified_at::timestamp) as modified_at, coalesce(m.is_chunk, false) as is_chunk,
 m.chunk_info.chunk_index as chunk_index, m.chunk_info.total_chunks as total_chunks, m.chunk_info.chunk_size as chunk_size, m.chunk_info.chunk_tokens as chunk_tokens,
 list_sort(list_transform(list_filter(coalesce(map_entries(m.extra), []), lambda e: e.value is not null), lambda e: e.key || '=' || e.value)) as extra from r""")
def metadata_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field after flattening and back; extra as sorted 'key=value'."""
    rows = table(spark, sf_dir, "loader_results").dropDuplicates(["result_id"])
    m = rows.select("result_id", metadata.unflatten(metadata.flatten("metadata")).alias("m")).select("result_id", "m.*")
    extra = F.array_sort(F.transform(F.map_entries("extra"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    times = {name: F.col(name).cast("timestamp_ntz") for name in metadata.TIMES}
    return m.withColumns(times | {"extra": extra}).select("*", "chunk_info.*").drop("chunk_info")


@query("""
select id, count(*) as rows from chunks where metadata.file_type in ('pdf', 'markdown') and metadata.chunk_info.chunk_index >= 2
 and not coalesce(metadata.chunk_info.chunk_size > 300, false) and metadata.title is not null group by id""")
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "chunks")
    tree = {"bool": {
        "must": [{"terms": {"metadata.file_type": ["pdf", "markdown"]}}], "filter": [{"range": {"metadata.chunk_info.chunk_index": {"gte": 2}}}, {"exists": {"field": "metadata.title"}}],
        "must_not": {"range": {"metadata.chunk_info.chunk_size": {"gt": 300}}},
    }}
    return rows.where(metadata.condition(rows, tree)).groupBy("id").agg(F.count("*").alias("rows"))


@query("select id, count(*) as rows from chunks where metadata.file_type = 'pdf' or metadata.page > 5 group by id")
def metadata_filter_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field that the table doesn't have matches nothing, beside fields that it has."""
    rows = table(spark, sf_dir, "chunks")
    tree = {"bool": {"should": [{"term": {"metadata.nowhere.at_all": 1}}, {"term": {"metadata.file_type": "pdf"}}, {"range": {"metadata.page": {"gt": 5}}}], "must_not": {"exists": {"field": "metadata.nowhere"}}}}
    return rows.where(metadata.condition(rows, tree)).groupBy("id").agg(F.count("*").alias("rows"))


@query(f"with c as (select id, any_value(content) as content, any_value(metadata) as m from chunks where id is not null group by id) select id, content, {SQL_SHOWN} as metadata from c")
def chunk_to_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as documents of a store: flat metadata, no vector."""
    rows = table(spark, sf_dir, "chunks").where(F.col("id").isNotNull()).select("id", "content", "metadata").dropDuplicates(["id"])
    return metadata.as_document(rows, "id", "content", "metadata").select("id", "content", metadata.shown(F.col("metadata")).alias("metadata"))


@query(f"with c as (select id, any_value(content) as content, any_value(metadata) as m from chunks where id is not null group by id) select id, {sql_strip('content')} as content, coalesce(m.file_type, 'string') as file_type, coalesce(m.file_name, '') as file_name, m.title as title, case when m.source in ('unknown', 'PDF', 'Microsoft Word', 'Microsoft Excel', 'LibreOffice Writer', 'LibreOffice Calc', 'Markdown') then m.source end as source, m.page as page, m.chunk_info.chunk_index as chunk_index from c")
def chunk_from_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks made documents of a store and read back."""
    rows = table(spark, sf_dir, "chunks").where(F.col("id").isNotNull()).select("id", "content", "metadata").dropDuplicates(["id"])
    back = metadata.as_chunk(metadata.as_document(rows, "id", "content", "metadata"))
    return back.select("id", "content", "metadata.file_type", "metadata.file_name", "metadata.title", "metadata.source", "metadata.page", "metadata.chunk_info.chunk_index")


@query("""
select document_id, case when metadata_json is null or trim(metadata_json) = '' then 'none' when not json_valid(metadata_json) then 'broken' when len(json_keys(metadata_json)) = 0 then 'empty' else 'ok' end as state,
 case when json_valid(metadata_json) then json_extract_string(metadata_json, '$.file_type') end as file_type from catalog_files""")
def catalog_metadata_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the catalog's JSON holds, told from missing, broken and empty ones."""
    parsed = table(spark, sf_dir, "catalog_files").select("document_id", "metadata_json", metadata.parsed_json(F.col("metadata_json")).alias("m"))
    state = F.when(F.coalesce(F.trim("metadata_json"), F.lit("")) == "", "none").when(F.col("m").isNull(), "broken").when(F.size("m") == 0, "empty").otherwise("ok")
    return parsed.select("document_id", state.alias("state"), F.try_element_at("m", F.lit("file_type")).alias("file_type"))


@query("""
with t as (select document_id, case when chunk_count % 3 = 0 then strftime(created_at, '%Y/%m/%d %H:%M:%S') when chunk_count % 3 = 1 then strftime(created_at, '%Y:%m:%d %H:%M:%S') else strftime(created_at, '%d.%m.%Y') end as written, created_at, chunk_count from catalog_files)
select document_id, written, case when chunk_count % 3 in (0, 1) then date_trunc('second', created_at::timestamp) end as taken_at from t""")
def exif_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as images write them, read back; other ways of writing give null."""
    form = F.col("chunk_count") % 3
    written = F.when(form == 0, F.date_format("created_at", "yyyy/MM/dd HH:mm:ss")).when(form == 1, F.date_format("created_at", "yyyy:MM:dd HH:mm:ss")).otherwise(F.date_format("created_at", "dd.MM.yyyy"))
    rows = table(spark, sf_dir, "catalog_files").select("document_id", written.alias("written"))
    return rows.withColumn("taken_at", metadata.exif_date(F.col("written")).cast("timestamp_ntz"))


@query("with r as (select result_id, any_value(items) as items from loader_results group by result_id) select result_id, case when coalesce(len(items), 0) > 0 then 'structural' else 'pass-through' end as chunker from r")
def chunker_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "loader_results").dropDuplicates(["result_id"])
    return rows.select("result_id", metadata.chunker(F.col("items")).alias("chunker"))


@query(f"""
with r as (select result_id, any_value(items) as items from loader_results where items is not null group by result_id),
i as (select result_id, unnest(items, recursive := true) from r),
k as (select *, lag(label) over (partition by result_id order by item_no) as before, row_number() over (partition by result_id order by item_no) as n from i where {sql_strip("coalesce(text, '')")} <> '')
select result_id, string_agg(case when n = 1 then '' when before = 'list_item' and label = 'list_item' then chr(10) else chr(10) || chr(10) end
 || case when label = 'title' then '# ' || text when label = 'section_header' then repeat('#', least(coalesce(level + 1, 2), 6)) || ' ' || text when label = 'list_item' then '- ' || text else text end, '' order by n) as content
from k group by result_id""")
def markdown_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "loader_results").where(F.col("items").isNotNull()).dropDuplicates(["result_id"])
    return chunking.markdown(rows, "result_id", "items").where(F.col("content") != "")


_SQL_CASES = lambda key, cases, other: "case " + key + " " + " ".join(f"when '{k}' then '{v}'" for k, v in cases.items()) + f" else '{other}' end"
_SUFFIX = "lower(regexp_extract(source_path, '\\.([^./\\\\]+)$', 1))"


@query(f"select document_id, {_SQL_CASES(_SUFFIX, metadata.LOADERS, 'error')} as loader, {_SQL_CASES(_SUFFIX, metadata.MIMES, 'application/octet-stream')} as mime from catalog_files")
def mime_and_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = metadata.suffix(F.col("source_path"))
    return table(spark, sf_dir, "catalog_files").select("document_id", metadata.looked_up(key, metadata.LOADERS, "error").alias("loader"), metadata.looked_up(key, metadata.MIMES, "application/octet-stream").alias("mime"))


@query("""
with p as (select result_id, coalesce(metadata.producer, '') as p from loader_results)
select result_id, case when regexp_matches(p, 'Microsoft.+Excel') then 'Microsoft Excel' when regexp_matches(p, 'Microsoft.+Word') then 'Microsoft Word' when regexp_matches(p, 'Adobe.+PDF') then 'PDF'
 when lower(p) like '%libreoffice%' and lower(p) like '%writer%' then 'LibreOffice Writer' when lower(p) like '%libreoffice%' and lower(p) like '%calc%' then 'LibreOffice Calc' else 'unknown' end as pdf_source, count(*) as rows from p group by all""")
def producer_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "loader_results")
    return rows.select("result_id", metadata.pdf_source(F.col("metadata.producer")).alias("pdf_source")).groupBy("result_id", "pdf_source").agg(F.count("*").alias("rows"))


@query("""
with r as (select result_id, any_value(metadata) as m from loader_results group by result_id),
o as (select result_id, m.file_name as file_name, m.page as page, unnest(m.outlines) as title, generate_subscripts(m.outlines, 1) as n from r where m.page is not null)
select file_name, page, count(*) as titles, string_agg(title, ' / ' order by result_id, n) as outline from o where title is not null group by all""")
def outline_page_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The titles of each page in their order, repeats included; results that were delivered twice count once."""
    rows = table(spark, sf_dir, "loader_results").where(F.col("metadata.page").isNotNull()).select("result_id", F.col("metadata.file_name").alias("file_name"), F.col("metadata.page").alias("page"), "metadata.outlines")
    titles = rows.dropDuplicates(["result_id"]).select("result_id", "file_name", "page", F.posexplode("outlines").alias("n", "title")).where(F.col("title").isNotNull())
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("result_id", "n", "title"))), lambda t: t["title"])
    return titles.groupBy("file_name", "page").agg(F.count("*").alias("titles"), F.array_join(ordered, " / ").alias("outline"))


@query("""
with f as (select metadata.file_name as file_name, max(metadata.page) as pages from loader_results where metadata.page is not null group by all),
p as (select file_name, unnest(range(1, pages + 1)) as page from f),
l as (select metadata.file_name as file_name, metadata.page as page, max(len(metadata.outlines)) as titles, count(*) as rows from loader_results group by all)
select p.file_name, p.page, coalesce(titles, 0) as titles, coalesce(rows, 0) as rows from p left join l using (file_name, page)""")
def page_metadata_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each page of a file up to its last, also where no row came."""
    rows = table(spark, sf_dir, "loader_results").select(F.col("metadata.file_name").alias("file_name"), F.col("metadata.page").alias("page"), F.size("metadata.outlines").alias("n"))
    known = rows.where(F.col("page").isNotNull()).groupBy("file_name", "page").agg(F.max(F.when(F.col("n") >= 0, F.col("n"))).alias("titles"), F.count("*").alias("rows"))
    every = rows.groupBy("file_name").agg(F.max("page").alias("pages")).where(F.col("pages").isNotNull()).select("file_name", F.explode(F.sequence(F.lit(1), F.col("pages"))).alias("page"))
    return every.join(known, ["file_name", "page"], "left").select("file_name", "page", F.coalesce("titles", F.lit(0)).alias("titles"), F.coalesce("rows", F.lit(0)).alias("rows"))


@query("""
select 'Table Part ' || printf('%03d', (p_partkey // 30) + 1) as part, p_name as row_label, p_partkey as n, length(p_name) as width from part""")
def table_split_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.table_parts(table(spark, sf_dir, "part"), "p_partkey", "p_name", ["p_partkey", "p_name"], 30)
    return rows.select("part", "row_label", F.get_json_object("json", "$.p_partkey").cast("long").alias("n"), F.length(F.get_json_object("json", "$.p_name")).alias("width"))


@query("""
with t as (select p_partkey // 30 as table_id, row_number() over (partition by p_partkey // 30 order by p_partkey) - 1 as n, * from part),
c as (select table_id, 0 as k, 'row_name' as name, n, n::varchar as v from t union all select table_id, 1, 'p_partkey', n, p_partkey::varchar from t
 union all select table_id, 2, 'p_name', n, p_name from t union all select table_id, 3, 'p_brand', n, p_brand from t),
o as (select table_id, k, '  "col' || printf('%03d', k) || '":{' || chr(10) || '    "column_name":' || to_json(name)::varchar
 || string_agg(',' || chr(10) || '    "row' || printf('%03d', n) || '":' || to_json(v)::varchar, '' order by n) || chr(10) || '  }' as written from c group by table_id, k, name)
select table_id, 'Table Part ' || printf('%03d', k // 2 + 1) as part, '{' || chr(10) || string_agg(written, ',' || chr(10) order by k) || chr(10) || '}' as json from o group by table_id, k // 2""")
def table_json_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of thirty parts as JSON by columns, two columns a part, rows and columns named."""
    names = ["p_partkey", "p_name", "p_brand"]
    row = F.struct("p_partkey", *(F.col(n).cast("string").alias(f"_{n}") for n in names))
    lists = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 30).alias("table_id")).agg(F.sort_array(F.collect_list(row)).alias("all"))
    tables = lists.select("table_id", F.transform("all", lambda r: F.struct(*(r[f"_{n}"].alias(n) for n in names))).alias("rows"))
    return chunking.table_columns(tables, "table_id", names, "rows", 2)
