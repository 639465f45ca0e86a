"""Metadata: flattening to dotted keys and back, and filters as trees of conditions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALARS = ("file_type", "file_name", "title", "author", "subject", "source", "producer")
TIMES = ("created_at", "modified_at")
CHUNK_INFO = ("chunk_index", "total_chunks", "chunk_size", "chunk_tokens")
#: Fields of the variants of single loaders; the older flat form hasn't got them.
VARIANTS = ("source", "producer", "page", "outlines")
ISO = "yyyy-MM-dd'T'HH:mm:ss"


def flatten(metadata: str) -> Column:
    """A map from dotted keys to text: nulls left out, times in ISO form, is_chunk only if true, outlines as JSON."""
    m = F.col(metadata)
    pairs = [(name, m[name]) for name in SCALARS] + [(name, F.date_format(m[name], ISO)) for name in TIMES]
    pairs += [("is_chunk", F.when(m["is_chunk"], F.lit("true")))] + [(f"chunk_info.{name}", m["chunk_info"][name].cast("string")) for name in CHUNK_INFO]
    pairs += [("page", m["page"].cast("string")), ("outlines", F.to_json(m["outlines"]))]
    own = F.map_from_arrays(F.array(*(F.lit(k) for k, _ in pairs)), F.array(*(v for _, v in pairs)))
    extra = F.transform_keys(F.coalesce(m["extra"], F.create_map().cast("map<string,string>")), lambda k, _: F.concat(F.lit("extra."), k))
    return F.map_filter(F.map_concat(own, extra), lambda _, v: v.isNotNull())


def unflatten(flat: Column, strict: bool = False) -> Column:
    """The struct that a flat map stands for; file_type defaults to 'string', file_name to ''; ``strict``: a source that is none of ``SOURCES`` is null."""
    at = lambda key: F.try_element_at(flat, F.lit(key))
    info = F.struct(*(at(f"chunk_info.{name}").cast("int").alias(name) for name in CHUNK_INFO))
    extra = F.transform_keys(F.map_filter(flat, lambda k, _: k.startswith("extra.")), lambda k, _: F.substr(k, F.lit(7)))
    return F.struct(
        F.coalesce(at("file_type"), F.lit("string")).alias("file_type"), F.coalesce(at("file_name"), F.lit("")).alias("file_name"),
        *((source(at(name)) if strict and name == "source" else at(name)).alias(name) for name in SCALARS[2:]), *(F.try_to_timestamp(at(name), F.lit(ISO)).alias(name) for name in TIMES),
        (F.coalesce(at("is_chunk"), F.lit("false")) == "true").alias("is_chunk"), info.alias("chunk_info"), extra.alias("extra"),
        at("page").cast("int").alias("page"), F.from_json(at("outlines"), "array<string>").alias("outlines"),
    )


def shown(flat: Column) -> Column:
    """A flat map as one line, 'key=value' in order of the keys."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(flat), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ", ")


# The sources that a page may name; any other is none.
SOURCES = ("unknown", "PDF", "Microsoft Word", "Microsoft Excel", "LibreOffice Writer", "LibreOffice Calc", "Markdown")


def source(name: Column) -> Column:
    """A source's name as it is kept: null where it is none of ``SOURCES``, whose case counts."""
    return F.when(name.isin(*SOURCES), name)


def as_document(rows: DataFrame, chunk_id: str, content: str, metadata: str) -> DataFrame:
    """(id, content, metadata): a chunk as a document of a store, its metadata flat and its vector left out."""
    return rows.select(F.col(chunk_id).alias("id"), F.col(content).alias("content"), flatten(metadata).alias("metadata"))


def as_chunk(documents: DataFrame) -> DataFrame:
    """(id, content, metadata): a document of a store as a chunk again, its metadata a struct; content is stripped."""
    from inkwell.functions.text import strip

    return documents.select("id", strip(F.col("content")).alias("content"), unflatten(F.col("metadata"), strict=True).alias("metadata"))


def parsed_json(text: Column) -> Column:
    """A JSON object as a map from its keys to text; null for null, blank and broken text."""
    return F.from_json(F.when(F.try_parse_json(text).isNotNull(), text), "map<string,string>")


def exif_date(text: Column) -> Column:
    """The time that an image names, as in 2024:05:01 12:30:00 or with slashes; anything else is null."""
    return F.try_to_timestamp(F.replace(text, F.lit("/"), F.lit(":")), F.lit("yyyy:MM:dd HH:mm:ss"))


def chunker(items: Column) -> Column:
    """How a parsed file is cut: by its structure if it has items, else as a whole."""
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, "structural").otherwise("pass-through")


def _resolve(schema: T.StructType, path: str) -> bool:
    kind: T.DataType = schema
    for part in path.split("."):
        if isinstance(kind, T.MapType):
            return True
        if not isinstance(kind, T.StructType) or part not in kind.fieldNames():
            return False
        kind = kind[part].dataType
    return True


def condition(df: DataFrame, tree: dict) -> Column:
    """A filter tree as a column.

    term {path: value}, terms {path: [values]}, range {path: {gte, gt, lte, lt}}, exists {field: path}, bool {must,
    filter, should, must_not}.  A path that the table doesn't have matches nothing.  Null never matches.
    """
    (kind, body), = tree.items()
    if kind == "bool":
        must = [condition(df, t) for t in [*_listed(body.get("must")), *_listed(body.get("filter"))]]
        should = [condition(df, t) for t in _listed(body.get("should"))]
        banned = [~condition(df, t) for t in _listed(body.get("must_not"))]
        if should:
            must.append(reduce(Column.__or__, should))
        return reduce(Column.__and__, must + banned, F.lit(True))
    path, value = (body["field"], None) if kind == "exists" else next(iter(body.items()))
    if not _resolve(df.schema, path):
        return F.lit(False)
    column = F.col(path)
    if kind == "exists":
        return column.isNotNull()
    if kind == "term":
        found = column == F.lit(value)
    elif kind == "terms":
        found = column.isin(*value)
    elif kind == "range":
        signs = {"gte": Column.__ge__, "gt": Column.__gt__, "lte": Column.__le__, "lt": Column.__lt__}
        found = reduce(Column.__and__, (signs[s](column, F.lit(v)) for s, v in value.items()))
    else:
        raise ValueError(f"unknown filter {kind}")
    return F.coalesce(found, F.lit(False))


def _listed(trees) -> list[dict]:
    return [] if trees is None else trees if isinstance(trees, list) else [trees]


# What the names of a PDF's makers tell about its source; the first that is found counts.
PRODUCERS = (
    ("Microsoft Excel", "Microsoft.+Excel"),
    ("Microsoft Word", "Microsoft.+Word"),
    ("PDF", "Adobe.+PDF"),
    ("LibreOffice Writer", "(?i)(?=.*LibreOffice)(?=.*Writer)"),
    ("LibreOffice Calc", "(?i)(?=.*LibreOffice)(?=.*Calc)"),
)


def pdf_source(producer: Column) -> Column:
    return reduce(lambda rest, p: F.when(F.coalesce(producer, F.lit("")).rlike(p[1]), p[0]).otherwise(rest), reversed(PRODUCERS), F.lit("unknown"))


# Loaders and media types by suffix.
LOADERS = {"md": "markdown", "markdown": "markdown", "pdf": "pdf", "goodnotes": "notebook", "gn": "notebook", "docx": "docx", "xlsx": "xlsx", "png": "image", "jpg": "image", "jpeg": "image", "txt": "string"}
MIMES = {
    "md": "text/markdown", "markdown": "text/markdown", "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "txt": "text/plain",
}


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([^./\\\\]+)$", 1))


def looked_up(key: Column, table: dict[str, str], other: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key), F.lit(other))
