"""Readers of files: gold lines, markdown, office documents, and plug-ins for what needs a model.

Every reader gives (path, content, metadata..., items) rows from ``binaryFile`` or ``text`` scans, so files are
spread over tasks; a file is parsed by one task.  Broken files give a row with ``error`` and no content; a sheet with cells
beyond the limits keeps its content and names them there.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions.text import strip

GOLD = "query string, keywords array<string>, reference string"
SAMPLE = "row_id bigint, line_no int, eval_type string, user_input string, retrieved_contexts array<string>, response string, reference string, reference_contexts array<string>"
PARSED = "path string, content string, title string, author string, subject string, created_at string, modified_at string, items array<struct<item_no int, label string, level int, text string>>, error string"
MAX_ROWS = MAX_COLUMNS = 10_000
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line): lines of text files, numbered from 1 in each file.

    A file is split over tasks.  Lines are numbered where they lie; how many lines the blocks before have is counted and
    added, one small row per block.
    """
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("_at"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"))
    counts = lines.groupBy("file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return lines.join(offsets, ["file", "_block"]).select("file", (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("int").alias("line_no"), F.col("value").alias("line"))


def gold(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, query, keywords, reference): lines of JSON; blank lines are skipped but counted."""
    parsed = numbered_lines(spark, path).where(strip(F.col("line")) != "").select("line_no", F.from_json("line", GOLD).alias("j"))
    return parsed.select("line_no", "j.query", F.coalesce("j.keywords", F.array().cast("array<string>")).alias("keywords"), "j.reference")


def samples(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation rows from lines of JSON; one file may be larger than a task, as lines are split by the scan."""
    return spark.read.schema(SAMPLE).json(path)


def markdown_items(text: str) -> list[tuple[int, str, int | None, str]]:
    """(item_no, label, level, text) of headings, list items and paragraphs."""
    items: list[tuple[int, str, int | None, str]] = []
    paragraph: list[str] = []

    def close() -> None:
        if paragraph:
            items.append((len(items), "paragraph", None, "\n".join(paragraph)))
            paragraph.clear()

    for line in text.split("\n"):
        heading, item = re.match(r"(#{1,6})\s+(.*\S)", line), re.match(r"\s*(?:[-*•・]|\d+[.)])\s+(.*\S)", line)
        if heading:
            close()
            items.append((len(items), "title" if len(heading.group(1)) == 1 and not items else "section_header", len(heading.group(1)), heading.group(2)))
        elif item:
            close()
            items.append((len(items), "list_item", None, item.group(1)))
        elif line.strip():
            paragraph.append(line.strip())
        else:
            close()
    close()
    return items


def _core(archive: zipfile.ZipFile) -> dict[str, str | None]:
    names = {"title": "title", "creator": "author", "subject": "subject", "created": "created_at", "modified": "modified_at"}
    found: dict[str, str | None] = dict.fromkeys(names.values())
    if "docProps/core.xml" in archive.namelist():
        for node in ElementTree.fromstring(archive.read("docProps/core.xml")):
            name = names.get(node.tag.rpartition("}")[2])
            if name:
                found[name] = node.text
    return found


def parse_markdown(data: bytes) -> dict:
    text = data.decode("utf-8", "replace")
    return {"content": text, "items": markdown_items(text)}


def parse_docx(data: bytes) -> dict:
    archive = zipfile.ZipFile(io.BytesIO(data))
    items = []
    for p in ElementTree.fromstring(archive.read("word/document.xml")).iter(f"{_WORD}p"):
        text = "".join(t.text or "" for t in p.iter(f"{_WORD}t")).strip()
        style = p.find(f"{_WORD}pPr/{_WORD}pStyle")
        name = style.get(f"{_WORD}val", "") if style is not None else ""
        level = re.search(r"\d+", name)
        if text:
            label = "title" if name.lower() == "title" else "section_header" if name.lower().startswith("heading") else "list_item" if "list" in name.lower() else "paragraph"
            items.append((len(items), label, int(level.group()) if level and label == "section_header" else None, text))
    return _core(archive) | {"content": "\n\n".join(i[3] for i in items), "items": items}


def tables(cells: dict[tuple[int, int], str]) -> list[tuple[int, int, int, int]]:
    """Bounds (top, left, bottom, right) of the blocks of touching cells, in row-major order of their first cell."""
    left, found = set(cells), []
    for start in sorted(cells):
        if start not in left:
            continue
        left.discard(start)
        todo, block = [start], [start]
        while todo:
            r, c = todo.pop()
            for near in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                if near in left:
                    left.discard(near)
                    todo.append(near)
                    block.append(near)
        rows, columns = [r for r, _ in block], [c for _, c in block]
        bounds = (min(rows), min(columns), max(rows), max(columns))
        left -= {(r, c) for r, c in left if bounds[0] <= r <= bounds[2] and bounds[1] <= c <= bounds[3]}
        found.append(bounds)
    return found


def _column(name: str) -> int:
    n = 0
    for ch in name:
        n = n * 26 + ord(ch) - 64
    return n


def parse_xlsx(data: bytes) -> dict:
    """Values, not formulas, of all sheets; at most MAX_ROWS x MAX_COLUMNS cells of a sheet as in the format's readers."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in archive.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))]
    items, beyond = [], 0
    for name in sorted(n for n in archive.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
        cells: dict[tuple[int, int], str] = {}
        for cell in ElementTree.fromstring(archive.read(name)).iter(f"{_SHEET}c"):
            m = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r", ""))
            value = cell.find(f"{_SHEET}v")
            text = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t")) if cell.get("t") == "inlineStr" else value.text if value is not None else None
            if cell.get("t") == "s" and text is not None:
                text = shared[int(text)]
            if m and text and int(m.group(2)) <= MAX_ROWS and _column(m.group(1)) <= MAX_COLUMNS:
                cells[int(m.group(2)), _column(m.group(1))] = text
            elif m and text:
                beyond += 1
        for top, left, bottom, right in tables(cells):
            rows = ["| " + " | ".join(cells.get((r, c), "") for c in range(left, right + 1)) + " |" for r in range(top, bottom + 1)]
            items.append((len(items), "table", None, "\n".join(rows)))
    note = {"error": f"{beyond} cells beyond {MAX_ROWS} x {MAX_COLUMNS} were left out"} if beyond else {}
    return _core(archive) | {"content": "\n\n".join(i[3] for i in items), "items": items} | note


PARSERS: dict[str, Callable[[bytes], dict]] = {"md": parse_markdown, "markdown": parse_markdown, "docx": parse_docx, "xlsx": parse_xlsx}


def files(spark: SparkSession, path: str | list[str], parsers: dict[str, Callable[[bytes], dict]] | None = None) -> DataFrame:
    """Files of all types that have a parser, under one path or several; ``parsers`` adds plug-ins, as for PDF and images, by suffix.

    A file that names no time of its change has that of the file system.
    """
    known = PARSERS | (parsers or {})

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["content", "title", "author", "subject", "created_at", "modified_at", "items", "error"]
        for batch in batches:
            out = []
            for where, data in zip(batch["path"], batch["content"]):
                parser = known.get(where.rpartition(".")[2].lower())
                try:
                    row = parser(data) if parser else {"error": "no parser for this type"}
                except Exception as ex:  # a broken file must not end the job
                    row = {"error": f"{type(ex).__name__}: {ex}"}
                out.append([where, *(row.get(n) for n in names)])
            yield pd.DataFrame(out, columns=["path", *names])

    found = spark.read.format("binaryFile").load(path)
    times = found.select(F.col("path").alias("_path"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss").alias("_changed"))
    parsed = found.select("path", "content").mapInPandas(parse, PARSED)
    changed = F.coalesce("modified_at", "_changed")
    return parsed.join(times, F.col("path") == F.col("_path")).withColumn("modified_at", changed).drop("_path", "_changed")


def checksums(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source_path, checksum, filesize_bytes) of files, for the catalog."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("source_path"), F.sha2("content", 256).alias("checksum"), F.col("length").alias("filesize_bytes"))
