"""Readers, providers and the stream, on files made here."""

import zipfile

import pytest
from pyspark.sql import functions as F

from inkwell.operators import store
from inkwell.sources import providers, readers
from inkwell.streaming import ingest

WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\n\nfirst\nsecond\n\n- x\n- y\n")
    (tmp_path / "b.docx").write_bytes(b"broken")
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{WORD}"><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>H</w:t></w:r></w:p><w:p><w:r><w:t>p</w:t></w:r></w:p></w:document>')
        z.writestr("docProps/core.xml", '<c xmlns:d="d"><d:title>T</d:title><d:creator>A</d:creator></c>')
    with zipfile.ZipFile(tmp_path / "d.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{SHEET}"><si><t>品名</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<w xmlns="{SHEET}"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>3</v></c><c r="D5"><v>7</v></c></w>')
    (tmp_path / "e.pdf").write_bytes(b"x")
    found = readers.files(spark, str(tmp_path), {"pdf": lambda data: {"content": "plugged", "items": []}}).collect()
    by = {r.path.rpartition("/")[2]: r for r in found}
    assert [i.label for i in by["a.md"]["items"]] == ["title", "paragraph", "list_item", "list_item"]
    assert by["b.docx"].error and by["b.docx"].content is None
    assert (by["c.docx"].title, by["c.docx"].author, [(i.label, i.text) for i in by["c.docx"]["items"]]) == ("T", "A", [("section_header", "H"), ("paragraph", "p")])
    assert by["d.xlsx"].content == "| 品名 | 3 |\n\n| 7 |"
    assert by["e.pdf"].content == "plugged"
    assert readers.checksums(spark, str(tmp_path)).count() == 5


def test_gold_counts_blank_lines(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"query": "a", "reference": "r"}\n\n{"query": "b", "keywords": ["k"], "reference": "s"}\n')
    assert [(r.line_no, r["query"], r.keywords) for r in readers.gold(spark, str(tmp_path / "g.jsonl")).orderBy("line_no").collect()] == [(1, "a", []), (3, "b", ["k"])]


def test_only_missing_texts_are_encoded(spark):
    provider = providers.HashEmbedder(4)
    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, " ")], "id int, text string")
    empty = spark.createDataFrame([], "cache_key string, value array<float>")
    found, fresh = providers.encode_cached(rows, "text", provider, empty)
    assert fresh.count() == 1 and found.where("id <= 2 and size(embedding) = 4").count() == 2
    assert providers.encode_cached(rows, "text", provider, fresh)[1].count() == 0


def test_provider_is_tried_three_times():
    calls = []
    with pytest.raises(providers.EmbeddingError):
        providers.tried(lambda t: calls.append(1) or 1 / 0, ["a"])
    assert len(calls) == 3


def test_recognition_plug_ins(spark):
    pages = spark.createDataFrame([("f", 1, bytearray(b"ab"))], "filename string, page int, pixels binary")
    got = providers.recognise(pages, lambda image: [{"x_min": 0, "y_min": 0, "x_max": 1, "y_max": 1}] * len(image), lambda image, box: ("t", 0.5)).collect()
    assert [(r.det_no, r.text) for r in got] == [(0, "t"), (1, "t")]


def test_stream_into_store(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "store")
    schema = "id string, v int, ingested_at timestamp"
    make = lambda data: spark.createDataFrame(data, "id string, v int, t string").select("id", "v", F.to_timestamp("t").alias("ingested_at"))
    for data in ([("a", 1, "2020-01-01"), ("a", 2, "2020-01-02")], [("a", 1, "2020-01-01"), ("b", 5, "2020-01-03")]):
        make(data).coalesce(1).write.mode("append").parquet(source)
        ingest.into_store(ingest.arrivals(spark, source, schema), root, str(tmp_path / "check")).awaitTermination()
    assert sorted((r.id, r.v) for r in store.current(spark, root).collect()) == [("a", 2), ("b", 5)]


def test_pages_are_read_in_groups(spark):
    from inkwell.sources import providers

    boxes = {b"one": [("A", 5, 5, 15, 12), ("B", 14, 5, 24, 12), ("C", 40, 30, 50, 38), ("?", 0, 0, 1, 1)], b"none": []}
    detect = lambda image: [dict(zip(("x_min", "y_min", "x_max", "y_max"), b[1:])) for b in boxes[bytes(image)]]
    read = lambda image, box: next((b[0], 0.1 if b[0] == "?" else 0.9) for b in boxes[bytes(image)] if b[1] == box["x_min"])
    pages = spark.createDataFrame([("f", 1, bytearray(b"one")), ("f", 2, bytearray(b"none"))], "filename string, page int, pixels binary")
    got = providers.read_pages(pages, detect, read, 0.5).collect()
    assert [(r.filename, r.page, r.content, [(g.contents, g.counts) for g in r.groups]) for r in got] == [("f", 1, "A\nB\nC", [("A\nB", 2), ("C", 1)])]


def test_plug_ins_fall_back_and_are_tried_again(spark):
    from inkwell.sources import providers

    def broken(*_):
        raise RuntimeError("no model")

    assert providers.first_of(broken, lambda x: x + 1)(1) == 2
    with pytest.raises(RuntimeError):
        providers.first_of(broken, broken)(1)
    calls = []

    def flaky(texts):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("busy")
        return [[1.0]] * len(texts)

    assert providers.tried(flaky, ["a"], wait=0.01) == [[1.0]] and len(calls) == 3

    class Narrow(providers.HashEmbedder):
        def encode(self, texts):
            return [[0.0]] * len(texts)

    with pytest.raises(Exception, match="1 values instead of 8"):
        providers.encode(spark.createDataFrame([("a",)], "t string"), "t", Narrow()).collect()
