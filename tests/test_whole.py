"""Cases in which an operator once did less than the whole job."""

import hashlib
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from inkwell.operators import chunking, knn, lexical, metadata, retrieve, store
from inkwell.streaming import ingest


def test_queries_draw_from_all_rows(spark):
    ids = [f"id-{i}" for i in range(700)]
    rows = spark.createDataFrame([(x, [float(i), 0.0]) for i, x in enumerate(ids)], "id string, v array<float>")
    asked = spark.createDataFrame([(q * 100,) for q in range(40)], "q bigint")
    md5 = lambda x: hashlib.md5(str(x).encode()).hexdigest()
    order = sorted(ids, key=md5)
    got = {r.q: r.id for r in retrieve.drawn(asked, "q", rows, "id").collect()}
    assert got == {q * 100: order[int(md5(q * 100)[:15], 16) % len(ids)] for q in range(40)}
    assert len(set(got.values())) > 30
    assert retrieve.drawn(asked, "q", rows.limit(0), "id").count() == 0


def test_knn_takes_text_as_ids(spark):
    df = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("B", [1.0, 0.0]), ("c", [0.0, 5.0]), (None, [1.0, 0.0])], "id string, v array<float>")
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "q bigint, v array<float>")
    assert [(r.query_id, r.id) for r in knn.knn(df, "id", asked, "q", "v", 3).orderBy("rank").collect()] == [(7, "B"), (7, "a"), (7, "b")]


def test_every_question_has_a_vector_of_its_own_draw(spark, sf_dir):
    from inkwell.plans import search

    hits = search._chunk_hits(spark, sf_dir)
    lines = spark.read.parquet(f"{sf_dir}/jp_reference.parquet").where("line_no % 100 = 0").select("line_no").distinct().count()
    assert hits.where("list_no = 0").select("query_id").distinct().count() == lines
    usable = spark.read.parquet(f"{sf_dir}/chunks.parquet").where(F.size("embedding") == 8).select("id")
    assert hits.where("list_no = 0").join(usable, hits["item"] == usable["id"], "left_anti").count() == 0


def _streamed(spark, tmp_path, batches):
    source, root = str(tmp_path / "in"), str(tmp_path / "store")
    for check, data in batches:
        rows = spark.createDataFrame(data, "id string, v int, t string").select("id", "v", F.to_timestamp("t").alias("ingested_at"))
        rows.coalesce(1).write.mode("append").parquet(source)
        ingest.into_store(ingest.arrivals(spark, source, rows.schema), root, str(tmp_path / check)).awaitTermination()
    return sorted((r.id, r.v) for r in store.current(spark, root).collect())


def test_stream_keeps_late_rows(spark, tmp_path):
    batches = [("one", [("a", 1, "2022-01-01")]), ("one", [("b", 2, "2022-01-02")]), ("one", [("c", 3, "2019-01-01"), ("a", 0, "2019-01-01")])]
    assert _streamed(spark, tmp_path, batches) == [("a", 1), ("b", 2), ("c", 3)]


def test_new_checkpoint_keeps_the_store(spark, tmp_path):
    stored = spark.createDataFrame([("z", 9, "2020-01-01"), ("a", 7, "2023-01-01")], "id string, v int, t string").select("id", "v", F.to_timestamp("t").alias("ingested_at"))
    store.swap(stored, str(tmp_path / "store"))
    assert _streamed(spark, tmp_path, [("new", [("a", 1, "2022-01-01"), ("b", 2, "2022-01-01")])]) == [("a", 7), ("b", 2), ("z", 9)]


def test_metadata_comes_back_whole(spark, sf_dir):
    kind = spark.read.parquet(f"{sf_dir}/loader_results.parquet").schema["metadata"].dataType
    none = dict.fromkeys(kind.fieldNames())
    long = "k" * 1500
    data = [none | {"source": "MS Word", "producer": "w", "page": 3, "outlines": ['a "b"', "第一"], "extra": {long: "v"}}, none | {"outlines": []}]
    df = spark.createDataFrame([(d,) for d in data], f"metadata {kind.simpleString()}")
    back = [r.m for r in df.select(metadata.unflatten(metadata.flatten("metadata")).alias("m")).collect()]
    assert [(m.source, m.producer, m.page, m.outlines, m.extra) for m in back] == [("MS Word", "w", 3, ['a "b"', "第一"], {long: "v"}), (None, None, None, [], {})]


def _brute_cut(text, budget):
    pieces = []
    while len(text) > budget:
        sentence = [i for i in range(1, budget + 1) if text[i - 1] in "。！？" or text[i - 1] in ".!?" and text[i : i + 1].isspace()]
        blank = [i for i in range(1, budget + 1) if text[i - 1].isspace()]
        at = (sentence or blank or [budget])[-1]
        pieces.append(text[:at])
        text = text[at:]
    joined = [""]
    for piece in [*pieces, text]:
        if len(joined[-1]) + len(piece) <= budget:
            joined[-1] += piece
        else:
            joined.append(piece)
    return joined


def test_long_texts_are_cut_to_the_budget(spark):
    random.seed(4)
    texts = ["".join(random.choice(chars) for _ in range(n)) for n in (40, 41, 500, 2000) for chars in ("abc def. ", "日本語。", "x", "a😀b 1.5! ", "ab。c. ")]
    texts = [t.strip() for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.p for r in df.select("i", chunking.bounded(F.array("t"), 40).alias("p")).collect()}
    assert got == {i: _brute_cut(t, 40) for i, t in enumerate(texts)}


def test_no_chunk_is_above_the_budget(spark):
    lines = spark.createDataFrame([(1, "a\n" + "y" * 300 + "\nb"), (2, "z" * 100)], "doc_id int, text string")
    got = chunking.packed_lines(lines, "doc_id", "text", 100, cut=True).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.content, r.total_chunks) for r in got] == [(1, "a", 5), *[(1, "y" * 100, 5)] * 3, (1, "b", 5), (2, "z" * 100, 1)]
    items = spark.createDataFrame([(1, [(0, "title", None, "T"), (1, "paragraph", None, "One is here. " * 30), (2, "paragraph", None, "end")])], "result_id bigint, items array<struct<item_no int, label string, level int, text string>>")
    chunks = chunking.structural(items, "result_id", "items", 100, cut=True).orderBy("chunk_index").collect()
    assert max(r.chunk_size for r in chunks) <= 100 and len(chunks) > 3
    assert "".join(r.content for r in chunks).replace("\n", "") == "One is here. " * 30 + "end"


def test_fetched_row_keeps_its_text(spark, tmp_path):
    from inkwell.plans import tables

    texts = ["x" * 40 + "one", "x" * 40 + "two"]
    spark.createDataFrame([("a", t) for t in [*texts, texts[0]]] + [("b", "y")], "id string, content string").write.parquet(str(tmp_path / "chunks.parquet"))
    assert sorted(r.content for r in tables.store_get_whole(spark, str(tmp_path)).collect()) == texts


def _rows_shuffled(plan):
    """Rows that the exchanges of a plan that ran have written."""
    name, below = plan.nodeName(), plan.children()
    parts = [below.apply(i) for i in range(below.size())]
    if name.startswith("AdaptiveSparkPlan"):
        parts = [plan.executedPlan()]
    elif "QueryStage" in name:
        parts = [plan.plan()]
    own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
    return own + sum(map(_rows_shuffled, parts))


def test_scores_of_all_pairs_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, "common " + "x " * (i % 7)) for i in range(600)], "id int, t string").repartition(3)
    asked = spark.createDataFrame([(q, f"common word{q}") for q in range(50)], "q int, t string")
    df = lexical.bm25(docs, "id", "t", asked, "q", "t", 2)
    got = df.collect()
    assert sorted((r.query_id, r.doc_id, r["rank"]) for r in got) == [x for q in range(50) for x in ((q, 0, 1), (q, 7, 2))]
    assert _rows_shuffled(df._jdf.queryExecution().executedPlan()) <= 2 * 50 * 4


def _brute_bm25(docs, asked, k):
    counts = {i: Counter(t.split()) for i, t in docs if (t or "").split()}
    mean = sum(c.total() for c in counts.values()) / len(counts)
    df = Counter(w for c in counts.values() for w in c)
    found = []
    for q, words in asked:
        of = lambda c: sum(math.log(1 + (len(counts) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * c.total() / mean)) for w in words if c[w])
        best = sorted((-round(of(c), 6), i) for i, c in counts.items() if any(w in c for w in words))[:k]
        found += [(q, i, -score, n) for n, (score, i) in enumerate(best, 1)]
    return sorted(found)


def test_best_documents_are_those_of_all_pairs(spark):
    random.seed(17)
    letters, weights = "abcdefghijklmnop", [2.0**-n for n in range(16)]
    docs = [(f"d{i}", " ".join(random.choices(letters, weights, k=random.choice((1, 5, 30))))) for i in range(900)] + [("none", None), ("empty", " ")]
    asked = [(q, " ".join(random.choices(letters + "z", k=1 + q % 6))) for q in range(40)] + [(3, "b b p")]
    terms = {}
    for q, t in asked:
        terms.setdefault(q, set()).update(t.split())
    there, questions = spark.createDataFrame(docs, "id string, t string").repartition(5), spark.createDataFrame(asked, "q bigint, t string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        for k, limits in ((3, {}), (50, {"most_pairs": 40}), (3, {"most_pairs": 40, "most_terms": 0})):
            got = sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in lexical.bm25(there, "id", "t", questions, "q", "t", k, **limits).collect())
            assert got == _brute_bm25(docs, [(q, sorted(w)) for q, w in terms.items()], k)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert lexical.bm25(there, "id", "t", questions.limit(0), "q", "t", 3).count() == 0
    assert lexical.bm25(there.limit(0), "id", "t", questions, "q", "t", 3).count() == 0
