"""Small cases with known results: nulls, ties, empty tables, golden values."""

import math
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.functions import text, vectors
from inkwell.operators import cache, catalog, chunking, evaluate, geometry, knn, lexical, metadata, pixels, retrieve, store


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---------------------------------------------------------------- functions

def test_strip_takes_all_white_space(spark):
    df = spark.createDataFrame([("　 a b\n ",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(text.strip(F.col("t"))).collect()] == ["a b", None, ""]


def test_uuid5_is_that_of_the_standard_library(spark):
    names = ["a", "", "日本語 😀", "x" * 5000]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(text.uuid5(F.col("n"))).collect()] == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]


def test_terms_pair_wide_characters(spark):
    df = spark.createDataFrame([("Hello, 日本語 A1 猫",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(text.terms(F.col("t"))).collect()] == [["hello", "a1", "日本", "本語", "猫"], None, []]


def test_prompt_context(spark):
    df = spark.createDataFrame([(["a", None],), ([],), (None,)], "c array<string>")
    assert [r[0] for r in df.select(text.prompt_context(F.col("c"))).collect()] == ["[Context 1]\na\n\n[Context 2]\n", "", ""]


def test_similarity_golden_values(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [1.0, 1.0]), ([1.0, 1.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 0 and got[1] == pytest.approx(1 / math.sqrt(2)) and got[2] == pytest.approx(1) and got[3] is None and got[4] is None


# ---------------------------------------------------------------- search

def test_knn_equals_brute_force_in_blocks(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(300, 6)).round(2)
    data = [(i, p.tolist(), "x") for i, p in enumerate(points)] + [(300, None, "x"), (301, [], "x"), (302, [1.0], "x"), (303, points[7].tolist(), "x")]
    df = spark.createDataFrame(data, "id bigint, v array<float>, score string")
    asked = df.where("id % 50 = 7")
    got = {(r.query_id, r["rank"]): r.id for r in knn.knn(df, "id", asked, "id", "v", 4, query_bytes=96).collect()}
    exact = np.array([np.asarray(p, np.float32) for p in points]).astype(float)
    for q in range(7, 300, 50):
        d = np.round(np.sqrt(((exact - exact[q]) ** 2).sum(1)), 6)
        order = sorted([(d[i], i) for i in range(300)] + [(d[7], 303)])[:4]
        assert [got[q, k + 1] for k in range(4)] == [i for _, i in order]


def test_knn_of_empty_tables(spark):
    df = spark.createDataFrame([], "id bigint, v array<float>")
    full = spark.createDataFrame([(1, [1.0, 2.0])], "id bigint, v array<float>")
    assert knn.knn(df, "id", full, "id", "v", 3).count() == 0
    assert knn.knn(full, "id", df, "id", "v", 3).count() == 0


def test_wrong_width_is_an_error_and_mixed_widths_are_none(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0])], "id bigint, v array<float>")
    with pytest.raises(ValueError, match="1 values instead of 2"):
        knn.knn(df, "id", df, "id", "v", 3, width=2)
    assert rows(knn.knn(df, "id", df, "id", "v", 3).select("query_id", "id")) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)]


def test_wide_vectors_and_the_index_of_codes(spark):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(400, 1536)).round(3)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)] + [(400, None)], "id bigint, v array<float>")
    asked = df.where("id % 100 = 0")
    codes = knn.fit_codes(df, "v")
    indexed = knn.index(df, "id", "v", codes)
    assert indexed.count() == 400 and {r.width for r in indexed.select("width").distinct().collect()} == {1536}
    exact = knn.knn(df, "id", asked, "id", "v", 5)
    found = knn.search(indexed, df, "id", asked, "id", "v", codes, 5, 20)
    assert min(r.recall for r in knn.recall(found, exact).collect()) >= 0.9
    assert knn.fit_codes(df.limit(0), "v").read(b"", 0).shape == (0,)
    odd = knn.Codes(-1.0, 1.0)
    assert len(odd.read(odd.write([0.1, -2.0, 2.0]), 3)) == 3


def test_terms_are_counted_inside_the_row(spark):
    random.seed(11)
    texts = [" ".join(random.choices("abcdefgh", k=n)) for n in (1, 5, 60, 3000)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {(r.doc_id, r.term): (r.tf, r.length) for r in lexical.postings(df, "id", "t").collect()}
    assert got == {(i, w): (t.split().count(w), len(t.split())) for i, t in enumerate(texts) if t for w in set(t.split())}


def test_many_asked_terms_are_joined(spark):
    random.seed(12)
    docs = spark.createDataFrame([(i, " ".join(random.choices("abcdefghijkl", k=12))) for i in range(40)] + [(99, None)], "id int, t string")
    asked = spark.createDataFrame([(1, "a b zz"), (2, "c c k"), (3, None), (4, "")], "q int, t string")
    same = [rows(lexical.bm25(docs, "id", "t", asked, "q", "t", 5, most_terms=n).select("query_id", "doc_id", "score", "rank")) for n in (0, 100)]
    assert same[0] == same[1] and len(same[0]) == 10


def test_cosine_order_and_ties(spark):
    df = spark.createDataFrame([(1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, [0.7, 0.3]), (4, [0.9, 0.1]), (5, [0.0, 0.0])], "id bigint, v array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "id bigint, v array<float>")
    assert [(r.id, r["rank"]) for r in knn.knn(df, "id", q, "id", "v", 3, "cosine").orderBy("rank").collect()] == [(1, 1), (4, 2), (3, 3)]


def test_index_recall(spark, sf_dir):
    from inkwell.plans.search import ann_recall

    assert min(r.recall for r in ann_recall(spark, sf_dir).collect()) >= 0.9


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "a c"), (3, None), (4, ""), (5, "d d d d")], "doc_id bigint, text string")
    q = spark.createDataFrame([(9, "b a")], "q bigint, t string")
    got = {r.doc_id: r.score for r in lexical.bm25(docs, "doc_id", "text", q, "q", "t", 5).collect()}
    n, mean = 3, 3.0
    idf = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    s = lambda tf, df, length: idf(df) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))
    assert got == {1: round(s(2, 1, 3) + s(1, 2, 3), 6), 2: round(s(1, 2, 2), 6)}


def test_keep_first_keeps_order(spark):
    hits = spark.createDataFrame([(1, "b", 0, 1), (1, "a", 0, 2), (1, "b", 1, 1), (1, "c", 1, 2), (1, "c", 1, 2)], "q int, item string, list_no int, rank int")
    got = retrieve.keep_first(hits, ["q"], "item").orderBy("position").collect()
    assert [(r.item, r.position) for r in got] == [("b", 1), ("a", 2), ("c", 3)]
    shown = retrieve.render(spark.createDataFrame([(1, 1, "x"), (1, 2, None)], "q int, o int, c string"), ["q"], "o", "c").first()
    assert shown.text == "Found 2 documents\n\n[1] x\n\n[2] "


# ---------------------------------------------------------------- store, catalog, cache

@pytest.fixture
def stored(spark):
    return spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "id string, v int")


def test_store_changes(spark, stored):
    batch = spark.createDataFrame([("b", 9), ("d", 4)], "id string, v int")
    assert rows(store.upsert(stored, batch, "id").fillna(-1)) == [("a", 1), ("b", 9), ("c", -1), ("d", 4)]
    twice = store.upsert(store.upsert(stored, batch, "id"), batch, "id")
    assert twice.count() == 4
    with pytest.raises(store.ConflictError):
        store.insert(stored, batch, "id")
    with pytest.raises(store.MissingError):
        store.update(stored, batch, "id")
    assert store.update(stored, batch.where("id = 'b'"), "id").where("v = 9").count() == 1
    assert store.delete(stored, batch, "id").count() == 2
    assert rows(store.delete_where(stored, F.col("v") > 1).select("id")) == [("a",), ("c",)]
    assert store.get(stored, "id", "zz").count() == 0
    assert store.upsert(stored.limit(0), batch, "id").count() == 2


def test_snapshots_replace_each_other(spark, stored, tmp_path):
    store.swap(stored, str(tmp_path))
    store.swap(store.current(spark, str(tmp_path)).where("id = 'a'"), str(tmp_path))
    assert rows(store.current(spark, str(tmp_path))) == [("a", 1)]


def test_latest_breaks_ties_once(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", None, 3)], "id string, t int, v int")
    assert store.latest(df, ["id"], ["t"]).count() == 1


def test_catalog_states(spark):
    old = spark.createDataFrame([("p1", "x", "ingested", False), ("p2", "x", "ingested", False), ("p3", "x", "failed", True), ("p4", None, None, None)], "source_path string, checksum string, status string, needs_reingest boolean")
    new = spark.createDataFrame([("p1", "x"), ("p2", "y"), ("p5", "z"), ("p4", None)], "source_path string, checksum string")
    got = {r.source_path: (r.change, r.status, r.needs_reingest) for r in catalog.register(old, new).collect()}
    assert got["p1"] == ("unchanged", "ingested", False) and got["p2"] == ("changed", "pending", True) and got["p3"] == ("absent", "failed", True) and got["p5"] == ("new", "pending", True)
    assert {r.change for r in catalog.register(old, new, force=True).collect()} >= {"forced"}
    assert {r.source_path for r in catalog.due(old).collect()} == {"p3", "p4"}


def test_cache_lives_and_dies(spark):
    entries = spark.createDataFrame([("a", "2020-01-02"), ("b", "2020-01-01")], "k string, e string").select("k", F.to_timestamp("e").alias("expires_at"))
    now = F.to_timestamp(F.lit("2020-01-01 12:00:00"))
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    assert rows(cache.split(asked, entries, "k", now)) == [("a", True), ("b", False), ("c", False)]
    renewed = {r.k: str(r.expires_at) for r in cache.renew(entries, asked, "k", now, 60).collect()}
    assert renewed == {"a": "2020-01-01 12:01:00", "b": "2020-01-01 00:00:00"}


# ---------------------------------------------------------------- metadata, chunks

def test_metadata_round_trip(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/loader_results.parquet")
    back = df.select("metadata.*", metadata.unflatten(metadata.flatten("metadata")).alias("m"))
    assert back.where(~F.col("m.file_name").eqNullSafe(F.coalesce("file_name", F.lit(""))) | ~F.col("m.title").eqNullSafe(F.col("title"))).count() == 0


def test_conditions(spark):
    df = spark.createDataFrame([(1, {"a": "x"}), (2, {"b": "y"}), (None, None)], "n int, m map<string,string>")
    assert df.where(metadata.condition(df, {"term": {"m.a": "x"}})).count() == 1
    assert df.where(metadata.condition(df, {"term": {"nowhere": 1}})).count() == 0
    assert df.where(metadata.condition(df, {"bool": {"must_not": {"term": {"n": 1}}}})).count() == 2
    assert df.where(metadata.condition(df, {"bool": {"should": [{"term": {"n": 1}}, {"range": {"n": {"gt": 1, "lte": 2}}}]}})).count() == 2
    with pytest.raises(ValueError):
        metadata.condition(df, {"fuzzy": {"n": 1}})


def test_packs_hold_the_budget(spark):
    random.seed(3)
    texts = [None, "", "\n\n", "\n".join("x" * random.randrange(0, 60) for _ in range(50)), "y" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = chunking.packed_lines(df, "doc_id", "text", 100).orderBy("doc_id", "chunk_index").collect()

    def brute(t):
        packs, open_ = [], None
        for line in (x.strip() for x in (t or "").split("\n")):
            if not line:
                continue
            if open_ is not None and len(open_) + 1 + len(line) <= 100:
                open_ += "\n" + line
            else:
                packs += [open_] if open_ is not None else []
                open_ = line
        return packs + ([open_] if open_ is not None else [])

    assert [(r.doc_id, r.content) for r in got] == [(i, p) for i, t in enumerate(texts) for p in brute(t)]


def test_structured_document_gives_five_chunks(spark):
    # A document of two sections with two headers each, and the number of its chunks
    labels = [("title", "T"), ("section_header", "A"), ("section_header", "A1"), ("paragraph", "p1"), ("section_header", "A2"), ("paragraph", "p2"), ("section_header", "B"), ("section_header", "B1"), ("paragraph", "p3"), ("section_header", "B2"), ("paragraph", "p4"), ("list_item", "l1"), ("list_item", "l2"), ("list_item", "l3")]
    df = spark.createDataFrame([(1, [(i, label, None, t) for i, (label, t) in enumerate(labels)])], "result_id bigint, items array<struct<item_no int, label string, level int, text string>>")
    got = chunking.structural(df, "result_id", "items", 8192).orderBy("chunk_index").collect()
    assert [(r.heading, r.content, r.total_chunks) for r in got] == [("A1", "p1", 5), ("A2", "p2", 5), ("B1", "p3", 5), ("B2", "p4", 5), ("B2", "l1\nl2\nl3", 5)]


# ---------------------------------------------------------------- evaluation

def test_precision_recall_and_means(spark):
    df = spark.createDataFrame([(1, ["a b", "zz", "a"], "a b", "a b。zz"), (2, [], "a", None), (3, None, None, "")], "row_id bigint, retrieved_contexts array<string>, reference string, response string")
    assert rows(evaluate.context_precision(df))[0] == (1, round((1 + 2 / 3) / 2, 6))
    assert rows(evaluate.faithfulness(df))[0] == (1, 1.0)
    scores = spark.createDataFrame([(1.0, "x"), (float("nan"), "x"), (float("inf"), None), (None, None), (3.0, "x")], "m double, t string")
    got = {r.t: (r.m_mean, r.m_valid, r["rows"]) for r in evaluate.means(scores, ["m"], ["t"]).collect()}
    assert got == {"x": (2.0, 2, 3), None: (None, 0, 2)}


def test_first_bad_sample_raises(spark):
    df = spark.createDataFrame([(1, "q", ["c"], "r"), (2, "q", [], "r")], "row_id int, user_input string, retrieved_contexts array<string>, reference string")
    evaluate.require(df.where("row_id = 1"), "context_reference", "row_id")
    with pytest.raises(ValueError, match="row 2: retrieved_contexts"):
        evaluate.require(df, "context_reference", "row_id")


# ---------------------------------------------------------------- pages

def test_box_golden_values(spark):
    # Boxes A, B, C and the expansion of (10, 20, 30, 40) within (35, 45)
    one = spark.range(1)
    x = geometry.expanded(F.lit(10), F.lit(30), ratio=2, limit=F.lit(35))
    y = geometry.expanded(F.lit(20), F.lit(40), ratio=2, limit=F.lit(45))
    assert tuple(one.select(x[0], y[0], x[1], y[1]).first()) == (0, 10, 35, 45)
    boxes = spark.createDataFrame([(1, 0, 5, 5, 15, 12, "A"), (1, 1, 14, 5, 24, 12, "B"), (1, 2, 40, 30, 50, 38, "C"), (2, 0, 0, 0, 1, 1, "D")], "page int, i int, x_min int, y_min int, x_max int, y_max int, text string")
    assert rows(geometry.overlapping(boxes, "page", "i")) == [(1, 0, 1)]
    assert rows(geometry.components(boxes, "page", "i")) == [(1, 0, 0), (1, 1, 0), (1, 2, 2), (2, 0, 0)]
    groups = geometry.reading_groups(boxes, "page", "i", "text")
    assert rows(groups.drop("box")) == [(1, 0, "A\nB", 2), (1, 1, "C", 1), (2, 0, "D", 1)]
    assert [r.box for r in groups.where("page = 1 and group_no = 0").collect()] == [[[5, 12], [5, 5], [15, 5], [15, 12]]]
    assert geometry.reading_groups(boxes.limit(0), "page", "i", "text").count() == 0


@pytest.mark.parametrize("low, high, grown", [(5, 12, (1, 16)), (3, 12, (-1, 16)), (0, 1, (0, 1)), (0, 3, (-2, 5)), (0, 5, (-2, 7))])
def test_growth_is_rounded_before_it_is_added(spark, low, high, grown):
    x = geometry.expanded(F.lit(low), F.lit(high), ratio=2)
    assert tuple(spark.range(1).select(*x).first()) == grown


def test_links_reach_through_others(spark):
    random.seed(9)
    data = [(0, i, random.randrange(200), random.randrange(200)) for i in range(60)]
    boxes = spark.createDataFrame([(p, i, x, y, x + 14, y + 9) for p, i, x, y in data], "page int, i int, x_min int, y_min int, x_max int, y_max int")
    root = list(range(60))
    for _ in range(60):
        for _, i, x, y in data:
            for _, j, u, v in data:
                if abs(x - u) <= 14 and abs(y - v) <= 9:
                    root[i] = root[j] = min(root[i], root[j])
    assert rows(geometry.components(boxes, "page", "i")) == [(0, i, root[i]) for i in range(60)]


def test_a_page_above_the_bound_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(geometry, "MOST_BOXES", 2)
    boxes = spark.createDataFrame([(1, i, 0, 0, 1, 1) for i in range(3)], "page int, i int, x_min int, y_min int, x_max int, y_max int")
    with pytest.raises(Exception, match="more than 2 boxes"):
        geometry.components(boxes, "page", "i").collect()


def test_greedy_clusters(spark):
    points = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 5, 5), (1, 2, 100, 100)], "page int, i int, x int, y int")
    assert rows(geometry.greedy_clusters(points, "page", "i", 10, 10)) == [(1, 0, 0), (1, 1, 0), (1, 2, 1)]
    assert geometry.greedy_clusters(points.limit(0), "page", "i", 10, 10).count() == 0


@pytest.mark.parametrize("least", [1, 2, 3])
def test_clusters_against_brute_force(spark, least):
    random.seed(least)
    data = [(1, i, random.randrange(120), random.randrange(120)) for i in range(50)]
    owner, clusters = {}, []
    for _, i, x, y in data:
        near = [j for _, j, u, v in data if abs(u - x) <= 12 and abs(v - y) <= 20]
        if i not in owner and len(near) >= least:
            clusters.append([j for j in near if j not in owner])
            owner.update({j: 1 for j in near})
    clusters += [[i] for _, i, _, _ in data if i not in owner]
    mean = lambda c, k: sum(data[i][k] for i in c) / len(c)
    clusters.sort(key=lambda c: (mean(c, 3), mean(c, 2)))
    want = sorted((1, i, n) for n, c in enumerate(clusters) for i in c)
    points = spark.createDataFrame(data, "page int, i int, x int, y int")
    assert rows(geometry.greedy_clusters(points, "page", "i", 12, 20, least)) == want


def test_crops_keep_score_and_polygon(spark):
    found = spark.createDataFrame([("f", 1, [[10, 20], [30, 20], [30, 40], [10, 40]], 0.9, 35, 45), ("f", 1, [], None, 35, 45)], "filename string, page int, poly array<array<int>>, score double, width int, height int")
    got = [(r.x_min, r.y_min, r.x_max, r.y_max, r.score, r.expand_ratio) for r in geometry.crops(found, 2.0).collect()]
    assert got == [(0, 10, 35, 45, 0.9, 2.0), (None, None, None, None, None, 2.0)]


def test_pixel_golden_values(spark):
    px = spark.createDataFrame([(1, 210, 210, 210), (1, 200, 255, 255)], "page int, r int, g int, b int")
    c = pixels.enhanced(F.col("r"), F.col("g"), F.col("b"), "white", 200, 30, 0.5, 10)
    assert rows(px.select(*c)) == [(100, 127, 127), (240, 240, 240)]
    assert pixels.background(spark.createDataFrame([(1, 128, 128, 128)], px.schema), "page").first().background == "white"
    with pytest.raises(ValueError):
        pixels.mask(F.col("r"), F.col("g"), F.col("b"), "red", 1)


# ---------------------------------------------------------------- ranks, tables, tokens

def test_ranks_over_many_tasks(spark):
    random.seed(2)
    data = [(random.choice(["hot"] * 6 + ["b", "c", None]), random.choice([None, *range(30)]), f"id{i:04d}", "x") for i in range(3000)]
    df = spark.createDataFrame(data, "f string, i int, id string, rank string").drop("rank").repartition(6)
    got = {r.id: (r["rank"], r.total) for r in chunking.ranks(df, ["f"], [F.col("i").asc_nulls_last(), F.col("id")]).collect()}
    by = {}
    for f, i, name, _ in data:
        by.setdefault(f, []).append((i is None, i or 0, name))
    assert got == {name: (n, len(rows_)) for rows_ in by.values() for n, (_, _, name) in enumerate(sorted(rows_))}
    assert chunking.ranks(df.limit(0), ["f"], [F.col("id")]).count() == 0


def test_packing_takes_long_texts(spark):
    text = "\n".join(f"line {i}" for i in range(60_000))
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "\n\n"), (5, "a")], "doc_id int, text string")
    got = chunking.packed_lines(df, "doc_id", "text", 100).orderBy("doc_id", "chunk_index").collect()
    assert "\n".join(r.content for r in got if r.doc_id == 1) == text and max(r.chunk_size for r in got) <= 100
    assert [(r.doc_id, r.content, r.total_chunks) for r in got if r.doc_id != 1] == [(5, "a", 1)]


def test_chunks_within_a_budget_of_tokens(spark):
    from inkwell.functions import tokens

    long = "One sentence is here. " * 60 + "x" * 700
    items = [(0, "title", None, "T"), (1, "paragraph", None, long), (2, "paragraph", None, "short"), (3, "paragraph", None, "also short"), (4, "list_item", None, "a"), (5, "paragraph", None, None)]
    df = spark.createDataFrame([(1, items), (2, [])], "result_id int, items array<struct<item_no int, label string, level int, text string>>")
    got = chunking.structural_tokens(df, "result_id", "items", 40).orderBy("chunk_index").collect()
    assert max(r.chunk_tokens for r in got) <= 40 and all(r.chunk_tokens == tokens.token_count(r.content, tokens.DEFAULT) for r in got)
    assert "".join(r.content for r in got if r.heading_no == 1).replace("\n", "") == (long + "short" + "also short")
    assert [r.content for r in got][-1] == "a" and all(r.total_chunks == len(got) for r in got)


def test_table_as_json_by_columns(spark):
    df = spark.createDataFrame([(1, [("1", 'a"'), (None, "11")]), (2, [])], "t int, rows array<struct<n: string, m: string>>")
    got = {(r.table_id, r.part): r.json for r in chunking.table_columns(df, "t", ["n", "m"], "rows", 2).collect()}
    assert got[1, "Table Part 001"] == '{\n  "col000":{\n    "column_name":"row_name",\n    "row000":"0",\n    "row001":"1"\n  },\n  "col001":{\n    "column_name":"n",\n    "row000":"1",\n    "row001":null\n  }\n}'
    assert got[1, "Table Part 002"] == '{\n  "col002":{\n    "column_name":"m",\n    "row000":"a\\"",\n    "row001":"11"\n  }\n}'
    assert got[2, "Table Part 002"] == '{\n  "col002":{\n    "column_name":"m"\n  }\n}'


# ---------------------------------------------------------------- pixels, metadata

def test_variants_golden_values(spark):
    px = spark.createDataFrame([(210, 210, 210), (90, 95, 100), (250, 20, 30), (255, 255, 255), (0, 0, 0)], "r int, g int, b int")
    got = {name: [tuple(r) for r in px.select(*v(F.col("r"), F.col("g"), F.col("b"))).collect()] for name, v in pixels.VARIANTS.items()}
    assert got["02U_invert"] == [(15, 15, 15), (228, 227, 225), (255, 255, 255), (0, 0, 0), (255, 255, 255)]
    assert got["02L_invert"] == [(45, 45, 45), (255, 255, 255), (255, 255, 255), (0, 0, 0), (255, 255, 255)]
    assert got["11_color2black"] == [(255, 255, 255), (255, 255, 255), (0, 0, 0), (255, 255, 255), (255, 255, 255)]
    assert got["51_color_filter"] == [(255, 255, 255), (90, 95, 100), (255, 255, 255), (255, 255, 255), (0, 0, 0)]


@pytest.mark.parametrize("producer, source", [
    ("Microsoft® Word for Microsoft 365", "Microsoft Word"), ("Microsoft Excel 2019", "Microsoft Excel"), ("microsoft excel", "unknown"), ("Excel for Microsoft 365", "unknown"), ("Acrobat Distiller", "unknown"),
    ("Adobe PDF Library 15", "PDF"), ("LibreOffice 7.2 Writer", "LibreOffice Writer"), ("calc libreoffice", "LibreOffice Calc"), ("Writer", "unknown"), (None, "unknown"), ("", "unknown"),
])
def test_producers(spark, producer, source):
    assert spark.createDataFrame([(producer,)], "p string").select(metadata.pdf_source(F.col("p"))).first()[0] == source


def test_small_column_functions(spark):
    df = spark.createDataFrame([('{"a": 1}', "2024:05:01 12:30:00"), ("{}", "2024/05/01 12:30:00"), ("{", "1.5.2024"), (None, None), (" ", "")], "j string, d string")
    got = df.select(metadata.parsed_json(F.col("j")).alias("j"), F.date_format(metadata.exif_date(F.col("d")), "HH:mm").alias("d")).collect()
    assert [r.j for r in got] == [{"a": "1"}, {}, None, None, None] and [r.d for r in got] == ["12:30", "12:30", None, None, None]


# ---------------------------------------------------------------- retrieval

def test_modes_and_texts_of_hits(spark):
    hits = spark.createDataFrame([(1, "a", 0, 1), (1, "b", 1, 1), (1, "a", 2, 1), (2, "c", 0, 1)], "q int, item string, list_no int, rank int")
    got = retrieve.by_mode(hits, ["q"], "item")
    assert rows(got.select("q", "eval_type", "position", "item")) == [(1, "embedding", 1, "a"), (1, "keywords", 1, "b"), (1, "keywords", 2, "a"), (1, "mix", 1, "a"), (1, "mix", 2, "b"), (2, "embedding", 1, "c"), (2, "mix", 1, "c")]
    asked = spark.createDataFrame([(1,), (3,)], "q int")
    assert retrieve.require_modes(got, asked).count() == 7 and retrieve.require_modes(got.limit(0), asked.limit(0)).count() == 0
    with pytest.raises(retrieve.EmptyModeError, match="keywords"):
        retrieve.require_modes(retrieve.by_mode(hits.where("list_no = 0"), ["q"], "item"), asked)
    found = spark.createDataFrame([(1, 2, None, None, "zwei"), (1, 1, "f.md", "page=1", "eins")], "q int, position int, f string, i string, c string")
    texts = dict(rows(retrieve.described(asked, found, ["q"], "position", "f", "i", "c")))
    assert texts == {1: "找到 2 個相關文件：\nf.md\n文件資訊: page=1\n內文: eins\n\n\n文件資訊: \n內文: zwei\n", 3: "未找到相關文件。"}


def test_nearest_of_the_same_group(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [0.9, 0.1], "y"), (3, [0.0, 1.0], "x"), (4, [1.0, 0.0], None)], "id bigint, v array<float>, g string")
    assert rows(knn.knn(df, "id", df, "id", "v", 1, group="g").select("query_id", "id")) == [(1, 3), (3, 1)]


# ---------------------------------------------------------------- evaluation

def test_grades_and_another_judge(spark):
    data = [(1, "red cat", ["a red cat"], "a red cat", "red cat"), (2, "red cat", ["dog"], "dog", "red cat sat"), (3, "red cat", [], None, "x"), (4, None, None, "", None)]
    df = spark.createDataFrame(data, "row_id int, user_input string, retrieved_contexts array<string>, response string, reference string")
    assert rows(evaluate.context_relevance(df)) == [(1, 1.0), (2, 0.0), (3, None), (4, None)]
    assert rows(evaluate.answer_accuracy(df)) == [(1, 0.75), (2, 0.0), (3, 0.0), (4, 0.0)]
    assert rows(evaluate.groundedness(df)) == [(1, 1.0), (2, 1.0), (3, None), (4, None)]
    kind = lambda claim, source: F.lit(0.5)
    assert rows(evaluate.groundedness(df, kind)) == [(1, 0.5), (2, 0.5), (3, None), (4, None)]
    assert rows(evaluate.context_precision(df, kind))[0] == (1, 1.0)
    assert evaluate.evaluated(df.where("row_id = 1"), "context_reference").columns == ["row_id", "context_relevance", "context_precision", "context_recall"]
    assert evaluate.evaluated(df.where("row_id = 1"), "answer").columns == ["row_id", "answer_accuracy", "f1", "similarity", "correctness"]
    with pytest.raises(ValueError, match="row 3: response"):
        evaluate.evaluated(df.where("row_id < 4"), "groundedness")


def test_report_sink(spark, tmp_path):
    from inkwell.sources import sinks

    df = spark.createDataFrame([(1, "mix", float("nan"), ["a", "b"]), (2, None, 0.5, None), (3, "mix", 1.0, [])], "row_id int, eval_type string, m double, contexts array<string>")
    results, meta = sinks.report(df, ["m"], "eval_type", str(tmp_path), sinks.run_stamp("run"))
    back = {r.row_id: (r.m, r.contexts) for r in spark.read.option("header", True).option("escape", '"').csv(results).collect()}
    assert back == {"1": (None, '["a","b"]'), "2": ("0.5", None), "3": ("1.0", "[]")}
    assert {(r.eval_type, r.overall, r.m_mean, r.m_valid) for r in spark.read.json(meta).collect()} == {("mix", False, 1.0, 1), (None, False, 0.5, 1), (None, True, 0.75, 2)}


# ---------------------------------------------------------------- catalog and ingestion

def test_catalog_lookup_is_unique(spark):
    df = spark.createDataFrame([("a", "/x"), ("b", "/y"), ("c", "/y")], "document_id string, source_path string")
    assert catalog.lookup(df, "/x").first().document_id == "a" and catalog.lookup(df, "/z").count() == 0
    with pytest.raises(store.ConflictError):
        catalog.lookup(df, "/y")


def test_ingestion_run(spark, tmp_path):
    from inkwell import ingest

    files, root = tmp_path / "files", str(tmp_path / "tables")
    files.mkdir()
    (files / "a.md").write_text("# Head\n\nOne.\n\n- x\n- y\n")
    (files / "b.md").write_text("\n")
    (files / "c.docx").write_bytes(b"broken")
    table = lambda name: store.current(spark, f"{root}/{name}")
    assert ingest.main([str(files), "--root", root, "--trigger", "watch"], spark) == 1
    states = {r.file_name: (r.status, r.needs_reingest, r.chunk_count, r.vector_synced_at is not None) for r in table("catalog").collect()}
    assert states == {"a.md": ("ingested", False, 2, True), "b.md": ("ingested", False, 0, True), "c.docx": ("failed", True, None, False)}
    chunks = table("chunks").orderBy("chunk_index").collect()
    assert [(r.content, r.chunker, len(r.embedding)) for r in chunks] == [("One.", "structural", 8), ("x\ny", "structural", 8)]
    (files / "c.docx").unlink()
    assert ingest.main([str(files), "--root", root], spark) == 0
    assert table("tasks").groupBy("status").count().collect() and table("tasks").count() == 3
    (files / "a.md").write_text("# Head\n\nTwo.\n")
    assert ingest.main([str(files), "--root", root], spark) == 0
    assert [r.content for r in table("chunks").collect()] == ["Two."] and table("tasks").count() == 4
    assert ingest.main([str(files), "--root", root, "--force-reingest", "--file-type", "markdown"], spark) == 0
    assert table("tasks").count() == 6 and {r.trigger_type for r in table("tasks").collect()} == {"watch", "manual"}
    assert {r.retry_count for r in table("tasks").where("status = 'failed'").collect()} == {1}


def test_lines_of_split_files_are_numbered(spark, tmp_path):
    from inkwell.sources import readers

    for name, n in (("a", 4000), ("b", 3)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i}\n" if i % 7 else "\n" for i in range(1, n + 1)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = {(r.file[-5], r.line_no): r.line for r in readers.numbered_lines(spark, str(tmp_path)).collect()}
        assert readers.numbered_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 4 or len(got) == 4003
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got == {(name, i): (f"{name}{i}" if i % 7 else "") for name, n in (("a", 4000), ("b", 3)) for i in range(1, n + 1)}


def test_store_keeps_the_last_whole_snapshot(spark, tmp_path):
    root = str(tmp_path / "store")
    with pytest.raises(store.MissingError):
        store.current(spark, root)
    for i in range(3):
        store.swap(spark.range(i + 1), root)
    broken = tmp_path / "store" / "snapshot-000000000009-x"
    broken.mkdir()
    assert store.current(spark, root).count() == 3
