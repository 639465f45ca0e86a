"""Small cases with known results for each problem: nulls, empty and long texts, ties, repeated rows, empty tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import languages, leaks, pack, pairs, scans, sentences, split, tokens, unify


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---------------------------------------------------------------- 1

EVAL = "row_id bigint, user_input string, response string, reference string, field string"
WHOLE = ["變化後是『書きます』。先判斷動詞的類別再改語尾。", "The word has accent type [2], so watch where the pitch falls. See page 4."]


@pytest.mark.parametrize("answer, defect", [
    (None, "empty"), ("", "empty"), ("  　\n", "empty"), ("```\n```", "empty"), ("<p></p>", "empty"), ("n/a", "empty"), ("（待補）", "empty"), ("回答：", "empty"),
    ("抱歉，我無法回答這個問題，請改問其他問題。", "refusal"), ("Thank you for asking. I can't help with that. Please ask something else.", "refusal"),
    ("『書く』的ます形是什麼", "copy"), ("您的問題是：『書く』的ます形是什麼？", "copy"),
    ("變化後是『書きます』。先判斷動", "truncated"), ("可以說『申し訳", "truncated"), ("變化後是『書きます』，", "truncated"),
    ("'書く'의 ます형은 먼저 동사의 종류를 확인해야 합니다.", "other_lang"), ("The polite form is easy, and you should check the verb group first.", "other_lang"),
    ("變化後是『書きます』。", None), ("第 345 頁", None), ("可以說『お答えできません』，意思是『我無法回答』。", None), ("抱歉讓您久等了。變化後是『書きます』。", None),
    ("先判斷動詞的類別再改語尾", None), ("變化後是『書きます』 ✅", None),
])
def test_defects(spark, answer, defect):
    data = [(1, "『書く』的ます形是什麼？", answer, WHOLE[0], "x"), (1, "『書く』的ます形是什麼？", answer, WHOLE[0], "x"), (2, "How is it said?", WHOLE[1], WHOLE[1], None)]
    got = pairs.defects(spark.createDataFrame(data, EVAL))
    assert rows(got) == ([(1, "response", defect)] if defect else [])


# phrases that no template holds
@pytest.mark.parametrize("answer", [
    "I'm sorry, but I am not able to help with this request.", "I won't answer that.", "Sorry. We couldn't locate anything on this, and I'd rather not comment.", "很抱歉，這題我答不出來。", "我沒有辦法協助您處理這件事。",
    "その質問には回答いたしかねます。", "申し訳ありませんが、お役に立てません。", "Ich kann diese Frage nicht beantworten.", "Je ne peux pas répondre à cette question.", "Lo siento. No puedo ayudarte con eso.",
    "Não consigo responder a essa pergunta.", "Xin lỗi, tôi không thể trả lời câu hỏi này.", "ขออภัย ฉันไม่สามารถตอบคำถามนี้ได้ค่ะ", "К сожалению, я не могу ответить на этот вопрос.", "죄송합니다. 그 부분은 말씀드리기 어렵습니다.",
])
def test_refusals_in_other_words(answer):
    assert pairs.is_refusal(answer)


@pytest.mark.parametrize("answer", [
    "可以說『很抱歉，這題我答不出來』。", "You can say \"I can't answer that\" politely.", "「回答できません」は丁寧な断り方です。", "『はい』不能接在名詞後面。", "The particle cannot be used after a verb.", "先に答えを書いてください。",
    "I can't answer that one from memory. The polite form is ikimasu.", "Das Verb kann nicht am Anfang stehen.",
])
def test_answers_about_refusing_are_sound(answer):
    assert not pairs.is_refusal(answer)


@pytest.mark.parametrize("question, answer, copied", [
    ("何ですか？", "何ですか？何ですか？何ですか？", True), ("何？", "何？", True), ("何？", "何でもありません。", False), ("書くのます形は", "您的問題是：書くのます形は　書くのます形は", True),
    ("How is it said? " * 40, "How is it said? " * 120, True), ("How is it said?", "How is it said? It is said so.", False), ("", "x", False), ("？", "？", False),
])
def test_copies_of_any_length_and_number(question, answer, copied):
    assert pairs.is_copy(question, answer) is copied


def test_asked_language_is_wanted():
    assert pairs.wanted_language("請把『橋』這句話翻成英文。") == "en"
    assert pairs.wanted_language("想委婉拒絕別人的邀約，日語要怎麼說？") == "zh"
    assert pairs.wanted_language("'黒板'를 일본어로 설명해 주세요.") == "ja"
    assert pairs.wanted_language("On what occasions do people say ごちそうさまでした?") == "en"


def test_common_subsequence_against_brute_force():
    random.seed(2)
    for _ in range(60):
        a, b = ("".join(random.choices("abc", k=random.randrange(0, 12))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert pairs.common_length(a, b) == table[-1][-1]


def test_no_answers(spark):
    assert pairs.defects(spark.createDataFrame([], EVAL)).count() == 0


# ---------------------------------------------------------------- 2

@pytest.mark.parametrize("text, plain", [
    ("ＡＢ１２", "AB12"), ("\U0001d41a\U0001d7d8", "a0"), ("ﬁn", "fin"), ("ｶﾞｲﾄﾞ", "ガイド"), ("⽇本", "日本"), ("來", "來"), ("が", "が"), ("é", "é"),
    ("한", "한"), ("a​b﻿­", "ab"), ("a b\tc ", "a b c "), ("a\r\nb", "a\nb"),
    ("か゚", "か゚"), ("👩‍🏫 ✏️", "👩‍🏫 ✏️"), ("，！（）　\f", "，！（）　\f"), ("", ""),
])
def test_plain_form(text, plain):
    assert unify.plain_form(text) == plain
    assert unify.plain_form(plain) == plain


def test_mixed_words_are_repaired_towards_the_corpus(spark):
    data = [(1, "the grammar"), (2, "thе grаmmar"), (3, "рест"), (4, None), (5, ""), (6, "αβq"), (2, "thе grаmmar"), (7, "x" * 100_000 + "​")]
    df = spark.createDataFrame([(i, t, "k") for i, t in data], "id int, text string, unified string").drop("unified")
    got = unify.unify(df.dropDuplicates(), ["id"], "text").collect()
    by = {r.id: (r.unified, r.changed) for r in got}
    assert {r.id for r in got if r.guessed} == {6}
    assert len(got) == 7
    assert by[2] == ("the grammar", True) and by[1] == ("the grammar", False) and by[3][1] is False and by[4] == (None, False) and by[5] == ("", False)
    assert by[6][1] is True and by[7] == ("x" * 100_000, True)


def test_vocabulary_is_of_plain_forms_and_decides_between_scripts(spark):
    df = spark.createDataFrame([(1, "Ｒeview"), (2, "Reνіew"), (3, "сор"), (4, "cор")], "id int, text string")
    assert {r.id: (r.unified, r.changed, r.guessed) for r in unify.unify(df, ["id"], "text").collect()} == {
        1: ("Review", True, False), 2: ("Review", True, False), 3: ("сор", False, False), 4: ("сор", True, False)}


def test_what_is_found_comes_from_the_repair(spark, sf_dir):
    from inkwell.llm import queries

    plan = queries.p2_found(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "_spellings_udf" in plan and "_respell_udf" in plan and "_u_found" in plan


def test_prefilter_sees_all_that_changes(spark):
    texts = [chr(c) for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    missed = [r.t for r in df.where(~unify.suspect(F.col("t"))).collect() if unify.plain_form(r.t) != r.t]
    seen = {r.t for r in df.where(F.col("t").rlike(unify.SUSPECT)).collect()}
    assert {r.t for r in df.where(unify.suspect(F.col("t"))).collect()} == seen
    assert not [m for m in missed if unify._STYLED.search(m) or unify._HALF_KANA.search(m) or unify._RADICAL.search(m) or unify._BLANK.search(m) or unify._BREAK.search(m)]


# ---------------------------------------------------------------- 3

def scanned(spark, data):
    return spark.createDataFrame(data, "tbl string, rec_key string, file string, file_type string, page int, title string, content string")


MODEL_TEXT = "The recording was played before the class. 例文をノートに書きました。でも文法の練習は大切です。이번 주에는 시험이 있습니다. "


@pytest.fixture(scope="module")
def model(spark):
    return scans.language_model(spark.createDataFrame([(MODEL_TEXT * 8,)], "content string"))


def test_traces_and_repair(spark, model):
    pages = "- 4 -\nThe Book\nThe rec0rding was pla-\nyed before the\n\n- 5 -\nThe Book\nclass. でも丈法の練習は大切です。\n- 6 -\nThe Book\n시험이 있습나다."
    df = scanned(spark, [("t", "1", "f", "pdf", None, None, pages), ("t", "2", "g", "pdf", None, None, ""), ("t", "3", "h", "image", 7, None, "·7·\n例文をノートに書きました。")])
    got = rows(scans.traces(df, model))
    expected = {("t", "1", n, "pagenum") for n in (1, 6, 9)} | {("t", "1", n, "header") for n in (2, 7, 10)}
    expected |= {("t", "1", 3, "hyphen"), ("t", "1", 3, "misread"), ("t", "1", 8, "misread"), ("t", "1", 11, "misread"), ("t", "3", 1, "pagenum")}
    assert set(got) == expected
    text = {r.rec_key: r.content for r in scans.repaired(df, model).collect()}
    assert text["1"].startswith("The recording was played before the") and "文法" in text["1"] and "있습니다" in text["1"] and "Book" not in text["1"]
    assert text["2"] == "" and text["3"] == "例文をノートに書きました。"


def test_numbers_in_text_are_no_page_numbers(spark, model):
    df = scanned(spark, [("t", "1", "f", "pdf", None, None, "The class.\nNo. 20\nThe class.\n57 / 40 點\n9 - 4 = 5\nThe class."), ("t", "2", "g", "image", 3, None, "(24)\nThe class.")])
    assert scans.traces(df, model).where("kind = 'pagenum'").count() == 0


@pytest.mark.parametrize("text, value", [("12", 12), ("一〇", 10), ("三十二", 32), ("百五", 105), ("xiv", 14), ("l9", 19), ("９", 9)])
def test_page_number_values(text, value):
    assert scans.page_number(text)[1] == value


def test_clean_text_stays(spark, model):
    decoder = scans.Decoder(model)
    assert scans.examine(MODEL_TEXT, set(), set(), decoder)[0] == []
    assert scans._words(decoder, "") == [] and decoder.characters(["", "a"]) == [[], []] and decoder.characters([]) == []


def test_pairs_of_words_decide_on_the_path(spark):
    text = "the cat sat there. " * 30 + "they eat fish. " * 30 + "we eat rice. " * 10 + "a cat ran. " * 10
    decoder = scans.Decoder(scans.language_model(spark.createDataFrame([(text,)], "content string")))
    assert decoder.line("they cat fish".split()) == {1: "eat"}
    assert decoder.line("the cat sat".split()) == {} and decoder.line("a cat ran".split()) == {}
    assert decoder.line("they cat rice we cat fish".split()) == {1: "eat", 4: "eat"}


def test_a_misreading_that_occurs_in_the_corpus_too_is_found_at_any_size(spark):
    for times in (200, 20_000):
        text = "the recording was short. " * times + "the rec0rding was short. " * (times // 200)
        decoder = scans.Decoder(scans.language_model(spark.createDataFrame([(text,)], "content string")))
        assert decoder.line("the rec0rding was short".split()) == {1: "recording"}


def test_confusions_are_estimated_from_the_scanned_texts(spark, model):
    often = scanned(spark, [("t", str(i), "f", "pdf", None, None, "The rec0rding was played bef0re the class.") for i in range(300)])
    never = scanned(spark, [("t", str(i), "f", "pdf", None, None, "The recording was played before the class.") for i in range(300)])
    shared = spark.sparkContext.broadcast(model._replace(tables=tuple(np.where(t > 0, np.minimum(t.astype(int) + 40, 255), 0).astype(np.uint8) for t in model.tables)))
    high, low = (scans.channel(df, shared)["0>o"] for df in (often, never))
    assert high > scans.CHANNEL > low and scans.channel(often.limit(0), shared).get("0>o", scans.CHANNEL) == pytest.approx(scans.CHANNEL, abs=0.1)


def test_long_running_titles_and_wide_pages_are_found(spark, model):
    title = "The Very Long and Winding Running Title of a Book about Recordings and Their Classes in Schools"
    body = "\n".join("The recording was played before the class and it went on for a good while longer than we had thought it would be that day." for _ in range(6))
    pages = [f"{title}\n{body}\n- {n} -" for n in (3, 4, 5)]
    df = scanned(spark, [("t", str(n), "f", "pdf", None, None, text) for n, text in enumerate(pages)])
    assert {(r.rec_key, r.line_no, r.kind) for r in scans.traces(df, model).where("kind in ('header', 'pagenum')").collect()} == {(str(n), i, k) for n in range(3) for i, k in ((1, "header"), (8, "pagenum"))}


# ---------------------------------------------------------------- 4

@pytest.mark.parametrize("text, units", [
    (None, []), ("", []), (" \n\n ", []), ("no mark", ["no mark"]),
    ("He met Dr. Hale at 3 p.m. in the U.S. office. It was 2.5 km, e.g. far.", ["He met Dr. Hale at 3 p.m. in the U.S. office.", "It was 2.5 km, e.g. far."]),
    ("“Why?” is the question. She asked, “Really? Now!” He left.", ["“Why?” is the question.", "She asked, “Really? Now!”", "He left."]),
    ("「急いで！時間がない。」と言った。次です。", ["「急いで！時間がない。」と言った。", "次です。"]),
    ("他說：「很重要！請記下來。」這樣一來，就好了。", ["他說：「很重要！請記下來。」", "這樣一來，就好了。"]),
    ("一行目は\n続きます。終わり", ["一行目は\n続きます。", "終わり"]), ("# 見出し\n本文です。\n\n- a\n- b", ["# 見出し", "本文です。", "- a", "- b"]),
    ("甲：「一？」\n乙：「二。」", ["甲：「一？」", "乙：「二。」"]), ("ไปครับ มาค่ะ", ["ไปครับ", "มาค่ะ"]), ("Am 4. Mai kam z. B. er. Gut.", ["Am 4. Mai kam z. B. er.", "Gut."]),
    ("Сказал: «Да!» урок идёт и т. д., сказала она.", ["Сказал: «Да!»", "урок идёт и т. д., сказала она."]),
])
def test_units(text, units):
    assert [text[s:e] for s, e in sentences.unit_spans(text)] == units if text else sentences.unit_ends(text) == units


def test_units_in_spark_agree(spark):
    texts = ["  A b. C d!\n\n  x", None, "", "「あ。」と。い", "a" * 200_000 + ". B."]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "k int, content string, unit string")
    got = sentences.sentence_units(df, ["k"], "content").collect()
    for r in got:
        assert texts[r.k][r.start_pos : r.end_pos] == r.unit
    assert len(got) == sum(len(sentences.unit_ends(t)) for t in texts)


# ---------------------------------------------------------------- 5

def test_pieces_give_the_text_back(spark):
    random.seed(4)
    texts = ["".join(random.choices("abcdefgh 。\n", k=random.randrange(0, 900))) + "z" * random.choice([0, 0, 150]) for _ in range(40)] + ["", "# a\n" + "b c. " * 90]
    df = spark.createDataFrame([(i, t, "md", "x") for i, t in enumerate(texts)] + [(99, None, "md", "x"), (98, "q" * 500, "none", "x"), (0, texts[0], "md", "x")], "k int, content string, file_type string, plan string")
    limits = spark.createDataFrame([("md", 100, 10)], "file_type string, max_chars int, overlap_chars int")
    arguments = (df, ["k"], "content", "file_type", limits)
    over = split.oversized(*arguments)
    assert {r.k for r in over.collect()} == {i for i, t in enumerate(texts) if len(t) > 100}
    by = {}
    for r in split.pieces(*arguments, tokens.DEFAULT).orderBy("k", "chunk_info.chunk_index").collect():
        assert len(r.piece) <= 100 and r.chunk_info.chunk_size == len(r.piece) and r.piece == texts[r.k][r.start_pos : r.end_pos]
        by.setdefault(r.k, []).append(r)
    for k, parts in by.items():
        ends = [0, *(p.end_pos for p in parts)]
        assert ends == sorted(set(ends)) and ends[-1] == len(texts[k]) and [p.start_pos for p in parts] == [0, *(max(0, e - 10) for e in ends[1:-1])]
        assert all(p.chunk_info.total_chunks == len(parts) for p in parts)
        assert all(p.forced or p.end_pos == len(texts[k]) or texts[k][p.end_pos - 1] in split.STRETCH_END or texts[k][p.end_pos] in "#\n" for p in parts)
    for r in over.collect():
        stretch = max(map(len, __import__("re").split("[ \n　。！？.!?]", texts[r.k])))
        assert r.cut == ("forced" if stretch > 100 else "natural")


def test_headings_are_kept_with_their_text():
    text = "# A\n" + "a b. " * 10 + "\n# B\n" + "c d. " * 10
    ends, inside, long = split.cut(text, 60, 0)
    assert [text[s:e].startswith("#") for s, e in zip([0, *ends], ends)] == [True, True] and not any(inside) and not long


@pytest.mark.parametrize("text, most, pieces", [
    ("# A\n" + "a" * 10 + " " + "b" * 10 + "\n\n# B\ncccc.", 20, ["# A\naaaaaaaaaa ", "bbbbbbbbbb\n\n", "# B\ncccc."]),
    ("# A\naa.\n\n## B\nbb.\n\n# C\ncccc.", 20, ["# A\naa.\n\n## B\nbb.\n\n", "# C\ncccc."]),
    ("```\n# no heading\nx = 1\n```\n\nend of it.", 30, ["```\n# no heading\nx = 1\n```\n\n", "end of it."]),
    ("- one item\n  - inner a\n  - inner b\n- two item\n", 36, ["- one item\n  - inner a\n  - inner b\n", "- two item\n"]),
    ("- one item\n  - inner a\n  - inner b\n- two item\n", 24, ["- one item\n  - inner a\n", "  - inner b\n- two item\n"]),
])
def test_pieces_follow_the_tree(text, most, pieces):
    ends, _, _ = split.cut(text, most, 0)
    assert [text[s:e] for s, e in zip([0, *ends], ends)] == pieces


def test_long_texts_are_cut_in_linear_time():
    text = "".join(f"# H{i}\n" + "word and word. " * 40 + "\n- a\n- b\n" for i in range(3000))
    ends, _, _ = split.cut(text, 400, 20)
    assert ends[-1] == len(text) and max(b - a for a, b in zip([0, *ends], ends)) <= 380


# ---------------------------------------------------------------- 6

def test_plan_fills_and_never_overflows():
    random.seed(6)
    for capacity in (10, 64, 500):
        histogram = {random.randrange(1, capacity + 1): random.randrange(1, 40) for _ in range(30)}
        slots, containers = pack.plan(histogram, capacity)
        load, seen = {}, {}
        for size, first, last, container, each in slots:
            for rank in range(first, last + 1):
                at = container + (rank - first) // each
                load[at] = load.get(at, 0) + size
                assert (size, rank) not in seen
                seen[size, rank] = at
        assert len(seen) == sum(histogram.values()) and max(load.values()) <= capacity and set(load) == set(range(containers))
        assert containers <= sum(s * n for s, n in histogram.items()) / capacity * 1.25 + 1
    assert pack.plan({}, 5) == ([], 0)


def test_documents_take_the_slots(spark):
    data = [(i, 4) for i in range(200)] + [(200 + i, 3) for i in range(10)] + [(300, 25), (301, 0), (302, 10)]
    sized = spark.createDataFrame(data, "doc_id bigint, n_tokens int")
    got = pack.pack(spark, sized, 10).collect()
    load, each = {}, {}
    for r in got:
        each[r.doc_id] = each.get(r.doc_id, 0) + r.size
        if r.container >= 0:
            load[r.container] = load.get(r.container, 0) + r.size
    assert each == dict(data) and max(load.values()) <= 10 and [r.container for r in got if r.doc_id == 301] == [-1]
    assert len({(r.doc_id, r.piece) for r in got}) == len(got)
    assert pack.pack(spark, sized.limit(0), 10).count() == 0
    ranks = rows(pack.ranked(pack.pieces(sized, 10), 7).where("size = 4").select("rank"))
    assert ranks == [(i,) for i in range(200)]


def test_token_counts(spark):
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("日本語 " * 20_000,)], "t string")
    got = [r[0] for r in df.select(tokens.count_tokens(spark, F.col("t"))).collect()]
    assert 2 <= got[0] <= 3 and got[1] == got[2] == 0 and got[3] > 20_000


# ---------------------------------------------------------------- 7

def test_passages_against_brute_force(spark):
    random.seed(7)
    word = lambda n: "".join(random.choices("abcdefghij", k=n))
    items = [(i, f"{word(90)}", "en", "s") for i in range(6)] + [(10 + i, "".join(random.choices("あいうえおかきくけこ", k=60)), "ja", None) for i in range(6)] + [(50, None, "zh", None), (51, "", "en", None)]
    docs = []
    for d in range(120):
        _, text, lang, _ = items[random.randrange(12)]
        n = random.randrange(10, 60)
        at = random.randrange(0, len(text) - n) if n < len(text) else 0
        part = text[at : at + n].upper()
        docs.append((d, word(30) + " " + " ,".join(part[i : i + 7] for i in range(0, len(part), 7)) + word(30), "x"))
    docs += [(500, None, "x"), (501, "", "x"), (0, docs[0][1], "x")]
    got = rows(leaks.leaks(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), spark.createDataFrame(items, "item_id bigint, text string, lang string, section string")).select("doc_id", "item_id"))
    want = set()
    for d, text, _ in docs:
        for i, item, lang, _ in items:
            a, b, w = leaks.bare(text or ""), leaks.bare(item or ""), leaks.WINDOW[lang]
            if any(b[k : k + w] in a for k in range(len(b) - w + 1)):
                want.add((d, i))
    assert set(got) == want and len(got) == len(want) > 20


def test_joined_stretches_agree_with_broadcast_ones(spark, monkeypatch):
    random.seed(8)
    word = lambda n: "".join(random.choices("abcdef", k=n))
    items = spark.createDataFrame([(i, word(200) + "a" * 90, "en") for i in range(8)], "item_id bigint, text string, lang string")
    parts = [r.text for r in items.collect()]
    docs = spark.createDataFrame([(d, word(50) + parts[d % 8][d : d + 35 + d % 20] + word(50) + ("a" * 60 if d % 9 == 0 else "")) for d in range(90)], "doc_id bigint, text string")
    small = rows(leaks.leaks(docs, items))
    monkeypatch.setattr(leaks, "SMALL", 0)
    monkeypatch.setattr(leaks, "MOST_BITS", 1 << 16)
    assert rows(leaks.leaks(docs, items)) == small and len(small) > 60


def test_no_documents_or_items(spark):
    docs = spark.createDataFrame([(1, "a" * 50)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a" * 50, "en")], "item_id bigint, text string, lang string")
    assert leaks.leaks(docs.limit(0), items).count() == 0 and leaks.leaks(docs, items.limit(0)).count() == 0 and leaks.leaks(docs, items).count() == 1


# ---------------------------------------------------------------- 8

@pytest.mark.parametrize("label, lang", [("zh-Hant-TW", "zh"), ("JPN", "ja"), (" en_GB ", "en"), ("xx", None), ("", None), (None, None), ("ger", "de"), ("?", None), ("it", None)])
def test_labels(spark, label, lang):
    assert spark.createDataFrame([(label,)], "l string").select(languages.named_language(F.col("l"))).first()[0] == lang


def test_held_out_accuracy(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    matrix = languages.fit(documents.where(~held))
    own = languages.document_languages(languages.segments(documents.where(held), matrix)).withColumnRenamed("lang", "found")
    both = own.join(documents.select("doc_id", languages.named_language(F.col("lang")).alias("named")), "doc_id").where("named is not null and share > 0.9")
    assert both.where("found = named").count() >= 0.9 * both.count() > 50


def test_segments_and_unnamed(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    matrix = languages.fit(documents)
    text = "這一頁的疑問詞一共整理了二十二個，上週三要再背一次！The class starts in the morning and ends before lunch. 他說『The class starts in the morning.』這句話很重要。"
    mine = spark.createDataFrame([(1, text, "zh", 5), (2, None, "en", 5), (3, "", None, 5), (4, text, None, 5)], "doc_id bigint, text string, lang string, segment int")
    found = languages.segments(mine, matrix)
    assert [(r.lang, text[r.start_pos : r.end_pos][:3]) for r in found.where("doc_id = 1").orderBy("segment").collect()] == [("zh", "這一頁"), ("en", "The"), ("zh", "他說『")]
    assert rows(languages.unnamed_languages(mine, found)) == [(1, "en"), (4, "en"), (4, "zh")]
    assert languages.segments(mine.limit(0), matrix).count() == 0
    assert np.isfinite(languages.fit(documents.limit(0))).all()


# ---------------------------------------------------------------- rows without keys

def test_rows_without_keys_do_no_harm(spark, sf_dir, model):
    evals = spark.createDataFrame([(None, None, None, None, None), (2**60 + 1, None, None, "?", "x")], EVAL)
    assert rows(pairs.defects(evals)) == [(2**60 + 1, "reference", "empty"), (2**60 + 1, "response", "empty")]
    texts = spark.createDataFrame([(None, "thе word"), (1, "the word")], "id int, text string")
    assert {(r.id, r.unified) for r in unify.unify(texts, ["id"], "text").collect()} == {(None, "the word"), (1, "the word")}
    pages = scanned(spark, [(None, None, None, None, None, None, None), ("t", None, None, "image", None, None, "·7·\nThe rec0rding was"), ("t", "1", None, "image", None, None, "")])
    assert scans.traces(pages, model).where("kind = 'misread'").count() == 1
    docs = spark.createDataFrame([(None, "a" * 50, None), (2**60 + 1, "a" * 50, "en")], "doc_id bigint, text string, lang string")
    items = spark.createDataFrame([(None, "b" * 50, None), (2**60 + 3, "a" * 50, None)], "item_id bigint, text string, lang string")
    assert rows(leaks.leaks(docs, items).select("doc_id", "item_id")) == [(2**60 + 1, 2**60 + 3)]
    sized = spark.createDataFrame([(None, 3), (1, None), (2, 4)], "doc_id bigint, n_tokens int")
    assert rows(pack.pack(spark, sized, 10).where("doc_id is not null").select("doc_id", "size", "container")) == [(1, 0, -1), (2, 4, 0)]
