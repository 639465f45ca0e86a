"""Problem 1: unusable answers of question-answer pairs, with the kind of defect.

Copies are found by aligning question and answer: containment of the question's shingles, then the longest
common subsequence, then what the alignment leaves over, however often the question is repeated.  Refusals are found by
aligning each sentence, without its quotations, with templates: phrases by their shingles, and skeletons of content
words (who, can't or won't, answer or help) in order with what may stand between them.  An answer that stops inside a sentence is told from one that merely lacks the
final mark by the corpus itself: the shape of its last sentence occurs complete elsewhere or it doesn't, which
is a join on shapes, not a list held by each task.

Defined results: a null answer is 'empty' as there is nothing in it, and a null question is the empty text;
repeated rows count once and rows without an id not at all; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.sentences import unit_spans
from inkwell.llm.unify import _TO_LATIN, plain_form

# What stands for a missing answer, as letters and digits alone.
PLACEHOLDERS = set(
    "tbd tba todo na nan nil null none empty blank undefined notavailable noanswer pending xxx placeholder unknown "
    "無 空白 待補 待填 未填 未定 暫無 暂无 省略 略 無答案 空 なし 未記入 未入力 記入なし 回答なし 該当なし 없음 미정 빈칸 공란 해당없음".split()
)
# What announces an answer.
ANNOUNCEMENTS = set("a ans answer answers response reply 答 答案 回答 回覆 解答 答え 回答は 答えは 답 답변 대답 以下是答案 答案如下 答えは次のとおりです heresmyanswer hereistheanswer theansweris".split())
# Opening courtesies.
OPENERS = (
    "抱歉讓您久等了。 感謝您的提問。 好的， 根據筆記內容， 課本沒有直接說明，不過 お待たせしました。 ご質問ありがとうございます。 はい。 ノートによると、 "
    "教科書には直接の説明はありませんが、 네. 노트에 따르면 질문_감사합니다. 오래_기다리셨습니다. 기다리게_해서_죄송합니다. Sorry_for_the_long_wait. Thank_you_for_asking. Sure. According_to_the_notes, "
    "The_textbook_does_not_say_so_directly,_but"
).replace("_", "\x00").split()
OPENERS = tuple(o.replace("\x00", " ") for o in OPENERS)
# Sentences that ask for another question; they add nothing to an answer.
CLOSINGS = ("請改問其他問題", "建議您詢問老師", "ほかの質問をお願いします", "先生に聞いてください", "Please ask something else", "다른 질문을 해 주세요", "선생님께 여쭤")
# Templates of refusals.
REFUSALS = (
    "我無法回答", "無法回答這個問題", "無法提供答案", "沒辦法提供答案", "恕難回覆", "恕難回答", "請容我略過", "不便對此發表意見", "無從判斷", "我只是輔助工具",
    "不能代替老師作答", "超出了我能協助的範圍", "找不到相關資訊", "找不到相關內容", "沒有相關資訊", "我不知道答案", "無可奉告", "資料中沒有提到",
    "お答えできません", "お答えすることができません", "お手伝いすることができません", "答えがわかりません", "情報が見つかりません", "コメントできません", "判断しかねます",
    "回答を控えさせていただきます", "お答えしかねます", "回答できません", "記載がありません",
    "unable to answer", "can't help with that", "cannot help with that", "cannot answer", "can't answer", "not contain the answer", "beyond what i am able to do",
    "rather not comment", "decline to respond", "decline to answer", "not enough information", "nothing in the retrieved notes", "i don't know", "i do not know", "could not find",
    "답변할 수 없습니다", "답변드릴 수 없습니다", "도와드리기 어렵습니다", "판단할 수 없는", "답을 찾을 수 없습니다", "정보를 찾을 수 없", "정보가 없습니다", "정보가 부족", "답변을 삼가", "답변을 드리기 어렵", "답변하기 어렵",
    "의견을 말씀드리기", "의견을 드리기", "말씀드릴 수 없습니다", "능력 밖", "범위를 벗어", "모르겠습니다", "대답할 수 없습니다",
)
# Skeletons of refusals by language: lists of alternatives that follow each other in one clause.
SKELETONS = {
    "en": [
        ("i |we |i'm |this assistant |the assistant |as an ai ", "cannot |can not |can't |could not |couldn't |unable |not able |won't |will not |would rather not |'d rather not |prefer not |decline|refuse|not allowed |not permitted |not in a position ", "answer|help with|help you|assist|respond|reply|comment|provide|tell you|say|share|discuss|judge|determine|find|locate"),
        ("i |we ", "do not |don't ", "know the answer|know how to answer|have an answer|have enough information|have the information|have any information"),
        ("this |that |the question |your question ", "cannot be |can't be |could not be ", "answered"),
    ],
    "zh": [
        ("^|我|恕|這題|這个问题|這個問題|此題|目前|系統|助理|抱歉|對不起", "無法|无法|沒辦法|没办法|沒有辦法|不能|不便|恕難|難以|不方便|不願意|拒絕|恕不|未能", "回答|作答|答覆|回覆|協助您|協助你|幫您|幫你|評論|判斷|告訴您|告訴你|給出答案|提供答案|透露|解答"),
        ("我|這題|這個問題|此題|抱歉", "答不出來|答不上來|答不了|回答不了|回答不出|幫不上忙|不知道怎麼回答|不知道該怎麼回答|不清楚答案"),
        ("找不到|查無|沒有找到|未找到|查不到", "相關資料|相關資訊|相關內容|相關記載|答案|有關的資料"),
    ],
    "ja": [
        ("回答|お答え|答え|お手伝い|コメント|ご案内|お伝え|お役", "できません|できかね|出来ません|致しかね|いたしかね|しかねます|控えさせて|いたしません|差し控え|遠慮させて"),
        ("情報|記載|資料|答え|回答", "見つかりません|見当たりません|見つけられません"),
        ("わかりかねます|分かりかねます|存じません|存じ上げません|お役に立てません",),
    ],
    "ko": [
        ("답변|대답|답을|도움|도와|의견|판단|말씀|알려", "수 없습니다|수 없어요|수 없네요|어렵습니다|삼가|못합니다|않겠습니다|곤란합니다|불가능합니다"),
        ("정보|자료|내용|답을|기록", "찾을 수 없|찾지 못|없어 답|없어서 답|부족"),
        ("모르겠습니다|알 수 없습니다|잘 모르겠",),
    ],
    "de": [
        ("kann|können|könnte|darf|möchte|will|werde|bin", "nicht|leider nicht|keine", "beantworten|antworten|weiterhelfen|helfen|beurteilen|dazu sagen|auskunft|stellung nehmen|in der lage"),
        ("weiß|habe|finde|fand", "keine antwort|nicht die antwort|keine information|keine angaben|die antwort nicht"),
    ],
    "fr": [
        ("je |nous ", "ne peux|ne puis|ne pouvons|ne pourrai|ne suis pas|ne sais pas|refuse|préfère ne pas|n'ai pas|n'ai trouvé|ne trouve", "répondre|aider|commenter|fournir|réponse|en mesure|information|renseign"),
        ("je ne sais pas$|je ne sais pas[.]",),
    ],
    "es": [
        ("no puedo|no podemos|no podría|no soy capaz|prefiero no|me niego a|no estoy en condiciones|no sé|no encuentro|no encontré", "responder|contestar|ayudar|comentar|decirle|decirte|proporcionar|respuesta|información"),
    ],
    "pt": [
        ("não posso|não podemos|não consigo|não sou capaz|prefiro não|recuso|não sei|não encontrei|não encontro", "responder|ajudar|comentar|dizer|fornecer|resposta|informação|informações"),
    ],
    "vi": [("không thể|không biết|xin phép không|xin từ chối|từ chối|không tìm thấy|chưa thể", "trả lời|giúp|hỗ trợ|bình luận|cung cấp|câu trả lời|thông tin")],
    "th": [("ไม่สามารถ|ไม่ทราบ|ไม่รู้|ขอไม่|ไม่พบ|ไม่อาจ", "ตอบ|ช่วย|ให้ข้อมูล|แสดงความเห็น|ข้อมูล|คำตอบ")],
    "ru": [("не могу|не можем|не смогу|не в состоянии|отказываюсь|не знаю|не нашёл|не нашел|не удалось найти|затрудняюсь", "ответ|помочь|сказать|комментировать|предоставить|информац")],
}
#: Characters that may stand between two parts of a skeleton; a clause's end never does.
REACH = {"zh": 8, "ja": 10, "ko": 10, "th": 30}
# Apologies that neither answer nor refuse when they stand alone.
APOLOGIES = (
    "抱歉 很抱歉 非常抱歉 對不起 不好意思 申し訳ありません 申し訳ございません すみません ごめんなさい 죄송합니다 미안합니다 sorry imsorry iamsorry imverysorry myapologies iapologize unfortunately "
    "tutmirleid estutmirleid leider désolé jesuisdésolé losiento losientomucho desculpe sintomuito xinlỗi ขออภัย ขอโทษ ขออภัยครับ ขออภัยค่ะ извините простите ксожалению"
).split()


# Words of the frames in which an answer repeats its question.
FRAMES = (
    "您的問題是 你的問題是 您問的是 您問 關於 這個問題 的問題 問題 という ご質問 質問 ですね ですか です について のこと "
    "youasked youareasking yourquestionis yourquestionwas thequestionis question yourquestion asked regarding about 라는 이라는 질문이군요 질문입니다 질문 이군요 에대한 물으셨습니다 q"
).split()
_FRAME = re.compile("(?:" + "|".join(sorted(map(re.escape, FRAMES), key=len, reverse=True)) + ")*")

_QUOTED = re.compile(r"「[^「」]*」|『[^『』]*』|“[^“”]*”|„[^„“”]*[“”]|«[^«»]*»|《[^《》]*》|\"[^\"\n]*\"|(?<!\w)['‘][^'‘’\n]*['’](?![A-Za-z])")
_UNCLOSED = re.compile(r"[「『“„«《（(［\[【](?=[^」』”»》）)］\]】]*$)|(?<!\w)['‘](?=\w)[^'’\n]*$")
_MARKUP = re.compile(r"<[^<>]*>|&[a-z]+;")
_NOT_ALNUM = re.compile(r"[\W_]+")
_MARKER = re.compile(r"^\s*(?:[-*•・]\s*|[(（]?\d{1,3}[.)）]\s*)")
_TAIL_DECOR = re.compile(r"[^\w\s.,;:!?。、，；：！？…」』”\"'’»）)\]】》〉〜~\-—–/[({（「『“„«《+=&%°]+\s*$")
_FINAL = re.compile(r"[。！？｡.!?…．～♪](?:[」』”\"'’»）)\]】》]|\s)*$|[)）\]】][ \s]*$")
_OPEN_END = re.compile(r"[,，、;；:：\-—–/(（「『“„«《\[]\s*$")
_PLACE = re.compile(
    r"(?:第?\s*\d+\s*(?:課|頁|ページ|과|쪽|回|節|章|番|号|號|個|つ|型)\s*(?:の?(?:前半|後半|途中|最初|最後))?[\s,，、・]*)+(?:에\s*나옵니다)?"
    r"|(?:(?:lesson|lessons|page|pages|p\.|unit|chapter|no\.|type)\s*\d+[\s,]*(?:and)?\s*)+", re.IGNORECASE)


@lru_cache(maxsize=1 << 12)
def key(text: str) -> str:
    """Letters and digits alone; case, width, styles and look-alikes are levelled."""
    return _NOT_ALNUM.sub("", unicodedata.normalize("NFKC", plain_form(text)).casefold().translate(_TO_LATIN))


def unquoted(text: str) -> str:
    for _ in range(3):
        shorter = _QUOTED.sub("", text)
        if shorter == text:
            break
        text = shorter
    return text


def is_empty(text: str) -> bool:
    left = key(_MARKUP.sub(" ", text))
    if not left or left in PLACEHOLDERS or left in ANNOUNCEMENTS:
        return True
    return not key(without_openers(text))


def without_openers(text: str) -> str:
    text = text.strip()
    again = True
    while again:
        again = False
        for opener in OPENERS:
            if text.startswith(opener):
                text, again = text[len(opener) :].lstrip(), True
    return text


def _shingles(text: str, n: int = 3) -> set[str]:
    return {text[i : i + n] for i in range(max(1, len(text) - n + 1))}


def containment(part: str, whole: str, n: int = 3) -> float:
    own = _shingles(part, n)
    return len(own & _shingles(whole, n)) / len(own)


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _skeleton(lang: str, slots: tuple[str, ...]) -> str:
    between = f"[^.!?。！？；;\n]{{0,{REACH.get(lang, 40)}}}?"
    return between.join(f"(?:{slot})" for slot in slots)


_REFUSAL_KEYS = [(key(r), _shingles(key(r))) for r in REFUSALS]
_CLOSING_KEYS = [(key(c), _shingles(key(c))) for c in CLOSINGS]
_OPENER_KEYS = {key(o) for o in OPENERS} | {key(a) for a in APOLOGIES}
_SKELETON = re.compile("|".join(_skeleton(lang, slots) for lang, all_slots in SKELETONS.items() for slots in all_slots))
#: Share of a sentence that must be a template's for the sentence to be no more than a closing.
CLOSING_SHARE = 0.3


def _aligned(unit: str, templates: list[tuple[str, set[str]]]) -> float:
    """The share of the unit's shingles that a template explains which the unit holds, in whole or by nine tenths of its shingles."""
    own = _shingles(unit)
    return max((len(parts & own) / len(own) for t, parts in templates if t in unit or len(parts & own) >= max(0.9 * len(parts), 4)), default=0.0)


def refuses(unit: str) -> bool:
    """Whether a sentence, without its quotations, aligns with a phrase or a skeleton of refusals."""
    plain = unquoted(unit)
    if _aligned(key(plain), _REFUSAL_KEYS):
        return True
    return _SKELETON.search(re.sub(r"\s+", " ", unicodedata.normalize("NFKC", plain_form(plain)).casefold().replace("’", "'")).strip()) is not None


def is_refusal(text: str) -> bool:
    """Whether some sentence refuses and no other one answers."""
    refused = False
    for unit in _units(text):
        plain = key(unquoted(unit))
        if not plain or plain in _OPENER_KEYS:
            continue
        if refuses(unit):
            refused = True
        elif _aligned(plain, _CLOSING_KEYS) < CLOSING_SHARE:
            return False
    return refused


def _left(answer: str, question: str) -> str | None:
    """What is left of an answer once one alignment of the question is taken out; None if it doesn't hold the question."""
    if len(answer) < 0.9 * len(question) or containment(question, answer, min(3, len(question))) < 0.85 or common_length(question, answer) < 0.95 * len(question):
        return None
    at = answer.find(question)
    if at >= 0:
        return answer[:at] + answer[at + len(question) :]
    kept, at = [], 0
    for block in difflib.SequenceMatcher(None, answer, question, autojunk=False).get_matching_blocks():
        if block.size >= 2 or not block.size:
            kept.append(answer[at : block.a])
            at = block.a + block.size
    return "".join(kept)


def is_copy(question: str, answer: str) -> bool:
    """Whether the answer holds the question, once or repeated, and besides at most frames."""
    q, a = key(question), key(answer)
    left = _left(a, q) if q else None
    if left is None:
        return False
    while _FRAME.fullmatch(left) is None:
        again = _left(left, q)
        if again is None or len(again) >= len(left):
            return False
        left = again
    return True


@lru_cache(maxsize=1 << 12)
def _units(text: str) -> list[str]:
    return [text[s:e] for s, e in unit_spans(text)]


def shape(unit: str) -> str:
    """How a sentence ends, without what varies: quotations, numbers, Japanese words in other scripts' sentences.

    A sentence cut anywhere but at its end hardly ever ends like a whole one; a short one is taken from its start.
    """
    unit = without_openers(_MARKER.sub("", without_openers(plain_form(unit))))
    unit = _MARKER.sub("", unit)
    unit = unicodedata.normalize("NFKC", re.sub(r"\d+", "9", _QUOTED.sub("Q", unit))).lower()
    latin, hangul, wide = len(re.findall("[a-z]", unit)), len(re.findall("[가-힣]", unit)), len(re.findall("[぀-ヿ一-鿿]", unit))
    if latin + 3 * hangul > 2 * wide:
        unit = re.sub("[〜~々〆ー぀-ヿ一-鿿]+", "j", unit)
    plain = "^" + _NOT_ALNUM.sub("", unit)
    return plain[-12 if latin > hangul + wide else -6 :]


def ending(text: str) -> str | None:
    """None if the text ends soundly as it stands, '' if it breaks off, else the shape of its last unit."""
    text = _TAIL_DECOR.sub("", plain_form(text).rstrip().rstrip("`*_# \n")).rstrip()
    units = _units(text)
    if not units:
        return None
    last = units[-1]
    if _UNCLOSED.search(_QUOTED.sub("Q", last)) or _OPEN_END.search(last):
        return ""
    if _FINAL.search(last):
        return None
    body = without_openers(_MARKER.sub("", without_openers(last)))
    if len(units) == 1 and _PLACE.fullmatch(body.strip()) or not key(unquoted(body)):
        return None
    return shape(last)


def complete_shapes(text: str) -> list[str]:
    return sorted({shape(u) for u in _units(plain_form(text)) if _FINAL.search(_TAIL_DECOR.sub("", u)) and not _UNCLOSED.search(_QUOTED.sub("Q", u))})


# Common words that tell languages in Latin letters apart.
LATIN_WORDS = {
    "en": "the of and to in is it that for on with as are this be you or by from word page lesson says say people which form pattern particle",
    "de": "der die das und ist nicht wir haben ich ein eine zu mit auf für im am den dem hat heute nach gestern herr frau wort heft",
    "fr": "le la les et est une un des du que nous de à pour dans avec pas je a au cahier leçon mots très hier après",
    "es": "el la los las y es una un de que en por con para no se del al más muy ayer después cuaderno lección",
    "pt": "o a os as e é uma um de que em por com para não se do da no na mais muito ontem depois caderno lição hoje",
    "vi": "của và là một trong các tôi không cho với từ này bài học hôm qua vì sao ở thì khi chúng",
}
_LATIN_WORDS = {lang: set(words.split()) for lang, words in LATIN_WORDS.items()}
_ZH_ONLY = set("這麼個們為說對的了是嗎呢吧頁還沒來時會過學與著裡讓")


@lru_cache(maxsize=1 << 12)
def language(text: str) -> str:
    """Language of a short text without its quotations; '' if unknown, 'zh ja' for ideographs of either."""
    text = unicodedata.normalize("NFKC", unquoted(without_openers(plain_form(text)))).lower()
    count = {name: len(re.findall(f"[{span}]", text)) for name, span in
             (("hira", "぀-ゟ"), ("kata", "゠-ヿ"), ("han", "一-鿿"), ("ko", "가-힣"), ("th", "ก-๛"), ("ru", "Ѐ-ӿ"), ("latin", "a-zà-ɏḀ-ỿ"))}
    wide = count["hira"] + count["kata"] + count["han"]
    weights = {"ko": 1.5 * count["ko"], "th": count["th"] / 2, "ru": count["ru"] / 3, "latin": max(count["latin"] / 3, 2.5 * len(re.findall("[a-zà-ɏḀ-ỿ]+", text))), "wide": wide}
    best = max(weights, key=weights.__getitem__)
    if not weights[best]:
        return ""
    if best == "wide":
        zh = sum(ch in _ZH_ONLY for ch in text)
        if count["hira"] + count["kata"]:
            return "ja" if not count["han"] or not zh and (count["hira"] or count["kata"] > 1) or count["hira"] > 0.35 * wide else "zh"
        return "zh" if zh or count["han"] > 6 else "zh ja"
    if best != "latin":
        return best
    words = re.findall("[a-zà-ɏḀ-ỿ]+", text)
    scores = {lang: sum(w in own for w in words) for lang, own in _LATIN_WORDS.items()}
    marks = {"vi": "ăâđêôơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ", "de": "äöüß", "fr": "èêçœùî", "es": "ñ¿¡", "pt": "ãõ"}
    for lang, own in marks.items():
        scores[lang] += 0.6 * sum(ch in own for ch in text)
    top = max(scores, key=scores.__getitem__)
    return top if scores[top] > scores["en"] else "en"


# Names of languages in questions that ask for one.
ASKED = (
    (r"(?:翻成|翻譯成|譯成|用)\s*(英|日|韓|法|德)(?:文|語)(?!要怎麼說)", {"英": "en", "日": "ja", "韓": "ko", "法": "fr", "德": "de"}),
    (r"(英語|日本語|韓国語|中国語)で(?:説明|書|答|教え|訳)", {"英語": "en", "日本語": "ja", "韓国語": "ko", "中国語": "zh"}),
    (r"(영어|일본어|중국어|한국어)로\s*(?:설명|써|쓰|대답|답|번역)", {"영어": "en", "일본어": "ja", "중국어": "zh", "한국어": "ko"}),
    (r"(?:write|give|make|translate|explain|answer|reply)\b.*?\b(english|japanese|korean|chinese)\b", {"english": "en", "japanese": "ja", "korean": "ko", "chinese": "zh"}),
)


@lru_cache(maxsize=1 << 12)
def wanted_language(question: str) -> str:
    plain = unicodedata.normalize("NFKC", unquoted(plain_form(question).translate(_TO_LATIN))).lower()
    for pattern, names in ASKED:
        m = re.search(pattern, plain)
        if m:
            return names[m.group(1)]
    return language(question)


def is_other_language(question: str, answer: str) -> bool:
    got, wanted = language(answer), wanted_language(question)
    return bool(got and wanted) and not set(got.split()) & set(wanted.split())


@lru_cache(maxsize=1 << 12)
def _examine(question: str, answer: str | None) -> tuple[str | None, str | None, list[str], bool]:
    if answer is None or is_empty(answer):
        return "empty", None, [], False
    shapes = complete_shapes(answer)
    if is_refusal(answer):
        return "refusal", None, shapes, False
    if is_copy(question, answer):
        return "copy", None, [], False
    end = ending(answer)
    other = is_other_language(question, answer)
    return ("truncated" if end == "" else None), end or None, shapes, other


def _examined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [_examine(q or "", a) for q, a in zip(batch["user_input"], batch["answer"])]
        yield pd.DataFrame({
            "row_id": batch["row_id"], "field": batch["field"], "defect": [r[0] for r in rows], "tail": [r[1] for r in rows],
            "shapes": [r[2] for r in rows], "other": [r[3] for r in rows],
        })


def answers(eval_rows: DataFrame) -> DataFrame:
    """(row_id, user_input, field, answer), once for repeated rows."""
    one = eval_rows.where(F.col("row_id").isNotNull()).select("row_id", "user_input", "response", "reference").dropDuplicates(["row_id"])
    fields = F.array(*(F.struct(F.lit(name).alias("field"), F.col(name).alias("answer")) for name in ("response", "reference")))
    return one.select("row_id", "user_input", F.inline(fields))


def defects(eval_rows: DataFrame) -> DataFrame:
    """(row_id, field, defect) of each unusable answer; the first of empty, refusal, copy, truncated, other_lang.

    What was examined is kept: the shapes of whole sentences come from it and are joined to it.
    """
    seen = answers(eval_rows).mapInPandas(_examined, "row_id bigint, field string, defect string, tail string, shapes array<string>, other boolean")
    seen = seen.persist(StorageLevel.MEMORY_AND_DISK)
    whole = seen.select(F.explode("shapes").alias("tail")).select(F.xxhash64("tail").alias("_tail")).distinct()
    # only answers with an ending to look up meet the join; whole ones, nearly all, stay where they are
    doubtful = seen.where(F.col("defect").isNull() & F.col("tail").isNotNull()).select("row_id", "field", "other", F.xxhash64("tail").alias("_tail"))
    broken = doubtful.join(whole, "_tail", "left_anti").select("row_id", "field", F.lit("truncated").alias("defect"))
    kept = doubtful.where("other").join(whole, "_tail", "left_semi").select("row_id", "field", F.lit("other_lang").alias("defect"))
    plain = seen.where(F.col("defect").isNotNull() | F.col("tail").isNull()).select("row_id", "field", F.coalesce("defect", F.when(F.col("other"), "other_lang")).alias("defect"))
    return plain.where(F.col("defect").isNotNull()).unionByName(broken).unionByName(kept)
