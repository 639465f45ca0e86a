"""Problem 3: traces of the page and of recognition in scanned texts, and their repair.

Four steps.  ``furniture`` finds running titles and page numbers: a number counts if its neighbours on other
pages of the file continue it (or the page's own metadata say so), a title if the file repeats it or is called
so, or if it is one elsewhere in the corpus and stands alone here; this evidence is gathered over all rows of a file by partial aggregation and joined back, never grouped in
one task.  ``language_model`` counts character trigrams, words and pairs of words of the texts that were not scanned, in
hashed tables whose size follows the corpus up to a bound; the logarithms of the counts are broadcast.  ``channel``
estimates how often each confusion happens: from all scanned texts, by the words and characters that are far rarer
than what they may have been.  ``traces`` reads each text as one flow without the furniture and decodes it as a
noisy channel: the probability of the confusions times the likelihood of the corpus, by Viterbi over the candidate
words of each line (pairs of words) and, in scripts without blanks, over the candidate characters (trigrams).
All likelihoods are ratios, so nothing depends on how large the corpus is.  ``repaired`` gives continuous paragraphs.

Defined results: null texts give no rows and blank ones no traces; a row without a key keeps no furniture; a null file name makes the row a file of its own; repeated
rows count once; without any unscanned text nothing is judged misread; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.unify import plain_form

# Characters that recognition puts in place of others (read>meant).
CHARACTERS = (
    "ほ>は レ>し 諜>課 一>ー 勤>動 旬>句 昔>音 丈>文 錬>練 貢>頁 詰>話 帥>師 だ>た つ>っ よ>ょ ゆ>ゅ や>ゃ 便>使 나>니 肋>助 디>다 ろ>る 슴>습 列>例 宇>字 力>カ "
    "復>複 複>復 続>読 さ>き 기>가 汽>氣 間>問 口>ロ 八>ハ 夕>タ 工>エ 二>ニ ぬ>め 千>チ"
).split()
STRINGS = "c>e 0>o l>i o>a f>t 5>s ri>n b>h ii>u q>g 1>l rn>m vv>w d>cl m>rn I>l 0>O 5>S 1>i 8>B 6>b".split()
#: Places of a hashed table: the smallest that holds the corpus at ``CHARS_EACH`` characters a place, within these bounds.
FEWEST, MOST, CHARS_EACH = 1 << 22, 1 << 23, 64
#: Places that one row of a table holds on its way to the driver, and steps of one unit of log count.
BLOCK, STEP = 1 << 16, 8
#: Log of the probability of a confusion before any is estimated, and how much evidence that stands for.
CHANNEL, PRIOR = -3.5, 200.0
#: Log-odds from which a confusion counts as one while the channel is estimated.
CERTAIN = 5.0
#: Log-odds from which a reading is changed.
CHANGE = 1.0
#: Log-odds for the reading in the script of both neighbours: an ideograph hardly ever stands inside katakana.
INSIDE = 6.0
NAME_CHANGE = 4.0
#: Log-odds that each letter beyond the second takes from a word that the corpus hasn't, as most spellings are no words.
NOVELTY = 1.0
#: Weight of pairs of words against single words, and log-odds by which a pair may speak for a reading.
PAIRED, CONTEXT = 0.6, 6.0
ROOM = 500_000

_SWAPS: dict[str, list[str]] = {}
for _pair in CHARACTERS:
    _SWAPS.setdefault(_pair[0], []).append(_pair[2])
_KATAKANA = re.compile("[゠-ヿ]").match
_LIKE_KATAKANA = {p[0] for p in CHARACTERS if _KATAKANA(p[2]) and not _KATAKANA(p[0])}
_RULES = [tuple(p.split(">")) for p in STRINGS]
_WORD = re.compile(r"[A-Za-zÀ-ɏḀ-ỿЀ-ӿ가-힣0-9]+(?:[-'’][A-Za-zÀ-ɏḀ-ỿЀ-ӿ0-9]+)*")
_LETTERED = re.compile(r"[A-Za-zÀ-ɏḀ-ỿЀ-ӿ가-힣]")
_DIGITS = re.compile(r"[0-9０-９]")
_BROKEN_OFF = re.compile(r"[.!?。！？\n]")
_WIDE = re.compile("[\u1100-\u115f\u2e80-\u303e\u3041-\u33ff\u3400-\u4dbf\u4e00-\u9fff\ua000-\ua4cf\ua960-\ua97f\uac00-\ud7a3\uf900-\ufaff\ufe30-\ufe6f\uff01-\uff60\uffe0-\uffe6\U0001f300-\U0001faff\U00020000-\U0003fffd]")
_HYPHENED = re.compile(r"[A-Za-zÀ-ɏḀ-ỿЀ-ӿ]([-‐‑‒–—¬­⁃~])\s*$")
_JOINS = re.compile("[⺀-鿿豈-﫿＀-￯]")

# ---------------------------------------------------------------- running titles and page numbers

_NUMBER = r"(?P<n>[0-9０-９OolI|SB]{1,4}|[〇一二三四五六七八九十百]{1,5}|[ivxlc]{1,8}|[IVXLC]{1,8})"
# How a page number may be written; {} is the number.
_FORMS = ["- {} -", "– {} –", "— {} —", "·{}·", "〔{}〕", "（{}）", "({})", "[{}]", "{}", "p. {}", "P. {}", "pp. {}", "Page {}", "page {}", "S. {}", "Seite {}", "第{}頁", "第{}页", "第{}ページ", "{}ページ", "{}頁", "{}쪽", "<{}>", "《{}》", "〈{}〉", "【{}】", "• {} •", "~ {} ~", "No. {}"]
_FORM = [(form, re.compile(re.escape(form).replace(r"\{\}", "\x00").replace(r"\ ", r"\s*").replace("\x00", r"\s*" + _NUMBER + r"\s*"))) for form in _FORMS]
_ANY_FORM = re.compile("|".join(pattern.pattern.replace("?P<n>", "?:") for _, pattern in _FORM))
_OF = re.compile(_NUMBER + r"\s*[/／]\s*(?P<m>[0-9０-９OolI|SB]{1,5})")
#: Forms that also number questions, points and notes in running text; alone they are no evidence.
_WEAK = {"（{}）", "({})", "No. {}", "[{}]"}
_KANJI = {ch: i for i, ch in enumerate("〇一二三四五六七八九")}
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
_MISTAKEN = str.maketrans("OolI|SB", "0011158")
_SENTENCE = re.compile(r"[。！？、，]|[.!?,;] |[.!?,;:。，、；：！？…][”“\x22»」』)）\s]*$|^[-*•・] |→")
_GAP = re.compile(r"\s{2,}|\t|　{2,}")
_DECOR = re.compile(r"[\W_]+")


def _value(text: str) -> int | None:
    text = unicodedata.normalize("NFKC", text)
    if text[0] in _KANJI or text[0] in "十百":
        if not set(text) & set("十百"):
            return int("".join(str(_KANJI[ch]) for ch in text)) if all(ch in _KANJI for ch in text) else None
        total, digit = 0, None
        for ch in text:
            if ch in "十百":
                total += (1 if digit is None else digit) * (10 if ch == "十" else 100)
                digit = None
            else:
                digit = _KANJI[ch]
        return total + (digit or 0)
    plain = text.translate(_MISTAKEN)
    if set(text.lower()) <= set(_ROMAN) and set(text) - set("lI"):
        steps = [_ROMAN[ch] for ch in text.lower()]
        return sum(-v if v < max(steps[i:]) else v for i, v in enumerate(steps))
    if not plain.isdigit() or not (_DIGITS.search(text) or len(text) == 1 and text in "lIO"):
        return None
    return int(plain)


def page_number(text: str) -> tuple[str, int] | None:
    """The form and value if the whole text is written like a page number."""
    m = _OF.fullmatch(text)
    if m:
        n, of = _value(m.group("n")), _value(m.group("m"))
        return (f"{{}}/{of}", n) if n is not None and of and n <= of else None
    for form, pattern in _FORM if _ANY_FORM.fullmatch(text) else ():
        m = pattern.fullmatch(text)
        if m:
            n = _value(m.group("n"))
            style = "k" if m.group("n")[0] in "〇一二三四五六七八九十百" else "r" if set(m.group("n").lower()) <= set(_ROMAN) and set(m.group("n")) - set("lI") else ""
            return (form + style, n) if n is not None else None
    return None


def title_key(text: str) -> str:
    """A title without decoration and case, with confusable characters levelled."""
    plain = _DECOR.sub("", unicodedata.normalize("NFKC", text)).casefold()
    plain = "".join(_SWAPS[ch][0] if ch in _SWAPS else ch for ch in plain)
    return plain.replace("複", "復").replace("rn", "m").replace("vv", "w").replace("ri", "n").replace("ii", "u").translate(_LEVEL)


_LEVEL = str.maketrans("c0l1o5fbq", "eoiiastbg")


def title_like(text: str) -> bool:
    """Mostly letters, unlike sums, scores and item numbers."""
    letters = sum(ch.isalpha() for ch in text)
    return letters >= 3 and letters >= 0.4 * len(text.replace(" ", "")) and not _SENTENCE.search(text) and not _HYPHENED.search(text) and not re.match(r"問\d|.*\d\s*[-+=]\s*\d", text)


def _columns(text: str) -> int:
    """Width in columns; wide characters take two."""
    return 2 * len(text) - len(_WIDE.sub("", text))


def _parts(line: str) -> tuple[str, tuple[str, int] | None]:
    """(title, number) of a line that may hold either or both."""
    number = page_number(line)
    if number:
        return "", number
    gaps = list(_GAP.finditer(line))
    for gap in (gaps[-1:] + gaps[:1]) if gaps else ():
        left, right = line[: gap.start()], line[gap.end() :]
        if (number := page_number(right)) and left:
            return left, number
        if (number := page_number(left)) and right:
            return right, number
    return line, None


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["tbl", "rec_key", "file", "page", "line_no", "edge", "title", "named", "form", "number", "follows", "short", "kind", "body"]
    for batch in batches:
        out = []
        for tbl, key, file, page, called, content in zip(batch["tbl"], batch["rec_key"], batch["file"], batch["page"], batch["title"], batch["content"]):
            lines = content.split("\n")
            full = [i for i, line in enumerate(lines) if line.strip()]
            if not full:
                continue
            wide = sorted(_columns(lines[i].strip()) for i in full)
            wide = [w for w in wide if w <= 2 * wide[len(wide) // 2]]  # without lines that were never wrapped
            width = wide[len(wide) * 9 // 10]
            body, own, seen = zlib.crc32(content.encode()), title_key(called or ""), []
            for i in full:
                raw = lines[i]
                line = raw.strip(" \t\x0c　\r")
                edge = i in (full[0], full[-1]) or raw.startswith("\x0c") or i + 1 < len(lines) and lines[i + 1].startswith("\x0c")
                if not edge and len(line) > 60 and not _GAP.search(line):  # inside a page a long line is text, unless a gap sets a number off
                    continue
                title, number = _parts(line)
                if number is None and (not edge and len(line) > 60 or _SENTENCE.search(line)):
                    continue
                key_ = title_key(title) if title else ""
                second = i in (full[1:2] + full[-2:-1]) and (page_number(lines[full[0] if i == full[1] else full[-1]].strip(" \t\x0c　\r")) is not None)
                if title and not number and not title_like(title):
                    continue
                short = _columns(line) < 0.85 * width
                edge = edge or second
                broken = bool(title) and i < full[-1] and (i == full[0] or bool(lines[i + 1].strip())) and len(wide) > 4 and not re.match(r"[(（]?\d+[.)）]", title)
                if broken:  # a line that wraps leaves no room for the first word of the next
                    after = lines[full[full.index(i) + 1]].strip(" \t\x0c　\r")
                    broken = _columns(line) + 1 + _columns(after[:1] if _JOINS.match(after[0]) else after.split(" ")[0]) <= (0.45 if _JOINS.match(line[-1]) else 0.8) * width
                seen.append([tbl, key, file, page, i + 1, edge, key_ if len(key_) > 2 else "", bool(own) and key_ == own or broken, number[0] if number else None, number[1] if number else None, False, short, _DIGITS.sub("0", key_), body])
            places: dict[str, list[list]] = {}
            for row in seen:
                if row[8] is not None:
                    places.setdefault(row[8], []).append(row)
            for rows in places.values():
                for a, b in zip(rows, rows[1:]):
                    if b[9] == a[9] + 1:
                        a[10] = b[10] = True
            out += seen
        frame = pd.DataFrame(out, columns=columns)
        frame["number"] = frame["number"].astype("Int64")
        frame["page"] = frame["page"].astype("Int64")
        yield frame


_CANDIDATE = "tbl string, rec_key string, file string, page bigint, line_no int, edge boolean, title string, named boolean, form string, number bigint, follows boolean, short boolean, kind string, body bigint"


@F.pandas_udf(T.StringType())
def _kind_udf(titles: pd.Series) -> pd.Series:
    return titles.map(lambda t: _DIGITS.sub("0", title_key(t)))


def furniture(scanned: DataFrame) -> DataFrame:
    """(tbl, rec_key, line_no, header, pagenum) of the lines that belong to the page, not to the text.

    ``scanned`` has tbl, rec_key, file, file_type, page, title, content; repeated rows are dropped once lines are short.  The lines that may
    be furniture are kept, since all the evidence is gathered from them.
    """
    found = scanned.select("tbl", "rec_key", "file", F.when(F.col("file_type") == "image", F.col("page")).cast("bigint").alias("page"), "title", "content").mapInPandas(_candidates, _CANDIDATE)
    found = found.dropDuplicates(["tbl", "rec_key", "line_no"])
    found = found.withColumn("on_page", F.coalesce(F.col("page") == F.col("number"), F.lit(False))).persist(StorageLevel.MEMORY_AND_DISK)
    forms = found.where(F.col("form").isNotNull())
    known = forms.groupBy("file", "form", "number").agg(F.max(F.col("follows") | F.col("on_page")).alias("proved"), F.countDistinct("body").alias("bodies"))
    pairs = known.select("file", "form", (F.col("number") + 1).alias("number")).withColumn("after", F.lit(True)).unionByName(
        known.select("file", "form", (F.col("number") - 1).alias("number")).withColumn("after", F.lit(True))
    ).distinct()
    known = known.join(pairs, ["file", "form", "number"], "left").select("file", "form", "number", "proved", F.coalesce("after", F.lit(False)).alias("linked"))
    used = known.where("proved").select("file", "form").distinct().withColumn("form_used", F.lit(True))
    nothing = [F.lit(None).cast("boolean").alias(name) for name in ("proved", "linked", "form_used")]
    judged = forms.join(known, ["file", "form", "number"]).join(used, ["file", "form"], "left").unionByName(found.where(F.col("form").isNull()).select("*", *nothing))
    weak = F.col("form").isin(*_WEAK)
    paged = F.col("page").isNotNull()
    number = F.when(paged, F.col("on_page")).otherwise(
        F.col("follows") | F.col("proved") | (F.col("linked") & (~weak | F.col("form_used"))) | (F.col("edge") & ~weak & F.col("form").isNotNull())
        | (F.col("edge") & F.col("form_used"))
    )
    judged = judged.withColumn("pagenum", F.coalesce(number, F.lit(False)) & F.col("form").isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)
    beside = F.col("pagenum") & (F.col("title") != "")
    named = F.col("named") | beside
    places = judged.where(F.col("title") != "").groupBy("file", "title", "tbl").agg(
        F.max(named).alias("called"), F.countDistinct("body", "line_no").alias("times"), F.countDistinct(F.when(F.col("edge"), F.struct("body", "line_no"))).alias("at_edge"),
        F.max(F.col("page").isNotNull()).alias("by_page"), F.min("short").alias("short"),
    )
    often = F.when(F.col("by_page"), F.col("at_edge")).otherwise(F.col("times"))
    running = places.where(F.col("called") | (often >= 2) & F.col("short") | (often >= 4)).select("file", "title").distinct().withColumn("running", F.lit(True))
    judged = judged.where(F.col("title") != "").join(running, ["file", "title"], "left").unionByName(judged.where(F.col("title") == "").withColumn("running", F.lit(None).cast("boolean")))
    called = scanned.where(F.col("title").isNotNull()).select("title").distinct().select(_kind_udf("title").alias("kind"))
    kinds = judged.where("running").select("kind").unionByName(called).where(F.length("kind") > 3).distinct().withColumn("kindred", F.lit(True))
    judged = judged.join(kinds, "kind", "left").withColumn("running", F.coalesce("running", F.when(F.col("short") & F.col("form").isNull(), F.col("kindred"))))
    header = F.col("running").isNotNull() & (F.col("form").isNull() | F.col("pagenum")) & (~paged | F.col("edge") | beside)
    return judged.select("tbl", "rec_key", "line_no", header.alias("header"), "pagenum").where(F.col("header") | F.col("pagenum"))


# ---------------------------------------------------------------- language model

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_I1, _I2, _I3, _FULL = int(_M1), int(_M2), int(_M3), (1 << 64) - 1
_MODEL_CHARS = np.array(sorted({ord(ch) for p in CHARACTERS for ch in (p[0], p[2])} | {ord(ch) for p in STRINGS for ch in p if ch != ">"}), np.uint32)
_TRIGRAM, _WORDS, _PAIR = range(3)


class Model(NamedTuple):
    """Log counts of trigrams, words and pairs of words in hashed tables (steps of 1/STEP), and the number of words."""

    tables: tuple[np.ndarray, np.ndarray, np.ndarray]
    total: float


def _codes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).copy()
    codes[(codes >= 48) & (codes <= 57)] = 48
    return codes


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        return h ^ (h >> np.uint64(29))


def _trigram(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(a.astype(np.uint64) * _M1 ^ b.astype(np.uint64) * _M2 ^ c.astype(np.uint64) * _M3)


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _pair(first: int, second: int) -> int:
    """The hash of a pair of words from those of the words."""
    h = (first * _I1 ^ second * _I2) & _FULL
    h ^= h >> 33
    h = h * 0xFF51AFD7ED558CCD & _FULL
    return h ^ h >> 29


def _flat(text: str) -> str:
    """Text as one line, as the flow of scanned lines is read."""
    return re.sub(r"\s*\n\s*", lambda m: "\0" if m.group().count("\n") > 1 else " ", text)


def _count(batches: Iterator[pd.DataFrame], places: int) -> Iterator[pd.DataFrame]:
    """(kind, place, n): counts of a partition in hashed tables; words and pairs have two places each."""
    tables = [np.zeros(places, np.int32) for _ in range(3)]
    mask, words = np.uint64(places - 1), 0
    wanted = np.zeros(0x110000, bool)
    wanted[_MODEL_CHARS] = True
    wanted[48] = True

    def add(kind: int, hashes: np.ndarray, both: bool = True) -> None:
        for h in (hashes, hashes >> np.uint64(32)) if both else (hashes,):
            np.add(tables[kind], np.bincount((h & mask).astype(np.int64), minlength=places), out=tables[kind], casting="unsafe")

    for batch in batches:
        pending, size = [], 0
        for text in [*batch["content"].tolist(), None]:
            if text:
                flat = _flat(plain_form(text))
                pending.append(flat)
                size += len(flat)
            if pending and (text is None or size > 4 * ROOM):
                joined = "\0".join(pending)
                codes = _codes(joined)
                if len(codes) > 2:
                    keep = wanted[codes[:-2]] | wanted[codes[1:-1]] | wanted[codes[2:]]
                    add(_TRIGRAM, _trigram(codes[:-2][keep], codes[1:-1][keep], codes[2:][keep]), False)
                found = _WORD.findall(joined)
                seen = {w: _hash(w) for w in set(found)}
                own = np.fromiter((seen[w] for w in found), np.uint64, len(found))
                words += len(own)
                add(_WORDS, own)
                with np.errstate(over="ignore"):
                    add(_PAIR, _mixed(own[:-1] * _M1 ^ own[1:] * _M2))
                pending, size = [], 0
    for kind, table in enumerate(tables):
        at = np.flatnonzero(table)
        yield pd.DataFrame({"kind": np.full(len(at), kind, np.int8), "place": at, "n": table[at]})
    yield pd.DataFrame({"kind": np.full(1, 3, np.int8), "place": [0], "n": [words]})


def language_model(plain: DataFrame) -> Model:
    """The model of the column ``content``.

    Tasks send the counts of their partition, the sums are packed in blocks by tasks, and the driver receives at most
    three tables of ``MOST`` bytes.
    """
    chars = plain.agg(F.sum(F.length("content"))).first()[0] or 0
    places = FEWEST
    while places < min(MOST, chars / CHARS_EACH):
        places *= 2
    sums = plain.select("content").mapInPandas(lambda batches: _count(batches, places), "kind tinyint, place int, n bigint").groupBy("kind", "place").agg(F.sum("n").alias("n"))
    step = F.least(F.round(F.log(2 * F.col("n") + 1) * STEP), F.lit(255)).cast("int")
    total = F.when(F.col("kind") == 3, F.col("n"))
    blocks = sums.groupBy("kind", F.floor(F.col("place") / BLOCK).alias("block")).agg(F.collect_list(F.struct((F.col("place") % BLOCK).alias("place"), step.alias("step"))).alias("steps"), F.max(total).alias("total"))

    @F.pandas_udf("binary")
    def packed(all_steps: pd.Series) -> pd.Series:
        def one(steps) -> bytes:
            table = np.zeros(BLOCK, np.uint8)
            table[[s["place"] for s in steps]] = [s["step"] for s in steps]
            return table.tobytes()

        return all_steps.map(one)

    tables, words = tuple(np.zeros(places, np.uint8) for _ in range(3)), 0
    for row in blocks.select("kind", "block", "total", packed("steps").alias("steps")).collect():
        if row["kind"] == 3:
            words = row["total"]
        else:
            tables[row["kind"]][row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["steps"], np.uint8)
    return Model(tables, float(words))


# ---------------------------------------------------------------- decoding

_SOURCES = np.zeros(0x110000, bool)
_SOURCES[[ord(ch) for ch in _SWAPS]] = True
_HANGUL = re.compile("[가-힣]")
_CONSONANTS = re.compile("[bcdfghjklmnpqrstvwxz]+")
_HANGUL_RULES = [(s, t) for s, ts in _SWAPS.items() for t in ts if "가" <= s <= "힣"]
#: Log of the count of what never occurs, as a half.
_NEVER = float(-np.log(2))


def _cluster(word: str) -> int:
    """Length of the longest run of consonants."""
    return max(map(len, _CONSONANTS.findall(word.lower())), default=0)


class Decoder:
    """Readings of scanned lines under the model; ``rates`` are log-probabilities of confusions, read>meant."""

    def __init__(self, model: Model, rates: dict[str, float] | None = None):
        self.grams, self.words, self.pairs = model.tables
        self.mask, self.rates = len(self.grams) - 1, rates or {}
        self.all = float(np.log(model.total + 1.0))
        self.log = np.arange(256) / STEP + _NEVER
        self.seen: dict[str, list] = {}
        self.three: dict[str, float] = {}

    def _rate(self, read: str, meant: str) -> float:
        return self.rates.get(f"{read}>{meant}", CHANNEL)

    def _counted(self, table: np.ndarray, h: int) -> float:
        return float(self.log[min(table[h & self.mask], table[h >> 32 & self.mask])])

    def count(self, word: str) -> float:
        """Log of how often the corpus has a word."""
        return self._counted(self.words, _hash(word))

    def usual(self, word: str) -> float:
        """The same, whatever case the word stands in at the head of a sentence or in a title."""
        return max(self.count(w) for w in {word, word.lower(), word.capitalize(), word.title()}) if word[:1].isupper() else self.count(word)

    def _gram(self, three: str) -> float:
        """Log of the count of one trigram."""
        score = self.three.get(three)
        if score is None:
            if len(self.three) > 500_000:
                self.three.clear()
            a, b, c = (48 if z.isascii() and z.isdigit() else ord(z) for z in three)
            h = ((a * _I1) ^ (b * _I2) ^ (c * _I3)) & _FULL
            h ^= h >> 33
            h = h * 0xFF51AFD7ED558CCD & _FULL
            h ^= h >> 29
            score = self.three[three] = float(self.log[self.grams[h & self.mask]])
        return score

    def _score(self, text: str) -> float:
        return sum(self._gram(text[i : i + 3]) for i in range(len(text) - 2))

    def _rare(self, text: str) -> int:
        return sum(self._gram(text[i : i + 3]) < 0 for i in range(len(text) - 2))

    # -- words

    def readings(self, word: str) -> dict[str, float]:
        """Other readings and the log-probability of their confusions.

        One confusion more is tried only if no reading with fewer is a word, up to one for each four characters and one besides.
        """
        rules = _HANGUL_RULES if _HANGUL.search(word) else _RULES
        found, layer = {word: 0.0}, [word]
        for _ in range(1 + max(1, len(word) // 4)):
            fresh = []
            for w in layer:
                for read, meant in rules:
                    at = w.find(read)
                    while at >= 0:
                        made = w[:at] + meant + w[at + len(read) :]
                        if made not in found:
                            found[made] = found[w] + self._rate(read, meant)
                            fresh.append(made)
                        at = w.find(read, at + 1)
            layer = fresh
            if any(self.usual(w) > 0 for w in layer):
                break
        del found[word]
        return found

    def candidates(self, word: str) -> list[tuple[str, float, float]]:
        """(reading, log-probability of its confusions, log count) of a word, itself first; others only if they may win."""
        known = self.seen.get(word)
        if known is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            known = self.seen[word] = self._candidates(word)
        return known

    def _candidates(self, word: str) -> list[tuple[str, float, float]]:
        own = self.usual(word)
        if own < 0:
            own -= NOVELTY * max(0, len(word) - 2)
        out = [(word, 0.0, own)]
        if len(word) < 2 or not _LETTERED.search(word) or own - CONTEXT > self.all + CHANNEL:
            return out
        for made, cost in self.readings(word).items():
            n = self.usual(made)
            if n > 0 and n + cost + CONTEXT > own + CHANGE:
                out.append((made, cost, n))
        if own < 0 and len(out) == 1 and not _HANGUL.search(word) and (name := self._name(word)):
            out.append((name, 0.0, self.all))
        return out

    def _name(self, word: str) -> str | None:
        """An invented name: by its trigrams, and only where consonants pile up or a digit stands inside."""
        if len(word) < 4:
            return None
        own = self._score(f" {word} ")
        rare = self._rare(f" {word} ")
        best, top = None, NAME_CHANGE
        for read, meant in _RULES:
            at = word.find(read)
            while at >= 0:
                made = word[:at] + meant + word[at + len(read) :]
                longer = len(meant) - len(read)
                gain = self._score(f" {made} ") - own - longer * 3.0 + CHANNEL
                digit = read.isdigit() and 0 < at and word[at - 1].isalpha()
                if not digit and (rare < 2 or self._rare(f" {made} ") or _cluster(word) < max(3, _cluster(made) + 1)):
                    at = word.find(read, at + 1)
                    continue
                if gain > (0 if digit else top) and gain > (top if best else -1e9):
                    best, top = made, max(gain, 0.0)
                at = word.find(read, at + 1)
        return best

    def _follows(self, before: str | None, before_count: float, word: str, count: float) -> float:
        """Log-probability of a word, up to a constant, after the word before it."""
        if before is None or before_count < 0:
            return count
        both = self._counted(self.pairs, _pair(_hash(before), _hash(word)))
        if both < 0:
            return count + np.log(1 - PAIRED)
        return float(np.logaddexp(count + np.log(1 - PAIRED), min(both - before_count, 0.0) + self.all + np.log(PAIRED)))

    def line(self, words: list[str]) -> dict[int, str]:
        """Places of a line of words where another word was meant: the best path through the candidates of all words.

        A state is a candidate with the best path that ends in it.  Between words with one candidate there is
        one path, so only the stretches around others take time.
        """
        lattice = [self.candidates(w) for w in words]
        if all(len(c) == 1 for c in lattice):
            return {}
        changes: dict[int, str] = {}
        at = 0
        while at < len(words):
            if len(lattice[at]) == 1:
                at += 1
                continue
            stop = at
            while stop < len(words) and len(lattice[stop]) > 1:
                stop += 1
            first = lattice[at - 1][0] if at else (None, 0.0, _NEVER)
            states = [(0.0, first[0], first[2], ())]
            for place in [*range(at, stop), *([stop] if stop < len(words) else [])]:
                nxt = []
                for text, cost, count in lattice[place]:
                    score, _, _, path = max(((s[0] + self._follows(s[1], s[2], text, count), 0, 0, s[3]) for s in states), key=lambda s: s[0])
                    nxt.append((score + cost, text, count, path if text == words[place] else (*path, (place, text))))
                states = nxt
            best = max(states, key=lambda s: (s[0] - (CHANGE if s[3] else 0.0)))
            changes.update(best[3])
            at = stop
        return changes

    # -- characters

    def _single(self, codes: np.ndarray) -> Iterator[tuple[str, str, np.ndarray, np.ndarray, np.ndarray]]:
        """(read, meant, places, gains, rarest log count as read) for each reading of a character alone; two characters at either end are skipped."""
        n = len(codes)
        places = np.flatnonzero(_SOURCES[codes[2 : n - 2]]) + 2 if n > 4 else np.empty(0, int)
        if not len(places):
            return
        a, b, c, d, e = (codes[places + k] for k in (-2, -1, 0, 1, 2))
        log = lambda *t: self.log[self.grams[(_trigram(*t) & np.uint64(self.mask)).astype(np.int64)]]
        read = np.stack([log(a, b, c), log(b, c, d), log(c, d, e)])
        for ch in np.unique(c).tolist():
            own = np.flatnonzero(c == ch)
            for meant in _SWAPS[chr(ch)]:
                m = np.full(len(own), ord(meant), np.uint32)
                gain = log(a[own], b[own], m) + log(b[own], m, d[own]) + log(m, d[own], e[own]) - read[:, own].sum(axis=0)
                yield chr(ch), meant, places[own], gain, read[:, own].min(axis=0)

    def characters(self, flows: list[str]) -> list[list[tuple[int, str]]]:
        """The places of each flow of text where another character was meant.

        First all places of all flows at once: the three trigrams around each, as read and as meant.  Places
        closer than three characters share trigrams, so runs of them are decoded jointly by Viterbi.
        """
        joined = "  " + "    ".join(flows) + "  "
        starts = np.cumsum([2, *(len(flow) + 4 for flow in flows)])
        doubtful = [np.empty(0, np.int64)]
        for read, meant, places, gain, rarest in self._single(_codes(joined)):
            doubtful.append(places[(gain + self._rate(read, meant) + INSIDE * (read in _LIKE_KATAKANA) > CHANGE) | (rarest < 1.0) & (gain > CHANNEL)])
        places = np.unique(np.concatenate(doubtful))
        out: list[list[tuple[int, str]]] = [[] for _ in flows]
        for run in np.split(places, np.flatnonzero(np.diff(places) > 2) + 1) if len(places) else ():
            for at, ch in self._viterbi(joined, run.tolist()).items():
                flow = int(np.searchsorted(starts, at, "right")) - 1
                out[flow].append((at - int(starts[flow]), ch))
        return out

    def _viterbi(self, flow: str, run: list[int]) -> dict[int, str]:
        """The best joint reading of neighbouring places; states are the last two characters."""
        start, stop = run[0], min(run[-1] + 3, len(flow))
        states = {flow[start - 2 : start]: (0.0, ())}
        options = {place: [flow[place], *_SWAPS[flow[place]]] for place in run}
        plain = sum(self._gram(flow[at - 2 : at + 1]) for at in range(start, stop))
        for at in range(start, stop):
            nxt: dict[str, tuple[float, tuple]] = {}
            own = flow[at]
            for last, (score, made) in states.items():
                for ch in options.get(at, own):
                    gain, taken = score + self._gram(last + ch), made
                    if ch != own:
                        gain += self._rate(own, ch) + (INSIDE if _KATAKANA(ch) and own in _LIKE_KATAKANA and _KATAKANA(flow[at - 1]) and _KATAKANA(flow[at + 1]) else 0)
                        taken = (*made, (at, ch))
                    state = last[1] + ch
                    if state not in nxt or nxt[state][0] < gain:
                        nxt[state] = (gain, taken)
            states = nxt
        best, made = max(states.values())
        return dict(made) if made and best - plain > CHANGE else {}


# ---------------------------------------------------------------- channel

_RATE = "rule string, happened double, possible double"


def _word_rates(batches: Iterator[pd.DataFrame], shared) -> Iterator[pd.DataFrame]:
    """Evidence from distinct words with their numbers: which are far rarer than a word one confusion away."""
    decoder = Decoder(shared.value)
    happened: dict[str, float] = {}
    possible: dict[str, float] = {}
    for batch in batches:
        for word, n in zip(batch["word"], batch["n"].tolist()):
            rules = _HANGUL_RULES if _HANGUL.search(word) else _RULES
            for read, meant in rules:
                if meant in word:
                    possible[f"{read}>{meant}"] = possible.get(f"{read}>{meant}", 0.0) + n
            own, best = decoder.usual(word), None
            if own + CERTAIN > decoder.all:
                continue
            for read, meant in rules:
                at = word.find(read)
                while at >= 0:
                    gain = decoder.usual(word[:at] + meant + word[at + len(read) :]) - own
                    if gain > CERTAIN and (best is None or gain > best[0]):
                        best = gain, f"{read}>{meant}"
                    at = word.find(read, at + 1)
            if best:
                happened[best[1]] = happened.get(best[1], 0.0) + n
    rules = sorted({*happened, *possible})
    yield pd.DataFrame({"rule": rules, "happened": [happened.get(r, 0.0) for r in rules], "possible": [possible.get(r, 0.0) for r in rules]})


def _character_rates(batches: Iterator[pd.DataFrame], shared) -> Iterator[pd.DataFrame]:
    """Evidence from the characters of scripts without blanks: which are far rarer in their place than another."""
    decoder = Decoder(shared.value)
    happened: dict[str, float] = {}
    meant_at: dict[str, float] = {}
    for batch in batches:
        codes = _codes("\0\0".join(["", *batch["content"], ""]))
        own, numbers = np.unique(codes, return_counts=True)
        for code, n in zip(own.tolist(), numbers.tolist()):
            meant_at[chr(code)] = meant_at.get(chr(code), 0.0) + n
        for read, meant, _, gain, _ in decoder._single(codes):
            happened[f"{read}>{meant}"] = happened.get(f"{read}>{meant}", 0.0) + int((gain > 2 * CERTAIN).sum())
    rules = [f"{read}>{meant}" for read, all_meant in _SWAPS.items() for meant in all_meant if not _HANGUL.match(read)]
    yield pd.DataFrame({"rule": rules, "happened": [happened.get(r, 0.0) for r in rules], "possible": [meant_at.get(r[2], 0.0) for r in rules]})


def channel(scanned: DataFrame, shared) -> dict[str, float]:
    """The log-probability of each confusion, estimated from all scanned texts; few and sure cases leave it near ``CHANNEL``.

    Words are counted by Spark, so each different one is looked at once.
    """
    texts = scanned.select("content")
    words = texts.select(F.explode(F.regexp_extract_all("content", F.lit(_WORD.pattern), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    by_words = words.mapInPandas(lambda batches: _word_rates(batches, shared), _RATE)
    by_characters = texts.mapInPandas(lambda batches: _character_rates(batches, shared), _RATE)
    sums = by_words.unionByName(by_characters).groupBy("rule").agg(F.sum("happened").alias("happened"), F.sum("possible").alias("possible")).collect()
    start = float(np.exp(CHANNEL))
    return {r["rule"]: min(-0.5, float(np.log((r["happened"] + PRIOR * start) / (r["happened"] + r["possible"] + PRIOR)))) for r in sums}


def _flow(lines: list[str], skip: set[int], vocabulary) -> tuple[str, list[int], set[int]]:
    """The text without furniture as one flow, the line (from 0) of each of its characters, the hyphened lines."""
    text: list[str] = []
    owner: list[int] = []
    hyphens: set[int] = set()
    kept = [i for i, line in enumerate(lines) if i not in skip]
    full = [i for i in kept if lines[i].strip(" \t\x0c　\r")]
    following = {i: j for i, j in zip(full, full[1:])}
    for i in kept:
        line = lines[i].strip(" \t\x0c　\r")
        if not line:
            if text and text[-1] != "\n":
                text.append("\n")
                owner.append(i)
            continue
        after = lines[following[i]].strip(" \t\x0c　\r") if i in following else ""
        m = _HYPHENED.search(line)
        if m and (not after or after[0].isalpha() and ord(after[0]) < 0x2E80 and not vocabulary(_compound(line, after))):
            hyphens.add(i)
            line = line[: m.start(1)]
            joint = ""
        elif m and after and m.group(1) == "-":
            joint = ""
        elif after and (_JOINS.match(line[-1]) and not "가" <= line[-1] <= "힣" or _JOINS.match(after[0]) and _JOINS.match(line[-1])):
            joint = ""
        else:
            joint = " "
        text += line
        owner += [i] * len(line)
        if joint:
            text.append(joint)
            owner.append(i)
    return "".join(text), owner, hyphens


def _compound(line: str, after: str) -> str:
    head = re.search(r"[\w'’]+[-‐‑‒–—¬­⁃~]\s*$", line)
    tail = re.match(r"[\w'’]+", after)
    return (re.sub(r"[-‐‑‒–—¬­⁃~]\s*$", "-", head.group()) if head else "") + (tail.group() if tail else "")


def _words(decoder: Decoder, flow: str) -> list[tuple[int, int, str]]:
    """(start, end, meant) of all words in a flow that are read otherwise; a line of words ends where a sentence or paragraph does."""
    out: list[tuple[int, int, str]] = []
    line: list[re.Match] = []
    for m in [*_WORD.finditer(flow), None]:
        if line and (m is None or _BROKEN_OFF.search(flow, line[-1].end(), m.start())):
            out += [(line[i].start(), line[i].end(), meant) for i, meant in decoder.line([w.group() for w in line]).items()]
            line = []
        if m is not None:
            line.append(m)
    return out


class Page:
    """One text: its flow without the furniture, and the lines of the furniture, which are read for themselves."""

    def __init__(self, content: str, header: set[int], numbered: set[int], decoder: Decoder):
        self.lines, self.header, self.numbered = content.split("\n"), header, numbered
        self.skip = sorted(header | numbered)
        known = lambda w: max(decoder.count(w), decoder.count(w.lower())) > 0
        self.flow, self.owner, self.hyphens = _flow(self.lines, {i - 1 for i in self.skip}, known)
        self.flows = [self.flow, *(self.lines[i - 1].strip(" \t\x0c　\r") for i in self.skip)]

    def read(self, changes: list[list[tuple[int, int, str]]]) -> tuple[list[tuple[int, str]], str]:
        """The traces (line from 1, kind), and the text repaired, from the changes of each of ``flows``."""
        traces = {(i + 1, "hyphen") for i in self.hyphens} | {(i, "header") for i in self.header} | {(i, "pagenum") for i in self.numbered}
        parts, at = [], 0
        for start, end, text in sorted(changes[0]):
            traces |= {(self.owner[k] + 1, "misread") for k in _differing(self.flow[start:end], text, start)}
            if start >= at:
                parts += [self.flow[at:start], text]
                at = end
        for i, line, changed in zip(self.skip, self.flows[1:], changes[1:]):
            if changed or i in self.numbered and _MISREAD_NUMBER.search(line):
                traces.add((i, "misread"))
        return sorted(traces), re.sub(r" *\n *", "\n\n", "".join([*parts, self.flow[at:]])).strip()


_MISREAD_NUMBER = re.compile(r"\d[OolI|SB]|[OolI|SB]\d|(?:^|\s{2,})[lIO](?:$|\s{2,})")


def examine_all(pages: list[Page], decoder: Decoder) -> Iterator[tuple[list[tuple[int, str]], str]]:
    """The traces and the repaired text of each page; the characters of all of them are weighed at once."""
    flows = [flow for page in pages for flow in page.flows]
    changed = iter([_words(decoder, flow) + [(at, at + 1, ch) for at, ch in own] for flow, own in zip(flows, decoder.characters(flows))])
    for page in pages:
        yield page.read([next(changed) for _ in page.flows])


def examine(content: str, header: set[int], numbered: set[int], decoder: Decoder) -> tuple[list[tuple[int, str]], str]:
    """The traces (line from 1, kind) of one text, and the text repaired."""
    return next(examine_all([Page(content, header, numbered, decoder)], decoder))


def _differing(word: str, meant: str, start: int) -> list[int]:
    head = 0
    while head < min(len(word), len(meant)) and word[head] == meant[head]:
        head += 1
    tail = 0
    while tail < min(len(word), len(meant)) - head and word[-1 - tail] == meant[-1 - tail]:
        tail += 1
    last = max(head, len(word) - tail - 1)
    return [start + head, start + min(last, len(word) - 1)]


def _examined(scanned: DataFrame, model: Model, repair: bool) -> DataFrame:
    scanned = scanned.where(F.col("content").isNotNull())
    shared = scanned.sparkSession.sparkContext.broadcast(model)
    rates = channel(scanned, shared)
    marks = furniture(scanned).groupBy("tbl", "rec_key").agg(
        F.collect_list(F.when(F.col("header"), F.col("line_no"))).alias("headers"), F.collect_list(F.when(F.col("pagenum"), F.col("line_no"))).alias("numbers")
    )
    rows = scanned.select("tbl", "rec_key", "content").dropDuplicates(["tbl", "rec_key"]).join(marks, ["tbl", "rec_key"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(shared.value, rates)
        for batch in batches:
            keys, pages, size = [], [], 0
            rows_ = zip(batch["tbl"], batch["rec_key"], batch["content"], batch["headers"], batch["numbers"])
            for row in [*rows_, None]:
                if row is not None:
                    tbl, key, content, headers, numbers = row
                    keys.append((tbl, key))
                    pages.append(Page(content, {*(headers if headers is not None else ())}, {*(numbers if numbers is not None else ())}, decoder))
                    size += len(content)
                if pages and (row is None or size > ROOM):
                    out: list[tuple] = []
                    for (tbl, key), (traces, text) in zip(keys, examine_all(pages, decoder)):
                        out += [(tbl, key, text)] if repair else [(tbl, key, line, kind) for line, kind in traces]
                    yield pd.DataFrame(out, columns=["tbl", "rec_key", "content"] if repair else ["tbl", "rec_key", "line_no", "kind"])
                    keys, pages, size = [], [], 0

    return rows.mapInPandas(run, "tbl string, rec_key string, " + ("content string" if repair else "line_no int, kind string"))


def traces(scanned: DataFrame, model: Model) -> DataFrame:
    """(tbl, rec_key, line_no, kind) of each line with a trace of the page or of recognition."""
    return _examined(scanned, model, False)


def repaired(scanned: DataFrame, model: Model) -> DataFrame:
    """(tbl, rec_key, content) with each text as continuous paragraphs, one blank line between them."""
    return _examined(scanned, model, True)
