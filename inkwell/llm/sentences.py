"""Problem 4: sentence units of texts in many languages and scripts.

``sentence_units`` runs a pushdown automaton over each text.  The stack holds the quotations and
brackets that are open; terminators count only while it is empty.  Blank lines, headings, list items
and dialogue lines are levels of their own above the running text.  Abbreviations are looked up in a
trie.  Scripts without spaces end sentences with their own terminators, Thai with a polite particle.

Defined results: a null or blank text has no units; ties and repeated rows are kept as they come (the
query drops repeated keys); a text without any terminator is one unit per paragraph; columns of the
input are never renamed, so extra columns with clashing names do no harm because only the named key and
text columns are read.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Pairs of marks that enclose.
PAIRS = {"「": "」", "『": "』", "（": "）", "(": ")", "［": "］", "[": "]", "【": "】", "《": "》", "〈": "〉", "〔": "〕", "“": "”", "‘": "’", "„": "“", "«": "»", "｢": "｣"}
CLOSERS = {close: open_ for open_, close in PAIRS.items()} | {"”": "“", "“": "„"}
QUOTES = set("「『“‘„«\"｢")

# Abbreviations after which a sentence never ends ...
INNER_ABBREVIATIONS = """
dr mr ms mrs prof no nos vol fig figs p pp esp incl e.g i.e vs cf ex sec ch approx st eq
s nr abb bzgl bzw z.b d.h hr fr ca sog ggf inkl vgl bspw
m mm mme mlle p.ex env chap
sr sra srta pág pag págs núm p.ej dra ud uds
profa cap
с стр рис напр г ул см гл
ts ths tr gs
""".split()
# ... and those after which it ends if the next word starts like a sentence.
OUTER_ABBREVIATIONS = "etc a.m p.m u.s u.k jr usw т.д т.п т.е v.v inc ltd co e.u ee.uu".split()
# Months that follow an ordinal number with a period.
MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split()
THAI_ENDINGS = ("ครับ", "ค่ะ", "คะ")


def _trie(words: list[str], mark: str, root: dict | None = None) -> dict:
    root = {} if root is None else root
    for word in words:
        node = root
        for ch in reversed(word):
            node = node.setdefault(ch, {})
        node[""] = mark
    return root


#: Read backwards from the period, so that the longest match is found without cutting out the word.
_ABBREVIATIONS = _trie(OUTER_ABBREVIATIONS, "outer", _trie(INNER_ABBREVIATIONS, "inner"))

_STOP = re.compile(
    "[" + re.escape("".join({*PAIRS, *CLOSERS})) + "\"]|[。！？｡!?]+[…。！？!?]*|…+|\\.{2,}|[.．]|(?:" + "|".join(THAI_ENDINGS) + ")(?=[ \n　]|$)"
)
_ENCLOSING = re.compile("[" + re.escape("".join({*PAIRS, *CLOSERS})) + "\"]")
_BLANK_LINE = re.compile(r"\n[ \t　\r]*(?:\n[ \t　\r]*)+")
_HEADING = re.compile(r"[ \t]{0,3}#{1,6}[ \t]")
_ITEM = re.compile(r"[ \t]*(?:[-*•・‣◦–][ 　]?|[(（]?[0-9０-９]{1,3}[.．)）][ 　])(?=\S)")
_BULLET = re.compile(r"[ \t]*[-*•][ ]|[ \t]*・")
_SPEAKER = re.compile(r"[^。！？.!?「『“\"«„：:\n]{1,30}\s?[：:]\s?(?:「[^「」]*」|『[^『』]*』|“[^“”]*”|\"[^\"]*\"|«[^«»]*»|„[^„“”]*[“”])[ \t]*$")
_TABLE_ROW = re.compile(r"\|.*\|[ \t]*$|[^|\n]+( \| [^|\n]+){2,}$")
_ENDED = re.compile(r"[。！？｡!?.…：:」』”\"»）)][ \t　]*$")
_UNSEEN = set("\u200b\u200c\u200d\u2060\ufeff\u00ad")


def _abbreviation(text: str, dot: int, start: int) -> str:
    """'inner', 'outer' or '' for the word that ends before the period at ``dot``."""
    node, found, i = _ABBREVIATIONS, "", dot - 1
    while i >= start:
        ch = text[i].lower()
        if ch in _UNSEEN:
            i -= 1
            continue
        if ch == " " and i and text[i - 1] == ".":  # z. B., т. д.
            i -= 1
            continue
        node = node.get(ch)
        if node is None:
            break
        if "" in node and (i == start or not text[i - 1].isalnum()):
            found = node[""]
        i -= 1
    return found


def _next(text: str, i: int, end: int) -> str:
    while i < end and text[i] in " \n\t　\r":
        i += 1
    return text[i] if i < end else ""


def _matched(tokens: list[re.Match]) -> tuple[set[int], set[int], int]:
    """Places where an enclosure opens and closes; the last closer that has no opener, or -1."""
    stack: list[tuple[str, int]] = []
    opens, closes, orphan = set(), set(), -1
    for m in tokens:
        ch, at = m.group(), m.start()
        if ch == '"':
            hit = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == '"'), None)
            if hit is None:
                stack.append((ch, at))
                continue
        elif ch in CLOSERS or ch == "“":
            wanted = [CLOSERS[ch]] if ch != "”" else ["“", "„"]
            hit = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in wanted), None)
            if hit is None:
                if ch == "“":
                    stack.append((ch, at))
                elif ch not in "’)）":
                    orphan = at
                continue
        elif ch in PAIRS:
            stack.append((ch, at))
            continue
        else:
            continue
        opens.add(stack[hit][1])
        closes.add(at)
        del stack[hit:]
    return opens, closes, orphan


def _running(text: str, start: int, end: int, ends: list[int]) -> None:
    """Adds the ends of the units of the running text between start and end."""
    tokens = list(_STOP.finditer(text, start, end))
    opens, closes, orphan = _matched(tokens) if _ENCLOSING.search(text, start, end) else (set(), set(), -1)
    depth = 1 if orphan >= 0 else 0
    unit, opened, stopped_inside = start, start, False
    for m in tokens:
        ch, at, after = m.group(), m.start(), m.end()
        if at in opens:
            if not depth:
                opened, stopped_inside = at, False
            depth += 1
            continue
        if at in closes or at == orphan:
            depth -= 1
            if depth or at == orphan or not stopped_inside or text[opened] not in QUOTES:
                continue
            k = opened - 1
            while k > unit and text[k] in "  \n\t":
                k -= 1
            lead = text[k] if k >= unit and opened > unit else ""
            follower = _next(text, after, end)
            if lead in (":", "：") and follower not in tuple(",，、;；と"):
                pass
            elif lead in (",", "，") and not (follower.islower() or follower in tuple(",，、;；と")):
                pass
            else:
                continue
        elif ch in PAIRS or ch in CLOSERS or ch == '"':
            continue
        elif depth:
            stopped_inside = not _more_inside(text, after, end)
            continue
        elif ch[0] in "。！？｡!?":
            if ch[0] in "!?" and after < end and (text[after].isalnum() and ord(text[after]) < 0x2E80):
                continue
        elif ch[0] == "…" or len(ch) > 1 and ch[0] == ".":
            follower = _next(text, after, end)
            if after < end and not (text[after].isspace() and (follower.isupper() or follower in QUOTES)):
                continue
        elif ch in ".．":
            if not _period_ends(text, at, start, end):
                continue
        unit = _close(text, unit, after, ends)
    _close(text, unit, end, ends)


def _more_inside(text: str, after: int, end: int) -> bool:
    """Whether words follow before the enclosure closes."""
    while after < end:
        ch = text[after]
        if ch in CLOSERS or ch == '"':
            return False
        if ch.isalnum():
            return True
        after += 1
    return False


def _period_ends(text: str, at: int, start: int, end: int) -> bool:
    after = text[at + 1] if at + 1 < end else ""
    before = text[at - 1] if at > start else ""
    if after and (after.isalnum() and ord(after) < 0x2E80 or after.isdigit() and before.isdigit() or after in ",;:)"):
        return False
    if not before or before.isspace():
        return False
    kind = _abbreviation(text, at, start)
    follower = _next(text, at + 1, end)
    if kind == "inner":
        return not follower
    if kind == "outer":
        return not follower or not follower.islower() and follower not in "(,;"
    lone = at - 1 == start or not (text[at - 2].isalnum() or text[at - 2] in "'’")
    if lone and before.isalpha() and ord(before) < 0x2E80 and follower:  # initials, options
        return False
    if before.isdigit():
        k = at - 1
        while k > start and text[k - 1].isdigit():
            k -= 1
        if at - k <= 2 and (k == start or text[k - 1] not in ".,:") and any(text.startswith(month, text.find(follower, at)) for month in MONTHS):
            return False
    return True


def _close(text: str, start: int, end: int, ends: list[int]) -> int:
    e = end
    while e > start and text[e - 1].isspace():
        e -= 1
    if e > start and not text[start:e].isspace():
        ends.append(e)
    return end


def unit_ends(text: str | None) -> list[int]:
    """Ends of the sentence units of one text, as numbers of characters from its start."""
    ends: list[int] = []
    if not text:
        return ends
    block = 0
    for gap in [*((m.start(), m.end()) for m in _BLANK_LINE.finditer(text)), (len(text), len(text))]:
        running, own, before = -1, True, ""
        at = block
        while at < gap[0]:
            stop = text.find("\n", at, gap[0])
            stop = gap[0] if stop < 0 else stop
            line = text[at:stop]
            free = own or _ENDED.search(before) is not None
            spoken = free and (":" in line or "：" in line) and _SPEAKER.match(line)
            single = _HEADING.match(line) or free and _ITEM.match(line) or spoken or own and _BULLET.match(line) or "|" in line and _TABLE_ROW.match(line)
            if single:
                if running >= 0:
                    _running(text, running, at, ends)
                    running = -1
                _close(text, at, stop, ends)
                own = True
            elif line.strip():
                if running < 0:
                    running = at
                own = False
            before, at = line, stop + 1
        if running >= 0:
            _running(text, running, gap[0], ends)
        block = gap[1]
    return ends


def unit_spans(text: str | None) -> list[tuple[int, int]]:
    """Starts and ends of the sentence units of one text."""
    spans, at = [], 0
    for end in unit_ends(text):
        while text[at].isspace():
            at += 1
        spans.append((at, end))
        at = end
    return spans


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _ends_udf(texts: pd.Series) -> pd.Series:
    return texts.map(unit_ends)


def sentence_ends(text: Column) -> Column:
    """The ends of the units of a text column, as an array; empty for null."""
    return _ends_udf(text)


def sentence_units(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per unit: the keys, unit_no from 0, start_pos (characters before it) and end_pos.

    ``start_pos`` is the end of the unit before it, blanks skipped, so start_pos < end_pos always holds.
    """
    ends = df.select(*keys, F.col(text).alias("_text"), sentence_ends(F.col(text)).alias("_ends"))
    unit = ends.select(*keys, "_text", "_ends", F.posexplode("_ends").alias("unit_no", "end_pos"))
    prior = F.when(F.col("unit_no") > 0, F.element_at("_ends", F.col("unit_no"))).otherwise(F.lit(0))
    raw = F.expr("substring(_text, _prior + 1, end_pos - _prior)")
    blanks = F.length("_raw") - F.length(F.regexp_replace("_raw", "^[\\s\\u3000]+", ""))
    return (
        unit.withColumn("_prior", prior).withColumn("_raw", raw)
        .select(*keys, "unit_no", (F.col("_prior") + blanks).cast("int").alias("start_pos"), "end_pos", F.regexp_replace("_raw", "^[\\s\\u3000]+", "").alias("unit"))
    )
