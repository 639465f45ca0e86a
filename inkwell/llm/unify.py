"""Problem 2: one consistent form for texts that look alike but differ in their characters.

Characters with only one reading are replaced one by one (``plain_form``).  Look-alike letters of other
scripts are repaired word by word: only in a word that mixes scripts, towards the spelling of the word's
dominant script that the corpus itself contains, else of another script that it contains (``unify``).  The
vocabulary is that of the plain forms of all texts.  If it has no spelling of a mixed word (names that occur
once), the word takes its dominant script and the row is marked ``guessed``, because a word left mixed would
still differ from the text that looks equal; a word with no whole spelling in one script stays as it is.

Defined results: null stays null and counts as unchanged; an empty text stays empty; repeated rows get the
same result; no row is dropped.  Columns named ``_u_*`` are used inside and do not reach the result.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of Cyrillic and Greek that look like Latin ones.
CYRILLIC = "АВЕЅІЈКМНОРСТУХаеѕіјорсухԁһԛԝ"
CYRILLIC_LATIN = "ABESIJKMHOPCTYXaesijopcyxdhqw"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαιικνορυ"
GREEK_LATIN = "ABEZHIKMNOPTYXaiikvopu"

# Characters that are not seen.
UNSEEN = (
    "\u00ad\u034f\u061c\u115f-\u1160\u17b4-\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0"
    "\U000e0000-\U000e007f\U000e0100-\U000e01ef\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f"
)
# Blanks and line breaks other than the ordinary ones.
BLANKS = "\t\u00a0\u1680\u2000-\u200a\u202f\u205f"
BREAKS = "\x0b\x85\u2028\u2029\r"
# Ranges of full-width, styled or joined letters and digits, half-width katakana,
# ideographs beside the unified ones, and marks or parts that may join with their letter or syllable.
LETTERS = "\uff10-\uff19\uff21-\uff3a\uff41-\uff5a\U0001d400-\U0001d7ff\ufb00-\ufb06\u2102-\u2131\u2133-\u2134\u2139\u2145-\u2149"
KANA = "\uff66-\uff9f"
IDEOGRAPHS = "\u2e9f\u2ef3\u2f00-\u2fd5\uf900-\ufaff\U0002f800-\U0002fa1d"
MARKS = "\u0300-\u034e\u0350-\u036f\u1100-\u115e\u1161-\u11ff\u3099-\u309a\ua960-\ua97f\ud7b0-\ud7ff"

_EMOJI = "[\u00a9\u00ae\u203c\u2049\u2122\u2139\u2194-\u21aa\u231a-\u23ff\u25aa-\u27bf\u2934\u2935\u2b05-\u2b55\u3030\u303d\u3297\u3299\U0001f000-\U0001faff]"
_SKIN = "[\U0001f3fb-\U0001f3ff]"
_UNIT = f"(?:{_EMOJI}\ufe0f?{_SKIN}?|[0-9#*]\ufe0f?\u20e3)(?:[\U000e0020-\U000e007f]+)?"
_SEEN_OR_NOT = re.compile(f"({_UNIT}(?:\u200d{_UNIT})*)|[{UNSEEN}]")
_STYLED = re.compile(f"[{LETTERS}]")
_HALF_KANA = re.compile(f"[{KANA}]+")
_RADICAL = re.compile(f"[{IDEOGRAPHS}]")
_BLANK = re.compile(f"[{BLANKS}]")
_BREAK = re.compile(f"\r\n|[{BREAKS}]")
_LETTER_RUN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0250-\u02af\u1e00-\u1eff"
_OTHER_RUN = "\u0370-\u03ff\u0400-\u052f\u1f00-\u1fff"
WORD = re.compile(f"[{_LETTER_RUN}{_OTHER_RUN}]+")
_LATIN = re.compile(f"[{_LETTER_RUN}]")
_OTHER = re.compile(f"[{_OTHER_RUN}]")
_GREEK = re.compile("[\u0370-\u03ff\u1f00-\u1fff]")
_CYRILLIC = re.compile("[\u0400-\u052f]")

_MAYBE = re.compile(f"[{UNSEEN}{BLANKS}{BREAKS}{LETTERS}{KANA}{IDEOGRAPHS}{MARKS}]")


def _java(ranges: str) -> str:
    """The inside of a character class for the JVM's patterns."""
    return "".join(ch if ch == "-" else f"\\x{{{ord(ch):x}}}" for ch in ranges)


#: True wherever plain_form or the repair of mixed words may change something; evaluated in the JVM.
SUSPECT = f"[{_java(UNSEEN + BLANKS + BREAKS + LETTERS + KANA + IDEOGRAPHS + MARKS)}]|[{_java(_LETTER_RUN)}][{_java(_OTHER_RUN)}]|[{_java(_OTHER_RUN)}][{_java(_LETTER_RUN)}]"
#: Some character beside those that are ordinary wherever they stand; a few ranges, so that most texts are passed over quickly.
_ODD = (
    "[^\\n\\f\\x20-\\x7e\\xa1-\\xac\\xae-\\x{24f}\\x{4e00}-\\x{9fff}\\x{3000}-\\x{3096}\\x{309b}-\\x{30ff}\\x{ac00}-\\x{d7a3}\\x{ff01}-\\x{ff0f}\\x{ff1a}-\\x{ff20}\\x{ff3b}-\\x{ff40}\\x{ff5b}-\\x{ff60}"
    "\\x{2010}-\\x{2027}\\x{2030}-\\x{205e}\\x{e00}-\\x{e7f}\\x{1ea0}-\\x{1eff}\\x{3400}-\\x{4dbf}]"
)


def suspect(text: Column) -> Column:
    """Whether plain_form or the repair of mixed words may change a text; null for null."""
    return text.rlike(_ODD) & text.rlike(SUSPECT)


def plain_form(text: str) -> str:
    """The text with every character in its ordinary form; letters of other scripts are left alone."""
    if not _MAYBE.search(text) and unicodedata.is_normalized("NFC", text):
        return text
    text = _STYLED.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
    text = _HALF_KANA.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
    text = _RADICAL.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
    text = _BREAK.sub("\n", _BLANK.sub(" ", text))
    text = _SEEN_OR_NOT.sub(lambda m: m.group(1) or "", text)
    return unicodedata.normalize("NFC", text)


def mixed_words(text: str) -> list[str]:
    """The distinct words that mix Latin letters with Cyrillic or Greek ones."""
    if not _OTHER.search(text):
        return []
    return sorted({w for w in WORD.findall(text) if _LATIN.search(w) and _OTHER.search(w)})


_TO_LATIN = str.maketrans(CYRILLIC + GREEK, CYRILLIC_LATIN + GREEK_LATIN)
_TO_CYRILLIC = str.maketrans(CYRILLIC_LATIN, CYRILLIC)
_TO_GREEK = str.maketrans(GREEK_LATIN, GREEK)


def spellings(word: str) -> list[str]:
    """Spellings of a mixed word in one script, the dominant script first; [] if none is complete."""
    latin, greek = len(_LATIN.findall(word)), len(_GREEK.findall(word))
    cyrillic = len(_CYRILLIC.findall(word))
    forms = []
    for _, rank, table in sorted(((-latin, 0, _TO_LATIN), (-cyrillic, 1, _TO_CYRILLIC), (-greek, 2, _TO_GREEK))):
        made = word.translate(table) if rank == 0 else word.translate(_TO_LATIN).translate(table)
        scripts = bool(_LATIN.search(made)) + bool(_GREEK.search(made)) + bool(_CYRILLIC.search(made))
        if scripts == 1:
            forms.append(made)
    return forms


@F.pandas_udf(T.StringType())
def _plain_udf(texts: pd.Series) -> pd.Series:
    return texts.map(plain_form, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _mixed_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: mixed_words(t) if t else [])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _spellings_udf(words: pd.Series) -> pd.Series:
    return words.map(spellings)


@F.pandas_udf(T.StringType())
def _respell_udf(texts: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
    def one(text, olds, news):
        table = dict(zip(olds, news))
        return WORD.sub(lambda m: table.get(m.group(), m.group()), text)

    return pd.Series([one(*row) for row in zip(texts, old, new)], dtype=object)


def vocabulary(df: DataFrame, text: str) -> DataFrame:
    """Distinct words of one script in all texts (column ``_u_form``); aggregated before the shuffle."""
    words = F.regexp_extract_all(F.col(text), F.lit(f"[{_java(_LETTER_RUN + _OTHER_RUN)}]+"), F.lit(0))
    word = df.where(F.col(text).isNotNull()).select(F.explode(words).alias("_u_form"))
    mixed = F.col("_u_form").rlike(f"[{_java(_LETTER_RUN)}]") & F.col("_u_form").rlike(f"[{_java(_OTHER_RUN)}]")
    return word.where(~mixed).distinct()


def repairs(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """(_u_word, _u_fix, _u_known) for distinct mixed words: the first spelling in the vocabulary, else, unknown, the first."""
    forms = words.select("_u_word", F.posexplode(_spellings_udf("_u_word")).alias("_u_rank", "_u_form"))
    known = forms.join(vocab.withColumn("_u_found", F.lit(True)), "_u_form", "left").withColumn("_u_known", F.col("_u_found").isNotNull())
    order = F.struct((~F.col("_u_known")).alias("a"), F.col("_u_rank").alias("b"))
    best = known.groupBy("_u_word").agg(F.min_by(F.struct("_u_form", "_u_known"), order).alias("_u_best"))
    return best.select("_u_word", F.col("_u_best._u_form").alias("_u_fix"), F.col("_u_best._u_known").alias("_u_known"))


def unify(df: DataFrame, keys: list[str], text: str, vocab: DataFrame | None = None) -> DataFrame:
    """Rows (keys, text, unified, changed, guessed) for every input row.

    ``keys`` must identify the row; a null in a key is a value like others.  ``changed`` is true if the text was not
    in the consistent form: its repair differs from it, or a mixed word has no complete spelling in one script and
    so had to stay.  ``guessed`` is true if some mixed word has no spelling in the vocabulary, which is that of the
    plain forms of ``df`` itself unless given.
    Only texts that hold a suspect character are sent to Python, and only those with a mixed word meet the
    vocabulary.  The suspect texts, a small part of all, are kept in memory or on disk, as several branches read
    them; the session's ``clearCache`` releases them.
    """
    rows = df.select(*keys, F.col(text).alias("_u_text"))
    sound = rows.where(~F.coalesce(suspect(F.col("_u_text")), F.lit(False)))
    odd = rows.where(suspect(F.col("_u_text"))).withColumn("_u_plain", _plain_udf("_u_text")).withColumn("_u_mixed", _mixed_udf("_u_plain"))
    odd = odd.persist(StorageLevel.MEMORY_AND_DISK)
    if vocab is None:
        vocab = vocabulary(sound.select("_u_text").unionByName(odd.select(F.col("_u_plain").alias("_u_text"))), "_u_text")
    columns = [*keys, text, "unified", "changed", "guessed"]
    clean = sound.select(*keys, "_u_text", F.col("_u_text").alias("unified"), F.lit(False), F.lit(False))
    plain = odd.where(F.size("_u_mixed") == 0).select(*keys, "_u_text", "_u_plain", ~F.col("_u_plain").eqNullSafe(F.col("_u_text")), F.lit(False))
    mixed = odd.where(F.size("_u_mixed") > 0)
    word = mixed.select(*keys, F.explode("_u_mixed").alias("_u_word"))
    fixes = repairs(word.select("_u_word").distinct(), vocab)
    fix = F.struct("_u_word", F.coalesce("_u_fix", "_u_word").alias("_u_fix"))
    per_text = word.join(fixes, "_u_word", "left").groupBy(*keys).agg(
        F.collect_list(fix).alias("_u_fixes"), F.max(F.col("_u_fix").isNull()).alias("_u_stays"), F.max(~F.coalesce("_u_known", F.lit(False))).alias("_u_guessed")
    )
    named = per_text.select(*(F.col(k).alias(f"_u_{k}") for k in keys), "_u_fixes", "_u_stays", "_u_guessed")
    same = reduce(Column.__and__, (mixed[k].eqNullSafe(named[f"_u_{k}"]) for k in keys))
    respelt = mixed.join(named, same).withColumn("_u_unified", _respell_udf("_u_plain", F.col("_u_fixes._u_word"), F.col("_u_fixes._u_fix")))
    respelt = respelt.select(*(mixed[k] for k in keys), "_u_text", "_u_unified", ~F.col("_u_unified").eqNullSafe(F.col("_u_text")) | F.col("_u_stays"), "_u_guessed")
    return clean.toDF(*columns).unionByName(plain.toDF(*columns)).unionByName(respelt.toDF(*columns))
