"""Problem 8: the language of each document and of each of its segments.

A multinomial naive Bayes model over hashed character 1- to 3-grams classifies each sentence unit, without
what stands in quotation marks.  It is fitted twice on about ``FIT_ROWS`` labelled documents per language:
first as labelled, then on those sentences alone whose label the first model confirms, so that wrong labels
and foreign passages leave the counts.  The log-probability matrix (``BUCKETS`` x 11 numbers) is of fixed size
and broadcast; batches are scored in numpy.

Defined results: null and blank texts have no segments and no language, nor have rows without an id; a text without letters outside
quotations takes no language either; documents that repeat a text each get their rows; an empty table gives
empty results; a language without labelled documents keeps a flat model, which loses to any fitted one where
that one knows the text and wins where none does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.sentences import unit_spans

LANGS = ("zh", "ja", "en", "ko", "de", "fr", "es", "pt", "vi", "th", "ru")
# ISO 639 codes by the language that they name.
CODES = {
    "zh": "zh zho chi cmn yue wuu hak nan lzh", "ja": "ja jpn", "en": "en eng", "ko": "ko kor", "de": "de deu ger", "fr": "fr fra fre",
    "es": "es spa", "pt": "pt por", "vi": "vi vie", "th": "th tha", "ru": "ru rus",
}
FIT_ROWS = 2000
BUCKETS = 1 << 15
#: Log-odds against the next language from which a sentence counts, and letters that it must have.
SURE = 6.0
LETTERS = 4
#: Below these log-odds the words in quotation marks are read too, as little but names may stand outside.
UNSURE = 20.0
ROOM = 40_000
_QUOTED = re.compile(r"「[^「」]*」|『[^『』]*』|“[^“”]*”|„[^„“”]*[“”]|«[^«»]*»|《[^《》]*》|\"[^\"\n]*\"|(?<!\w)['‘][^'‘’\n]*['’](?!\w[\w'’])")
_MARK = re.compile("[「『“„«《\"'‘]")
_NOT_TEXT = re.compile(r"[\W\d_]+")
_FINAL = re.compile(r"[。！？｡.!?…．](?:[」』”\"»“）)\]’']|\s)*$")
_THAI = re.compile("[ก-๎]")
_THAI_FINAL = re.compile("(?:ครับ|ค่ะ|คะ)$")


def named_language(label: Column) -> Column:
    """The language of ``LANGS`` that a label names, else null; placeholders and other languages give null."""
    code = F.split(F.lower(F.trim(label)), "[-_]")[0]
    pairs = [(c, lang) for lang, codes in CODES.items() for c in codes.split()]
    return reduce(lambda rest, pair: F.when(code == pair[0], pair[1]).otherwise(rest), pairs, F.lit(None).cast("string"))


def bare(text: str) -> str:
    """Lower-case letters outside quotations, single blanks between them."""
    for _ in range(3 if _MARK.search(text) else 0):
        shorter = _QUOTED.sub(" ", text)
        if shorter == text:
            break
        text = shorter
    return _NOT_TEXT.sub(" ", text).strip().lower()


def complete(unit: str) -> bool:
    """Whether a unit is a whole sentence rather than a heading or a list item."""
    return bool(_FINAL.search(unit)) or bool(_THAI_FINAL.search(unit))


def _grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1, 2, 3 the buckets of all n-grams of the texts, and the text in which each lies, in order of the texts."""
    joined = "\0".join(texts) + "\0\0"
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    n = len(owner)
    a, b, c = codes[:n], codes[1 : n + 1], np.append(codes[2:], np.uint64(0))[:n]
    with np.errstate(over="ignore"):
        one = a * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
        two = (one ^ b) * np.uint64(0xC2B2AE3D27D4EB4F)
        three = (two ^ c) * np.uint64(0x165667B19E3779F9)
    for h, there in ((one, a > 32), (two, (a > 0) & (b > 0)), (three, (a > 0) & (b > 0) & (c > 0))):
        h = h[there]
        h ^= h >> np.uint64(31)
        yield (h & np.uint64(BUCKETS - 1)).astype(np.int64), owner[there]


def score(matrix: np.ndarray, texts: list[str]) -> np.ndarray:
    """Log-likelihoods (texts x languages): the sparse counts of each text times the matrix."""
    out = np.zeros((len(texts), matrix.shape[1]), np.float32)
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(texts[stop]) < ROOM):
            size += len(texts[stop])
            stop += 1
        for grams, owner in _grams(texts[start:stop]):
            if len(owner):
                firsts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                out[start + owner[firsts]] += np.add.reduceat(matrix[grams], firsts, axis=0)
        start = stop
    return out


def _units(text: str) -> Iterator[tuple[int, int, str]]:
    for s, e in unit_spans(text):
        yield s, e, text[s:e]


def _matrix(counts: np.ndarray) -> np.ndarray:
    total = counts.sum(axis=0, keepdims=True)
    smooth = 0.1
    return np.log((counts + smooth) / (total + smooth * counts.shape[0])).astype(np.float32)


def _counts(labelled: DataFrame, prior) -> np.ndarray:
    """n-gram counts by language; with ``prior`` only of sentences that it gives their label."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((BUCKETS, len(LANGS)), np.int64)
        for batch in batches:
            texts, labels = [], []
            for text, lang in zip(batch["text"], batch["_lang"]):
                for _, _, unit in _units(text):
                    plain = bare(unit)
                    if plain:
                        texts.append(plain)
                        labels.append(LANGS.index(lang))
            if not texts:
                continue
            if prior is not None:
                keep = score(prior.value, texts).argmax(axis=1) == np.array(labels)
                texts, labels = [t for t, k in zip(texts, keep) if k], [x for x, k in zip(labels, keep) if k]
            if texts:
                for grams, owner in _grams(texts):
                    sums += np.bincount(grams * len(LANGS) + np.array(labels)[owner], minlength=sums.size).reshape(sums.shape)
        bucket, lang = np.nonzero(sums)
        yield pd.DataFrame({"bucket": bucket, "lang": lang, "n": sums[bucket, lang]})

    out = np.zeros((BUCKETS, len(LANGS)), np.float64)
    rows = labelled.mapInPandas(count, "bucket int, lang int, n bigint").groupBy("bucket", "lang").agg(F.sum("n").alias("n")).toPandas()
    out[rows["bucket"].to_numpy(int), rows["lang"].to_numpy(int)] = rows["n"].to_numpy(float)
    return out


def fit(documents: DataFrame, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """The log-probability matrix from about ``fit_rows`` labelled documents per language, or all if there are fewer.

    A language's documents are counted first, then those are taken whose hashed id lies in the share wanted: nothing
    is ranked and no text is shuffled but those taken.
    """
    labelled = documents.select("doc_id", "text", named_language(F.col("lang")).alias("_lang")).where(F.col("_lang").isNotNull() & F.col("doc_id").isNotNull())
    shares = {r["_lang"]: min(1.0, fit_rows / r["n"]) for r in labelled.groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    reach = reduce(lambda rest, pair: F.when(F.col("_lang") == pair[0], F.lit(pair[1])).otherwise(rest), sorted(shares.items()), F.lit(0.0))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    taken = labelled.where((place < reach) & (F.length(F.trim("text")) > 0)).select("text", "_lang")
    taken = taken.repartition(max(2, documents.sparkSession.sparkContext.defaultParallelism)).persist()
    first = documents.sparkSession.sparkContext.broadcast(_matrix(_counts(taken, None)))
    counts = _counts(taken, first)
    taken.unpersist()
    first.unpersist()
    return _matrix(counts)


def segments(documents: DataFrame, matrix: np.ndarray) -> DataFrame:
    """(doc_id, segment, start_pos, end_pos, lang, confidence, sentences): runs of units in one language.

    ``confidence`` is the posterior of the language with the evidence of at most 20 n-grams, ``sentences`` the number
    of complete sentences that the model is sure of.  Units without a language join the run before them.
    """
    shared = documents.sparkSession.sparkContext.broadcast(matrix)
    columns = ["doc_id", "segment", "start_pos", "end_pos", "lang", "confidence", "sentences"]

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            owner, spans, texts, units, whole = [], [], [], [], []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                for s, e, unit in _units(text) if text else ():
                    plain = bare(unit)
                    if plain:
                        owner.append(doc)
                        spans.append((s, e))
                        texts.append(plain)
                        units.append(unit)
                        whole.append(complete(unit))
            if not texts:
                continue
            likelihood = score(shared.value, texts)
            ordered = np.sort(likelihood, axis=1)
            unsure = [i for i in np.flatnonzero(ordered[:, -1] - ordered[:, -2] < UNSURE).tolist() if _NOT_TEXT.sub(" ", units[i]).strip().lower() != texts[i]]
            if unsure:
                likelihood[unsure] += score(shared.value, [_NOT_TEXT.sub(" ", " ".join(_QUOTED.findall(units[i]))).strip().lower() for i in unsure])
            letters = np.array([len(t) - t.count(" ") for t in texts])
            best = likelihood.argmax(axis=1)
            ordered = np.sort(likelihood, axis=1)
            margin = ordered[:, -1] - ordered[:, -2]
            grams = np.maximum(1, 3 * np.array([len(t) for t in texts]) - 3)
            tempered = (likelihood - ordered[:, -1:]) * (np.minimum(20, grams) / grams)[:, None]
            confidence = 1 / np.exp(tempered).sum(axis=1)
            sure = (margin >= SURE) & (letters >= LETTERS) & np.array(whole)
            out: list[list] = []
            for i, doc in enumerate(owner):
                lang = LANGS[best[i]]
                weak = margin[i] < SURE or letters[i] < LETTERS
                last = out[-1] if out and out[-1][0] == doc else None
                if last is not None and (last[4] == lang or weak):
                    size, more = last[3] - last[2], spans[i][1] - spans[i][0]
                    if last[4] == lang:
                        last[5] = (last[5] * size + float(confidence[i]) * more) / (size + more)
                    last[3] = spans[i][1]
                    last[6] += int(sure[i] and last[4] == lang)
                else:
                    out.append([doc, last[1] + 1 if last else 0, *spans[i], lang, float(confidence[i]), int(sure[i])])
            yield pd.DataFrame(out, columns=columns)

    return documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInPandas(
        runs, "doc_id bigint, segment int, start_pos int, end_pos int, lang string, confidence double, sentences int"
    )


def document_languages(segments_: DataFrame) -> DataFrame:
    """(doc_id, lang, confidence, share): the language with most characters; ties go to the earlier name."""
    by = segments_.withColumn("_size", F.col("end_pos") - F.col("start_pos")).groupBy("doc_id", "lang").agg(
        F.sum("_size").alias("_size"), (F.sum(F.col("confidence") * F.col("_size")) / F.sum("_size")).alias("confidence")
    )
    top = by.groupBy("doc_id").agg(F.min_by(F.struct("lang", "confidence", "_size"), F.struct(-F.col("_size"), "lang")).alias("_top"), F.sum("_size").alias("_all"))
    return top.select("doc_id", "_top.lang", F.round("_top.confidence", 6).alias("confidence"), F.round(F.col("_top._size") / F.col("_all"), 6).alias("share"))


def unnamed_languages(documents: DataFrame, segments_: DataFrame) -> DataFrame:
    """(doc_id, lang) of each language with a sure complete sentence that the document's label does not name."""
    seen = segments_.where(F.col("sentences") > 0).select("doc_id", "lang").distinct()
    labels = documents.select("doc_id", named_language(F.col("lang")).alias("_named")).where(F.col("_named").isNotNull())
    return seen.join(labels, (seen.doc_id == labels.doc_id) & (seen.lang == labels._named), "left_anti")
