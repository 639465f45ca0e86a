"""Problem 7: passages of test items inside training documents.

A passage may be a hundredth of the item and a thousandth of the document, so a sketch of a whole text can't
find it.  The MinHash containment search therefore sketches windows: texts are partitioned by the size of
the shortest passage that counts (20 or 40 letters and digits), every window of that size is a set of shingles,
and its sketch is the minimum hash of those shingles.  A document that contains the passage contains the
whole set, so it has a window with the very same minimum: no passage is missed.  Neighbouring windows mostly
share their minimum; such a run of windows is kept as one stretch of text with the place of the minimum in it.

The stretches of the items are a table.  Which minima occur in it is marked in a bit array whose size is bounded
(``MOST_BITS``) and which is broadcast, so that the documents are read once and only stretches whose
minimum may occur leave them.  Those are joined with the items' stretches on (window size, minimum), and
the exact containment of shingles is then read off the two stretches: equal around the minimum over a window or not.
A wider bit array only spares useless stretches; what is found doesn't depend on it.

Defined results: null, blank or short texts and rows without an id give no rows; a document under several ids is reported under
each; repeated rows count once; items or documents without rows give an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Shortest passage by language; 'en' stands for languages that write words apart.
WINDOW = {"zh": 20, "ja": 20, "en": 40}
#: Bits for each minimum of the items, and the largest bit array that is broadcast (64 MB).
BITS_EACH, MOST_BITS = 64, 1 << 29
#: Bits that one row of the array holds on its way to the driver.
BLOCK = 1 << 16
#: Stretches of items up to which they are broadcast to the documents' stretches.
SMALL = 200_000
#: Characters hashed at a time.
ROOM = 1_000_000
_NOT_ALNUM = re.compile(r"[\W_]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_STRETCH = "id bigint, size int, minimum bigint, at int, stretch string"


def bare(text: str) -> str:
    """Letters and digits alone, without case and width."""
    return _NOT_ALNUM.sub("", unicodedata.normalize("NFKC", text).casefold())


def shingle_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each shingle of k characters."""
    n = len(codes) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = h * _MULTIPLIER + codes[i : i + n] + np.uint64(1)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def window_minima(h: np.ndarray, need: int) -> np.ndarray:
    """The minimum of every ``need`` neighbouring hashes."""
    if len(h) < need:
        return np.empty(0, np.uint64)
    width, low = 1, h
    while width * 2 <= need:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    shift = need - width
    return np.minimum(low[: len(low) - shift], low[shift:]) if shift else low


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def stretches(joined: str, starts: np.ndarray, window: int, marked=None) -> Iterator[tuple[int, int, int, str]]:
    """(text, minimum, at, stretch) of the runs of windows that share a minimum, inside each of the texts that begin at ``starts``.

    The texts are joined by a character that none of them has.  With ``marked``, a test of minima, only those that pass.
    """
    k = window // 2
    need = window - k + 1
    h = shingle_hashes(_codes(joined), k)
    low = window_minima(h, need)
    hits = np.flatnonzero(marked(low)) if marked is not None else np.arange(len(low))
    if not len(hits):
        return
    owner = np.searchsorted(starts, hits, "right") - 1
    inside = hits + window < starts[owner + 1]
    hits, owner = hits[inside], owner[inside]
    place = np.empty(len(hits), np.int64)
    for part in range(0, len(hits), ROOM // 16):
        some = hits[part : part + ROOM // 16]
        place[part : part + len(some)] = some + h[some[:, None] + np.arange(need)].argmin(axis=1)
    firsts = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (np.diff(hits) != 1)]) if len(hits) else hits
    lasts = np.r_[firsts[1:], len(hits)] - 1
    for first, last in zip(firsts.tolist(), lasts.tolist()):
        a, b, at = int(hits[first]), int(hits[last]) + window, int(place[first])
        yield int(owner[first]), int(h[at].astype(np.int64)), at - a, joined[a:b]


def _stretched(batches: Iterator[pd.DataFrame], marks) -> Iterator[pd.DataFrame]:
    """Stretches of the rows (id, text, size); size 0 stands for all sizes."""
    columns = ["id", "size", "minimum", "at", "stretch"]
    for batch in batches:
        ids, texts, sizes, length = [], [], [], 0
        rows = zip(batch["id"].tolist(), batch["text"].tolist(), batch["size"].tolist())
        for row in [*rows, None]:
            if row is not None:
                plain = bare(row[1]) if row[1] else ""
                if plain:
                    ids.append(row[0])
                    texts.append(plain)
                    sizes.append(row[2])
                    length += len(plain)
            if texts and (row is None or length > ROOM):
                out = []
                for size in sorted(set(WINDOW.values())):
                    own = [i for i, s in enumerate(sizes) if s in (0, size)]
                    starts = np.cumsum([0, *(len(texts[i]) + 1 for i in own)])
                    marked = (lambda low, size=size: marks(low, size)) if marks else None
                    out += dict.fromkeys((ids[own[o]], size, *rest) for o, *rest in stretches("\0".join(texts[i] for i in own) + "\0", starts, size, marked))
                if out:
                    yield pd.DataFrame(out, columns=columns)
                ids, texts, sizes, length = [], [], [], 0


def bit_array(items: DataFrame, count: int) -> np.ndarray:
    """Bits for the (size, minimum) of the items' stretches; packed in blocks by tasks, so the driver holds bytes of bounded number."""
    bits = BLOCK
    while bits < min(MOST_BITS, count * BITS_EACH):
        bits *= 2
    place = F.col("minimum").bitwiseXOR(F.col("size").cast("long")).bitwiseAND(F.lit(bits - 1).cast("long"))
    blocks = items.select(place.alias("bit")).distinct().groupBy(F.floor(F.col("bit") / BLOCK).alias("block")).agg(F.collect_list((F.col("bit") % BLOCK).cast("int")).alias("bits"))

    @F.pandas_udf("binary")
    def packed(places: pd.Series) -> pd.Series:
        def one(own) -> bytes:
            flags = np.zeros(BLOCK, np.uint8)
            flags[np.asarray(own, np.int64)] = 1
            return np.packbits(flags).tobytes()

        return places.map(one)

    out = np.zeros(bits // 8, np.uint8)
    for row in blocks.select("block", packed("bits").alias("bits")).toLocalIterator():
        out[row["block"] * (BLOCK // 8) : (row["block"] + 1) * (BLOCK // 8)] = np.frombuffer(row["bits"], np.uint8)
    return out


@F.pandas_udf(T.IntegerType())
def _shared(a: pd.Series, at: pd.Series, b: pd.Series, bt: pd.Series, size: pd.Series) -> pd.Series:
    """How many windows two stretches share around their common minimum."""

    def one(x: str, i: int, y: str, j: int, window: int) -> int:
        k = window // 2
        if x[i : i + k] != y[j : j + k]:
            return 0
        left = right = 0
        while left < min(i, j) and x[i - left - 1] == y[j - left - 1]:
            left += 1
        while right < min(len(x) - i, len(y) - j) - k and x[i + k + right] == y[j + k + right]:
            right += 1
        return max(0, left + k + right - window + 1)

    return pd.Series([one(*row) for row in zip(a, at, b, bt, size)], dtype="int32")


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, shared_windows) for each document that holds a passage of an item.

    ``shared_windows`` counts the pairs of equal windows in their different stretches.  The items' stretches are kept, as they are counted, marked and
    joined; they are broadcast in the join only if there are at most ``SMALL``.
    """
    window = F.lit(WINDOW["en"])
    for lang, size in WINDOW.items():
        window = F.when(F.col("lang") == lang, size).otherwise(window)
    asked = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").alias("id"), "text", window.alias("size")).distinct()
    own = asked.mapInPandas(lambda batches: _stretched(batches, None), _STRETCH).distinct().persist()
    count = own.count()
    shared = documents.sparkSession.sparkContext.broadcast(bit_array(own, count))

    def marks(low: np.ndarray, size: int) -> np.ndarray:
        bits = shared.value
        place = (low ^ np.uint64(size)) & np.uint64(len(bits) * 8 - 1)
        return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8))) & 1

    rows = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").alias("id"), "text", F.lit(0).alias("size"))
    found = rows.mapInPandas(lambda batches: _stretched(batches, marks), _STRETCH)
    held = own.select(F.col("id").alias("item_id"), "size", "minimum", F.col("at").alias("item_at"), F.col("stretch").alias("item_stretch"))
    both = found.join(F.broadcast(held) if count <= SMALL else held, ["size", "minimum"])
    pairs = both.select(F.col("id").alias("doc_id"), "item_id", "size", "stretch", "item_stretch", _shared("stretch", "at", "item_stretch", "item_at", "size").alias("n")).where("n > 0").distinct()
    return pairs.groupBy("doc_id", "item_id").agg(F.sum("n").alias("shared_windows"))
