"""Column functions for text: stripping, identifiers, analysis for search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{1c}-\\x{1f}]"
#: Scripts written without blanks; their runs are indexed by pairs of characters.
WIDE = "\\x{3040}-\\x{30ff}\\x{31f0}-\\x{31ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}\\x{3005}\\x{0e01}-\\x{0e5b}"
# Fixed value: the DNS name space of version 5 identifiers.
DNS = "6ba7b8109dad11d180b400c04fd430c8"


def strip(text: Column) -> Column:
    """Without white space of any script at either end; null stays null."""
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def uuid5(name: Column) -> Column:
    """The version 5 identifier of a name in the DNS name space."""
    digest = F.sha1(F.concat(F.unhex(F.lit(DNS)), F.encode(name, "utf-8")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F))).bitwiseOR(F.lit(0x80))))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 19, 2), F.lit("-"), F.substring(digest, 21, 12),
    )


def terms(text: Column) -> Column:
    """Index terms: lower-case words, and pairs of characters in runs of scripts without blanks.

    A run of one character is a term itself.  Null gives null.
    """
    low = F.lower(text)
    words = F.regexp_extract_all(F.regexp_replace(low, f"[{WIDE}]+", " "), F.lit("([\\p{L}\\p{N}]+)"), F.lit(1))
    runs = F.regexp_extract_all(low, F.lit(f"([{WIDE}]+)"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, 2))))
    return F.concat(words, pairs)


def cache_key(model: str, text: Column) -> Column:
    """Key of a cached vector: the model belongs to it."""
    return F.md5(F.concat(F.lit(model + "|"), text))


def namespaced(namespace: Column, key: Column) -> Column:
    return F.when(F.coalesce(namespace, F.lit("")) != "", F.concat_ws(":", namespace, key)).otherwise(key)


def prompt_context(contexts: Column) -> Column:
    """'[Context i]' blocks joined by a blank line; null and empty lists give the empty text."""
    blocks = F.transform(contexts, lambda c, i: F.concat(F.lit("[Context "), (i + 1).cast("string"), F.lit("]\n"), F.coalesce(c, F.lit(""))))
    return F.coalesce(F.array_join(blocks, "\n\n"), F.lit(""))
