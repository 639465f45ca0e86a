"""Numbers of tokens by a public tokenizer, in Arrow batches."""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Where the installed vocabulary files of public tokenizers lie; callers may name another file.
DEFAULT = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern by which that kind of vocabulary splits a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A longer text is counted in parts, cut at line breaks or blanks where there are any.
PART = 20_000


def vocabulary_file(spark: SparkSession, path: str | Path) -> str:
    """Sends the vocabulary file along with the job, so that workers need no copy; its name for ``encoding``."""
    spark.sparkContext.addFile(str(path))
    return Path(path).name


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a vocabulary file, given by its path or by its name if it was sent with the job."""
    import tiktoken

    with open(path if Path(path).is_absolute() else SparkFiles.get(path), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts(text: str) -> list[str]:
    out, at = [], 0
    while len(text) - at > PART:
        stop = max(text.rfind("\n", at, at + PART), text.rfind(" ", at, at + PART))
        stop = stop if stop > at else at + PART
        out.append(text[at:stop])
        at = stop
    return [*out, text[at:]]


def token_count(text: str | None, path: str) -> int:
    return sum(len(encoding(path).encode_ordinary(part)) for part in parts(text)) if text else 0


def count_tokens(spark: SparkSession, text: Column, tokenizer: str | Path = DEFAULT) -> Column:
    """Number of tokens of a text column; 0 for null and empty texts."""
    name = vocabulary_file(spark, tokenizer)

    @F.pandas_udf("int")
    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: token_count(t, name)).astype("int32")

    return counted(text)
