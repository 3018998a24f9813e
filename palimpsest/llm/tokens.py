"""Token counts by a public tokenizer's vocabulary."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how that vocabulary cuts a text into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def ship(spark: SparkSession, vocabulary: str = VOCABULARY) -> str:
    """Send the vocabulary file along with the session's jobs, for machines that don't have it; returns its name, to be
    given as ``vocabulary``."""
    spark.sparkContext.addFile(vocabulary)
    return os.path.basename(vocabulary)


@lru_cache(maxsize=4)
def encoder(vocabulary: str):
    import tiktoken

    path = vocabulary if os.path.exists(vocabulary) else SparkFiles.get(vocabulary)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, vocabulary: str = VOCABULARY) -> int:
    return len(encoder(vocabulary).encode_ordinary(text)) if text else 0


def n_tokens(text: Column | str, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of the whole text; 0 for null. The vocabulary: a path that every machine has, or what ``ship`` returns."""

    # a call a text: the encoder's batch call takes half as long again
    @F.arrow_udf(LongType())
    def counted(texts: pa.Array) -> pa.Array:
        return pa.array([count(t.as_py(), vocabulary) for t in texts], pa.int64())

    return counted(text)
