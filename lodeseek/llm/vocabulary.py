"""A word list from a public tokenizer's vocabulary, and Viterbi segmentation with it."""

from __future__ import annotations

import base64
import math
import os
import re
from functools import lru_cache

from pyspark.broadcast import Broadcast
from pyspark.sql import SparkSession

DEFAULT = os.environ.get("LODESEEK_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
_WORD = re.compile(rb"[A-Za-z]{3,20}")


# Fixed value: how the public byte-level vocabularies cut a text before they merge.
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(ranks: bytes):  # noqa: ANN201
    """The tokenizer of a file of ranks, given by its content."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines())}
    return tiktoken.Encoding("public", pat_str=_PATTERN, mergeable_ranks=table, special_tokens={})


def shipped(spark: SparkSession, path: str) -> Broadcast[bytes]:
    """A vocabulary file (about a megabyte) as the driver reads it, sent to the executors, which need no copy of their own."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


@lru_cache(maxsize=4)
def read_words(path: str = DEFAULT) -> dict[str, float]:
    """Lower-case words of the vocabulary (tokens that begin a word) with a cost that grows with their rank."""
    words: dict[str, float] = {}
    with open(path, "rb") as f:
        for line in f:
            token, rank = line.split()
            token = base64.b64decode(token)
            if token[:1] == b" " and _WORD.fullmatch(token[1:]):
                words.setdefault(token[1:].decode().lower(), math.log(int(rank) + 10))
    return words


def unexplained(text: str, words: dict[str, float], least: int = 4, letter_cost: float = 4.0) -> int:
    """How many characters no dictionary word of `least` letters or more accounts for, in the cheapest segmentation.

    A word costs its rank's logarithm, a character by itself `letter_cost`. Separators (`_`, `-`, `.`,
    blanks, slashes, colons) count as explained.
    """
    low = text.lower()
    n = len(low)
    cost, left = [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        free = low[i - 1] in "_-. /:"
        best, rest = cost[i - 1] + (0.0 if free else letter_cost), left[i - 1] + (not free)
        if low[i - 1].isalpha():
            for k in range(least, min(i, 16) + 1):
                c = words.get(low[i - k : i])
                if c is not None and cost[i - k] + c < best:
                    best, rest = cost[i - k] + c, left[i - k]
        cost[i], left[i] = best, rest
    return left[n]
