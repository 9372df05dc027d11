"""Hashed text vectors: a deterministic stand-in for a sentence model behind a small interface.

Words and letter trigrams are hashed into ``dim`` buckets with signs, weighted by 1 + log(count) and
normalised. Any function from a Series of texts to a list of vectors can take its place.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmap.runtime import spread

DIM = 256


@lru_cache(maxsize=50_000)
def _parts(word: str) -> list[str]:
    """What is counted of a word: itself and its letter trigrams."""
    padded = f" {word} "
    return [word, *(padded[i : i + 3] for i in range(len(padded) - 2))]


@lru_cache(maxsize=100_000)
def _hash(part: str) -> int:
    return zlib.crc32(part.encode())


def hashed_vector(text: str | None, dim: int = DIM) -> list[float]:
    counts: Counter[str] = Counter()
    for w in re.findall(r"\w+", (text or "").lower()):
        counts.update(_parts(w))
    v = [0.0] * dim
    for k, n in counts.items():
        h = _hash(k)
        v[h % dim] += (1 + math.log(n)) * (1 if h >> 16 & 1 else -1)
    size = math.sqrt(sum(x * x for x in v))
    return [x / size for x in v] if size else v


def embed_texts(df: DataFrame, text: str, out: str = "v", provider: Callable[[pd.Series], list[list[float]]] | None = None) -> DataFrame:
    encode = provider or (lambda s: [hashed_vector(t) for t in s])

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(encode(s))

    return spread(df).withColumn(out, run(F.col(text)))


#: Providers by name: what makes the encoder of a process.
PROVIDERS: dict[str, Callable[[], Callable[[pd.Series], list[list[float]]]]] = {"hashed": lambda: lambda s: [hashed_vector(t) for t in s]}
_LOADS: Counter[str] = Counter()


@lru_cache(maxsize=4)
def cached_provider(name: str) -> Callable[[pd.Series], list[list[float]]]:
    """The encoder of this name, made once per process."""
    _LOADS[name] += 1
    return PROVIDERS[name]()


def loads(name: str) -> int:
    """How often this process made the encoder."""
    return _LOADS[name]
