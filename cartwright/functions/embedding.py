"""Hash embedding: 64 numbers in [0, 1) per text, from MD5."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

# Number of components, and the modulus that scales a digest to [0, 1).
COMPONENTS = 64
MODULUS = 10_000

_SUFFIXES = [str(i).encode() for i in range(COMPONENTS)]


def _embed(text: str) -> list[float]:
    """Component i is MD5(text followed by i) mod 10000 / 10000.

    The digest state after the text is copied for each suffix: a long text is hashed once,
    not once per component as built-in ``md5`` calls would.
    """
    state = hashlib.md5(text.encode(), usedforsecurity=False)
    parts = []
    for suffix in _SUFFIXES:
        digest = state.copy()
        digest.update(suffix)
        parts.append(int.from_bytes(digest.digest(), "big") % MODULUS / MODULUS)
    return parts


def hash_embedding(text: Column) -> Column:
    @F.pandas_udf(ArrayType(DoubleType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(_embed, na_action="ignore")

    return embed(text)

