"""Deterministic ids and stand-in embeddings: no built-in function has them, so Arrow-batched ones do."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def uuid5(names: pd.Series) -> pd.Series:
    """Name-based id in the DNS namespace; null stays null."""
    return names.map(lambda s: str(uuid.uuid5(uuid.NAMESPACE_DNS, s)), na_action="ignore")


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """A unit vector that depends on the text alone: chained SHA-256 digests read as numbers in -1..1."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(texts: pd.Series) -> pd.Series:
        def one(s: str) -> np.ndarray:
            raw, seed = b"", s.encode()
            while len(raw) < 4 * dim:
                seed = hashlib.sha256(seed).digest()
                raw += seed
            v = np.frombuffer(raw[: 4 * dim], ">u4") / 2.0**32 * 2 - 1
            return v / (np.linalg.norm(v) or 1.0)

        return texts.map(lambda s: one(s or ""))

    return embed(text)


@F.pandas_udf(T.StringType())
def money(x: pd.Series) -> pd.Series:
    """Whole dollars with separators; the number itself is rounded, not its shortest decimal form, as Java does, and exact halves go to the even side."""
    return x.map(lambda v: f"${v:,.0f}", na_action="ignore")


@F.pandas_udf(T.StringType())
def _percent(x: pd.Series) -> pd.Series:
    return x.map(lambda v: f"{v:.1f}%", na_action="ignore")


def percent(x: Column) -> Column:
    """A share as a percentage with one decimal, rounded as ``money`` is."""
    return _percent(x * 100)
