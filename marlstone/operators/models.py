"""Encoders and pair scorers as plain functions over a batch of texts, run on Arrow batches in tasks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from marlstone.operators.retrieval import ranked
from marlstone.session import ship

#: Words of letters, digits and underscores; CJK characters one by one.
_TOKEN = re.compile(r"[0-9a-z_]+|[一-鿿]")


def hashed(texts: list[str], dims: int = 256) -> np.ndarray:
    """Bags of hashed words with hashed signs, of length 1 (0 for a text without words): the encoder of no model."""
    out = np.zeros((len(texts), dims), dtype=np.float64)
    for i, t in enumerate(texts):
        for w in _TOKEN.findall(t.lower()):
            h = xxhash.xxh3_64_intdigest(w)
            out[i, h % dims] += 1.0 if h >> 63 else -1.0
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def shared_words(a: list[str], b: list[str]) -> np.ndarray:
    """Share of a's distinct words that b has: the pair scorer of no model."""
    sets = [(set(_TOKEN.findall(x.lower())), set(_TOKEN.findall(y.lower()))) for x, y in zip(a, b, strict=True)]
    return np.array([len(x & y) / len(x) if x else 0.0 for x, y in sets])


def encode(rows: DataFrame, encoder: Callable[[list[str]], np.ndarray] = hashed, text: str = "text", out: str = "v") -> DataFrame:
    """rows and their vectors (array<float>, column out, replaced if there). A null text is an empty one."""
    ship(rows.sparkSession)
    base = rows.drop(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{out: list(encoder([t or "" for t in b[text]]))})

    return base.mapInPandas(run, StructType([*base.schema.fields, StructField(out, ArrayType(FloatType()))]))


def rescore(candidates: DataFrame, scorer: Callable[[list[str], list[str]], np.ndarray] = shared_words, k: int = 5) -> DataFrame:
    """qid, cid, score, rank: the k best candidates (qid, cid, query, content) by a model of pairs, ties by cid.

    Null texts are empty ones; a score that is no number counts as 0.
    """
    ship(candidates.sparkSession)
    pairs = candidates.select("qid", "cid", F.coalesce("query", F.lit("")).alias("a"), F.coalesce("content", F.lit("")).alias("b"))

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series(np.nan_to_num(np.asarray(scorer(a.tolist(), b.tolist()), dtype=np.float64), nan=0.0))

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    score = F.pandas_udf(run, "double")
    return ranked(pairs.select("qid", "cid", score("a", "b").alias("score")), k)
