"""Pluggable models: embeddings and pair judgements, as pandas UDFs behind names."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EMBEDDERS: dict[str, Callable[[list[str]], list[list[float]]]] = {}
_JUDGES: dict[str, Callable[[list[str], list[str]], list[tuple[float, float]]]] = {}


def register_embedder(name: str, encode: Callable[[list[str]], list[list[float]]]) -> None:
    _EMBEDDERS[name] = encode


def register_judge(name: str, score: Callable[[list[str], list[str]], list[tuple[float, float]]]) -> None:
    """score gives (contradiction, entailment) of each ordered pair."""
    _JUDGES[name] = score


def embed_new(entities: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """(content_hash, embedding) of the texts that `known` (content_hash) lacks: each distinct text once."""
    encode = _EMBEDDERS[name]

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(text: pd.Series) -> pd.Series:
        return pd.Series(encode(text.tolist()))

    text = F.concat_ws("\n\n", "title", "content")
    fresh = entities.select(F.sha2(text, 256).alias("content_hash"), text.alias("text")).dropDuplicates(["content_hash"]).join(known.select("content_hash"), "content_hash", "left_anti")
    return fresh.select("content_hash", run("text").alias("embedding"))


def judge(pairs: DataFrame, name: str | None, contradiction: float = 0.70, entailment: float = 0.55) -> DataFrame:
    """Pairs (id, other, a, b) with a verdict: the stronger direction decides. Without a model no pair has one."""
    if name is None or name not in _JUDGES:
        return pairs.select("id", "other", F.lit(None).cast("string").alias("verdict"))
    score = _JUDGES[name]

    @F.pandas_udf("struct<c:double,e:double>")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        forward, backward = score(a.tolist(), b.tolist()), score(b.tolist(), a.tolist())
        return pd.DataFrame([(max(x[0], y[0]), max(x[1], y[1])) for x, y in zip(forward, backward)], columns=["c", "e"])

    verdict = F.when(F.col("s.c") >= contradiction, "contradiction").when(F.col("s.e") >= entailment, "entailment")
    return pairs.withColumn("s", run("a", "b")).select("id", "other", verdict.alias("verdict"))
