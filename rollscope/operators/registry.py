"""Scorer registry and adapters for user functions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from rollscope.functions import text as T
from rollscope.operators.gates import dispatch

Scorer = Callable[[Column, Column], Column]


class RewardRegistry:
    """Named scorers over (completion, solution) columns; stays in one native projection."""

    def __init__(self, scorers: Mapping[str, Scorer]):
        self._scorers = dict(scorers)

    @classmethod
    def default(cls) -> "RewardRegistry":
        return cls({
            "default": T.fuzzy_text, "mcq": T.mcq_score, "yes_no": T.yes_no_score, "all_match": T.all_match,
            "repetition": lambda c, s: T.repetition_reward(c),
            "format": lambda c, s: c.rlike(T.FORMAT_SIMPLE).cast("double")})

    def extend(self, more: Mapping[str, Scorer]) -> "RewardRegistry":
        return RewardRegistry({**self._scorers, **more})

    def column(self, name: str, completion: Column, solution: Column) -> Column:
        if name not in self._scorers:
            raise KeyError(f"unknown scorer {name!r}; known: {sorted(self._scorers)}")
        return self._scorers[name](completion, solution)

    def score_all(self, df: DataFrame, names: Sequence[str]) -> DataFrame:
        return df.withColumns({n: self.column(n, F.col("completion"), F.col("solution")) for n in names})

    def dispatch(self, df: DataFrame, method: str, default: str = "default") -> DataFrame:
        """Score each row by its own method; unknown methods take the default."""
        cols = {n: self.column(n, F.col("completion"), F.col("solution")) for n in self._scorers}
        return df.withColumn("score", dispatch(F.col(method), cols, default))


def sample_udf(fn: Callable[..., Sequence[float]]) -> Callable[..., Column]:
    """Adapter for per-sample functions (lists in, list of floats out); runs on Arrow batches."""
    @F.pandas_udf(DoubleType())
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series(list(fn(*[c.tolist() for c in cols])), dtype="float64")

    return run


def group_udf(df: DataFrame, keys: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Adapter for functions of a whole group; the group must fit one worker, so prefer native aggregates."""
    return df.groupBy(*keys).applyInPandas(fn, schema)
