"""The boundary to models: a scorer turns rows into rows with one more column. Three kinds: a column that is there
already, a stand-in that only the key decides, and a model that a Python worker loads once and calls by batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.sampling import unit

Scorer = Callable[[DataFrame], DataFrame]


def from_column(name: str, column: Column) -> Scorer:
    return lambda rows: rows.withColumn(name, column)


def stand_in(name: str, key: str, low: float = 0.0, high: float = 1.0) -> Scorer:
    """A number from low to high by hash of the key: for tests and dry runs."""
    return lambda rows: rows.withColumn(name, low + unit(F.col(key), name) * (high - low))


def from_model(name: str, load: Callable[[], Callable[[pd.DataFrame], pd.Series]], inputs: list[str], kind: str = "double") -> Scorer:
    """load() runs once in each Python worker; what it returns gets Arrow batches of `inputs`."""

    def score(rows: DataFrame) -> DataFrame:
        @F.pandas_udf(kind)
        def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            model = load()
            for x in batches:
                yield model(x)

        return rows.withColumn(name, call(F.struct(*inputs)))

    return score


def isolated(name: str, work: Callable[[pd.DataFrame], pd.Series], inputs: list[str], kind: str = "double") -> Scorer:
    """work() on Arrow batches of `inputs`; where a batch fails, on its rows one by one, so that a row that fails costs
    no other. Adds `name`, null where a row failed, and name_error, the kind of its error."""

    def one(x: pd.DataFrame) -> tuple:
        try:
            return work(x).iloc[0], None
        except Exception as e:  # whatever a model raises is that row's error
            return None, type(e).__name__

    def run(x: pd.DataFrame) -> pd.DataFrame:
        try:
            return pd.DataFrame({"value": work(x), "error": None})
        except Exception:
            return pd.DataFrame([one(x.iloc[i : i + 1]) for i in range(len(x))], columns=["value", "error"])

    def score(rows: DataFrame) -> DataFrame:
        call = F.pandas_udf(run, f"value {kind}, error string")
        found = rows.withColumn(f"{name}_found", call(F.struct(*inputs)))
        return found.withColumns({name: F.col(f"{name}_found.value"), f"{name}_error": F.col(f"{name}_found.error")}).drop(f"{name}_found")

    return score


def scored(rows: DataFrame, scorers: list[Scorer]) -> DataFrame:
    """Runs the scorers in turn. Put filters in front of this: Spark does not move them past a model."""
    for s in scorers:
        rows = s(rows)
    return rows
