"""A registered query: a callable over (spark, sf_dir) and, where SQL can say it, an independent SQL text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    runners: dict[str, Runner] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def query(self, name: str, sql: str | None = None) -> Callable[[Runner], Runner]:
        def register(run: Runner) -> Runner:
            self.runners[name] = run
            if sql is not None:
                self.sql[name] = sql
            return run

        return register


def rounded(col: Column | str, digits: int = 6) -> Column:
    """Round for comparison; adding zero turns -0.0 into 0.0."""
    return F.round(col, digits) + F.lit(0.0)


def round_all(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: rounded(F.col(n), digits) for n in names})
