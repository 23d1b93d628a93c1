from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from careerloom.plans.demo import Careers
from careerloom.plans.oracle import compose

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(careers) -> DataFrame``; ``sql`` may use the blocks of ``oracle``."""

    def register(fn: Callable[[Careers], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Careers(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = compose(sql)
        return fn

    return register
