"""Registry of named queries: each has a Spark builder and (where expressible) a DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from farelake.session import keep_methods_compiled

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    build: Builder
    sql: str | None
    doc: str


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            keep_methods_compiled(spark)
            return fn(spark, sf_dir)

        REGISTRY[name] = Query(name, build, sql, (fn.__doc__ or "").strip())
        return fn

    return deco


def load_all() -> dict[str, Query]:
    # Importing the modules registers their queries.
    from farelake.plans import (  # noqa: F401
        q_clean,
        q_profile,
        q_sources,
        q_geo,
        q_features,
        q_splits,
        q_models,
        q_training,
        q_comparables,
        q_estimate,
        q_calibrate,
        q_eda,
        q_reports,
    )

    return REGISTRY
