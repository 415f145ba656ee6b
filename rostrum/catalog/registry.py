"""Registry of named queries: a Spark callable and, where SQL can state it, an oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rostrum.plans.proxies import render


class Tables:
    """Read access to one data folder: base tables and proxy views as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = str(sf_dir).rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        return self.sql("SELECT * FROM {" + name + "}")

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(render(text, "spark", self.sf_dir))


QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


def register(name: str, *covers: str, oracle: str | None = None):
    """Register the decorated function under ``name``; ``covers`` lists survey rows it stands for."""

    def add(function: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        COVERS[name] = covers
        if oracle is not None:
            ORACLES[name] = render(oracle, "duckdb").strip()
        return function

    return add
