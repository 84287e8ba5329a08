"""Query registry: name -> (builder, SQL)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """The driver tables of one scale folder, read on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    nation = cached_property(lambda self: self._read("nation"))
    customer = cached_property(lambda self: self._read("customer"))
    supplier = cached_property(lambda self: self._read("supplier"))
    part = cached_property(lambda self: self._read("part"))
    orders = cached_property(lambda self: self._read("orders"))
    lineitem = cached_property(lambda self: self._read("lineitem"))
    events = cached_property(lambda self: self._read("events"))
    documents = cached_property(lambda self: self._read("documents"))
    pages = cached_property(lambda self: self._read("pages"))
    labels = cached_property(lambda self: self._read("labels"))
    conversations = cached_property(lambda self: self._read("conversations"))


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``builder(tables)`` under ``name`` with its SQL twin."""

    def register(builder: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, builder, sql)
        return builder

    return register
