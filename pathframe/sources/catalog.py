"""The document that an expression sees: named tables."""

from __future__ import annotations

import glob
import os

from pyspark.sql import DataFrame, SparkSession


class Catalog:
    """DataFrames by name; read lazily, each use a source of its own."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = dict(tables)

    def __contains__(self, name: str) -> bool:
        return name in self.tables

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    @classmethod
    def of(cls, source: DataFrame | dict[str, DataFrame] | Catalog) -> Catalog:
        if isinstance(source, Catalog):
            return source
        return cls(source) if isinstance(source, dict) else cls({"": source})

    @classmethod
    def folder(cls, spark: SparkSession, path: str, names: list[str] | None = None) -> Catalog:
        """``<name>.parquet`` of a folder; ``names`` are needed where only Spark can list it."""
        if names is None:
            names = [os.path.basename(p)[: -len(".parquet")] for p in sorted(glob.glob(f"{path}/*.parquet"))]
        return cls({n: spark.read.parquet(f"{path}/{n}.parquet") for n in names})


def json_documents(spark: SparkSession, path: str, column: str = "document") -> DataFrame:
    """A text file of JSON lines as a column of documents, for the document evaluator."""
    return spark.read.text(path).withColumnRenamed("value", column)
