"""Data files by name: where they lie, and that they are what they should be."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(default: str, variable: str = "SHOALSPARK_DATA_DIR") -> str:
    """The data folder: the environment's if it names one."""
    return os.environ.get(variable) or default


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256) of the files of a folder, read by the executors."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def fetch(spark: SparkSession, path: str, name: str, sha256: str) -> str:
    """The path of a file; an error if it is not there or is not the one registered."""
    full = f"{path.rstrip('/')}/{name}"
    got = digests(spark, full).first()
    if got["sha256"] != sha256:
        raise ValueError(f"{full} is not the registered file: {got['sha256']}")
    return full
