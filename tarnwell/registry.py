"""Where queries are registered, with the SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnwell.plans import nodes as n
from tarnwell.plans.lower import Context, lower
from tarnwell.sources.writers import shared_folder

Plan = Callable[[Callable[[str], n.Node]], n.Node]
FRAMES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def tables(sf_dir: str) -> Callable[[str], n.Node]:
    return lambda name: n.parquet(f"{sf_dir}/{name}.parquet", name=name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession, tag: str) -> str:
    """A new place in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def frame(sql: str | None = None):
    """Register a function of session and folder under its name."""

    def add(make):
        FRAMES[make.__name__] = make
        if sql:
            SQL[make.__name__] = sql
        return make

    return add


def plan(sql: str | None = None):
    """Register a plan over ``t(name)`` under its function's name."""

    def add(make: Plan) -> Plan:
        FRAMES[make.__name__] = lambda spark, sf_dir: run(spark, sf_dir, make)
        if sql:
            SQL[make.__name__] = sql
        return make

    return add


def run(spark: SparkSession, sf_dir: str, make: Plan) -> DataFrame:
    return lower(make(tables(sf_dir)), Context(spark)).df
