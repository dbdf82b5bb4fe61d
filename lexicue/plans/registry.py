"""Names each job and, where SQL can express it, the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Job(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


JOBS: dict[str, Job] = {}


def job(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` under ``name``."""

    def add(fn):
        if name in JOBS:
            raise ValueError(f"job {name} is registered twice")
        JOBS[name] = Job(fn, sql)
        return fn

    return add
