"""Column expressions that are put together once a session."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext


def built_once(build: Callable) -> Callable:
    """build, whose result is kept for as long as the Spark context lives. Its arguments are names and flags, never columns:
    a large expression takes thousands of calls into the JVM to put together, and stays the same for every table."""
    known: dict[tuple, object] = {}

    @wraps(build)
    def call(*args):
        context = SparkContext._active_spark_context
        key = (id(context._jvm) if context else None, *args)
        if key not in known:
            known[key] = build(*args)
        return known[key]

    return call
