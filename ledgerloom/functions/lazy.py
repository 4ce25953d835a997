"""Arrow UDFs that are made on first use, as their types are parsed by a session."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, wraps

from pyspark.sql import functions as F


def arrow_udf(kind: str) -> Callable:
    def put(f: Callable) -> Callable:
        made = cache(lambda: F.pandas_udf(f, kind))

        @wraps(f)
        def call(*columns):
            return made()(*columns)

        call.udf = made
        return call

    return put
