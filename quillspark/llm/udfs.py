"""Vectorised functions that are made when they are used, so modules can be imported without a session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def lazy_udf(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    """Like ``pandas_udf(kind)``, but the type is parsed at the first use."""

    def wrap(f: Callable) -> Callable[..., Column]:
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(f, kind)(*columns)

        call.__doc__ = f.__doc__
        return call

    return wrap
