"""Helpers for expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once for each row however often it is used, also within lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) that follows from the parts' text: the first 52 bits of a digest."""
    digest = F.md5(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)
