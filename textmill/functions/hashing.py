"""Portable deterministic hash used for every seeded choice (split order,
folds, sampling, skip-gram windows).  ``rand()`` is never used in a result
that is compared: it depends on partitioning.

The hash is the first 32 bits of md5("<key>:<seed>") as a non-negative
BIGINT.  md5 is a built-in expression in Spark and in most SQL engines, so
an independent oracle can compute the same order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def phash(*keys: Column | str, seed: int = 42) -> Column:
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    s = F.concat_ws(":", *[p.cast("string") for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long")
