"""Explode helpers.

``explode(col)`` on a column reference makes Catalyst infer a
``size(col) > 0 AND col IS NOT NULL`` filter, which is then pushed below
the projection that computes ``col`` and rewritten in terms of its
expression: a regex chain (cleaning + tokenising a whole document) would
run twice per row.  Passing the array through ``filter(x -> x IS NOT NULL)``
first keeps one evaluation; the result rows are the same (arrays of tokens
hold no nulls; null or empty arrays give no rows either way).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _wrap(c) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.filter(col, lambda x: x.isNotNull())


def explode(c) -> Column:
    return F.explode(_wrap(c))


def posexplode(c) -> Column:
    return F.posexplode(_wrap(c))


def value_counts(c) -> Column:
    """array<struct<value, n>> of an array's distinct values and how often each
    occurs, inside the row: sort, then the distances between run starts."""
    runs = F.transform(F.array(F.sort_array(_wrap(c))), lambda s: F.struct(s.alias("s"), F.filter(
        F.sequence(F.lit(1), F.size(s)),
        lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2))).alias("b")))
    runs = F.filter(runs, lambda r: F.size(r["s"]) > 0)
    return F.flatten(F.transform(runs, lambda r: F.transform(r["b"], lambda b, j: F.struct(
        F.get(r["s"], b - 1).alias("value"),
        (F.coalesce(F.get(r["b"], j + 1), F.size(r["s"]) + 1) - b).cast("long").alias("n")))))


def explode_counts(df: DataFrame, key: str, values, out: str = "token", n: str = "n") -> DataFrame:
    """(key, out, n): one row per distinct value of a row's array."""
    e = df.select(key, explode(value_counts(values)).alias("__e"))
    return e.select(key, F.col("__e.value").alias(out), F.col("__e.n").alias(n))


def value_positions(c) -> Column:
    """array<struct<value, at>>: each distinct value of an array without nulls
    and its 0-based positions, inside the row."""
    pairs = F.sort_array(F.transform(c if isinstance(c, Column) else F.col(c), lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    runs = F.transform(F.array(pairs), lambda s: F.struct(s.alias("s"), F.filter(
        F.sequence(F.lit(1), F.size(s)),
        lambda i: (i == 1) | (F.get(s, i - 1)["v"] != F.get(s, i - 2)["v"])).alias("b")))
    runs = F.filter(runs, lambda r: F.size(r["s"]) > 0)
    return F.flatten(F.transform(runs, lambda r: F.transform(r["b"], lambda b, j: F.struct(
        F.get(r["s"], b - 1)["v"].alias("value"),
        F.transform(F.slice(r["s"], b, F.coalesce(F.get(r["b"], j + 1), F.size(r["s"]) + 1) - b), lambda x: x["i"]).alias("at")))))
