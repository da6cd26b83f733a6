"""Window-style operators.

A plain ``row_number().over(partitionBy(g))`` sends a whole group to one
task.  When the groups are classes, one class may hold a third of all rows,
so rank-within-group runs as a distributed rank instead: range-partition on
(group, order), number rows inside each partition, and add the sizes of the
same group in earlier partitions (a small per-partition table).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions.hashing import phash
from textmill.session import cut_lineage


def group_row_number(df: DataFrame, group: list[str], order: list[Column | str], out: str = "rn",
                     num_partitions: int | None = None) -> DataFrame:
    """Exact 1-based row number within ``group`` by ``order`` (ties must be
    broken by the caller), without putting a group in one task."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ocols = [F.col(o) if isinstance(o, str) else o for o in order]
    names = [f"__o{i}" for i in range(len(ocols))]
    keyed = df.select("*", *[c.alias(nm) for c, nm in zip(ocols, names)])
    part = (keyed.repartitionByRange(n, *group, *names)
            .sortWithinPartitions(*group, *names)
            .withColumn("__pid", F.spark_partition_id())
            .withColumn("__mid", F.monotonically_increasing_id()))
    # The numbering is read twice below (block sizes and rows).  Range bounds
    # come from a sample whose input order is not fixed, so the numbered
    # frame is written once (reliable checkpoint in the shared folder, which
    # also survives executor loss) and both reads see the same rows.
    part = cut_lineage(part)
    # rows of one (partition, group) are contiguous; their positions and sizes
    blocks = part.groupBy("__pid", *group).agg(F.min("__mid").alias("__first"), F.count("*").alias("__cnt"))
    # the blocks table has at most (partitions + groups) rows
    w = (Window.partitionBy(*group) if group else Window).orderBy("__pid").rowsBetween(
        Window.unboundedPreceding, -1)
    blocks = blocks.select("__pid", *group, "__first",
                           F.coalesce(F.sum("__cnt").over(w), F.lit(0)).alias("__before"))
    # Groups may be null: every row is numbered.  Written, as rows don't move
    # for a table whose small size is known.
    blocks = cut_lineage(blocks.select(*[F.col(c).alias(f"__g_{c}") for c in ["__pid", *group]], "__first", "__before"))
    same = [part[c].eqNullSafe(blocks[f"__g_{c}"]) for c in ["__pid", *group]]
    joined = part.join(blocks, same, "inner").drop(*[f"__g_{c}" for c in ["__pid", *group]])
    return (joined.withColumn(out, F.col("__mid") - F.col("__first") + 1 + F.col("__before"))
            .drop("__pid", "__mid", "__first", "__before", *names))


def group_sizes_col(df: DataFrame, group: list[str], out: str = "group_n") -> DataFrame:
    """Attach the group size by an aggregate + join (no group in one task);
    rows of a null group count as one group."""
    sizes = df.groupBy(*group).agg(F.count("*").alias(out)).withColumnsRenamed({c: f"__g_{c}" for c in group})
    same = [df[c].eqNullSafe(sizes[f"__g_{c}"]) for c in group]
    return df.join(sizes, same, "inner").drop(*[f"__g_{c}" for c in group])


def stratified_split(df: DataFrame, stratum: str, test_size: float = 0.2, key: str = "id",
                     seed: int = 42) -> DataFrame:
    """Adds ``split`` = test for the first round(test_size x n) rows of each
    stratum in seeded hash order, else train."""
    ranked = group_row_number(df.withColumn("__h", phash(key, seed=seed)), [stratum], ["__h", key])
    sized = group_sizes_col(ranked, [stratum], "__n")
    test = F.col("rn") <= F.round(F.lit(test_size) * F.col("__n"))
    return sized.withColumn("split", F.when(test, "test").otherwise("train")).drop("__h", "__n", "rn")


def stratified_folds(df: DataFrame, label: str, k: int, key: str = "id", seed: int = 42,
                     out: str = "fold") -> DataFrame:
    """Fold = (row number in seeded order within the class - 1) mod k, so
    fold sizes differ by at most one row per class."""
    ranked = group_row_number(df.withColumn("__h", phash(key, seed=seed)), [label], ["__h", key])
    return ranked.withColumn(out, ((F.col("rn") - 1) % k).cast("int")).drop("__h", "rn")


def downsample_class(df: DataFrame, label: str, value, cap: int = 700, key: str = "id",
                     seed: int = 42) -> DataFrame:
    """Keep at most ``cap`` rows of one class (seeded order), others whole."""
    hot = df.where(F.col(label) == F.lit(value))
    rest = df.where((F.col(label) != F.lit(value)) | F.col(label).isNull())
    ranked = group_row_number(hot.withColumn("__h", phash(key, seed=seed)), [label], ["__h", key])
    kept = ranked.where(F.col("rn") <= cap).drop("__h", "rn")
    return rest.unionByName(kept)


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int,
                    out: str = "rank", salts: int = 64) -> DataFrame:
    """Exact top k rows per group in two phases: the top k of each
    (group, salt) slice first, then the top k of those k x salts
    candidates.  A group with millions of distinct values is never sorted
    in one task.  ``order`` must be a total order (end with a unique key)."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts))
    w1 = Window.partitionBy(*group, "__salt").orderBy(*order)
    pre = (df.withColumn("__salt", salt).withColumn("__r", F.row_number().over(w1))
           .where(F.col("__r") <= k).drop("__r", "__salt"))
    w2 = Window.partitionBy(*group).orderBy(*order)
    return pre.withColumn(out, F.row_number().over(w2)).where(F.col(out) <= k)


def compact_ids(df: DataFrame, order: list[str], out: str = "pid") -> DataFrame:
    """Consecutive 0-based ids in sorted order, distributed and JVM-side:
    range-partition, number rows inside each partition, add the sizes of
    earlier partitions (``order`` must be unique)."""
    ranked = group_row_number(df, [], list(order), out="__rn")
    return ranked.withColumn(out, F.col("__rn") - 1).drop("__rn")
