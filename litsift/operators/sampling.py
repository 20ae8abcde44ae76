"""Folds, splits, balancing and per-class heads -- seeded, reproducible, distributed.

Randomness is an order by ``md5(concat(pmid, ':', seed))`` (DuckDB computes the same
hash), never ``rand()``, so every split is reproducible across runs, engines and
task retries.  Ranks come from the range-partitioned helpers in
:mod:`litsift.operators.prefix`; no step pulls a whole class into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litsift.operators.prefix import global_row_number, grouped_row_number
from litsift.operators.scalars import with_group_values, with_scalars


def seeded_hash(key: Column | str, seed: int) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(k.cast("string"), F.lit(":"), F.lit(str(seed))))


def assign_folds(df: DataFrame, v: int = 5, seed: int = 42, key: str = "pmid",
                 tie: list[str] | None = None, out: str = "fold") -> DataFrame:
    """Near-equal random folds 1..v (``ntile(v)`` over a seeded hash order; sizes differ by <= 1).

    Not stratified, like the reference's resampling.  ``tie`` columns make the order
    total when a key repeats.
    """
    tie = tie or []
    h = seeded_hash(key, seed)
    numbered = global_row_number(df.withColumn("_h", h),
                                 [F.col("_h")] + [F.col(t) for t in tie], name="_rn")
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    q = F.floor(F.col("_n") / v)
    r = F.col("_n") % v
    big = r * (q + 1)
    fold = F.when(F.col("_rn") <= big, F.floor((F.col("_rn") - 1) / (q + 1)) + 1) \
        .otherwise(r + F.floor((F.col("_rn") - 1 - big) / q) + 1)
    return (with_scalars(numbered, n)
            .withColumn(out, fold.cast("int")).drop("_h", "_rn", "_n"))


def _class_sizes(df: DataFrame, strata: str) -> DataFrame:
    return df.groupBy(strata).agg(F.count(F.lit(1)).alias("_n_class"))


def stratified_split(df: DataFrame, strata: str = "class", prop: float = 0.8,
                     seed: int = 1353, key: str = "pmid", out: str = "split") -> DataFrame:
    """Random split per stratum: floor(prop * n) rows of each class go to ``train``, rest ``test``."""
    numer = int(round(prop * 1000))
    ranked = grouped_row_number(df.withColumn("_h", seeded_hash(key, seed)), [strata],
                                [F.col("_h"), F.col(key)], name="_rk")
    sized = with_group_values(ranked, _class_sizes(df, strata), [strata])
    cut = F.floor(F.col("_n_class") * numer / 1000)
    return (sized.withColumn(out, F.when(F.col("_rk") <= cut, F.lit("train"))
                             .otherwise(F.lit("test")))
            .drop("_h", "_rk", "_n_class"))


def prefix_split(df: DataFrame, strata: str = "class", order_key: str = "pmid",
                 size: int | None = None, out: str = "split") -> DataFrame:
    """Positional 80/20 split of each class's ordered list, cut to its first ``size`` rows.

    Rows 1..floor(0.8 s) train, the others of the prefix test. (The reference's index
    arithmetic leaves the last row out when 0.8 s is not whole; here it is a test row.)
    ``size=None`` uses each class's whole list.
    """
    ranked = grouped_row_number(df, [strata], [F.col(order_key).try_cast("long"),
                                               F.col(order_key)], name="_rk")
    sized = with_group_values(ranked, _class_sizes(df, strata), [strata])
    s = F.col("_n_class") if size is None else F.least(F.col("_n_class"), F.lit(size))
    n_train = F.floor(s * 4 / 5)
    role = (F.when(F.col("_rk") <= n_train, F.lit("train"))
            .when(F.col("_rk") <= s, F.lit("test")))
    return (sized.withColumn(out, role).where(F.col(out).isNotNull())
            .drop("_rk", "_n_class"))


def balance_classes(df: DataFrame, strata: str = "class", seed: int = 42,
                    key: str = "pmid") -> DataFrame:
    """Down-sample every class to the smallest class size (seeded hash order)."""
    sizes = _class_sizes(df, strata)
    smallest = sizes.agg(F.min("_n_class").alias("_m"))
    ranked = grouped_row_number(df.withColumn("_h", seeded_hash(key, seed)), [strata],
                                [F.col("_h"), F.col(key)], name="_rk")
    return (with_scalars(ranked, smallest).where(F.col("_rk") <= F.col("_m"))
            .drop("_h", "_rk", "_m"))


def sample_to_ratio(df: DataFrame, pos_share: float, total: int, strata: str = "class",
                    positive=1, seed: int = 42, key: str = "pmid") -> DataFrame:
    """Sample ``total`` rows with a given positive share (class-mix sweep input)."""
    n_pos = int(round(total * pos_share))
    n_neg = total - n_pos
    ranked = grouped_row_number(df.withColumn("_h", seeded_hash(key, seed)), [strata],
                                [F.col("_h"), F.col(key)], name="_rk")
    cap = F.when(F.col(strata) == positive, F.lit(n_pos)).otherwise(F.lit(n_neg))
    return ranked.where(F.col("_rk") <= cap).drop("_h", "_rk")


def head_per_class(df: DataFrame, n: int = 100, strata: str = "class",
                   order_key: str = "pmid") -> DataFrame:
    """First ``n`` rows of each class in id order (top-k per group).

    ``row_number() <= n`` with a small ``n`` lets Spark insert a per-partition group
    limit before the shuffle, so a hot class ships at most ``n`` rows per map task.
    """
    w = Window.partitionBy(strata).orderBy(F.col(order_key).try_cast("long"), F.col(order_key))
    return (df.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= n)
            .drop("_rk"))
