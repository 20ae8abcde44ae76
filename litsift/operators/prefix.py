"""Order-dependent primitives that stay distributed on skewed or unpartitioned input.

``Window.orderBy(...)`` with no ``partitionBy`` moves every row into one task, and a
window partitioned by a hot key puts a third of the data into one task.  The two
helpers here give the same exact answers through range partitioning:

* :func:`global_row_number` -- 1..n over a total order.  Range-partition on the sort
  keys, sort within partitions, number rows locally with
  ``monotonically_increasing_id`` (partition id in the high bits, local position in
  the low 33 bits), then add the row count of all earlier partitions.  The offsets
  table has one row per partition, a proven size bound, so it is broadcast.
* :func:`grouped_cumsum` -- running sums of weight columns along an ordered key per
  group.  Range-partition on (group, key) so a hot group spans many partitions;
  per-(group, partition) totals (one row per group and partition) give the offset
  of each slice, and the local running sum is a window over one slice.

Both read the range-partitioned data twice (counts, then rows).  Column pruning
makes the two reads different plans, and a range partitioner samples its input, so
the partitioned frame is checkpointed (eagerly, into the session's checkpoint
folder) first: both reads then see the same partitions, also after a lost executor.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litsift.operators.scalars import with_group_values

from litsift.session import ensure_checkpoint_dir

_LOW33 = (1 << 33) - 1


def _num_partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _materialize(ranged: DataFrame, source: DataFrame) -> DataFrame:
    """Eagerly checkpoint ``ranged`` (a range repartition of ``source``).

    ``source`` is cached for the duration: the range partitioner samples it in one job
    and the shuffle reads it in the next, so without the cache it is computed twice.
    The checkpoint is eager, so the cache can be released as soon as it is written.
    """
    ensure_checkpoint_dir(ranged.sparkSession)
    lvl = source.storageLevel
    already = lvl.useMemory or lvl.useDisk
    if not already:  # never release a cache the caller owns
        source.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return ranged.checkpoint(eager=True)
    finally:
        if not already:
            source.unpersist()


def global_row_number(df: DataFrame, order: list[Column], name: str = "row_number",
                      num_partitions: int | None = None) -> DataFrame:
    """Append ``name`` = 1..n following ``order`` (make the order total for stable output)."""
    n = _num_partitions(df, num_partitions)
    ranged = _materialize(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                          .withColumn("_mid", F.monotonically_increasing_id()), df)
    ranged = (ranged.withColumn("_pid", F.shiftright(F.col("_mid"), 33))
              .withColumn("_loc", F.col("_mid").bitwiseAND(F.lit(_LOW33))))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    out = (ranged.join(F.broadcast(offsets), "_pid")
           .withColumn(name, F.col("_off") + F.col("_loc") + F.lit(1))
           .drop("_mid", "_pid", "_loc", "_off"))
    return out


def grouped_cumsum(df: DataFrame, group_cols: list[str], order_col: str,
                   sum_cols: list[str], ascending: bool = True,
                   suffix: str = "_cum", num_partitions: int | None = None) -> DataFrame:
    """Running sums (inclusive) of ``sum_cols`` along ``order_col`` within each group.

    ``df`` should hold one row per (group, order value) -- aggregate first.  Output
    keeps all input columns and adds ``<col><suffix>`` for every summed column.
    """
    n = _num_partitions(df, num_partitions)
    okey = F.col(order_col).asc() if ascending else F.col(order_col).desc()
    keys = [F.col(g) for g in group_cols] + [okey]
    ranged = _materialize(df.repartitionByRange(n, *keys)
                          .withColumn("_pid", F.spark_partition_id()), df)
    slice_keys = group_cols + ["_pid"]
    totals = ranged.groupBy(*slice_keys).agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    w_slices = (Window.partitionBy(*group_cols).orderBy("_pid")
                .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(
        *slice_keys,
        *[F.coalesce(F.sum(f"_t_{c}").over(w_slices), F.lit(0)).alias(f"_o_{c}")
          for c in sum_cols])
    w_local = (Window.partitionBy(*slice_keys).orderBy(okey)
               .rowsBetween(Window.unboundedPreceding, 0))
    local = ranged.select("*", *[F.sum(c).over(w_local).alias(f"_l_{c}") for c in sum_cols])
    out = local.join(offsets, slice_keys)
    for c in sum_cols:
        out = out.withColumn(c + suffix, F.col(f"_o_{c}") + F.col(f"_l_{c}"))
    return out.drop("_pid", *[f"_o_{c}" for c in sum_cols], *[f"_l_{c}" for c in sum_cols])


def grouped_row_number(df: DataFrame, group_cols: list[str], order: list[Column],
                       name: str = "row_number",
                       num_partitions: int | None = None) -> DataFrame:
    """1..n within each group following ``order`` -- safe when one group is huge.

    A global row number over (group, order) minus the group's first global number;
    the per-group minimum is an ordinary (map-side combined) aggregate.
    """
    keys = [F.col(g) for g in group_cols] + list(order)
    numbered = global_row_number(df, keys, name="_grn", num_partitions=num_partitions)
    first = numbered.groupBy(*group_cols).agg(F.min("_grn").alias("_gmin"))
    return (with_group_values(numbered, first, group_cols)
            .withColumn(name, F.col("_grn") - F.col("_gmin") + F.lit(1))
            .drop("_grn", "_gmin"))
