"""Attach the values of a one-row aggregate (a handful of numbers) as literal columns.

Used instead of joining a data frame with a one-row frame: the aggregate runs as its
own small job, its row comes back to the driver, and the values enter the plan as
constants (foldable, no join, nothing whole through the driver).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    row = one_row.first()
    cols = []
    for f in one_row.schema.fields:
        v = None if row is None else row[f.name]
        cols.append(F.lit(v).cast(f.dataType).alias(f.name))
    return df.select("*", *cols)


# Groups whose values enter a plan as constants; a table of more groups is joined.
MAX_GROUPS = 256


def with_group_values(df: DataFrame, per_group: DataFrame, keys: list[str]) -> DataFrame:
    """Attach a per-group table (one row per class, model, fold) to every row, null groups included.

    The values of up to ``MAX_GROUPS`` groups enter the plan as constants, so the rows of ``df`` are
    not shuffled on a key of a few values. A table of more groups is joined, null keys meeting
    null keys. Either way every row stays, and one without its group gets nulls.
    """
    rows = per_group.limit(MAX_GROUPS + 1).collect()
    kinds = {f.name: f.dataType for f in per_group.schema.fields}
    values = [c for c in per_group.columns if c not in keys]
    if len(rows) > MAX_GROUPS:
        other = per_group.select(*[F.col(k).alias(f"_group_{i}") for i, k in enumerate(keys)], *values)
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & df[k].eqNullSafe(other[f"_group_{i}"])
        return df.join(other, same, "left").drop(*[f"_group_{i}" for i in range(len(keys))])
    out = []
    for name in values:
        value = F.lit(None).cast(kinds[name])
        for row in rows:
            same = F.lit(True)
            for k in keys:
                same = same & F.col(k).eqNullSafe(F.lit(row[k]).cast(kinds[k]))
            value = F.when(same, F.lit(row[name]).cast(kinds[name])).otherwise(value)
        out.append(value.alias(name))
    return df.select("*", *out)
